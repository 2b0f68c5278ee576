import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfold.llm.bytetext import IS_SEPARATOR, buffers, distinct_sorted, runs, shingles, words

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def by_hand(text):
    return BLANK.findall(fold(text or ""))


texts = st.lists(st.one_of(st.none(), st.text(alphabet="aAbBé \t\n\x0b\x1c.🙂", max_size=30)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_and_shingles(column):
    data, off = buffers(pa.array(column, pa.string()))
    value, s, e, word_off = words(data, off)
    want = [by_hand(t) for t in column]
    assert np.diff(word_off).tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert [fold(bytes(data[a:b]).decode()) for a, b in zip(s, e)] == flat
    seen = {}
    for w, v in zip(flat, value.tolist()):
        assert seen.setdefault(w, v) == v
    assert len(set(seen.values())) == len(seen)
    for n in (2, 3):
        sh, sh_off = shingles(value, word_off, n)
        keys = [[tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)] if len(ws) >= n else ([tuple(ws)] if ws else []) for ws in want]
        assert np.diff(sh_off).tolist() == [len(k) for k in keys]
        d, d_off = distinct_sorted(sh, sh_off)
        assert np.diff(d_off).tolist() == [len(set(k)) for k in keys]
        for i in range(len(keys)):
            part = d[d_off[i] : d_off[i + 1]]
            assert (part[1:] > part[:-1]).all() if len(part) > 1 else True


def test_same_words_anywhere_have_the_same_value():
    data, off = buffers(pa.chunked_array([["one two"], [None, "zero one  two"]]))
    value, *_ = words(data, off)
    assert value[0] == value[3] and value[1] == value[4]
    sliced = pa.array(["x", "one two", None]).slice(1)
    assert words(*buffers(sliced))[0].tolist() == value[:2].tolist()
    assert words(*buffers(pa.array(["One. (TWO)"])), IS_SEPARATOR)[0].tolist() == value[:2].tolist()


def test_runs_cover_all_rows():
    off = np.array([0, 3, 3, 10, 400, 401])
    assert list(runs(off, 8)) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert list(runs(np.array([0]), 8)) == []
    assert len(words(*buffers(pa.array([], pa.string())))[0]) == 0


def test_structured_long_words_differ():
    """Patterns whose sums cancel in a polynomial modulo a power of two, and words longer than one part."""
    thue = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    turned = thue.translate(str.maketrans("ab", "ba"))
    found = [thue[:n] for n in (8, 64, 1024, 4096)] + [turned[:n] for n in (8, 64, 1024, 4096)] + [c * n for c in "xy" for n in (7, 8, 9, 511, 512, 513, 1024, 100_000, 100_001)] + ["q\0", "q", "q\0\0"]
    value = words(*buffers(pa.array([" ".join(found)])))[0]
    assert len(set(value.tolist())) == len(found)
    again = words(*buffers(pa.array(["pad " * 3 + found[3].upper()])))[0]
    assert again[-1] == value[3]
