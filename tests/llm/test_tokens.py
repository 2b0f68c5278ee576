import pytest
import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wayfold.llm import token_counts as tc
from wayfold.llm import token_output as to
from wayfold.llm.token_counts import token_counts
from wayfold.llm.token_output import Encoder, ShardReader, ShardWriter, read_token_files, write_token_files

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "  x\t\ty  ", "It's 12345 don't. WHAT'S. a.b, x,.! Ünï.côdé,  nbsp em ǅ İstanbul. ΣΑΣ. é. ́x", "<|endoftext|>a <|startoftext|>.", "a\x1cb\x0bc\x85d", "the... THE,;. ſ. ﬁ. x'.", "日本 語。テ\n🙂🙂.", "aaaa " * 3000, "ababab" * 50, "!" * 3000, "\n\n  \n"]
text = st.text(alphabet=st.one_of(st.sampled_from("ab eE.,'s\n<|>1éÉß*%İΣςÅ\u0958\u0301\u212bŉſ"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(text, max_size=6))
def test_same_counts_as_the_library(found):
    lib = Tokenizer.from_file(BYTE)
    assert tc.Counter(BYTE).count(found) == [len(lib.encode(t, add_special_tokens=False).ids) for t in found]


@settings(max_examples=150, deadline=None)
@given(st.lists(text, max_size=6))
def test_same_ids_as_the_library(found):
    lib, e = Tokenizer.from_file(WORD), Encoder(WORD)
    assert e.by_piece
    assert [np.frombuffer(x, e.kind).tolist() for x in e.pack(found)] == [lib.encode(t, add_special_tokens=False).ids for t in found]


def test_long_texts_go_in_parts():
    long = "some words, and <|endoftext|> more  of\n them's " * 60_000
    assert "".join(tc.segments(long)) == long and max(map(len, tc.segments(long))) < 1 << 20 and tc.segments("x" * 10**6) == ["x" * 10**6]
    for path in (BYTE, WORD):
        ids = Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids
        if path == BYTE:
            assert tc.Counter(path).count(["a b", long, None]) == [2, len(ids), 0]
        else:
            e = Encoder(path)
            assert np.frombuffer(e.pack(["x", long])[1], e.kind).tolist() == ids


def test_odd_texts_and_small_chunks_give_the_same(monkeypatch):
    lib, e = Tokenizer.from_file(WORD), Encoder(WORD)
    more = ["<|ENDOFTEXT|>", "A<|endoftext|>B,C", "x<|startoftext|><|endoftext|>y", "don't,DON'T.A'b'", "A\u0301.E\u0301x", "a\x00b\x7fC", "1a2B3,,4;c", "", " ", "a"]
    found = [t or "" for t in ODD] + more + [" ".join(t or "" for t in ODD + more)]
    want = [lib.encode(t, add_special_tokens=False).ids for t in found]
    for chunk in (1 << 22, 64, 1):
        monkeypatch.setattr(to, "CHUNK", chunk)
        assert [np.frombuffer(x, e.kind).tolist() for x in e.pack(found)] == want
    monkeypatch.setattr(to, "REMEMBERED", 2)
    for _ in range(3):
        assert [np.frombuffer(x, e.kind).tolist() for x in e.pack(found)] == want
    assert e.pack([None, "", "a"])[:2] == [b"", b""] and e.pack([]) == []


def test_vocabularies_with_other_rules_are_not_cut(tmp_path):
    spec = json.load(open(WORD))
    for name, change in [("n", {"normalizer": {"type": "NFC"}}), ("p", {"pre_tokenizer": {"type": "Whitespace"}}), ("a", {"added_tokens": [{**spec["added_tokens"][0], "content": "two words"}]})]:
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps({**spec, **change}))
        assert not to._cuts(str(path))


def test_other_vocabularies_go_text_by_text():
    e, lib = Encoder(BYTE), Tokenizer.from_file(BYTE)
    assert not e.by_piece
    assert np.frombuffer(e.pack(["a b  c"])[0], e.kind).tolist() == lib.encode("a b  c").ids


def test_small_memory_gives_the_same(monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 3)
    lib, c = Tokenizer.from_file(BYTE), tc.Counter(BYTE)
    for _ in range(3):
        assert c.count([t or "" for t in ODD]) == [len(lib.encode(t or "", add_special_tokens=False).ids) for t in ODD]


def test_counts_of_a_table(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(0, "again", "x"), (None, "b", "x")]
    lib = Tokenizer.from_file(BYTE)
    got = sorted(map(tuple, token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), BYTE, limit=1000).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1000))
    assert got == sorted(want, key=repr)
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), BYTE).count() == 0


def test_files_round_trip(spark):
    rows = [(100 - i, t, "x") for i, t in enumerate(ODD)] + [(50, "same id b", "x"), (50, "same id a", "x"), (None, "no id", "x")]
    lib = Tokenizer.from_file(WORD)
    index = write_token_files(spark.createDataFrame(rows, "doc_id long, text string, start string"), WORD, seq_len=16, batch_rows=2).cache()
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read_token_files(index).collect())
    want, start = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    uri = index.select("path").first()[0]
    reader = ShardReader(uri)
    assert reader.file.schema.field("input_ids").type == pa.list_(pa.uint16(), 16) and reader.file.schema.field("mask").type == pa.list_(pa.bool_(), 16)
    assert write_token_files(spark.createDataFrame([], "doc_id long, text string"), WORD).count() == 0


def test_shard_access(tmp_path):
    uri = str(tmp_path / "s.arrow")
    w = ShardWriter(uri, np.dtype("<u4"), 4, 3)
    stream = np.arange(29, dtype="<u4")
    for a in range(0, 29, 7):
        w.append(stream[a : a + 7].tobytes())
    w.close()
    r = ShardReader(uri)
    assert [r.read(a, n).tolist() for a, n in ((0, 29), (11, 2), (28, 1), (5, 0))] == [list(range(29)), [11, 12], [28], []]
    ids, mask = r.sequence(7)
    assert ids.tolist() == [28, 0, 0, 0] and mask.tolist() == [True, False, False, False]
    assert r.sequence(3)[0].base is not None  # a view of the file
    try:
        r.read(28, 2)
    except ValueError:
        return
    raise AssertionError("padding was read as ids")


@pytest.mark.parametrize(("part", "change"), [("pre_tokenizer", {"use_regex": False}), ("pre_tokenizer", {"add_prefix_space": True}), ("pre_tokenizer", {"type": "Whitespace"}), ("model", {"end_of_word_suffix": "</w>"}), ("model", {"ignore_merges": True})])
def test_other_vocabularies_are_refused(tmp_path, part, change):
    from wayfold.llm.token_counts import Merges

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec[part] |= change
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="counted here"):
        Merges(str(tmp_path / "other.json"))
