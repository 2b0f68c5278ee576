import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_bytetext import by_hand as words_of
from wayfold.llm import jaccard
from wayfold.llm.components import components
from wayfold.llm.jaccard import jaccard_join, may_link, overlap_links

SCHEMA = "doc_id long, text string, n_shingles long, component_id string"


def sets_of(rows, n):
    out = []
    for _, t, *_ in rows:
        w = words_of(t)
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


def by_hand(rows, n, num, den):
    sets, root = sets_of(rows, n), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * inter >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            best[find(i)] = min(best.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), best.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=repr)


def run(spark, rows, n, num, den):
    got = jaccard_join(spark.createDataFrame([(r[0], r[1], 9, "c") for r in rows], SCHEMA), n, num, den)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def corpus(seed, n_docs=160):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = [r.choice(vocab) for _ in range(30)]
    rows = []
    for i in range(n_docs):
        kind = r.random()
        if rows and kind < 0.45:
            w = list(r.choice(rows)[1].split()) or ["a"]
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.3:
                w = w[: max(1, len(w) - r.randint(0, 3))]
        elif kind < 0.6:
            w = passage + [r.choice(vocab) for _ in range(r.randint(5, 40))]
        else:
            w = [r.choice(vocab) for _ in range(r.randint(1, 90))]
        rows.append((i * 3 % 997, " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "n", "num", "den"), [(1, 3, 90, 100), (2, 5, 80, 100), (3, 3, 80, 100), (4, 3, 50, 100)])
def test_same_as_all_pairs(spark, seed, n, num, den):
    rows = corpus(seed)
    assert run(spark, rows, n, num, den) == by_hand(rows, n, num, den)


def test_large_groups_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    r = random.Random(7)
    base = [f"b{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):  # copies with one changed word each: alike to the base, less so among each other
        w = list(base)
        for k in r.sample(range(100), 1 if i % 2 else 4):
            w[k] = f"x{i}{k}"
        rows.append((i, " ".join(w)))
    for num in (90, 95):
        assert run(spark, rows, 3, num, 100) == by_hand(rows, 3, num, 100)


@pytest.mark.parametrize("centers", [1, 4])
def test_large_clusters_meet_centers_first(spark, monkeypatch, centers):
    """Families whose members a centre links, and others that only chains of versions hold together."""
    for name, value in [("SMALL", 3), ("BLOCK", 4), ("DIRECT", 1), ("CENTERS", centers)]:
        monkeypatch.setattr(jaccard, name, value)
    star, seeds = jaccard._star_tiles, []
    monkeypatch.setattr(jaccard, "_star_tiles", lambda *a: seeds.append(a[3]) or star(*a))
    r = random.Random(11)
    rows = []
    for family in range(3):
        w = [f"f{family}w{i}" for i in range(80)]
        for i in range(45):
            if family == 2 or i % 9 == 8:  # a chain: each version changes the one before
                w = list(w)
                w[r.randrange(80)] = f"v{family}x{i}"
                rows.append((len(rows), " ".join(w)))
            else:
                own = list(w)
                own[r.randrange(80)] = f"y{family}x{i}"
                rows.append((len(rows), " ".join(own + [f"z{k}" for k in range(i % 4)])))
    r.shuffle(rows)
    for num in (90, 95):
        assert run(spark, rows, 3, num, 100) == by_hand(rows, 3, num, 100)
    assert seeds.count(0) == 2


def test_unlike_sets_with_one_sum_are_told_apart(spark, monkeypatch):
    """With names of three bits nearly all sets share theirs with others."""
    monkeypatch.setattr(jaccard, "CLASS_BITS", 3)
    rows = corpus(6, 120) + [(2000, "some words here"), (2001, "some words here"), (2002, None)]
    assert run(spark, rows, 3, 90, 100) == by_hand(rows, 3, 90, 100)
    monkeypatch.setattr(jaccard, "MAX_APART", 5)
    with pytest.raises(ValueError):
        run(spark, rows, 3, 90, 100)


def test_structured_words_are_no_link(spark):
    """A Thue-Morse word and its complement, whose byte sums cancel modulo powers of two."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word)]
    assert run(spark, rows, 3, 90, 100) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one two"), (3, "ONE  two"), (9, "one two three"), (9, "one two three"), (None, "one two three"), (None, "alone here now"), (1, "x " * 5000), (2, "x " * 6000), (10, "é É")]
    assert run(spark, rows, 3, 90, 100) == by_hand(rows, 3, 90, 100)
    assert run(spark, [], 3, 90, 100) == []


sets = st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=40), min_size=2, max_size=12)


@settings(max_examples=200, deadline=None)
@given(sets, st.sampled_from([(80, 100), (90, 100), (50, 100)]), st.booleans())
def test_tile_links(found, ratio, two):
    num, den = ratio
    ids = np.arange(len(found)) * 10
    side = np.arange(len(found)) % 2 if two else np.zeros(len(found), int)
    arrays = [np.array(sorted(x), np.uint64) for x in found]
    links = overlap_links(ids, arrays, side, num, den)
    root = {int(i): int(i) for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert den * len(found[a // 10] & found[b // 10]) >= num * len(found[a // 10] | found[b // 10])
        root[find(a)] = find(b)
    off = np.concatenate([[0], np.cumsum([len(x) for x in arrays])])
    maps = jaccard._aligned(jaccard._bitmaps(np.concatenate(arrays), off))
    label = may_link(ids, np.array([len(x) for x in arrays]), maps, side, num, den)
    for i in range(len(found)):
        for j in range(i):
            if (side[i] != side[j] or len(set(side)) == 1) and den * len(found[i] & found[j]) >= num * len(found[i] | found[j]):
                assert find(i * 10) == find(j * 10)
                assert label[i] == label[j] >= 0


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + r.randint(0, 50), 100 + r.randint(0, 50)) for _ in range(30)] + [(7, None), (None, None), (60, 60)]
    got = {x["id"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
