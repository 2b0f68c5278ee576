import random

import numpy as np
import pytest

from wayfold.llm import decontaminate as dc
from wayfold.llm.decontaminate import leaked_documents
from wayfold.llm.substring_dedup import longest, minima, ordered, passages, repeated_passages, signature_windows, sliding_minimum, tree_intervals


def prose(r, n, vocab=4000):
    return [f"t{r.randrange(vocab)}" for _ in range(n)]


def leaks(spark, docs, items):
    found = leaked_documents(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"))
    return sorted({(x["doc_id"], x["item_id"]) for x in found.collect()}, key=repr)


@pytest.fixture(scope="module")
def bench():
    r = random.Random(11)
    items = [(i, " ".join(prose(r, r.randint(15, 55)))) for i in range(30)]
    docs, want = [], []
    for d in range(400):
        w = prose(r, r.randint(20, 400))
        if d % 8 == 0:
            i = r.randrange(30)
            item = items[i][1].split()
            if d % 16 == 0:  # a paraphrase: a fifth of the words are others
                item = [f"y{k}" if r.random() < 0.2 else x for k, x in enumerate(item)]
            at = r.randrange(len(w))
            w[at:at] = item
            want.append((d, i))
        docs.append((d, " ".join(w).upper() if d % 24 == 0 else ", ".join(w) + ".", "x"))
    return docs, items, want


def test_finds_copies_and_paraphrases(spark, bench):
    docs, items, want = bench
    got = leaks(spark, docs, items)
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)


def test_blocks_of_items_give_the_same(spark, bench, monkeypatch):
    docs, items, want = bench
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 8)
    got = leaks(spark, docs[:120], items)
    assert set(got) <= set(want) and len(got) >= 0.9 * len([w for w in want if w[0] < 120])


def test_leak_edges(spark, bench):
    docs, items, _ = bench
    text = items[3][1]
    own = [(1, text, "x"), (1, text, "x"), (2, None, "x"), (3, "", "x"), (None, text, "x"), (4, "pad " * 20000 + text, "x")] + docs[:50]
    got = leaks(spark, own, [*items, (90, None), (91, " "), (92, text)])
    assert {(1, 3), (1, 92), (None, 3), (4, 3), (4, 92)} <= set(got)
    assert leaks(spark, [], items) == [] and leaks(spark, docs, []) == []


def test_answer_decides_paraphrases():
    vocab = dc.Vocabulary(dc._words_of(["a b c d e f g h. the answer is z"]))
    weight = np.ones(len(vocab.values))
    item = dc.Item(1, "a b c d e f g h. the answer is z", vocab, weight)
    assert item.answer == set(vocab.find(dc._words_of(["the answer is z"]))[1].tolist())
    asked = dc.Item(1, "a b c? z", vocab, weight)
    assert asked.answer == set(vocab.find(dc._words_of(["z"]))[1].tolist())
    seq = vocab.find(dc._words_of(["b q a c e d"]))[1].tolist()
    assert item.common(seq) == 3


def test_item_in_a_third_of_the_documents(spark):
    r = random.Random(23)
    items = [(i, " ".join(prose(r, 30))) for i in range(5)]
    docs = []
    for d in range(300):
        w = prose(r, 60)
        if d % 3 == 0:
            w[20:20] = items[2][1].split()
        docs.append((d, " ".join(w), "x"))
    assert set(leaks(spark, docs, items)) == {(d, 2) for d in range(0, 300, 3)}


def test_item_of_common_words_only(spark):
    """Every word of the item stands in a tenth or more of all passages; one document holds it verbatim."""
    r = random.Random(29)
    common = [f"c{i}" for i in range(60)]
    text = lambda n: " ".join(r.choice(common) if r.random() < 0.7 else f"t{r.randrange(4000)}" for _ in range(n))
    items = [(1, " ".join(r.choice(common) for _ in range(34))), (2, " ".join(prose(r, 30)))]
    docs = [(d, text(80) + (" " + items[0][1] + " " + text(40) if d == 500 else ""), "x") for d in range(800)]
    assert leaks(spark, docs, items) == [(500, 1)]


def test_item_between_words_said_again_and_again(spark):
    r = random.Random(37)
    items = [(i, " ".join(prose(r, 21))) for i in range(40)]
    noise = items[5][1].split()[3]
    docs = [(d, " ".join(prose(r, 60)), "x") for d in range(200)]
    docs += [(300, f"{noise} " * 37 + items[7][1] + f" {noise}" * 40, "x"), (301, f"{noise} and " * 37 + items[7][1] + f" or {noise}" * 40, "x")]
    assert leaks(spark, docs, items) == [(300, 7), (301, 7)]


def test_sums_have_a_bounded_fan_in(spark, monkeypatch):
    from wayfold.llm import scratch

    monkeypatch.setattr(scratch, "FAN_IN", 3)

    def run(batches):
        n = sum(b.num_rows for b in batches)
        yield scratch.packed_row(0, np.array([n, 1]))
        yield scratch.packed_row(5, np.array([2 * n]))

    got = scratch.sum_arrays(spark.range(0, 100, 1, 29).mapInArrow(run, "part int, task int, body binary"), "int64")
    assert {k: v.tolist() for k, v in got.items()} == {0: [100, 29], 5: [200]}
    assert scratch.sum_arrays(spark.createDataFrame([], "part int, task int, body binary"), "int64") == {}


def test_segment_sums():
    r = np.random.default_rng(1)
    table, index = r.normal(size=(20, 5)).astype(np.float32), r.integers(0, 20, 500)
    first = np.array([0, 1, 2, 300, 320])
    want = np.add.reduceat(table[index].astype(float), first, axis=0)
    assert np.allclose(dc.segment_sums(table, index, first), want, atol=1e-3)


def nodes_by_hand(h, t):
    """Every passage of ``t`` or more, its minimum, and how far that minimum reaches."""
    out = set()
    for i in range(len(h)):
        for j in range(i + t - 1, len(h)):
            c = min(range(i, j + 1), key=lambda x: (h[x], x))
            lo, hi = c, c
            while lo > 0 and h[lo - 1] > h[c]:
                lo -= 1
            while hi < len(h) - 1 and h[hi + 1] >= h[c]:
                hi += 1
            out.add((lo, c, hi))
    return out


def test_compact_windows_are_the_wide_tree_nodes():
    r = np.random.default_rng(3)
    for n, t in ((60, 7), (5, 7), (7, 7), (40, 1), (80, 9)):
        value = r.integers(0, 1 << 63, n).astype(np.uint64)
        if n == 80:
            value[10:30] = value[0]  # a repeated word: equal hashes go to the leftmost
        h = [(ordered(value, f) >> np.uint64(20)).tolist() for f in (2, 3)]
        off = np.array([0, n // 2, n])
        start, of = passages(off, t)
        _, at, c, least = minima(ordered(value, 2), start, of, t)
        row = of[at]
        a, b = tree_intervals(off, row, c, least)
        got = {(int(i), int(x - off[i]), int(y - off[i]), int(z - off[i])) for i, x, y, z in zip(row, a, c, b)}
        assert got == {(i, *w) for i in (0, 1) for w in nodes_by_hand(h[0][off[i] : off[i + 1]], t)}
        # signatures: the two nodes of every passage of t shingles
        want = set()
        for i in (0, 1):
            one, two = ({(x, y, z) for x, y, z in nodes_by_hand(p[off[i] : off[i + 1]], t)} for p in h)
            for s in range(off[i + 1] - off[i] - t + 1):
                held = [next(w for w in nodes if w[0] <= s and s + t - 1 <= w[2] and s <= w[1] < s + t) for nodes in (one, two)]
                want.add((i, held[0][1], held[1][1], max(held[0][0], held[1][0]), min(held[0][2], held[1][2])))
        row, key, c1, c2, lo, hi = signature_windows(value, off, start, of, t, 1)
        assert {tuple(map(int, x)) for x in zip(row, c1, c2, lo, hi)} == want
    x = r.integers(0, 50, 33).astype(np.uint64)
    assert sliding_minimum(x, 5).tolist() == [int(x[i : i + 5].min()) for i in range(29)]
    assert longest(np.array([0, 1, 1, 0, 1, 1, 1, 0], bool), 1) == (1, 6) and longest(np.array([0, 1, 1, 0, 1, 0], bool), 9) == (1, 2) and longest(np.zeros(3, bool), 1) == (0, -1)


def test_repeated_passages(spark):
    r = random.Random(5)
    passage, near = prose(r, 60, 10**6), prose(r, 120, 10**6)
    docs, want = [], set()
    for d in range(120):
        w = prose(r, r.randint(10, 300), 10**6)
        if d % 10 == 0:
            at = r.randrange(len(w))
            w[at:at] = passage
            want.add(d)
        if d % 10 == 5:
            copy = [f"n{d}" if k in (30 + d % 7, 80) else x for k, x in enumerate(near)]
            w[0:0] = copy
            want.add(d)
        docs.append((d, " ".join(w), "x"))
    docs += [(200, docs[3][1], "x"), (201, docs[3][1], "x"), (202, None, "x"), (203, "", "x"), (204, "short text", "x"), (None, docs[3][1], "x"), (205, "word " * 3000, "x"), (206, " ".join(passage[:49]), "x")]
    want |= {3, 200, 201}
    frame = spark.createDataFrame(docs, "doc_id long, text string, kept_doc_id string")
    rows = repeated_passages(frame).collect()
    assert {x["doc_id"] for x in rows} | {x["kept_doc_id"] for x in rows} == want
    texts = {d: t.split() for d, t, _ in docs if d is not None and t}
    for x in rows:
        a, b = (texts[x[p + "doc_id"]][x[p + "first_word"] : x[p + "last_word"] + 1] for p in ("", "kept_"))
        assert x["kept_doc_id"] < x["doc_id"] and len(a) >= 50 and x["similarity"] >= 0.8
        five = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        assert len(five(a) & five(b)) / len(five(a) | five(b)) == pytest.approx(x["similarity"])
    assert repeated_passages(frame.limit(0)).count() == 0


@pytest.mark.parametrize("small", [64, 1])
def test_later_partners_of_a_group(spark, monkeypatch, small):
    """Every shingle of a passage is in an earlier document, in halves; only the last three hold the passage."""
    from wayfold.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "SMALL", small, raising=False)
    r = random.Random(17)
    passage = prose(r, 60, 10**6)
    docs = [(d, " ".join(prose(r, 30, 10**6) + (passage[:34] if d % 2 else passage[26:]) + prose(r, 30, 10**6))) for d in range(16)]
    docs += [(d, " ".join(prose(r, 60, 10**6) + passage + prose(r, 60, 10**6))) for d in (20, 21, 22)]
    rows = repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    assert {x["doc_id"] for x in rows} == {21, 22} and {x["kept_doc_id"] for x in rows if x["doc_id"] == 21} == {20}


@pytest.mark.parametrize(("size", "more"), [(50, 2), (60, 4), (70, 4), (70, 7)])
def test_words_put_in_or_left_out(size, more):
    from wayfold.llm.substring_dedup import shared_passages

    r = np.random.default_rng(size + more)
    word = r.integers(1, 1 << 40, size).tolist()
    longer = word[: size // 2] + r.integers(1, 1 << 40, more).tolist() + word[size // 2 :]
    number: dict[tuple, int] = {}
    five = lambda w: np.array([number.setdefault(tuple(w[i : i + 5]), len(number)) for i in range(len(w) - 4)], np.uint64)
    one, two = five(word), five(longer)
    similar = len(set(one) & set(two)) / len(set(one) | set(two))
    assert similar >= 0.8
    for own, kept in ((one, two), (two, one)):
        assert shared_passages(own, 0, len(own) - 1, kept, 46, 80, 100) == [(0, len(own) - 1, 0, len(kept) - 1, pytest.approx(similar))]


def exact_runs(docs, t=46):
    """Documents that hold ``t`` shingles in a row which a smaller doc_id holds too, and their passages."""
    first, later = {}, set()
    for d, text in sorted(docs):
        w = text.split()
        for i in range(len(w) - t - 3):
            run = tuple(w[i : i + t + 4])
            if first.setdefault(run, d) != d:
                later.add(d)
    return later


def pieced(r, d):
    """Documents put together from common lines and passages, some with changed words."""
    lines = [[f"l{k}w{i}" for i in range(12)] for k in range(6)]
    passages = [[f"p{k}w{i}" for i in range(70)] for k in range(8)]
    out = []
    for _ in range(r.randint(1, 5)):
        kind = r.random()
        if kind < 0.4:
            out += r.choice(lines)
        elif kind < 0.6:
            own = list(r.choice(passages))
            if r.random() < 0.3:
                own[r.randrange(70)] = f"c{d}"
            out += own
        else:
            out += [f"d{d}x{r.randrange(10**6)}" for _ in range(r.randint(5, 80))]
    return out


def test_no_exact_run_is_missed_and_layout_does_not_matter(spark):
    r = random.Random(31)
    docs = [(d, " ".join(pieced(r, d))) for d in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    one = sorted(map(tuple, repeated_passages(frame.coalesce(1)).collect()))
    other = sorted(map(tuple, repeated_passages(frame.orderBy("text").repartition(7)).collect()))
    assert one == other
    assert exact_runs(docs) <= {x[0] for x in one}


def test_keeper_does_not_depend_on_files(spark):
    passage = " ".join(prose(random.Random(1), 60, 10**6))
    frame = spark.createDataFrame([(10, passage), (11, passage)], "doc_id long, text string").coalesce(1).union(spark.createDataFrame([(1, passage)], "doc_id long, text string").coalesce(1))
    assert sorted((x["doc_id"], x["kept_doc_id"]) for x in repeated_passages(frame).collect()) == [(10, 1), (11, 1)]


def test_near_passages_are_found(spark):
    """Passages of 50 to 90 words in new surroundings; one or two words put in, left out or changed, at a similarity of 0.8 or more."""
    r = random.Random(41)
    five = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    docs, want = [], set()
    for k in range(150):
        passage = prose(r, r.randint(50, 90), 10**6)
        near = list(passage)
        for _ in range(r.randint(1, 2)):
            at = r.randrange(len(near))
            near[at : at + r.randint(0, 1)] = [f"n{k}"] if r.random() < 0.7 else []
        a, b = five(passage), five(near)
        for d, w in ((2 * k, passage), (2 * k + 1, near)):
            docs.append((d, " ".join(prose(r, 80, 10**6) + w + prose(r, 80, 10**6))))
        if len(a & b) / len(a | b) >= 0.8 and len(near) >= 50:
            want.add(2 * k + 1)
    got = {x["doc_id"] for x in repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(want) > 80 and len(want & got) >= 0.95 * len(want)


def halves_then_copies(r, edits):
    """Sixteen documents hold a passage in halves only; the last ones hold all of it, each with its own changed words."""
    passage = prose(r, 60, 10**6)
    texts = [prose(r, 30, 10**6) + (passage[:34] if d % 2 else passage[26:]) + prose(r, 30, 10**6) for d in range(16)]
    for k in edits:
        own = [f"n{len(texts)}" if i == k else w for i, w in enumerate(passage)]
        texts.append(prose(r, 60, 10**6) + own + prose(r, 60, 10**6))
    return texts


def test_near_copies_whose_shingles_all_stand_in_earlier_documents(spark):
    r, docs, want = random.Random(43), [], set()
    for _ in range(20):
        for k, w in enumerate(halves_then_copies(r, [None, 30, 25])):
            docs.append((len(docs), " ".join(w)))
            if k >= 17:  # one changed word: 0.84 with the first whole passage
                want.add(docs[-1][0])
    rows = repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x["doc_id"] for x in rows} <= want and len({x["doc_id"] for x in rows}) >= 0.95 * len(want)


def test_keeper_that_holds_the_passage_at_a_later_place(spark):
    """The keeper holds the passage's parts before it holds the passage; nobody else does."""
    r, docs = random.Random(47), []
    for k in range(60):
        passage = prose(r, 50, 10**6)
        w = prose(r, 20, 10**6)
        for a, b in ((0, 40), (10, 50), (5, 45)):
            w += passage[a:b] + prose(r, 30, 10**6)
        docs += [(2 * k, " ".join(w + passage + prose(r, 20, 10**6))), (2 * k + 1, " ".join(prose(r, 70, 10**6) + passage + prose(r, 70, 10**6)))]
    rows = repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    whole = {(x["doc_id"], x["kept_doc_id"]) for x in rows if x["first_word"] <= 70 and x["last_word"] >= 119}
    assert whole == {(2 * k + 1, 2 * k) for k in range(60)}


def test_least_shingles_by_hand():
    from wayfold.llm.substring_dedup import prefixes

    r = np.random.default_rng(9)
    number = r.integers(1, 1 << 62, 30).astype(np.uint64)
    own, t, size = number[r.integers(0, 30, 70)], 9, 3
    rare = dict(zip(number.tolist(), r.integers(0, 3, 30).tolist()))
    level = np.array([rare[x] for x in own.tolist()])
    start = np.array([0, 1, 2, 3, 10, 11, 30, 31, 32, 33, 34, 61])
    is_open = start % 2 == 0
    # the order is the module's own; a passage's least are its first different values in it
    h = {int(v): k for k, v in enumerate(sorted(set(own.tolist()), key=lambda v: (rare[v], int(ordered(np.array([v], np.uint64), 0)[0]) >> 20)))}
    want: dict[int, list] = {}
    for s, o in zip(start.tolist(), is_open.tolist()):
        for v in sorted(set(own[s : s + t].tolist()), key=h.get)[:size]:
            want.setdefault(int(v), []).append((s, o))
    got: dict[int, list] = {}
    for place, low, high, first, last in zip(*(x.tolist() for x in prefixes(own, level, start, is_open, t, size))):
        got.setdefault(int(own[place]), []).append((low, high - t + 1, first, last))
    assert got.keys() == want.keys()
    for v, rows in got.items():
        assert min(x[0] for x in rows) == min(s for s, _ in want[v]) and max(x[1] for x in rows) == max(s for s, _ in want[v])
        assert all(any(x[0] <= s <= x[1] for x in rows) for s, _ in want[v])
        assert all(any(x[2] <= s <= x[3] for x in rows) for s, o in want[v] if o)
        assert any(x[3] >= 0 for x in rows) == any(o for _, o in want[v])


def test_group_larger_than_every_round(spark, monkeypatch):
    """Many documents share each half of a passage, so their group is met part by part up to its last document."""
    from wayfold.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "SMALL", 1)
    r = random.Random(53)
    passage = prose(r, 60, 10**6)
    texts = [prose(r, 30, 10**6) + (passage[:34] if d % 2 else passage[26:]) + prose(r, 30, 10**6) for d in range(90)]
    texts[70:70] = [prose(r, 60, 10**6) + passage + prose(r, 60, 10**6)]
    texts.append(prose(r, 60, 10**6) + [f"n{i}" if i == 30 else w for i, w in enumerate(passage)] + prose(r, 60, 10**6))
    rows = repeated_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["kept_doc_id"]) for x in rows} == {(len(texts) - 1, 70)}


def test_windows_that_differ_in_own_words_only_meet_as_one(spark, monkeypatch):
    """Each document has a common passage behind words of its own said again and again: nobody settles the passages across, and they do not meet in pairs."""
    from wayfold.llm import substring_dedup

    rows, pieces = [], substring_dedup._pieces

    def counted(lined):
        made = pieces(lined)
        rows.append(made.count())
        return made

    monkeypatch.setattr(substring_dedup, "_pieces", counted)
    r = random.Random(59)
    passage, n = prose(r, 70, 10**6), 150
    docs = [(d, " ".join([f"j{d}"] * 30 + passage + prose(r, 40, 10**6))) for d in range(n)]
    got = repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x["doc_id"] for x in got} == set(range(1, n))
    assert sum(rows) <= 12 * n


def test_contents_by_hand():
    from wayfold.llm.substring_dedup import contents

    r = np.random.default_rng(61)
    common = r.integers(1, 1 << 62, 6).astype(np.uint64)
    own = lambda *places: np.array([common[p] if p < 6 else p for p in places], np.uint64)  # noqa: E731  10 and more: nobody else's
    text = [own(0, 1, 10, 10, 2), own(0, 1, 20, 20, 2), own(0, 1, 20, 21, 2), own(0, 1, 10, 2, 10), own(0, 1, 1, 1, 2)]
    value = [int(contents(x, (x > 100).astype(np.int64), np.array([0]), np.array([4]))[0]) for x in text]
    assert value[0] == value[1] and len(set(value)) == 4
    x = np.concatenate(text)
    some = contents(x, (x > 100).astype(np.int64), np.array([0, 5, 20, 20]), np.array([4, 9, 24, 23]))
    assert some[0] == some[1] == value[0] and int(some[2]) == value[4] and some[3] != some[2]


def test_windows_that_a_keeper_has_word_for_word_are_not_listed(spark, monkeypatch):
    """Copies of a passage are met in its first document; passages across its end are open and list the group."""
    from wayfold.llm import substring_dedup

    rows, write = {}, substring_dedup.materialize

    def counted(df, name, *args, **kwargs):
        made = write(df, name, *args, **kwargs)
        rows[name] = rows.get(name, 0) + made.count()
        return made

    monkeypatch.setattr(substring_dedup, "materialize", counted)
    r = random.Random(67)
    passage, copies, tails = prose(r, 70, 10**6), 60, 8
    texts = [passage] * copies + [passage + prose(r, 40, 10**6) for _ in range(tails)]
    got = repeated_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["kept_doc_id"]) for x in got} == {(d, 0) for d in range(1, copies + tails)}
    assert rows["listed"] <= 1 + tails


def test_near_copy_of_a_passage_that_later_documents_have_word_for_word(spark):
    """The near copy's first partners hold halves only; of the whole passages only the first one is listed."""
    r, docs, want = random.Random(71), [], set()
    for _ in range(8):
        texts = halves_then_copies(r, [None, None, None, 30])
        for k, w in enumerate(texts):
            docs.append((len(docs), " ".join(w)))
            if k >= 17:
                want.add(docs[-1][0])
    rows = repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x["doc_id"] for x in rows} == want


def test_stands_in():
    from wayfold.llm.substring_dedup import stands_in

    whole = np.array([3, 1, 2, 3, 1, 4], np.uint64)
    assert stands_in(whole[3:], whole) and stands_in(whole[:2], whole) and stands_in(whole, whole)
    assert not stands_in(np.array([1, 3], np.uint64), whole) and not stands_in(np.append(whole, whole[:1]), whole)
