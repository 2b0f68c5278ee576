import math
import random

from pyspark.sql import functions as F

from wayfold.llm.topk import topk_search

SCHEMA = "vec_id long, embedding array<float>, extra string, score long"


def by_hand(rows, k, scale=256):
    q = {}
    vecs = [(i, [math.floor(scale * float(x)) for x in v]) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for i, a in vecs:
        if i % 5 == 0:
            scores = sorted(((-sum(x * y for x, y in zip(a, b)), j) for j, b in vecs if j != i and len(a) == len(b)))
            q[i] = [(j, -s) for s, j in scores[:k]]
    return q


def run(spark, rows, k=5, **kw):
    v = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in topk_search(v, v.filter(F.col("vec_id") % 5 == 0), k=k, **kw).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for x in got.values():
        x.sort()
        assert [r for r, *_ in x] == list(range(1, len(x) + 1))
    return {q: [(v, s) for _, v, s in x] for q, x in got.items()}


def test_exact_with_ties_and_bad_vectors(spark):
    r = random.Random(3)
    f32 = lambda x: float(__import__("numpy").float32(x))
    rows = [(i, [f32(r.uniform(-1, 1)) for _ in range(7)], "x", 1) for i in range(300)]
    rows += [(i, rows[i % 4][1], None, None) for i in range(300, 330)]  # ties
    rows += [(331, None, "n", 1), (335, [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0], "n", 1), (340, [float("nan")] * 7, "n", 1), (345, [float("inf")] * 7, "n", 1), (None, [1.0] * 7, "n", 1), (350, [1.0, 2.0], "short", 1), (355, [], "e", 1)]
    for lists in (1, 3, 4):
        got = run(spark, rows, lists=lists)
        want = {q: x for q, x in by_hand(rows, 5).items() if x}
        assert got == want


def test_fewer_candidates_than_k(spark):
    rows = [(0, [1.0, 0.0], "a", 0), (3, [0.5, 0.5], "a", 0), (4, [-1.0, 0.0], "a", 0)]
    assert run(spark, rows) == {0: [(3, 128 * 256), (4, -256 * 256)]}
    assert run(spark, rows[:1]) == {} and run(spark, []) == {}


def test_scores_beyond_doubles(spark):
    rows = [(0, [3.0e6, 1.0], "a", 0), (1, [3.0e6, 1.0], "a", 0), (2, [3.0e6, 2.0], "a", 0)]
    got = run(spark, rows)
    assert got == by_hand(rows, 5)
    huge = [(0, [1.0e30], "a", 0), (1, [1.0e30], "a", 0), (2, [-1.0e30], "a", 0)]
    assert run(spark, huge) == {0: [(1, (1 << 63) - 1), (2, -(1 << 63))]}


def test_repeated_ids(spark):
    """Of queries with one id the least vector asks; candidates with one id are ranked each."""
    rows = [(0, [0.5, 0.0], "a", 0), (0, [0.25, 1.0], "b", 0), (1, [1.0, 0.0], "a", 0), (1, [0.0, 1.0], "a", 0), (2, [0.5, 0.5], "a", 0)]
    assert run(spark, rows) == {0: [(1, 256 * 256), (2, 64 * 128 + 256 * 128), (1, 64 * 256)]}


def test_short_vectors_leave_early(spark):
    """Blocks that cannot reach the cutoff; the best ones lie in a few blocks only."""
    r = random.Random(9)
    rows = [(i, [r.uniform(-0.01, 0.01) * (100 if 500 <= i < 520 else 1) for _ in range(8)], "x", 1) for i in range(1500)]
    v = spark.createDataFrame(rows, SCHEMA).repartition(6, "vec_id")
    got = {}
    for x in topk_search(v, v.filter("vec_id % 5 = 0"), k=3).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    f32 = lambda x: float(__import__("numpy").float32(x))
    want = by_hand([(i, [f32(x) for x in vec]) for i, vec, *_ in rows], 3)
    assert {q: [(b, c) for _, b, c in sorted(x)] for q, x in got.items()} == want
