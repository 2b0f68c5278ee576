import math
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_bytetext import by_hand as words_of
from wayfold.llm.mixing import mix_sources, quality_weight, ranged, uniform, word_count

SCHEMA = "doc_id long, text string, source string, size int, target string"


def fill(sizes, weights, most):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, live, out = float(sum(sizes.values())), set(names), {}
    while live:
        total = sum(w[s] for s in live)
        over = [s for s in live if left * w[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in live}
        for s in over:
            out[s] = float(most * sizes[s])
            live.remove(s)
        left -= sum(out[s] for s in over)
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, 7, "t") for r in rows], SCHEMA)
    found = mix_sources(df)
    assert found.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    return found.collect()


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_taken(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice([None, "", "w " * r.randint(1, 80), "#%& " * 10]), r.choice([None, "a", "b", "é", "hot", "hot", "hot", "z" + str(i % 3)])) for i in range(300)]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    want = fill(sizes, (1, 2, 3), 3)
    got = run(spark, rows)
    assert sorted(x["doc_id"] for x in got) == list(range(300))
    taken = {}
    for x in got:
        size, source = len(words_of(rows[x["doc_id"]][1])), rows[x["doc_id"]][2]
        assert x["size"] == size and x["source_size"] == sizes[source]
        assert x["target"] == pytest.approx(want[source], rel=1e-9) and 0 <= x["taken"] <= 3 * size
        full = math.floor(want[source] / sizes[source] + 1e-12) if sizes[source] else 0
        assert x["taken"] >= full * size
        taken[source] = taken.get(source, 0) + x["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1
    assert sorted(map(tuple, run(spark, rows))) == sorted(map(tuple, got))


def test_edges(spark):
    assert run(spark, []) == []
    (only,) = run(spark, [(None, None, None)])
    assert (only["doc_id"], only["size"], only["target"], only["taken"]) == (None, 0, 0.0, 0)
    twice = run(spark, [(1, "a b", "s"), (1, "a b", "s"), (2, "c", "t")])
    assert sorted(x["doc_id"] for x in twice) == [1, 1, 2] and sum(x["taken"] for x in twice) in (4, 5)


def test_better_documents_come_first(spark):
    rows = [(i, ("word " if i % 2 else "##% ") * 10, "big") for i in range(2000)] + [(5000 + i, "x " * 500, f"s{i}") for i in range(8)]
    got = {x["doc_id"]: x["taken"] for x in run(spark, rows) if x["doc_id"] < 5000}
    good, bad = sum(t for i, t in got.items() if i % 2), sum(t for i, t in got.items() if i % 2 == 0)
    assert good > 1.5 * bad > 0


@pytest.mark.parametrize("bad", [0.0, 0.5, 1.0])
def test_ranges_are_balanced_whatever_the_weights(spark, bad):
    r = random.Random(3)
    rows = [(i, "{}[]<>" * 4 if r.random() < bad else "words of prose", "code", 1, "t") for i in range(20_000)] + [(50_000 + i, "a", None, 1, "t") for i in range(10)]
    text = F.col("text")
    sized = spark.createDataFrame(rows, SCHEMA).select("doc_id", "source", word_count(text).alias("size"), quality_weight(text).alias("w"))
    placed = ranged(sized.withColumn("key", -F.log(uniform(F.col("doc_id"), 17)) / F.col("w")))
    found = placed.groupBy("source", "range").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
    code = sorted((x for x in found if x["source"] == "code"), key=lambda x: x["range"])
    assert sum(x["n"] for x in code) == 20_000 and len(code) >= 9 and max(x["n"] for x in code) < 2 * 2000
    assert all(a["high"] <= b["low"] for a, b in zip(code, code[1:]))
    assert [(x["range"], x["n"]) for x in found if x["source"] is None] == [(0, 10)]
