import random
import zlib

import numpy as np
import pyarrow as pa

from wayfold.llm import quality, toxicity
from wayfold.llm.bytetext import buffers
from wayfold.llm.queries import QUERIES

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for name, label, mod, out, least in (("op6_quality", "quality", 5, 0, 0.97), ("op9_toxicity", "toxic", 3, 1, 0.96)):
        rows = QUERIES[name](spark, DATA).collect()
        assert len(rows) == 10_000
        held = [r for r in rows if r["doc_id"] in labels and r["held_out"]]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == out) and 0 <= r["score"] <= 1 for r in rows)
        assert sum(r["predicted"] == labels[r["doc_id"]][label] for r in held) >= least * len(held)


def sample(spark, rows):
    return spark.createDataFrame(rows, "text string, y int")


def test_toxicity_learns_words_in_long_texts(spark):
    r = random.Random(1)
    plain = [f"word{i}" for i in range(200)]
    doc = lambda n, bad: " ".join([r.choice(plain) for _ in range(n)] + bad)
    rows = [(doc(r.randint(5, 300), ["zxqv"] if i % 4 == 0 else []), int(i % 4 == 0)) for i in range(300)]
    model = toxicity.fit(sample(spark, rows))
    docs = [(1, doc(5000, ["ZXQV"]), 0), (2, doc(5000, []), 0), (3, None, 0), (4, "", 0), (None, "zxqv", 0)]
    got = {x["doc_id"]: x for x in toxicity.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string, score int"), model).collect()}
    assert got[1]["predicted"] == 1 and got[2]["predicted"] == 0 and got[None]["predicted"] == 1
    assert got[3]["score"] == got[4]["score"] < 0.7
    assert toxicity.score_toxicity(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_one_class_or_no_labels(spark):
    for rows in ([], [("a", 0), ("b", 0)], [("a", 1)]):
        model = toxicity.fit(sample(spark, rows))
        assert np.isfinite(toxicity.score_texts(model, ["x", ""])).all()
    assert 0 <= quality.fit(sample(spark, [])).score(*quality.passage_features(*buffers(pa.array(["x", ""])))).max() <= 1


def test_ngrams_do_not_cross_texts():
    row, bucket = toxicity.ngram_places(["abc", "abcd", "", "ab"])
    by = {i: set(bucket[row == i].tolist()) for i in range(4)}
    assert len(by[0]) == 1 and by[0] < by[1] and not by[2] and not by[3]
    assert toxicity.ngram_places([])[0].size == 0


def test_long_texts_go_in_stretches(monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice("abc é") for _ in range(n)) for n in (10, 700, 90, 0, 250)]
    whole = [set(toxicity.ngram_places([t])[1].tolist()) for t in texts]
    monkeypatch.setattr(toxicity, "CHUNK", 100)
    got = {}
    for a, _, row, bucket in toxicity._spans(texts):
        for i, b in zip(row.tolist(), bucket.tolist()):
            got.setdefault(a + i, set()).add(b)
    assert [got.get(i, set()) for i in range(5)] == whole


def test_quality_learns_words(spark):
    """Good and bad passages have the same kinds of characters, lengths and repeats: only the words tell."""
    r = random.Random(8)
    good, bad = [f"ab{chr(97 + i)}de" for i in range(20)], [f"fg{chr(97 + i)}hi" for i in range(20)]
    text = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    rows = [(text(good, 120) + " " + text(bad if i % 2 else good, 60), int(i % 2 == 0)) for i in range(300)]
    model = quality.fit(sample(spark, rows), epochs=25)
    docs = [(i, text(good, 200) + " " + text(bad if i % 2 else good, 60)) for i in range(40)]
    got = {x["doc_id"]: x["score"] for x in quality.score_quality(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert max(s for i, s in got.items() if i % 2) < min(s for i, s in got.items() if i % 2 == 0)


def score_by_hand(model, text):
    """Gated attention over passages, one at a time, from the features of each text alone."""
    x, off = quality.passage_features(*buffers(pa.array([text or ""])))
    p, z, a = model.p, [], []
    for row in x[off[0] : off[1]].astype(float):
        h = np.tanh((row - p["mean"]) / p["scale"] @ p["W"] + p["b"])
        z.append(h)
        a.append((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"])
    a = np.exp(np.array(a) - max(a))
    bag = (a / a.sum()) @ np.array(z)
    return 1 / (1 + np.exp(-(bag @ p["c"] + p["d"][0])))


def test_scores_by_hand(spark):
    """Both classifiers' scores against plain loops over one text at a time."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-2, "again")], "doc_id long, text string"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.quality_model(docs, labels)
    texts = {}
    for x in docs.collect():
        texts.setdefault(x["doc_id"], []).append(x["text"])
    found = quality.score_quality(docs, model).collect()
    assert len(found) == docs.count()
    for x in found:
        assert min(abs(x["score"] - score_by_hand(model, t)) for t in texts[x["doc_id"]]) < 1e-5
    tox = toxicity.toxicity_model(docs, labels)
    for x in toxicity.score_toxicity(docs, tox).collect():
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in x["text"] or "")
        grams = {t[i : i + n] for n in toxicity.SIZES for i in range(len(t) - n + 1)}
        buckets = {int(b) for g in grams for b in toxicity.ngram_places([g])[1][-1:]}
        z = sum(float(tox["table"][b]) for b in buckets) + tox["bias"]
        assert abs(x["score"] - 1 / (1 + np.exp(-z))) < 1e-5


def test_sample_is_bounded_when_ids_repeat(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)] + [(2, 1), (None, 1), (4, None)], "doc_id long, quality int")
    from pyspark.sql import functions as F
    from wayfold.llm.labelled import labelled_sample

    rows = sorted(map(tuple, labelled_sample(docs, labels, "quality", F.lit(True), 100).collect()))
    assert rows == [("text 0", 0), ("text 1", 1), ("text 12", 1), ("text 13", 1), ("text 14", 0)]
    assert labelled_sample(docs, labels, "quality", F.lit(True), 2).count() == 2


def test_attention_gradients():
    r = np.random.default_rng(0)
    model = quality.Attention.start(1, np.zeros(quality.WIDTH), np.ones(quality.WIDTH))
    x, off, y = r.normal(size=(9, quality.WIDTH)), np.array([0, 4, 5, 9]), np.array([1.0, 0.0, 1.0])
    loss = lambda: float(np.sum(np.logaddexp(0, model.forward(x, off)["logit"]) - y * model.forward(x, off)["logit"]))
    f = model.forward(x, off)
    grads = model.gradients(f, 1 / (1 + np.exp(-f["logit"])) - y)
    for k, g in grads.items():
        at = tuple(r.integers(0, s) for s in g.shape)
        old = model.p[k][at]
        model.p[k][at] = old + 1e-5
        up = loss()
        model.p[k][at] = old - 1e-5
        down = loss()
        model.p[k][at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4, k


def test_one_bad_passage_decides(spark):
    r = random.Random(2)
    good = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "of", "the", "house"]) + str(r.randint(0, 999)) for _ in range(n))
    rows = [(good(160) + (" " + "spam " * 60 if i % 2 else " " + good(60)), int(i % 2 == 0)) for i in range(200)]
    model = quality.fit(sample(spark, rows), epochs=25)
    docs = [(1, good(900) + " " + "spam " * 80), (2, good(980)), (3, None), (4, "  "), (5, "")]
    got = {x["doc_id"]: x["score"] for x in quality.score_quality(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert got[1] < got[2] and got[3] == got[4] == got[5]
    assert quality.score_quality(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
