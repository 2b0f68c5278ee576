"""The pipeline against a version that holds everything in Python lists."""

import math
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm.test_bytetext import by_hand as words_of
from tests.llm.test_jaccard import by_hand as groups_of
from wayfold.llm.mixing import mix_sources
from wayfold.llm.queries import QUERIES
from wayfold.llm.toxicity import score_toxicity, toxicity_model

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    return [r.asDict() for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_every_stage(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = rows_of(docs)
    model = toxicity_model(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    bad = {r["doc_id"] for r in score_toxicity(docs, model, cp.TOXIC).filter("predicted = 1").collect()}
    want = [r for r in kept if r["doc_id"] not in bad]
    found = cp.drop_toxic(spark, docs, DATA)
    assert found.columns == docs.columns and sorted(rows_of(found), key=repr) == sorted(want, key=repr)

    roots = {d: c for d, _, c in groups_of([(r["doc_id"], r["text"]) for r in want], 5, 80, 100)}
    want = [r for r in want if roots[r["doc_id"]] == r["doc_id"]]
    found = cp.drop_near_duplicates(spark, found, DATA)
    assert sorted(rows_of(found), key=repr) == sorted(want, key=repr)

    norm = lambda t: " ".join(words_of(t))
    items = [norm(r["text"])[8:-8] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = [r for r in want if not any(i in norm(r["text"]) for i in items)]
    found = cp.drop_leaks(spark, found, DATA)
    assert sorted(rows_of(found), key=repr) == sorted(want, key=repr)

    taken = {r["doc_id"]: r["taken"] for r in mix_sources(found).collect()}
    copies = {r["doc_id"]: math.floor(taken[r["doc_id"]] / n + 0.5) if (n := len(words_of(r["text"]))) else 0 for r in want}
    want = [r for r in want for _ in range(copies[r["doc_id"]])]
    found = cp.mix(spark, found, DATA)
    assert sorted(rows_of(found), key=repr) == sorted(want, key=repr)

    lib, start, lines = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in sorted(want, key=lambda r: r["doc_id"]):
        ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        lines.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, cp.write_tokens(spark, found, DATA).collect())) == lines
    assert sorted(map(tuple, cp.run(spark, DATA).collect())) == lines


def test_stages_on_odd_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(None, "only here, some words", "en", None, 1), (None, None, None, None, None), (5000, "same text of a few words", "en", "s", 1), (5000, "same text of a few words", "en", "s", 1), (5000, "another text altogether, quite so", "en", "s", 1)], docs.schema)
    own = docs.filter("doc_id <> 5000").unionByName(odd).withColumn("__copies_of", F.lit(1)).withColumn("score", F.lit("s")).withColumn("size", F.lit("z"))
    one = cp.drop_near_duplicates(spark, own, DATA)
    assert one.columns == own.columns
    left = [(r["doc_id"], r["text"]) for r in one.filter("doc_id is null or doc_id = 5000").collect()]
    assert sorted(left, key=repr) == sorted([(None, "only here, some words"), (None, None), (5000, "same text of a few words"), (5000, "another text altogether, quite so")], key=repr)
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, own, DATA).columns == own.columns and stage(spark, own.limit(0), DATA).count() == 0
    assert cp.write_tokens(spark, own.limit(0), DATA).count() == 0


def test_rows_of_one_id_are_judged_each(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    a = " ".join(f"alpha{i}" for i in range(60))
    b = " ".join(f"beta{i}" for i in range(40))
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (6, b + " and more", "y"), (7, b + " before " + item, "x"), (7, "short one", "x"), (7, None, None), (8, "two words", "x"), (8, "two words", "y"), (9, "the same", "x"), (9, "the same", "x")]
    docs = spark.createDataFrame([(d, t, "en", s, 1, "k") for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars int, stage_key string")
    left = lambda stage: sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs, DATA).collect()), key=repr)
    once = [(3, a), (7, b + " before " + item), (7, "short one"), (7, None), (8, "two words"), (9, "the same")]
    near = left(cp.drop_near_duplicates)
    # of the two near texts of b, the one under the smaller key stays
    assert [r for r in near if r[1] in (b, b + " and more")] in ([(5, b)], [(6, b + " and more")])
    assert sorted((r for r in near if r[1] not in (b, b + " and more")), key=repr) == sorted(once, key=repr)
    assert left(cp.drop_leaks) == sorted(((d, t) for d, t, _ in rows if t is None or item not in t), key=repr)
    # enough of another source for every row of x and y to be taken three times
    more = spark.createDataFrame([(1000 + i, "w " * 400, "en", "z", 1, "k") for i in range(40)], docs.schema)
    taken = {}
    for r in cp.mix(spark, docs.union(more), DATA).filter("doc_id < 1000").collect():
        taken[r["doc_id"], r["text"], r["source"]] = taken.get((r["doc_id"], r["text"], r["source"]), 0) + 1
    assert taken == {(d, t, s): 3 * sum(x == (d, t, s) for x in rows) for d, t, s in rows if t}


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]
