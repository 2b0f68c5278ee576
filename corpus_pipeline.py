"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but
the last return the columns of ``documents``.

Rows, not ids, are judged: inside a stage a row is known by its doc_id, and where that is null or
stands for several texts, all but one of them by a value of id and text beyond all real ids.  In
every stage null and empty texts are documents (never toxic by a word, near or leaking; the mix
has no words to take from them), long texts are read whole, columns of any other name pass
through, and an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.decontaminate import leaked_documents
from wayfold.llm.jaccard import jaccard_join
from wayfold.llm.mixing import mix_sources
from wayfold.llm.scratch import materialize
from wayfold.llm.token_output import read_token_files, write_token_files
from wayfold.llm.toxicity import score_toxicity, toxicity_model

TOXIC = 0.7
SHINGLE, SIMILAR = 5, (80, 100)
WEIGHTS, EPOCHS = (1, 2, 3), 3


def _free(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``docs`` has."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key that is equal only for rows of one doc_id and one text, and the key's name."""
    key = _free(docs, "stage_key")
    value = F.xxhash64(F.col("text"))
    ids = docs.select(F.col("doc_id").cast("long").alias("id"), value.alias("text")).filter("id is not null")
    several = ids.groupBy("id").agg(F.min("text").alias("least"), F.max("text").alias("most")).filter("least <> most")
    several = materialize(several.select(F.col("id").alias(f"{key}_id"), F.col("least").alias(f"{key}_least")), "several", narrow=True)
    own = F.lit(1 << 62) + F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.coalesce(F.col("text"), F.lit(""))).bitwiseAND(F.lit((1 << 61) - 1))
    marked = docs.join(several, F.col("doc_id").cast("long") == F.col(f"{key}_id"), "left")
    other = F.col("doc_id").isNull() | F.coalesce(F.col(f"{key}_least") != value, F.lit(False))
    return marked.withColumn(key, F.when(other, own).otherwise(F.col("doc_id").cast("long"))).drop(f"{key}_id", f"{key}_least"), key


def _once(rows: DataFrame, repeated: DataFrame, key: str, *more: str) -> DataFrame:
    """One row of each key that ``repeated`` lists (rows of equal id and text); the others as they are."""
    if repeated.isEmpty():
        return rows
    return rows.join(repeated, key, "left_anti").unionByName(rows.join(repeated, key, "left_semi").dropDuplicates([key, *more]))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go (score of ``TOXIC`` or more); equal texts share their fate, a null text scores as the empty one."""
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, verdict = _free(docs, "toxic_score"), _free(docs, "toxic")
    scored = score_toxicity(docs, model, threshold=TOXIC, names=(score, verdict))
    return scored.filter(F.col(verdict) == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest key.

    That is the smallest doc_id; null ids and further texts of a repeated id come after all
    others.  Rows of one id are near duplicates only if their texts are; rows of equal id and
    text are one document.  Null and empty texts are alike to nothing and stay.
    """
    keyed, key = _keyed(docs)
    groups = materialize(jaccard_join(keyed.select(F.col(key).alias("doc_id"), "text"), n=SHINGLE, num=SIMILAR[0], den=SIMILAR[1]), "groups", narrow=True)
    gone = materialize(groups.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(key)).distinct(), "gone", narrow=True)
    repeated = materialize(groups.groupBy(F.col("doc_id").alias(key)).count().filter("count > 1").select(key), "repeated", narrow=True)
    return _once(keyed.join(gone, key, "left_anti"), repeated, key).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item or a paraphrase of one go; other texts of their ids stay, null and empty ones too."""
    keyed, key = _keyed(docs)
    leaks = leaked_documents(keyed.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = materialize(leaks.select(F.col("doc_id").alias(key)).distinct(), "gone", narrow=True)
    return keyed.join(gone, key, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole copy; texts stay whole.

    Documents that the mix takes less than half of are left out, those without words too (they
    have nothing to take).  Rows of one id are taken each by its own size; rows of equal id,
    text and source count together, their copies are those of one of them.
    """
    keyed, key = _keyed(docs)
    source, copies = _free(docs, "mix_source"), _free(docs, "mix_copies")
    taken = mix_sources(keyed.select(F.col(key).alias("doc_id"), "text", "source"), weights=WEIGHTS, max_epochs=EPOCHS)
    whole = F.floor(F.col("taken") / F.col("size") + F.lit(0.5))
    counted = taken.filter("size > 0").groupBy(F.col("doc_id").alias(key), F.col("source").alias(source)).agg(F.sum(whole).cast("int").alias(copies), F.count("*").alias("rows"))
    counted = materialize(counted.filter(F.col(copies) > 0), "copies", narrow=True)
    rows = _once(keyed, counted.filter("rows > 1").select(key).distinct(), key, "source")
    rows = rows.withColumnRenamed(key, f"{key}_row")
    chosen = rows.join(counted.drop("rows"), (F.col(f"{key}_row") == F.col(key)) & F.col("source").cast("string").eqNullSafe(F.col(source)))
    return chosen.withColumn(_free(chosen, "copy"), F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; returns what the files give back for each row: null ids first, rows of one id by their text, an empty text as the end id alone."""
    return read_token_files(write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("token_output", write_tokens),
]

#: Learned scores, libraries and files have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
