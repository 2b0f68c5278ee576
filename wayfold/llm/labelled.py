"""A bounded, repeatable sample of labelled texts for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

FIT_PARTITIONS = 8


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids hash as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, bound: int) -> DataFrame:
    """``text, y`` of at most ``bound`` labelled documents, chosen by a hash of the id.

    ``usable`` filters the labels (folds).  Null labels are no labels; a document labelled
    more than once has the largest label, of texts that share an id the least is read.  The chosen ids are few by construction
    (``bound`` rows), so that side, and only that side, is broadcast.
    """
    marked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = materialize(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound), "labels")
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")
    return materialize(joined.repartition(FIT_PARTITIONS), "sample")
