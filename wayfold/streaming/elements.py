"""Queries over streams of elements: the same predicate on an unbounded table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.tags import tag_columns
from ..plans.predicate import compile_predicate, of_ids, of_relation_type
from ..plans.query import OsmQuery


def stream_tables(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Element rows as their Parquet files arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_query(elements: DataFrame, q: OsmQuery, kind: str) -> DataFrame:
    """Selected elements of one kind; stateless, so any output mode and sink work."""
    if kind not in ("nodes", "ways", "relations"):
        raise ValueError("kind must be nodes, ways or relations")
    ids = {"nodes": q.node_ids, "ways": q.way_ids}.get(kind)
    found = of_ids(elements, ids)
    if kind == "relations":
        found = of_relation_type(found, q.relation_type)
    found = found.filter(compile_predicate(q)).withColumnRenamed("id", "osmid")
    if q.tags is True:
        return found
    return found.drop("tags") if q.tags is False else tag_columns(found, q.tags)


def changes_by_key(elements: DataFrame, key: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Edited elements by value of a key and event-time window; state is dropped after the watermark."""
    value = F.element_at("tags", F.lit(key))
    return elements.withWatermark("timestamp", late).filter(value.isNotNull()).groupBy(F.window("timestamp", window), value.alias("value")).agg(F.count("*").alias("n"))
