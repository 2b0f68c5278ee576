"""Topology: ways split at every interior node that the queried ways use more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def way_refs(ways: DataFrame, way: str = "osmid", refs: str = "refs") -> DataFrame:
    """``way, pos, node, n``: one row for each reference, positions from 1."""
    return ways.filter(F.size(refs) >= 2).select(F.col(way), F.size(refs).alias("n"), F.posexplode(refs).alias("pos", "node")).withColumn("pos", F.col("pos") + 1)


def end_values(ways: DataFrame, way: str = "osmid", refs: str = "refs") -> DataFrame:
    """First and last reference of each way."""
    return ways.select(way, F.element_at(refs, 1).alias("first"), F.element_at(refs, -1).alias("last"))


def shared_nodes(refs: DataFrame) -> DataFrame:
    """``node, uses`` of the nodes with more than one reference, within one way or between ways."""
    return refs.groupBy("node").agg(F.count("*").alias("uses")).filter("uses > 1")


def split_points(refs: DataFrame, way: str = "osmid") -> DataFrame:
    """References where a segment starts or ends.

    Use counts are partial-aggregated before the shuffle and joined back as the few shared
    nodes; no window gathers a node's references, and AQE splits those of a hub in the join.
    """
    marked = refs.join(shared_nodes(refs), "node", "left")
    return marked.filter((F.col("pos") == 1) | (F.col("pos") == F.col("n")) | F.col("uses").isNotNull()).select(way, "n", "pos", "node")


def segments(ways: DataFrame, way: str = "osmid", refs: str = "refs") -> DataFrame:
    """``way, seg, source, target, from_pos, to_pos``; segments of a way are numbered from 0.

    A segment's target is the next split point of its way, so no reference is duplicated.
    Ways with fewer than two references have none; a closed way without crossings is one
    segment whose source is its target.
    """
    order = Window.partitionBy(way).orderBy("pos")
    bounds = split_points(way_refs(ways, way, refs), way)
    cut = bounds.select(
        way, (F.row_number().over(order) - 1).cast("long").alias("seg"), F.col("node").alias("source"), F.lead("node").over(order).alias("target"),
        F.col("pos").alias("from_pos"), F.lead("pos").over(order).alias("to_pos"),
    )
    return cut.filter("to_pos is not null")


def segment_refs(ways: DataFrame, way: str = "osmid", refs: str = "refs", carry: list[str] | None = None) -> DataFrame:
    """Segments with their own references, cut from the way's array, and the way's columns to ``carry``."""
    carry = carry or []
    own = F.slice(F.col(refs), F.col("from_pos"), F.col("to_pos") - F.col("from_pos") + 1).alias(refs)
    return segments(ways, way, refs).join(ways.select(way, refs, *carry), way).select(way, "seg", "source", "target", own, *carry)
