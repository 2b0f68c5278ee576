"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, root`` for every id in ``edges``: root is the smallest id that links reach.

    Each round takes the smallest label among the neighbours and then the label's own label
    (pointer jumping), so rounds grow with the logarithm of the longest path.  Every round is
    two equi-joins of narrow rows and is written to shared storage.  Null ends are no links;
    an empty table gives an empty result.
    """
    one_way = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    both = materialize(one_way.union(one_way.select(F.col("v"), F.col("u"))).distinct(), "edges", narrow=True)
    labels = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")), "labels", narrow=True)
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("l").alias("vl")), "v").groupBy("u").agg(F.min("vl").alias("vl"))
        step = labels.join(near, "u").select("u", F.col("l").alias("old"), F.least("l", "vl").alias("l"))
        jump = labels.select(F.col("u").alias("l"), F.col("l").alias("ll"))
        after = materialize(step.join(jump, "l", "left").select("u", "old", F.least("l", F.coalesce("ll", "l")).alias("l")), "labels", narrow=True)
        labels = after.select("u", "l")
        if after.filter("old <> l").isEmpty():
            return labels.select(F.col("u").alias("id"), F.col("l").alias("root"))
