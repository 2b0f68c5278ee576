"""Element tables as Parquet: the one-time load that makes column and row-group pruning possible.

Predicates on map entries are not pushed into Parquet, so the keys that are asked for most are
also written as columns of their own, and the files are sorted by id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tags import tag
from ..plans.predicate import PREFIX

#: Keys with a column of their own.
HOT_KEYS = ("highway", "building", "amenity", "type")


def write_tables(frames: dict[str, DataFrame], path: str, hot_keys: Sequence[str] = HOT_KEYS, partitions: int | None = None) -> None:
    """Write ``nodes``, ``ways`` and ``relations`` below ``path``, range-partitioned and sorted by id."""
    for kind, frame in frames.items():
        own = frame.withColumns({PREFIX + k: tag(k) for k in hot_keys} | {"tag_keys": F.map_keys("tags")})
        spread = own.repartitionByRange(partitions, "id") if partitions else own.repartitionByRange("id")
        spread.sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/{kind}")


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {kind: spark.read.parquet(f"{path}/{kind}") for kind in ("nodes", "ways", "relations")}


def pushed_key(frame: DataFrame, key: str, values: Sequence[str] | None = None) -> DataFrame:
    """Filter on a hot key's own column, which reaches the scan."""
    column = F.col(PREFIX + key)
    return frame.filter(column.isNotNull() if not values else column.isin(*values))
