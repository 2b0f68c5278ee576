"""Tags as a map, as rows and as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.predicate import safe_tags


def tag(key: str, tags: str = "tags") -> Column:
    return F.element_at(safe_tags(F.col(tags)), F.lit(key))


#: More columns than this are refused.
MAX_KEYS = 5000


def _named(keys: Sequence[str], taken: Sequence[str], tags: str) -> list[Column]:
    """Columns of the keys; one that is named like another column gets the prefix ``tag_``, as often as needed."""
    used, out = {c.lower() for c in taken}, []
    for key in keys:
        name = key
        while name.lower() in used:
            name = f"tag_{name}"
        used.add(name.lower())
        out.append(tag(key, tags).alias(name))
    return out


def tag_columns(frame: DataFrame, keys: Sequence[str], tags: str = "tags") -> DataFrame:
    """One column for each key, null where the key is absent; the schema does not depend on the data."""
    kept = [c for c in frame.columns if c != tags]
    return frame.select(*kept, *_named(keys, kept, tags))


def only_keys(frame: DataFrame, keys: Sequence[str], tags: str = "tags") -> DataFrame:
    listed = F.array(*[F.lit(k) for k in keys]) if keys else F.array().cast("array<string>")
    return frame.withColumn(tags, F.map_filter(safe_tags(F.col(tags)), lambda k, _: F.array_contains(listed, k)))


def tag_rows(frame: DataFrame, keep: Sequence[str], tags: str = "tags") -> DataFrame:
    """Long form: the ``keep`` columns with ``key`` and ``value``."""
    return frame.select(*keep, F.explode(safe_tags(F.col(tags))).alias("key", "value"))


def wide_tags(frame: DataFrame, keep: Sequence[str], tags: str = "tags") -> DataFrame:
    """One column for each key that occurs, by a first job that lists the keys; more than ``MAX_KEYS`` are an error."""
    found = frame.select(F.explode(F.map_keys(safe_tags(F.col(tags)))).alias("key")).distinct().limit(MAX_KEYS + 1)
    keys = sorted(r[0] for r in found.collect())  # at most MAX_KEYS + 1 rows
    if len(keys) > MAX_KEYS:
        raise ValueError(f"more than {MAX_KEYS} different keys; name the ones to have as columns")
    return frame.select(*keep, *_named(keys, keep, tags))
