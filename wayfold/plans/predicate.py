"""Compiles a query's tag rules to one null-safe Catalyst predicate over the ``tags`` map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .query import Filter, OsmQuery

#: Columns with this prefix hold the values of single keys (see sources/tables.py).
PREFIX = "tag_"
#: Longer id lists become a join instead of an IN list.
IN_LIST = 1000


def safe_tags(tags: Column) -> Column:
    return F.coalesce(tags, F.create_map().cast("map<string,string>"))


def has_any_key(tags: Column, keys: Sequence[str]) -> Column:
    """At least one of the keys is present."""
    if not keys:
        return F.lit(False)
    return F.arrays_overlap(F.map_keys(safe_tags(tags)), F.array(*[F.lit(k) for k in keys]))


def matches(tags: Column, rules: Filter) -> Column:
    """Some entry matches: its value is listed, or its list is empty and its key is present."""
    tests = [F.map_contains_key(safe_tags(tags), F.lit(k)) if not values else F.coalesce(F.element_at(safe_tags(tags), F.lit(k)).isin(*values), F.lit(False)) for k, values in rules.items()]
    found = F.lit(False)
    for test in tests:
        found = found | test
    return found


def compile_predicate(query: OsmQuery, tags: Column | str = "tags") -> Column:
    """must AND ((keep AND NOT exclude) or, without keep_first, (NOT exclude OR keep))."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    test = F.lit(True) if query.must_tags is None else has_any_key(tags, query.must_tags)
    kept = matches(tags, query.keep) if query.keep else None
    excluded = matches(tags, query.exclude) if query.exclude else F.lit(False)
    if query.keep_first:
        return test & (F.lit(True) if kept is None else kept) & ~excluded
    return test & (~excluded | (F.lit(False) if kept is None else kept))


def pushable(query: OsmQuery, columns: Sequence[str]) -> Column | None:
    """What the predicate implies about single-key columns; unlike map entries these reach the Parquet scan."""
    stored = lambda keys: bool(keys) and all(PREFIX + k in columns for k in keys)
    column = lambda k: F.col(f"`{PREFIX}{k}`")
    implied = []
    if query.must_tags and stored(query.must_tags):
        implied.append([column(k).isNotNull() for k in query.must_tags])
    if query.keep_first and query.keep and stored(query.keep):
        implied.append([column(k).isin(*v) if v else column(k).isNotNull() for k, v in query.keep.items()])
    test = None
    for alternatives in implied:
        either = alternatives[0]
        for a in alternatives[1:]:
            either = either | a
        test = either if test is None else test & either
    return test


def of_ids(frame: DataFrame, ids: Sequence[int] | DataFrame | None, column: str = "id") -> DataFrame:
    """Restrict to a whitelist: an IN list while it is short, beyond that a semi-join that the planner sizes."""
    if ids is None:
        return frame
    if isinstance(ids, DataFrame):
        return frame.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")
    if len(ids) <= IN_LIST:
        return frame.filter(F.col(column).isin(*ids)) if ids else frame.filter(F.lit(False))
    listed = frame.sparkSession.createDataFrame([(int(i),) for i in ids], f"{column} long")
    return frame.join(listed, column, "left_semi")


def of_relation_type(relations: DataFrame, types: Sequence[str] | None) -> DataFrame:
    if types is None:
        return relations
    return relations.filter(F.coalesce(F.element_at(safe_tags(F.col("tags")), F.lit("type")).isin(*types), F.lit(False)))
