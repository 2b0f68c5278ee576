"""Geometry codes of ways and relations as CASE expressions: 0 none, 1 point, 2 line, 3 area."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.predicate import has_any_key, matches, safe_tags
from ..plans.rules import IS_AREA, IS_AREA_KEY, NOT_AREA, RELATION_AREA, RELATION_LINE
from ..schema import AREA, LINE, NO_GEOMETRY, WAY


def is_closed(refs: Column) -> Column:
    return F.coalesce(F.element_at(refs, 1) == F.element_at(refs, -1), F.lit(False))


def is_area(tags: Column) -> Column:
    """area=no is none; then listed values are areas, listed exceptions are not, listed keys are."""
    return F.when(matches(tags, {"area": ["no"]}), False).when(matches(tags, IS_AREA), True).when(matches(tags, NOT_AREA), False).otherwise(has_any_key(tags, IS_AREA_KEY))


def way_geotype(refs: Column, tags: Column) -> Column:
    n = F.coalesce(F.size(refs), F.lit(0))
    return F.when(n < 2, NO_GEOMETRY).when((n < 4) | ~is_closed(refs), LINE).when(is_area(tags), AREA).otherwise(LINE)


def relation_geotype(members: Column, tags: Column) -> Column:
    kind = F.element_at(safe_tags(tags), F.lit("type"))
    foreign = F.coalesce(F.exists(members, lambda m: m["type"] != WAY), F.lit(False))
    return F.when(foreign, NO_GEOMETRY).when(kind.isin(*RELATION_LINE), LINE).when(kind.isin(*RELATION_AREA), AREA).otherwise(NO_GEOMETRY)
