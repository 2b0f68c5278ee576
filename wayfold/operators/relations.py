"""Relations: members as rows, member ways, line and area geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import AREA, LINE, WAY
from .geometry import collect_parts, drop_complex, gather, multi_kind, polygons
from .rings import assemble_rings


def member_rows(relations: DataFrame, outer: bool = True, carry: list[str] | None = None) -> DataFrame:
    """One row for each member in order: ``osmid, carry, pos, memid, type, role``."""
    carry = carry or []
    expand = F.posexplode_outer if outer else F.posexplode
    rows = relations.select("osmid", *carry, expand("members").alias("pos", "m"))
    return rows.select("osmid", *carry, "pos", F.col("m.ref").alias("memid"), F.col("m.type").alias("type"), F.col("m.role").alias("role"))


def member_ways(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """Members that are ways, with the ways' references; the ways are found by the members' ids."""
    rows = member_rows(relations, outer=False).filter(F.col("type") == WAY)
    return rows.join(ways.select(F.col("id").alias("memid"), "refs"), "memid")


def without_members(ways: DataFrame, relations: DataFrame) -> DataFrame:
    """Ways that no selected relation uses."""
    used = member_rows(relations, outer=False).filter(F.col("type") == WAY).select(F.col("memid").alias("osmid"))
    return ways.join(used, "osmid", "left_anti")


def relation_geometry(relations: DataFrame, ways: DataFrame, nodes: DataFrame, complex_rings: str = "drop_inner") -> DataFrame:
    """``osmid, kind, parts, missing_refs``: routes as (multi)lines of their ways, areas as (multi)polygons.

    ``complex_rings``: "drop_inner" drops inner rings where several inner meet several outer
    rings, "contain" places each by containment.
    """
    found = member_ways(relations.filter(F.col("geom").isin(LINE, AREA)), ways).join(relations.select("osmid", "geom"), "osmid")
    lines = gather(found.filter(F.col("geom") == LINE), nodes, ["osmid", "pos"])
    lines = lines.filter(F.size("points") >= 2).select("osmid", F.col("pos").alias("seq"), F.lit("LINESTRING").alias("kind"), F.array(F.array("points")).alias("parts"), "missing_refs")
    missing = lines.groupBy("osmid").agg(F.sum("missing_refs").alias("missing_refs"))
    routes = collect_parts(lines, ["osmid"]).join(missing, "osmid")

    rings = assemble_rings(found.filter(F.col("geom") == AREA).select(F.col("osmid").alias("rel"), "pos", "role", "refs"))
    rings = rings.filter(F.size("refs") >= 4)
    if complex_rings == "drop_inner":
        rings = drop_complex(rings, ["rel"])
    placed = gather(rings, nodes, ["rel", "role", "ring"]).filter(F.size("points") >= 4)
    lost = placed.groupBy("rel").agg(F.sum("missing_refs").alias("missing_refs"))
    areas = polygons(placed, ["rel"]).join(lost, "rel").select(F.col("rel").alias("osmid"), multi_kind("POLYGON", F.col("parts")).alias("kind"), "parts", "missing_refs")
    return routes.unionByName(areas)
