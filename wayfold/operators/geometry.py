"""Geometry as coordinates: gather, lines, closed areas, holes and multi-part collection.

``parts`` is a list of polygons (or lines, or points), each a list of rings, each a list of
``struct<lon, lat>``; ``kind`` names it.  Serializers live in ``wayfold.functions.wkt``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import AREA, LINE


def point_lookup(nodes: DataFrame) -> DataFrame:
    """``id, lon, lat``, sorted by id."""
    return nodes.select("id", "lon", "lat").orderBy("id")


def gather(lists: DataFrame, nodes: DataFrame, keys: list[str], refs: str = "refs", carry: list[str] | None = None) -> DataFrame:
    """``keys, carry, points, missing_refs``: references replaced by coordinates, in order; unknown nodes drop out.

    Columns to ``carry`` travel with the first reference only, so no join brings them back.
    AQE picks broadcast or sort-merge by size, and splits the references of a hub node.
    """
    carry = carry or []
    flat = lists.select(*keys, *carry, F.posexplode(refs).alias("__at", "__ref"))
    flat = flat.withColumns({c: F.when(F.col("__at") == 0, F.col(c)) for c in carry}) if carry else flat
    placed = flat.join(nodes.select(F.col("id").alias("__ref"), "lon", "lat"), "__ref", "left")
    found = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.struct("__at", "lon", "lat"))
    held = [F.first(c, ignorenulls=True).alias(c) for c in carry]
    grouped = placed.groupBy(*keys).agg(*held, F.array_sort(F.collect_list(found)).alias("p"), F.count(F.when(found.isNull(), 1)).alias("missing_refs"))
    return grouped.select(*keys, *carry, F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("points"), "missing_refs")


def close_ring(ring: Column) -> Column:
    """Append the first element where the last one differs."""
    return F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def way_geometry(ways: DataFrame, nodes: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``osmid, carry, kind, parts, missing_refs`` of ways by their ``geom`` code; null parts when too few points remain."""
    carry = carry or []
    gathered = gather(ways.filter(F.col("geom").isin(LINE, AREA)), nodes, ["osmid"], carry=["geom", *carry])
    n, area = F.size("points"), F.col("geom") == AREA
    good = F.when(area, n >= 3).otherwise(n >= 2)
    ring = F.when(area, close_ring(F.col("points"))).otherwise(F.col("points"))
    return gathered.select("osmid", *carry, F.when(good, F.when(area, "POLYGON").otherwise("LINESTRING")).alias("kind"), F.when(good, F.array(F.array(ring))).alias("parts"), "missing_refs")


def node_geometry(nodes: DataFrame, carry: list[str] | None = None) -> DataFrame:
    at = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.array(F.array(F.array(F.struct("lon", "lat")))))
    return nodes.select("osmid", *(carry or []), F.when(at.isNotNull(), "POINT").alias("kind"), at.alias("parts"), F.lit(0).cast("long").alias("missing_refs"))


def point_in_ring(ring: Column, lon: Column, lat: Column) -> Column:
    """Ray casting over a closed ring, as an aggregate of its edges."""
    pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))
    crosses = lambda e: ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)) & (lon < (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) + e["a"]["lon"])
    return F.aggregate(pairs, F.lit(False), lambda acc, e: acc != F.coalesce(crosses(e), F.lit(False)))


def drop_complex(rings: DataFrame, keys: list[str]) -> DataFrame:
    """Drop inner rings of relations with more than one inner and more than one outer ring."""
    all_ = Window.partitionBy(*keys)
    inner, outer = F.count(F.when(F.col("role") == "inner", 1)).over(all_), F.count(F.when(F.col("role") == "outer", 1)).over(all_)
    return rings.withColumn("complex", (inner > 1) & (outer > 1)).filter(~F.col("complex") | (F.col("role") == "outer")).drop("complex")


def polygons(rings: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, parts, n``: rings (``role, ring, points``) to polygons, every hole under the outer that holds it.

    With one outer ring all holes are its own; with several, a hole belongs to the first outer
    ring that contains its first point and is dropped if none does.
    """
    by = rings.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("role") == "outer", F.struct("ring", "points")))).alias("outers"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "inner", F.struct("ring", "points")))).alias("inners"),
    )
    first = lambda i: F.element_at(i["points"], 1)
    holder = lambda i: F.filter(F.col("outers"), lambda o: (F.size("outers") == 1) | point_in_ring(o["points"], first(i)["lon"], first(i)["lat"]))
    held = by.withColumn("inners", F.transform("inners", lambda i: F.struct(i["points"].alias("points"), F.get(holder(i), 0)["ring"].alias("of"))))
    parts = F.transform("outers", lambda o: F.concat(F.array(o["points"]), F.transform(F.filter(F.col("inners"), lambda i: i["of"] == o["ring"]), lambda i: i["points"])))
    return held.filter(F.size("outers") > 0).select(*keys, parts.alias("parts"))


def polygon_index(rings: DataFrame, key: str) -> DataFrame:
    """Running polygon number of each ring: a new one at each outer ring, inner rings after the outer before them."""
    order = Window.partitionBy(key).orderBy(F.when(F.col("role") == "outer", 0).otherwise(1), "ring").rowsBetween(Window.unboundedPreceding, 0)
    return rings.withColumn("poly", F.sum(F.when(F.col("role") == "outer", 1).otherwise(0)).over(order) - 1)


def multi_kind(kind: str, parts: Column) -> Column:
    return F.when(F.size(parts) > 1, F.lit(f"MULTI{kind}")).otherwise(F.lit(kind))


def collect_parts(single: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Rows of one kind that share a key become one multi-part geometry; a single one stays single."""
    grouped = single.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "kind", "parts"))).alias("g"))
    kind = F.element_at("g", 1)["kind"]
    mixed = F.exists("g", lambda x: x["kind"] != kind)
    checked = F.when(mixed, F.raise_error(F.lit("one key has geometries of several kinds"))).otherwise(F.when(F.size("g") > 1, F.concat(F.lit("MULTI"), kind)).otherwise(kind))
    return grouped.select(*keys, checked.alias("kind"), F.flatten(F.transform("g", lambda x: x["parts"])).alias("parts"))
