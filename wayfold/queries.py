"""The registered queries: each operator applied to the star-schema view of the driver tables."""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dataset import OsmDataset
from .functions.json import expand_json
from .functions.text import comparable_string
from .functions.wkt import to_wkt
from .operators.geometry import drop_complex, gather, polygon_index, way_geometry
from .operators.geotype import relation_geotype, way_geotype
from .operators.relations import member_rows, relation_geometry, without_members
from .operators.tags import tag_rows, wide_tags
from .operators.topology import end_values, segments, shared_nodes, way_refs
from .plans.query import OsmQuery
from .sources import starview
from .sources.pbf_sink import shared_folder, write_pbf
from .sources.places import Places, first_wins, from_city_list, from_json_index

COLUMNS = ["status", "priority", "kind"]


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return starview.ways(spark, sf_dir).withColumnRenamed("id", "osmid")


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return starview.relations(spark, sf_dir).withColumnRenamed("id", "osmid")


def _ask(**options) -> Callable[[SparkSession, str], DataFrame]:
    q = OsmQuery(**{"ways": True, "tags": COLUMNS} | options)
    return lambda spark, sf_dir: starview.dataset(spark, sf_dir).query(q)


def id_whitelist(spark, sf_dir):
    """Ways whose ids a whole table lists: the customers' numbers."""
    listed = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return starview.dataset(spark, sf_dir).query(OsmQuery(ways=True, tags=COLUMNS, way_ids=listed))


def tags_long(spark, sf_dir):
    return tag_rows(_ways(spark, sf_dir), ["osmid"]).groupBy("key", "value").agg(F.count("*").alias("n"))


def tags_wide(spark, sf_dir):
    return wide_tags(_ways(spark, sf_dir), ["osmid"])


def geometry_points(spark, sf_dir):
    return starview.dataset(spark, sf_dir).geometry()


def coords_of_ids(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") * 100000 + F.col("p_partkey") % 100).alias("id"))
    return starview.dataset(spark, sf_dir).coords(ids)


def _points(spark, sf_dir):
    return gather(_ways(spark, sf_dir), starview.nodes(spark, sf_dir), ["osmid"])


def way_bbox(spark, sf_dir):
    lon, lat = F.transform("points", lambda p: p["lon"]), F.transform("points", lambda p: p["lat"])
    return _points(spark, sf_dir).select("osmid", F.array_min(lon).alias("min_lon"), F.array_max(lon).alias("max_lon"), F.array_min(lat).alias("min_lat"), F.array_max(lat).alias("max_lat"), F.size("points").cast("long").alias("n"))


def _steps(points):
    cent = lambda p: F.struct(F.round(p["lon"] * 100).cast("long").alias("x"), F.round(p["lat"] * 100).cast("long").alias("y"))
    c = F.transform(points, cent)
    return F.arrays_zip(F.slice(c, 1, F.size(c) - 1).alias("a"), F.slice(c, 2, F.size(c) - 1).alias("b"))


def way_length(spark, sf_dir):
    square = lambda e: (e["b"]["x"] - e["a"]["x"]) * (e["b"]["x"] - e["a"]["x"]) + (e["b"]["y"] - e["a"]["y"]) * (e["b"]["y"] - e["a"]["y"])
    found = _points(spark, sf_dir).filter(F.size("points") >= 2)
    return found.select("osmid", F.aggregate(_steps(F.col("points")), F.lit(0).cast("long"), lambda s, e: s + square(e)).alias("length2"))


def closed_area(spark, sf_dir):
    closed = _ways(spark, sf_dir).filter((F.size("refs") >= 4) & (F.element_at("refs", 1) == F.element_at("refs", -1)))
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    points = gather(closed, starview.nodes(spark, sf_dir), ["osmid"])
    return points.select("osmid", F.abs(F.aggregate(_steps(F.col("points")), F.lit(0).cast("long"), lambda s, e: s + cross(e))).alias("area2"))


def way_ends(spark, sf_dir):
    return end_values(_ways(spark, sf_dir))


def topology_segments(spark, sf_dir):
    return segments(_ways(spark, sf_dir)).select("osmid", "seg", "source", "target", (F.col("to_pos") - F.col("from_pos") + 1).cast("long").alias("npts"))


def topology_tags(spark, sf_dir):
    q = OsmQuery(ways=True, geometry=True, topology=True, keep={"status": ["O", "P"]}, tags=["status"])
    found = starview.dataset(spark, sf_dir).query(q, form="parts")
    return found.select("osmid", "seg", "source", "target", "status", F.size(F.element_at(F.element_at("parts", 1), 1)).cast("long").alias("npts"))


def shared(spark, sf_dir):
    return shared_nodes(way_refs(_ways(spark, sf_dir)))


def _area_tagged(spark, sf_dir):
    kind = F.element_at("tags", F.lit("kind"))
    pick = lambda *pairs: F.create_map(*[F.lit(x) for x in pairs])
    tags = (
        F.when(kind == "PROMO", pick("building", "yes")).when(kind == "STANDARD", pick("natural", "cliff")).when(kind == "MEDIUM", pick("barrier", "wall"))
        .when(kind == "LARGE", pick("highway", "residential")).when(kind == "SMALL", pick("area", "no", "building", "yes")).otherwise(pick("natural", "wood"))
    )
    return _ways(spark, sf_dir).withColumn("tags", tags)


def way_codes(spark, sf_dir):
    return _area_tagged(spark, sf_dir).select("osmid", way_geotype(F.col("refs"), F.col("tags")).alias("geom"))


def way_text(spark, sf_dir):
    ways = _area_tagged(spark, sf_dir).withColumn("geom", way_geotype(F.col("refs"), F.col("tags")))
    return way_geometry(ways, starview.nodes(spark, sf_dir)).select("osmid", to_wkt().alias("wkt"), "missing_refs")


def relation_members(spark, sf_dir):
    return member_rows(_relations(spark, sf_dir)).select("osmid", F.col("pos").cast("long").alias("pos"), "memid", "type", "role")


def relation_codes(spark, sf_dir):
    return _relations(spark, sf_dir).select("osmid", relation_geotype(F.col("members"), F.col("tags")).alias("geom"))


def member_antijoin(spark, sf_dir):
    areas = _relations(spark, sf_dir).filter(F.element_at("tags", F.lit("type")) == "multipolygon")
    return without_members(_ways(spark, sf_dir), areas).select("osmid")


def _member_rings(spark, sf_dir):
    return member_rows(_relations(spark, sf_dir)).select("osmid", "role", F.col("memid").alias("ring"))


def ring_counts(spark, sf_dir):
    left = drop_complex(_member_rings(spark, sf_dir), ["osmid"])
    return left.groupBy("osmid").agg(F.count(F.when(F.col("role") == "outer", 1)).alias("n_outer"), F.count(F.when(F.col("role") == "inner", 1)).alias("n_inner"))


def multi_split(spark, sf_dir):
    routes = _relations(spark, sf_dir).withColumn("geom", relation_geotype(F.col("members"), F.col("tags"))).filter("geom = 2")
    found = relation_geometry(routes, starview.ways(spark, sf_dir), starview.nodes(spark, sf_dir))
    return found.select("osmid", "kind", F.size("parts").cast("long").alias("n"))


def polygon_indices(spark, sf_dir):
    return polygon_index(_member_rings(spark, sf_dir), "osmid").select("osmid", "ring", "poly")


def metadata(spark, sf_dir):
    found = starview.dataset(spark, sf_dir).query(OsmQuery(ways=True, metadata=True, tags=False))
    return found.select("osmid", F.col("version").cast("long").alias("version"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("edited"), "changeset")


def info(spark, sf_dir):
    return starview.dataset(spark, sf_dir).info()


def json_fields(spark, sf_dir):
    return expand_json(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props"), "props", "k bigint")


def json_rows(spark, sf_dir):
    return expand_json(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props"), "props", "map<string, bigint>", unstack=True)


def first_wins_union(spark, sf_dir):
    """Three whole tables that share names: suppliers' nations, all nations, all regions and nations."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    used = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    url = lambda prefix, c: F.concat(F.lit(prefix), c).alias("url")
    one = nation.join(used, "n_nationkey", "left_semi").select(F.col("n_name").alias("name"), url("a/", "n_name"))
    two = nation.select(F.col("n_name").alias("name"), url("b/", "n_name"))
    three = region.select(F.col("r_name").alias("name"), url("c/", "r_name"))
    return first_wins(one, two, three)


def comparable(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", comparable_string(F.concat(F.lit("o'"), "p_name", F.lit("’s"))).alias("name"))


def default_query(spark, sf_dir):
    kind = F.element_at("tags", F.lit("kind"))
    road = F.when(kind == "PROMO", "primary").when(kind == "STANDARD", "corridor").when(kind == "MEDIUM", "residential").when(kind == "LARGE", "service")
    service = F.when((kind == "LARGE") & (F.col("id") % 2 == 0), F.lit("yard"))
    data = starview.dataset(spark, sf_dir)
    pairs = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.alias("v"))) for k, v in (("highway", road), ("service", service))]))
    data.ways = data.ways.withColumn("tags", F.map_from_entries(pairs))
    q = OsmQuery(defaults="highways").append_exclude({"highway": ["residential"]})
    return data.query(q).select("osmid", "highway", "service", "oneway")


def elements_union(spark, sf_dir):
    q = OsmQuery(nodes=True, ways=True, relations=True)
    return starview.dataset(spark, sf_dir).elements(q).groupBy("osmtype").agg(F.count("*").alias("n"), F.sum("osmid").alias("id_sum"))


def strings(spark, sf_dir):
    return starview.dataset(spark, sf_dir).strings()


def relation_areas(spark, sf_dir):
    """Areas from rings chained out of open ways."""
    q = OsmQuery(relations=True, geometry=True, tags=["type"], relation_type=["multipolygon", "boundary"])
    return starview.dataset(spark, sf_dir).query(q, form="wkt")


def relation_rows(spark, sf_dir):
    """Relations of two types without geometry: one row for each member, beside a tag that is named like a column."""
    q = OsmQuery(relations=True, tags=["type"], relation_type=["route", "boundary"])
    found = starview.dataset(spark, sf_dir).query(q)
    return found.select("osmid", F.col("pos").cast("long").alias("pos"), "memid", "type", "role", "geom", "tag_type")


def point_geometry(spark, sf_dir):
    """Nodes with a tag as points, with the reference system's number."""
    q = OsmQuery(nodes=True, geometry=True, keep={"brand": []}, exclude={"size": ["1", "2", "3"]}, tags=["brand"])
    return starview.dataset(spark, sf_dir).query(q, form="ewkt").select("osmid", "brand", "geometry", "missing_refs")


def _extract(spark, sf_dir, kinds=("nodes", "ways", "relations")) -> OsmDataset:
    """The view's elements written as ``.osm.pbf`` files and opened from there."""
    data = starview.dataset(spark, sf_dir)
    folder = shared_folder(spark, "extract")
    write_pbf({kind: getattr(data, kind) for kind in kinds}, folder)
    return OsmDataset.from_pbf(spark, folder)


def _flat(tags):
    entries = F.array_sort(F.map_entries(tags))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def extract_nodes(spark, sf_dir):
    return _extract(spark, sf_dir, ["nodes"]).nodes.select("id", "lon", "lat", _flat(F.col("tags")).alias("tags"), "version", "changeset")


def extract_ways(spark, sf_dir):
    edited = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("edited")
    return _extract(spark, sf_dir, ["ways"]).ways.select("id", F.array_join(F.col("refs").cast("array<string>"), ",").alias("refs"), _flat(F.col("tags")).alias("tags"), F.col("version").cast("long").alias("version"), edited, "changeset")


def extract_relations(spark, sf_dir):
    rows = _extract(spark, sf_dir, ["relations"]).relations.select("id", _flat(F.col("tags")).alias("tags"), F.posexplode("members").alias("pos", "m"))
    return rows.select("id", "tags", F.col("pos").cast("long").alias("pos"), F.col("m.ref").alias("ref"), F.col("m.type").alias("type"), F.col("m.role").alias("role"))


def extract_info(spark, sf_dir):
    """Counts of elements; that every kind has blocks stands for their number, which follows the tasks."""
    found = _extract(spark, sf_dir).info()
    return found.select("kind", "elements", "tagged", (F.col("blocks") > 0).alias("has_blocks"))


def extract_features(spark, sf_dir):
    found = _extract(spark, sf_dir).features
    return spark.createDataFrame([(kind, name) for kind, names in found.items() for name in names], "kind string, feature string")


def extract_topology(spark, sf_dir):
    q = OsmQuery(ways=True, geometry=True, topology=True, keep={"status": ["O", "P"]}, tags=["status", "source"])
    found = _extract(spark, sf_dir).query(q, form="parts")
    return found.select("osmid", "seg", "source", "target", "status", "tag_source", F.size(F.element_at(F.element_at("parts", 1), 1)).cast("long").alias("npts"))


def _places(spark, sf_dir) -> Places:
    """Two catalogues from files: the nations as a JSON index, the regions and some nations as a city list."""
    folder = shared_folder(spark, "places")
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    own = F.struct(F.struct(F.col("n_name").alias("name"), F.struct(F.concat(F.lit("one/"), "n_name").alias("pbf")).alias("urls")).alias("properties"))
    index = nation.filter("n_regionkey < 3").agg(F.to_json(F.struct(F.collect_list(own).alias("features"))).alias("value"))
    index.coalesce(1).write.text(f"{folder}/index")
    names = nation.select(F.col("n_name").alias("n")).union(region.select("r_name"))
    lines = names.agg(F.array_sort(F.collect_list("n")).alias("n")).select(F.array_join(F.concat(F.array_repeat(F.lit("# head"), 5), F.transform("n", lambda x: F.concat(x, F.lit(":1:2"))), F.array_repeat(F.lit("# foot"), 8)), "\n").alias("value"))
    lines.coalesce(1).write.text(f"{folder}/list")
    return Places(from_json_index(spark, f"{folder}/index", "one"), from_city_list(spark, f"{folder}/list", "two", "two/{}.osm.pbf"))


def place_catalogue(spark, sf_dir):
    return _places(spark, sf_dir).frame.select("name", F.element_at("urls", 1).alias("url"), F.size("urls").cast("long").alias("urls"), "provider")


def place_files(spark, sf_dir):
    """Files saved by an injected transport, read back."""
    places = _places(spark, sf_dir)
    folder = re.sub("^file:(//)?", "", shared_folder(spark, "files"))
    if "://" in folder:
        raise ValueError("downloads are saved below a path of a mounted file system")
    os.makedirs(folder)
    names = sorted(r[0] for r in places.valid_names().collect())  # a catalogue of places
    saved = places.download(folder, names, lambda url: f"content of {url}".encode(), rename=[n.replace(" ", "_") for n in names])
    rows = []
    for name, path in zip(names, saved, strict=True):
        with open(path, "rb") as f:
            rows.append((name, os.path.basename(path), f.read().decode()))
    shutil.rmtree(folder)
    return spark.createDataFrame(rows, "name string, file string, content string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q01_must_tags": _ask(must_tags=["priority"]),
    "q02_keep_pairs": _ask(keep={"status": ["O", "P"]}),
    "q03_keep_any": _ask(keep={"priority": []}),
    "q04_keep_first_true": _ask(keep={"status": ["O", "P"]}, exclude={"priority": ["1-URGENT"], "kind": ["PROMO"]}),
    "q05_keep_first_false": _ask(keep_first=False, exclude={"status": ["F"]}, keep={"kind": ["PROMO"]}),
    "q06_tag_columns": _ask(tags=["status", "priority", "absent"]),
    "q07_tags_long": tags_long,
    "q08_id_whitelist": id_whitelist,
    "q09_geometry_points": geometry_points,
    "q10_way_bbox": way_bbox,
    "q11_way_length": way_length,
    "q12_end_values": way_ends,
    "q13_topology_segments": topology_segments,
    "q14_topology_tags": topology_tags,
    "q15_shared_nodes": shared,
    "q16_way_geotype": way_codes,
    "q17_closed_area": closed_area,
    "q18_relation_members": relation_members,
    "q19_relation_geotype": relation_codes,
    "q20_member_antijoin": member_antijoin,
    "q21_ring_counts": ring_counts,
    "q22_multi_split": multi_split,
    "q23_polygon_index": polygon_indices,
    "q24_metadata": metadata,
    "q25_info": info,
    "q26_expand_json": json_fields,
    "q27_first_wins_union": first_wins_union,
    "q28_comparable_string": comparable,
    "q29_default_query": default_query,
    "q30_elements_union": elements_union,
    "q31_way_wkt": way_text,
    "q32_tags_wide": tags_wide,
    "q33_coords": coords_of_ids,
    "q34_strings": strings,
    "q35_json_rows": json_rows,
    "q36_relation_areas": relation_areas,
    "q37_extract_nodes": extract_nodes,
    "q38_extract_ways": extract_ways,
    "q39_extract_relations": extract_relations,
    "q40_extract_info": extract_info,
    "q41_extract_features": extract_features,
    "q42_extract_topology": extract_topology,
    "q43_place_catalogue": place_catalogue,
    "q44_place_files": place_files,
    "q45_relation_rows": relation_rows,
    "q46_point_geometry": point_geometry,
}
