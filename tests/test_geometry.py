import random
import struct

import pytest
from pyspark.sql import functions as F

from wayfold.dataset import OsmDataset
from wayfold.functions.wkt import to_wkt, wkb
from wayfold.operators.geometry import collect_parts, gather, polygons
from wayfold.operators.geotype import relation_geotype, way_geotype
from wayfold.operators.rings import chain
from wayfold.operators.topology import segments
from wayfold.plans.query import OsmQuery
from wayfold.schema import NODES, RELATIONS, WAYS
from wayfold.streaming.elements import changes_by_key, stream_query, stream_tables


def world(spark, ways=(), relations=(), extra=()):
    """Nodes 1..40 on a grid of ten columns; ways (id, refs, tags); relations (id, members, tags)."""
    nodes = [(i, float(i % 10), float(i // 10), {}, None, None, None) for i in range(1, 41)]
    nodes += [(i, None, None, None, None, None, None) for i in extra]
    return OsmDataset(
        spark.createDataFrame(nodes, NODES),
        spark.createDataFrame([(i, r, t, 1, None, 2) for i, r, t in ways], WAYS),
        spark.createDataFrame([(i, m, t, 1, None, 2) for i, m, t in relations], RELATIONS),
    )


def cut(spark, ways):
    return sorted((r["id"], r["seg"], r["source"], r["target"]) for r in segments(spark.createDataFrame(ways, "id long, refs array<long>"), "id").collect())


def test_topology_cases(spark):
    assert cut(spark, [(1, [1, 2, 3]), (2, [4, 2, 5])]) == [(1, 0, 1, 2), (1, 1, 2, 3), (2, 0, 4, 2), (2, 1, 2, 5)]
    assert cut(spark, [(1, [1, 2, 3, 1])]) == [(1, 0, 1, 1)]
    assert cut(spark, [(1, [1, 2, 3, 2, 4])]) == [(1, 0, 1, 2), (1, 1, 2, 2), (1, 2, 2, 4)]
    assert cut(spark, [(1, [9])]) == [] and cut(spark, [(1, None), (2, [])]) == []


def test_segments_rebuild_their_way(spark):
    r = random.Random(4)
    ways = [(i, [r.randint(1, 30) for _ in range(r.randint(2, 12))], {}) for i in range(40)]
    data = world(spark, ways)
    rows = data.query(OsmQuery(ways=True, geometry=True, topology=True), form="parts").collect()
    by = {}
    for x in sorted(rows, key=lambda x: (x["osmid"], x["seg"])):
        line = [(p["lon"], p["lat"]) for p in x["parts"][0][0]]
        by[x["osmid"]] = by[x["osmid"]][:-1] + line if x["osmid"] in by else line
    for i, refs, _ in ways:
        assert by[i] == [(float(n % 10), float(n // 10)) for n in refs]
    ends = {}
    for x in rows:
        ends.setdefault(x["osmid"], []).append((x["source"], x["target"]))
    spread = {x["osmid"]: n for x, n in ((x, len(ends[x["osmid"]])) for x in rows)}
    wide = data.ways.repartition(7)
    again = OsmDataset(data.nodes, wide, data.relations).query(OsmQuery(ways=True, geometry=True, topology=True), form="parts")
    assert again.count() == len(rows) and sum(spread.values()) > 0


AREA_CASES = [
    ({"building": "yes"}, 3), ({"area": "no", "building": "yes"}, 2), ({"natural": "cliff"}, 2), ({"barrier": "wall"}, 3),
    ({"highway": "residential"}, 2), ({}, 2), (None, 2), ({"highway": "services"}, 3), ({"shop": "x"}, 3), ({"shops": "x"}, 2),
]


def test_way_codes(spark):
    rows = [(t, [1, 2, 3, 1], c) for t, c in AREA_CASES] + [({"building": "yes"}, [1], 0), ({"building": "yes"}, [1, 2], 2), ({"building": "yes"}, [1, 2, 1], 2), ({"building": "yes"}, [1, 2, 3, 4, 5], 2), ({"building": "yes"}, None, 0)]
    frame = spark.createDataFrame(rows, "tags map<string,string>, refs array<long>, want int")
    assert frame.filter(way_geotype(F.col("refs"), F.col("tags")) != F.col("want")).count() == 0


def test_relation_codes(spark):
    way, point = (1, 1, "outer"), (1, 0, "")
    rows = [({"type": "route"}, [way], 2), ({"type": "boundary"}, [way], 3), ({"type": "multipolygon"}, [way, point], 0), ({"name": "route"}, [way], 0), (None, [way], 0), ({"type": "route"}, None, 2)]
    frame = spark.createDataFrame(rows, "tags map<string,string>, members array<struct<ref:long,type:int,role:string>>, want int")
    assert frame.filter(relation_geotype(F.col("members"), F.col("tags")) != F.col("want")).count() == 0


def test_ring_chaining():
    assert chain([[1, 2, 3, 1]]) == [[1, 2, 3, 1]]
    assert chain([[1, 2], [3, 2], [3, 4, 1]]) == [[1, 2, 3, 4, 1]]
    assert chain([[1, 2, 3]]) == [[1, 2, 3, 1]]
    assert chain([[1, 2, 1], [5, 6, 7], [7, 5]]) == [[1, 2, 1], [5, 6, 7, 5]]
    assert chain([[1], []]) == []


def area2(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])))


def test_ring_area_does_not_depend_on_member_order():
    place = {i: (i % 10, i // 10) for i in range(1, 41)}
    full = [1, 2, 3, 4, 14, 24, 34, 33, 32, 31, 21, 11, 1]
    pieces = [full[0:4], full[3:7], full[6:10], full[9:]]
    r = random.Random(1)
    for _ in range(20):
        mixed = [p if r.random() < 0.5 else p[::-1] for p in r.sample(pieces, 4)]
        (ring,) = chain(mixed)
        assert area2([place[n] for n in ring]) == area2([place[n] for n in full])


def rings_of(rows, osmid):
    return next(r for r in rows if r["osmid"] == osmid)


OUTER, INNER = [1, 5, 35, 31, 1], [12, 13, 23, 22, 12]


def test_relation_areas(spark):
    ways = [(1, OUTER, {}), (2, INNER, {}), (3, [1, 5], {}), (4, [35, 5], {}), (5, [35, 31, 1], {}), (6, [7, 9, 19, 17, 7], {}), (7, [24, 14, 13, 24], {}), (8, [7, 8, 18, 7], {})]
    m = lambda *x: [(i, 1, role) for i, role in x]
    area = {"type": "multipolygon"}
    relations = [
        (10, m((1, "outer"), (2, "inner")), area), (11, m((2, "inner"), (1, "outer")), area), (12, m((3, "outer"), (4, "outer"), (5, "outer")), area),
        (13, m((1, "outer"), (6, "outer")), area), (14, m((1, "outer"), (6, "outer"), (2, "inner"), (7, "inner")), area),
        (15, [(1, 1, "outer"), (3, 0, "")], area), (16, m((3, ""), (4, "")), {"type": "route"}), (17, m((99, "outer")), area), (18, m((6, "outer"), (1, "outer"), (2, "inner")), area),
    ]
    data = world(spark, ways, relations)
    q = OsmQuery(relations=True, geometry=True)
    rows = data.query(q, form="parts").collect()
    assert len(rows) == 9
    for i in (10, 11):
        assert rings_of(rows, i)["kind"] == "POLYGON" and len(rings_of(rows, i)["parts"][0]) == 2
    assert area2([(p["lon"], p["lat"]) for p in rings_of(rows, 12)["parts"][0][0]]) == area2([(n % 10, n // 10) for n in OUTER])
    assert rings_of(rows, 13)["kind"] == "MULTIPOLYGON" and len(rings_of(rows, 13)["parts"]) == 2
    assert [len(p) for p in rings_of(rows, 14)["parts"]] == [1, 1]
    assert rings_of(rows, 15)["kind"] is None and rings_of(rows, 17)["kind"] is None
    assert rings_of(rows, 16)["kind"] == "MULTILINESTRING"
    assert [len(p) for p in rings_of(rows, 18)["parts"]] == [1, 2]
    inside = data.query(q, form="parts", complex_rings="contain").collect()
    assert [len(p) for p in rings_of(inside, 14)["parts"]] == [3, 1]
    both = data.query(OsmQuery(relations=True, ways=True, geometry=True, tags=False), form="wkb").collect()
    assert {r["osmid"] for r in both if r["osmtype"] == 1} == {8}


def test_points_lines_and_missing_nodes(spark):
    data = world(spark, [(1, [1, 2, 999], {"a": "b"}), (2, [998, 3], {}), (1, [5], {})], extra=[50])
    rows = data.query(OsmQuery(nodes=True, ways=True, geometry=True, tags=["a"]), form="wkt").collect()
    by = {(r["osmtype"], r["osmid"]): r for r in rows}
    assert by[1, 1]["geometry"] == "LINESTRING (1.0 0.0, 2.0 0.0)" and by[1, 1]["missing_refs"] == 1 and by[1, 1]["a"] == "b"
    assert by[1, 2]["geometry"] is None and by[0, 7]["geometry"] == "POINT (7.0 0.0)" and by[0, 50]["geometry"] is None
    assert by[0, 1]["geometry"] == "POINT (1.0 0.0)"


def test_no_match_keeps_the_schema(spark):
    data = world(spark, [(1, [1, 2], {})])
    for q in (OsmQuery(), OsmQuery(ways=True, must_tags=["zz"], geometry=True, tags=["zz"]), OsmQuery(relations=True, metadata=True), OsmQuery(ways=True, geometry=True, topology=True, must_tags=["zz"])):
        found = data.query(q)
        assert found.count() == 0 and found.columns[:2] == ["osmtype", "osmid"] or set(found.columns) >= {"osmid", "osmtype"}


def test_relation_members_without_geometry(spark):
    data = world(spark, [], [(1, [(5, 1, "outer"), (6, 0, "x")], {"type": "site"}), (2, [], {})])
    rows = sorted((r["osmid"], r["pos"], r["memid"], r["type"], r["role"]) for r in data.query(OsmQuery(relations=True)).filter("osmid = 1").collect())
    assert rows == [(1, 0, 5, 1, "outer"), (1, 1, 6, 0, "x")]
    assert data.query(OsmQuery(relations=True)).filter("osmid = 2 and memid is null").count() == 1


def test_multi_collection(spark):
    rows = [(1, 0, "POINT", [[[(1.0, 2.0)]]]), (1, 1, "POINT", [[[(3.0, 4.0)]]]), (2, 0, "POINT", [[[(5.0, 6.0)]]])]
    frame = spark.createDataFrame(rows, "k int, seq int, kind string, parts array<array<array<struct<lon:double,lat:double>>>>")
    got = {r["k"]: r["wkt"] for r in collect_parts(frame, ["k"]).select("k", to_wkt().alias("wkt")).collect()}
    assert got == {1: "MULTIPOINT ((1.0 2.0), (3.0 4.0))", 2: "POINT (5.0 6.0)"}
    mixed = frame.withColumn("kind", F.when(F.col("seq") == 1, "LINESTRING").otherwise(F.col("kind")))
    with pytest.raises(Exception, match="several kinds"):
        collect_parts(mixed, ["k"]).collect()


def test_wkb_and_empty_rings(spark):
    p = {"lon": 1.5, "lat": -2.0}
    assert wkb("POINT", [[[p]]]) == struct.pack("<BI2d", 1, 1, 1.5, -2.0)
    assert wkb("LINESTRING", [[[p, p]]])[:9] == struct.pack("<BII", 1, 2, 2)
    assert wkb("MULTIPOLYGON", [[[p] * 4], [[p] * 4]])[:9] == struct.pack("<BII", 1, 6, 2)
    assert wkb(None, None) is None
    empty = spark.createDataFrame([], "rel long, role string, ring int, points array<struct<lon:double,lat:double>>")
    assert polygons(empty, ["rel"]).count() == 0
    assert gather(spark.createDataFrame([], "k long, refs array<long>"), world(spark).nodes, ["k"]).count() == 0


def test_streaming(spark, tmp_path):
    data = world(spark, [(i, [1, 2], {"highway": "primary" if i % 2 else "no"}) for i in range(10)])
    frame = data.ways.withColumn("timestamp", F.timestamp_seconds(F.col("id") * 600))
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    q = OsmQuery(defaults="highways")
    stream = stream_query(stream_tables(spark, str(tmp_path / "in"), WAYS, 1), q, "ways")
    run = stream.select("osmid", "highway").writeStream.format("memory").queryName("found").start()
    run.processAllAvailable()
    run.stop()
    assert {r["osmid"] for r in spark.table("found").collect()} == {1, 3, 5, 7, 9}
    counts = changes_by_key(stream_tables(spark, str(tmp_path / "in"), WAYS), "highway")
    run = counts.writeStream.format("memory").outputMode("complete").queryName("counts").start()
    run.processAllAvailable()
    run.stop()
    assert {(r["value"], r["n"]) for r in spark.table("counts").collect()} == {("no", 3), ("primary", 3), ("no", 2), ("primary", 2)}
    with pytest.raises(ValueError):
        stream_query(stream, q, "areas")
