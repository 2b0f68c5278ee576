import struct

import pytest
from pyspark.sql import functions as F

from wayfold.dataset import OsmDataset
from wayfold.operators import tags as tag_ops
from wayfold.plans.query import OsmQuery
from wayfold.schema import NODES, RELATIONS, WAYS
from wayfold.sources.pbf import read_pbf
from wayfold.sources.pbf_sink import packed_varints, write_pbf
from wayfold.sources.wire import packed


@pytest.fixture
def data(spark):
    nodes = [(i, float(i), float(i * i % 7), {"source": "survey"} if i == 3 else None, None, None, None) for i in range(8)]
    ways = [(1, [0, 1, 2, 3], {"source": "x", "osmid": "y", "missing_refs": "z"}, 4, None, 9), (2, [2, 5, 99], {"highway": "a"}, None, None, None), (3, [6], {"highway": "b"}, None, None, None)]
    relations = [(7, [(1, 1, "outer"), (2, 0, "")], {"type": "route", "role": "r"}, None, None, None), (8, [], {"type": "site"}, None, None, None)]
    return OsmDataset(spark.createDataFrame(nodes, NODES), spark.createDataFrame(ways, WAYS), spark.createDataFrame(relations, RELATIONS))


def test_names_never_clash(data):
    rows = data.query(OsmQuery(relations=True, tags=["type", "role", "TYPE"]), ordered=True)
    assert rows.columns == ["osmtype", "osmid", "pos", "memid", "type", "role", "geom", "tag_type", "tag_role", "tag_tag_TYPE"]
    assert [(r["osmid"], r["memid"], r["type"], r["tag_type"], r["tag_role"]) for r in rows.collect()] == [(7, 1, 1, "route", "r"), (7, 2, 0, "route", "r"), (8, None, None, "site", None)]
    q = OsmQuery(ways=True, geometry=True, topology=True, metadata=True, tags=["source", "osmid", "missing_refs", "highway"])
    found = data.query(q, form="wkt")
    assert found.columns == ["osmtype", "osmid", "changeset", "timestamp", "version", "seg", "source", "target", "missing_refs", "geometry", "tag_source", "tag_osmid", "tag_missing_refs", "highway"]
    got = sorted((r["osmid"], r["seg"], r["source"], r["target"], r["tag_source"], r["missing_refs"], r["changeset"]) for r in found.collect())
    assert got == [(1, 0, 0, 2, "x", 0, 9), (1, 1, 2, 3, "x", 0, 9), (2, 0, 2, 99, None, 1, None)]
    wide = data.query(OsmQuery(ways=True, geometry=True), form="wkt", wide=True)
    assert {"tag_osmid", "tag_missing_refs", "source", "highway"} <= set(wide.columns) and len(set(wide.columns)) == len(wide.columns)


def test_attributes_come_without_a_join_on_the_key(data):
    plan = data.query(OsmQuery(ways=True, geometry=True, topology=True, tags=["source"]), form="parts")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 3  # shared nodes, the way's own references, coordinates
    assert data.query(OsmQuery(ways=True, nodes=True, geometry=True))._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_reference_system_and_order(data):
    found = data.query(OsmQuery(nodes=True, ways=True, geometry=True, tags=False), form="ewkb", ordered=True).collect()
    assert [(r["osmid"], r["osmtype"]) for r in found] == sorted((r["osmid"], r["osmtype"]) for r in found)
    for r in found:
        kind, srid = struct.unpack("<II", r["geometry"][1:9])
        assert (kind, srid) == ((1 if r["osmtype"] == 0 else 2) | 0x20000000, 4326)
    text = data.query(OsmQuery(nodes=True, geometry=True, node_ids=[3]), form="ewkt").first()["geometry"]
    assert text == "SRID=4326;POINT (3.0 2.0)"


def test_ids_from_a_table_and_too_many_keys(spark, data, monkeypatch):
    listed = spark.createDataFrame([(2,), (2,), (50,)], "n long")
    assert [r["osmid"] for r in data.query(OsmQuery(ways=True, way_ids=listed)).collect()] == [2]
    assert OsmQuery(ways=True, way_ids=listed).append_tags(["a"]).as_dict()["way_ids"] is listed
    monkeypatch.setattr(tag_ops, "MAX_KEYS", 3)
    with pytest.raises(ValueError, match="more than 3"):
        data.query(OsmQuery(ways=True), wide=True)


def test_sink_round_trip(spark, data, tmp_path):
    frames = {"nodes": data.nodes, "ways": data.ways.withColumn("timestamp", F.lit("2020-02-03 04:05:06").cast("timestamp")), "relations": data.relations}
    made = write_pbf(frames, str(tmp_path / "out"))
    assert made and all(m.endswith(".osm.pbf") for m in made)
    for kind, frame in frames.items():
        plain = lambda df: sorted(((r[0], str(r[1:3]), sorted((r["tags"] or {}).items()), r["timestamp"], r["version"] or 0) for r in df.collect()), key=repr)
        assert plain(read_pbf(spark, str(tmp_path / "out"), kind).select(*frame.columns)) == plain(frame.withColumn("tags", F.coalesce("tags", F.create_map().cast("map<string,string>"))) if kind == "nodes" else frame)
    values = [0, -1, 1, 127, 128, 1 << 40, -(1 << 40), (1 << 62)]
    assert packed(packed_varints(values, True, True), True, True).tolist() == values
