import datetime as dt
import sys

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import pbf_writer as w
from wayfold.dataset import OsmDataset
from wayfold.plans.query import OsmQuery
from wayfold.sources import wire
from wayfold.sources.blocks import Block
from wayfold.sources.pbf import PbfReader, _arrow, features, list_files, read_pbf
from wayfold.sources.pbf_sink import _writer, block
from wayfold.sources.tables import pushed_key

NODES = [
    {"id": -5, "lon": 1510000000, "lat": -338000000, "tags": {"amenity": "cafe", "name": "é"}},
    {"id": 7, "lon": 0, "lat": 0},
    {"id": 3_000_000_000, "lon": 1511234567, "lat": -338765432, "tags": {"highway": "stop"}},
]
META = {"version": 3, "timestamp": 1_600_000_000, "changeset": 5_000_000_000}
WAYS = [{"id": 11, "refs": [-5, 7, 3_000_000_000], "tags": {"highway": "primary"}, **META}, {"id": 12, "refs": [7, -5, 3_000_000_000, 7], "tags": {"building": "yes"}}]
RELATIONS = [{"id": 20, "members": [(12, 1, "outer"), (7, 0, "")], "tags": {"type": "multipolygon"}}]


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    one = w.block([[(2, lambda s: w.dense(NODES[:2], s)), (2, lambda s: w.dense(NODES[2:], s))], [(3, lambda s: w.way(WAYS[0], s)), (3, lambda s: w.way(WAYS[1], s))]])
    plain = w.block([[(1, lambda s: w.node({"id": -9, "lon": 25, "lat": -4, "tags": {"a": "b"}, **META}, s))]], granularity=1000, lat_offset=500, lon_offset=-700, date_granularity=500)
    rel = w.block([[(4, lambda s: w.relation(RELATIONS[0], s))]])
    dated = w.block([[(2, lambda s: w.dense([{"id": 50, "lon": 1, "lat": 1, **META}, {"id": 51, "lon": 2, "lat": 2, **META}], s))]])
    p = tmp_path_factory.mktemp("x") / "small.osm.pbf"
    p.write_bytes(w.extract([(one, "zlib", False), (plain, "raw", True), (rel, "lzma", False), (dated, "zlib", True)]))
    return str(p)


def test_nodes_round_trip(spark, path):
    rows = {r["id"]: r for r in read_pbf(spark, path, "nodes", split_bytes=1).collect()}
    assert set(rows) == {-5, 7, 3_000_000_000, -9, 50, 51}
    for n in NODES:
        assert rows[n["id"]]["tags"] == n.get("tags", {})
        assert rows[n["id"]]["lon"] == n["lon"] * 100 / 1e9 and rows[n["id"]]["lat"] == n["lat"] * 100 / 1e9
    plain = rows[-9]
    assert (plain["lon"], plain["lat"]) == ((25 * 1000 - 700) / 1e9, (-4 * 1000 + 500) / 1e9)
    assert (plain["version"], plain["changeset"]) == (3, 5_000_000_000)
    assert plain["timestamp"] == dt.datetime.fromtimestamp(800_000_000, dt.UTC).replace(tzinfo=None)
    assert rows[51]["timestamp"] == dt.datetime.fromtimestamp(1_600_000_000, dt.UTC).replace(tzinfo=None)
    assert rows[7]["version"] is None


def test_ways_and_relations_round_trip(spark, path):
    ways = {r["id"]: r for r in read_pbf(spark, path, "ways").collect()}
    assert {i: r["refs"] for i, r in ways.items()} == {x["id"]: x["refs"] for x in WAYS}
    assert ways[11]["changeset"] == 5_000_000_000
    rel = read_pbf(spark, path, "relations").collect()
    assert [tuple(m) for m in rel[0]["members"]] == RELATIONS[0]["members"]


def test_dataset_of_an_extract(spark, path, tmp_path):
    data = OsmDataset.from_pbf(spark, path)
    assert data.features == {"required": ["OsmSchema-V0.6", "DenseNodes"], "optional": ["Sort.Type_then_ID"]}
    info = {r["kind"]: (r["elements"], r["tagged"], r["blocks"]) for r in data.info().collect()}
    assert info == {"nodes": (6, 3, 3), "ways": (2, 2, 1), "relations": (1, 1, 1)}
    assert {"amenity", "primary", "outer"} <= {r[0] for r in data.strings().collect()}
    assert [r["id"] for r in data.geometry().collect()] == [-9, -5, 7, 50, 51, 3_000_000_000]
    data.to_tables(str(tmp_path / "t"), partitions=1)
    again = OsmDataset.from_tables(spark, str(tmp_path / "t"))
    q = OsmQuery(ways=True, geometry=True, must_tags=["building"], tags=["building"])
    a, b = (d.query(q, form="wkt").collect() for d in (data, again))
    assert a == b and a[0]["geometry"].startswith("POLYGON")
    asked = again.query(OsmQuery(ways=True, must_tags=["building"], tags=["building"]))._jdf.queryExecution().toString()
    assert "IsNotNull(tag_building)" in asked and "refs" not in asked.split("ReadSchema")[1].split(chr(10))[0]
    assert again.query(OsmQuery(ways=True, keep={"highway": ["primary"], "building": []}, exclude={})).count() == data.query(OsmQuery(ways=True, keep={"highway": ["primary"], "building": []}, exclude={})).count() == 2
    plan = pushed_key(again.ways, "highway", ["primary"])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "In(tag_highway" in plan or "EqualTo(tag_highway" in plan


def test_bad_inputs(spark, path, tmp_path):
    for bad in (5, "nowhere.pbf", str(tmp_path)):
        with pytest.raises(ValueError):
            list_files(bad)
    (tmp_path / "x.txt").write_text("")
    with pytest.raises(ValueError):
        list_files(str(tmp_path / "x.txt"))
    strange = tmp_path / "s.pbf"
    strange.write_bytes(w.extract([], required=("Other",)))
    with pytest.raises(NotImplementedError):
        features(str(strange))
    packed = tmp_path / "p.pbf"
    packed.write_bytes(w.extract([(w.block([]), "lz4", False)]))
    with pytest.raises(Exception, match="not supported"):
        read_pbf(spark, str(packed), "nodes").collect()
    empty = tmp_path / "e.pbf"
    empty.write_bytes(w.extract([]))
    assert read_pbf(spark, str(empty), "ways").count() == 0
    assert len(list_files(str(tmp_path / "*.pbf"))) == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(1 << 62), (1 << 62) - 1), max_size=40))
def test_wire_kernels(values):
    assert wire.packed(w.packed(values, signed=True), signed=True).tolist() == values
    small = [v % (1 << 40) for v in values]
    assert wire.packed(w.packed(small, signed=True, delta=True), signed=True, delta=True).tolist() == small
    assert wire.varints(w.packed([v % (1 << 64) for v in values])).tolist() == [v % (1 << 64) for v in values]
    for v in values:
        assert wire.unzigzag(wire.read_varint(w.varint(w.zig(v)), 0)[0]) == v


def test_truncated_varint():
    with pytest.raises(ValueError):
        wire.varints(b"\x80")
    assert len(wire.varints(b"")) == 0 and wire.zigzag(np.array([1], np.uint64))[0] == -1


def test_duplicate_key_takes_the_last(spark, tmp_path):
    body = w.block([[(1, lambda s: w.field(1, w.zig(1)) + w.field(2, w.packed([s("k"), s("k")])) + w.field(3, w.packed([s("x"), s("y")])))]])
    p = tmp_path / "d.pbf"
    p.write_bytes(w.extract([(body, "zlib", False)]))
    assert read_pbf(spark, str(p), "nodes").select(F.element_at("tags", "k")).first()[0] == "y"


def _calls(run):
    """How many Python functions are entered while ``run`` runs."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event == "call"

    sys.setprofile(count)
    try:
        run()
    finally:
        sys.setprofile(None)
    return n


def _elements(kind, n):
    own = {"nodes": lambda i: {"lon": i / 100, "lat": -i / 100}, "ways": lambda i: {"refs": [i, i + 1, i]}, "relations": lambda i: {"members": [{"ref": i, "type": 1, "role": "outer"}]}}[kind]
    rows = [{"id": i, "tags": [("a", str(i % 5)), ("b", "")][: i % 3], "version": i % 7, "timestamp": i * 1000, "changeset": i} | own(i) for i in range(1, n + 1)]
    return pa.RecordBatch.from_pylist(rows, schema=_arrow(kind))


@pytest.mark.parametrize("kind", ["nodes", "ways", "relations"])
def test_work_of_blocks_not_of_rows(kind, tmp_path):
    """Ten times the elements of a block enter no more than twice the Python functions, written and read."""
    took = []
    for n in (200, 200, 2000):  # the first fills caches
        rows, made = _elements(kind, n), []
        at = rows.schema.get_field_index("timestamp")
        dated = rows.set_column(at, "timestamp", rows["timestamp"].cast(pa.timestamp("ms", "UTC")))
        writing = _calls(lambda dated=dated, made=made: made.extend(_writer(kind, str(tmp_path))([dated])))
        reader, got = PbfReader(made[0]["path"][0].as_py(), kind, 32 << 20, None), []
        (part,) = reader.partitions()
        reading = _calls(lambda reader=reader, got=got, part=part: got.extend(reader.read(part)))
        assert [r | {"tags": sorted(r["tags"])} for b in got for r in b.to_pylist()] == [r | {"tags": sorted(r["tags"])} for r in rows.to_pylist()]
        took.append((writing, reading))
    assert took[2][0] <= 2 * took[1][0] and took[2][1] <= 2 * took[1][1]


_BIG = st.integers(-(1 << 61), (1 << 61) - 1)
_SOME = st.none() | st.integers(-(1 << 31), (1 << 31) - 1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(_BIG, st.lists(_BIG, max_size=4), st.dictionaries(st.sampled_from(["a", "é", "k"]), st.sampled_from(["", "v", "a"])), _SOME, _SOME, _SOME), min_size=1, max_size=12), st.integers(0, 3))
def test_blocks_round_trip(found, skipped):
    """Odd rows of every kind, also in a slice of a batch: what is written is read."""
    names = ("id", "tags", "version", "timestamp", "changeset")
    for kind, own in (("ways", lambda refs: {"refs": refs}), ("relations", lambda refs: {"members": [{"ref": r, "type": i % 3, "role": "" if i else "é"} for i, r in enumerate(refs)]})):
        rows = [dict(zip(names, (i, list(tags.items()), *meta), strict=True)) | own(refs) for i, refs, tags, *meta in found]
        part = pa.RecordBatch.from_pylist(rows, schema=_arrow(kind)).slice(min(skipped, len(rows) - 1))
        (read,) = Block(block(kind, part)).columns(kind)
        assert {c: x.to_pylist() for c, x in read.items()} == {c: part[c].to_pylist() for c in read}
    nodes = [dict(zip(names, (i, list(tags.items()), v or 0, t or 0, c or 0), strict=True)) | {"lon": 1.5, "lat": -0.25} for i, _, tags, v, t, c in found]
    part = pa.RecordBatch.from_pylist(nodes, schema=_arrow("nodes"))
    (read,) = Block(block("nodes", part)).columns("nodes")
    assert {c: x.to_pylist() for c, x in read.items()} == {c: part[c].to_pylist() for c in read}


def test_repeated_strings_and_truncated_messages():
    """A key stands twice in the table: the last value stays; what is cut off is an error."""
    s = w.field(1, b"") + w.field(1, b"k") + w.field(1, b"k") + w.field(1, b"x")
    body = w.field(1, 7) + w.field(2, w.packed([1, 2, 3])) + w.field(3, w.packed([1, 3, 1])) + w.field(8, w.packed([5, 6], True, True))
    (read,) = Block(w.field(1, s) + w.field(2, w.field(3, body))).columns("ways")
    assert read["tags"].to_pylist() == [[("k", "x"), ("x", "k")]] and read["refs"].to_pylist() == [[5, 6]]
    for bad in (body[:-1], body + w.field(8, b"\x80"), body + w.field(2, w.packed([1])), body + w.field(3, w.packed([9, 9, 9]))):
        with pytest.raises((ValueError, IndexError)):
            list(Block(w.field(1, s) + w.field(2, w.field(3, bad))).columns("ways"))


def test_kinds_of_a_block():
    """A group of mixed kinds names them all; the count looks at no element's inside and decodes no strings."""
    assert Block(w.block([[(3, lambda s: w.way(WAYS[0], s)), (4, lambda s: w.relation(RELATIONS[0], s))], [(2, lambda s: w.dense(NODES[:1], s))]])).kinds() == {"nodes", "ways", "relations"}
    assert Block(w.block([[(1, lambda s: w.node(NODES[1], s))]])).kinds() == {"nodes"} and Block(b"").kinds() == set()
    small, large = (block("ways", _elements("ways", n)) for n in (200, 2000))
    assert _calls(lambda: Block(large).kinds()) <= 2 * _calls(lambda: Block(small).kinds())
