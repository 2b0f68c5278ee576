import json
import zipfile

import pytest
from pyspark.sql import functions as F

from wayfold.functions.json import expand_json
from wayfold.functions.text import comparable_string, zip_name
from wayfold.sources.places import Places, from_city_list, from_json_index


@pytest.fixture
def places(spark, tmp_path):
    index = {"features": [{"properties": {"name": n, "urls": {"pbf": f"one/{n}"}}} for n in ("Aland", "Bern")]}
    (tmp_path / "index.json").write_text(json.dumps(index))
    lines = [f"# {i}" for i in range(5)] + ["Bern:x:y", "Cork:z"] + [f"end {i}" for i in range(8)]
    (tmp_path / "cities.csv").write_text("\n".join(lines) + "\n")
    return Places(from_json_index(spark, str(tmp_path / "index.json"), "one"), from_city_list(spark, str(tmp_path / "cities.csv"), "two", "two/{}/{}.osm.pbf"))


def test_catalogue(places):
    assert {r["name"] for r in places.valid_names().collect()} == {"Aland", "Bern", "Cork"}
    assert places.urls("Bern") == ["one/Bern"] and places.urls(["Cork", "Aland"]) == {"Cork": ["two/Cork/Cork.osm.pbf"], "Aland": ["one/Aland"]}
    for bad in ("Nowhere", 7):
        with pytest.raises(ValueError):
            places.urls(bad)


def test_download(places, tmp_path):
    get = lambda url: url.encode()
    out = tmp_path / "out"
    out.mkdir()
    assert places.download(str(out), "Bern", get) == [f"{out}/Bern.osm.pbf"]
    assert (out / "Bern.osm.pbf").read_bytes() == b"one/Bern"
    (made,) = places.download(str(out), ["Cork"], get, rename=["c"], compress=True)
    assert made.endswith("c.osm.pbf.zip") and zipfile.ZipFile(made).read("c.osm.pbf") == b"two/Cork/Cork.osm.pbf"
    for kw in ({"place": ["Bern"], "rename": "x"}, {"place": ["Bern"], "rename": ["x", "y"]}, {"place": "Bern", "rename": ["x"]}):
        with pytest.raises(ValueError):
            places.download(str(out), get=get, **kw)

    def broken(url):
        raise OSError("no network")

    with pytest.raises(OSError, match="Aland is missing"):
        places.download(str(out), "Aland", broken)
    assert not (out / "Aland.osm.pbf").exists()


def test_text(spark):
    frame = spark.createDataFrame([("l’éte'",), (None,)], "s string")
    assert [r[0] for r in frame.select(comparable_string(F.col("s"))).collect()] == ["LÉTE", None]
    assert zip_name("a") == "a.zip" and zip_name("a.zip") == "a.zip"
    assert frame.select(zip_name(F.lit("b.zip"))).first()[0] == "b.zip"


def test_expand_json(spark):
    frame = spark.createDataFrame([(1, '{"a": 1, "b": null}'), (2, None), (3, "broken")], "i int, j string")
    assert [tuple(r) for r in expand_json(frame, "j", "a int, b int").orderBy("i").collect()] == [(1, 1, None), (2, None, None), (3, None, None)]
    assert expand_json(frame, "j", "a int, b int", subset=["a"]).columns == ["i", "a"]
    assert [tuple(r) for r in expand_json(frame, "j", "map<string,int>", unstack=True).collect()] == [(1, 1)]
    with pytest.raises(ValueError):
        expand_json(frame, "j", "a int", subset=["a"], unstack=True)
