import itertools

import pytest
from pyspark.sql import functions as F

from wayfold.operators.tags import only_keys, tag_columns, wide_tags
from wayfold.plans.predicate import IN_LIST, compile_predicate, of_ids, of_relation_type
from wayfold.plans.query import OsmQuery, merge_filters, merge_tags

ROWS = [{"a": "1"}, {"a": "2", "b": "x"}, {"b": "x"}, {"c": "9"}, {}, None, {"a": "1", "b": "y", "c": "9"}]


def by_hand(tags, q):
    tags = tags or {}
    hit = lambda rules: any(k in tags and (not v or tags[k] in v) for k, v in (rules or {}).items())
    must = q.must_tags is None or any(k in tags for k in q.must_tags)
    if q.keep_first:
        return must and (hit(q.keep) if q.keep else True) and not hit(q.exclude)
    return must and (not hit(q.exclude) or hit(q.keep))


def test_predicate_truth_table(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(ROWS)], "id int, tags map<string,string>").cache()
    rules = [None, {}, {"a": ["1"]}, {"a": []}, {"b": ["x", "y"], "c": []}]
    for keep, exclude, first, must in itertools.product(rules, rules, (True, False), (None, ["a"], ["b", "c"])):
        try:
            q = OsmQuery(ways=True, keep=keep, exclude=exclude, keep_first=first, must_tags=must)
        except ValueError:
            assert (first and keep is None and exclude is not None) or (not first and exclude is None and keep is not None)
            continue
        got = {r["id"] for r in frame.filter(compile_predicate(q)).collect()}
        assert got == {i for i, t in enumerate(ROWS) if by_hand(t, q)}, q


def test_exclude_never_grows_a_kept_result(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(ROWS)], "id int, tags map<string,string>")
    q = OsmQuery(ways=True, keep={"a": []}, exclude={"b": ["x"]})
    more = q.append_exclude({"c": []})
    assert {r[0] for r in frame.filter(compile_predicate(more)).collect()} <= {r[0] for r in frame.filter(compile_predicate(q)).collect()}


def test_builder():
    q = OsmQuery(ways=True, tags=["x"])
    assert q.append_tags(["y", "x"]).tags == ("x", "y") and q.tags == ("x",)
    assert q.append_tags(True).tags is True and OsmQuery().append_tags(["z"]).tags == ("z",)
    assert q.append_keep({"k": ["1"]}).append_keep({"k": ["2"], "l": []}).keep == {"k": ("1", "2"), "l": ()}
    assert merge_filters({"k": ["1"]}, {"k": []}) == {"k": ()} and merge_filters({"k": []}, {"k": ["1"]}) == {"k": ()}
    assert q.append_relation_type(["route"]).append_relation_type(["route", "boundary"]).relation_type == ("route", "boundary")
    assert merge_tags(("a",), False) == ("a",)
    with pytest.raises(ValueError):
        merge_filters(None, None)
    with pytest.raises(ValueError):
        OsmQuery(topology=True, ways=True)
    with pytest.raises(ValueError):
        OsmQuery(defaults="rivers")
    with pytest.raises(ValueError):
        OsmQuery(relation_type=[])
    assert OsmQuery(defaults="highways", geometry=True, topology=True).ways
    assert OsmQuery(keep={"a": ["b"]}, exclude={}, must_tags=["m"], tags=["t"]).all_strings() == {"a", "b", "m", "t"}
    assert q.copy(metadata=True).as_dict()["metadata"] and not q.metadata


@pytest.mark.parametrize(("name", "nodes", "ways", "relations", "n"), [("highways", False, True, False, 11), ("buildings", False, True, True, 16), ("pois", True, True, False, 64)])
def test_defaults(name, nodes, ways, relations, n):
    q = OsmQuery(defaults=name)
    assert (q.nodes, q.ways, q.relations, len(q.tags), q.keep_first) == (nodes, ways, relations, n, False)


def test_id_lists(spark):
    frame = spark.range(5000)
    assert of_ids(frame, None).count() == 5000 and of_ids(frame, []).count() == 0
    assert of_ids(frame, [1, 2, 99999]).count() == 2
    long = of_ids(frame, range(IN_LIST + 5))
    assert long.count() == IN_LIST + 5 and "LeftSemi" in long._jdf.queryExecution().toString()
    assert of_ids(frame, spark.range(3)).count() == 3


def test_tag_shapes(spark):
    frame = spark.createDataFrame([(1, {"a": "x"}), (2, None)], "id int, tags map<string,string>")
    assert [tuple(r) for r in tag_columns(frame, ["a", "zz"]).orderBy("id").collect()] == [(1, "x", None), (2, None, None)]
    assert wide_tags(frame, ["id"]).columns == ["id", "a"]
    assert only_keys(frame, []).filter(F.size("tags") > 0).count() == 0
    rel = spark.createDataFrame([(1, {"type": "route"}), (2, {}), (3, None)], "id int, tags map<string,string>")
    assert of_relation_type(rel, ["route"]).count() == 1 and of_relation_type(rel, None).count() == 3
