import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfold.llm import url_filter as uf
from wayfold.llm.queries import RULES
from wayfold.llm.url_filter import Bloom, Cascade, split_url, url_filter


def by_hand(url, rules=RULES):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    best = None
    for verdict, h, p in rules:
        if host and h and (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (len(h + p), len(h)) > best[0]):
            best = ((len(h + p), len(h)), h + p, verdict)
    return host, path, *(best[1:] if best else (None, "allow"))


def test_split(spark):
    urls = ["HTTP://A.Com/x?y#z", "x", None, "a://b", "a://b?c/d", "a://h#/x://y", "://", "https://É.ORG/Ä", "a://b\n/c\nd?e", "", "a://b//c"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    got = {r[0]: (r[1], r[2]) for r in frame.select("i", *split_url(F.col("u"))).collect()}
    assert got == {i: by_hand(u)[:2] for i, u in enumerate(urls)}


def run(spark, urls, rules):
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    return [(x["host"], x["path"], x["rule"], x["verdict"]) for x in sorted(url_filter(frame, rules).collect())]


def test_borders_and_ties(spark):
    """Host and prefix do not run into each other; prefixes without a slash; equal lengths; many labels."""
    rules = [("block", "com", "en"), ("block", "b.com", "/x"), ("allow", "a.b.com", "/"), ("allow", "c.d.e.f", ""), ("block", "", "/q"), ("block", "B.com", "/x")]
    urls = ["h://comen", "h://com/en", "h://x.comen/", "h://a.b.com/x", "h://b.com/x", "h://1.2.3.4.5.c.d.e.f", "h://.", "h://c.d.e.f./", "h:///q", "h://b.com/x"]
    assert run(spark, urls, rules) == [by_hand(u, [(v, h.lower(), p) for v, h, p in rules]) for u in urls]


def test_equal_values_are_drawn_anew(spark, monkeypatch):
    """Under the first seed every key has the same value; the search ends and stays exact."""
    real = uf.key_value
    monkeypatch.setattr(uf, "key_value", lambda h, p, seed: F.when(F.lit(seed > 1), real(h, p, seed)).otherwise(F.lit(7).cast("long")))
    urls = [f"h://{a}{b}{c}" for a in ("", "x.") for b in ("example.com", "example.net", "org") for c in ("/en/7", "/de/8", "/es/", "/")]
    assert run(spark, urls, RULES) == [by_hand(u) for u in urls]
    one = np.array([5], np.uint64)
    first = Bloom(1, 0.01)
    first.add(one, 0)
    with pytest.raises(ValueError):
        Cascade.build(one, first, one)


def test_same_as_rules(spark):
    r = random.Random(5)
    urls = [f"{r.choice(['http', 'HTTPS'])}://{r.choice(['', 'a.', 'b.c.', 'www.'])}{r.choice(['example.com', 'Example.net', 'example.org', 'com', 'xcom', 'org.de'])}{r.choice(['', '/', '/en/', '/en/7', '/en/71?x', '/de/8#t', '/de/', '/es/', '/es', '/en?/de/'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "x://", urls[0]]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in url_filter(df, RULES).collect()}
    assert got == {i: by_hand(u) for i, u in enumerate(urls)}
    assert url_filter(df.limit(0), RULES).count() == 0
    assert {x["verdict"] for x in url_filter(df, []).collect()} == {"allow"}
    assert url_filter(df.withColumn("_keys", F.lit(1)), RULES).columns == ["page_id", "url", "_keys", "host", "path", "rule", "verdict"]


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, (1 << 64) - 1), min_size=1, max_size=60), st.sets(st.integers(0, (1 << 64) - 1), max_size=200), st.floats(0.01, 0.6))
def test_cascade_is_exact_on_its_universe(listed, others, rate):
    others -= listed
    a, b = np.array(sorted(listed), np.uint64), np.array(sorted(others), np.uint64)
    first = Bloom(len(a), rate)
    first.add(a, 0)
    cascade = Cascade.build(a, first, b[first.test(b, 0)])
    assert cascade.contains(a).all() and not cascade.contains(b).any()
    assert not Cascade().contains(np.array([1], np.uint64)).any()
