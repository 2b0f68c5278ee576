"""URL filter: exact rule membership from cascades of Bloom filters, without a join.

Each verdict has a cascade.  Level 0 encodes its listed keys.  The corpus's complete key universe
(every host suffix of every url with every path prefix that a rule could name) is probed against
it; the universe keys that pass without being listed are its false positives and make level 1, the
listed keys that pass level 1 make level 2, and so on until a level has no false positives.  On that
universe the answer is exact: a key is listed iff it stops at an odd level.

Hosts, paths and keys are cut by SQL functions; Python sees the keys' 64-bit values, and the keys
themselves only where they pass level 0.  Should a key of the corpus have a listed key's value, all
values are drawn anew, so equal values never stand for different keys.

Sizes: level 0 grows with the rule list (a parameter, checked against ``MAX_RULES``); its
false-positive rate is lowered with the universe, so level 1 holds about ``FP_TARGET`` keys
however large the corpus is.  Only the filters travel, never the universe.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import mix

MAX_RULES = 1_000_000
FP_TARGET = 4096
_U = np.uint64
_MUL = _U(0xA24BAED4963EE407)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """``host, prefix`` of the keys that a rule fitting this url could have, the longest first, of equal ones the longer host."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), n - (labels - 1)), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))
    fits = F.filter(F.array(*[F.lit(k) for k in lengths]), lambda k: k <= F.length(path))
    key = lambda s, k: F.struct((-F.length(s) - k).alias("n"), (-F.length(s)).alias("m"), s.alias("host"), F.substr(path, F.lit(1), k).alias("prefix"))
    keys = F.array_sort(F.flatten(F.transform(suffixes, lambda s: F.transform(fits, lambda k: key(s, k)))))
    found = F.transform(keys, lambda c: F.struct(c["host"].alias("host"), c["prefix"].alias("prefix")))
    return F.when(host != "", found).otherwise(F.slice(found, 1, 0))


def key_value(host: Column, prefix: Column, seed: int) -> Column:
    """The 64-bit value of a key; host and prefix are hashed one after the other, so their border counts."""
    return F.xxhash64(F.lit(seed), host, prefix)


class Bloom:
    def __init__(self, expected: int, rate: float):
        bits = max(64, math.ceil(-max(1, expected) * math.log(rate) / math.log(2) ** 2))
        self.bits = (bits + 7) // 8 * 8
        self.hashes = max(1, round(-math.log2(rate)))
        self.level = np.zeros(self.bits // 8, np.uint8)

    def _places(self, values: np.ndarray, seed: int) -> Iterator[np.ndarray]:
        a = mix(values + _U((seed * 2 + 1) * int(_MUL) % (1 << 64)))
        b = mix(a + _MUL) | _U(1)
        for k in range(self.hashes):
            yield (a + _U(k) * b) % _U(self.bits)

    def add(self, values: np.ndarray, seed: int) -> None:
        for p in self._places(values, seed):
            np.bitwise_or.at(self.level, (p >> _U(3)).astype(np.int64), (_U(1) << (p & _U(7))).astype(np.uint8))

    def test(self, values: np.ndarray, seed: int) -> np.ndarray:
        ok = np.ones(len(values), bool)
        for p in self._places(values, seed):
            ok &= (self.level[(p >> _U(3)).astype(np.int64)] >> (p & _U(7)).astype(np.uint8)) & 1 > 0
        return ok


class Cascade:
    """Alternating filters; ``contains`` is exact on the universe that it was built over."""

    def __init__(self) -> None:
        self.levels: list[Bloom] = []

    def contains(self, values: np.ndarray) -> np.ndarray:
        answer = np.zeros(len(values), bool)
        live = np.ones(len(values), bool)
        for i, bloom in enumerate(self.levels):
            passed = np.zeros(len(values), bool)
            at = np.flatnonzero(live)
            passed[at] = bloom.test(values[at], i)
            answer[live & ~passed] = i % 2 == 1
            live = passed
        answer[live] = len(self.levels) % 2 == 1
        return answer

    @classmethod
    def build(cls, listed: np.ndarray, first: Bloom, false_positives: np.ndarray) -> Cascade:
        """``false_positives`` pass ``first`` and are not listed; a value on both sides could never be told apart."""
        self = cls()
        self.levels.append(first)
        inside, outside = np.unique(listed), np.unique(false_positives)
        if len(np.intersect1d(inside, outside)):
            raise ValueError("a listed key and another one have the same value")
        while len(outside):
            level = Bloom(len(outside), 0.5)
            level.add(outside, len(self.levels))
            hit = inside[level.test(inside, len(self.levels))]
            self.levels.append(level)
            inside, outside = outside, hit
        return self


def _cascades(spark: SparkSession, keys: DataFrame, listed: dict[tuple[str, str], str]) -> tuple[int, list[tuple[str, Cascade]]]:
    """(seed, cascade of each verdict), exact on ``keys`` (one row of candidate keys for each url)."""
    rules = spark.createDataFrame([(h, p) for h, p in listed], "host string, prefix string")
    seed = 0
    while True:
        seed += 1
        of = {(r[0], r[1]): r[2] for r in rules.select("host", "prefix", key_value(F.col("host"), F.col("prefix"), seed)).collect()}  # the rules, at most MAX_RULES
        values = {v: np.array([of[k] for k, x in listed.items() if x == v], np.int64).view(_U) for v in dict.fromkeys(listed.values())}
        valued = keys.withColumn("value", F.transform("keys", lambda c: key_value(c["host"], c["prefix"], seed)))
        size = int(valued.select(F.explode("value").alias("v")).agg(F.approx_count_distinct("v", 0.02)).first()[0])
        first = {v: Bloom(len(x), min(0.01, FP_TARGET / max(1, size * len(values)))) for v, x in values.items()}
        for v, x in values.items():
            first[v].add(x, 0)

        def passing(batches, first=first):
            for batch in batches:
                own = batch.column(1).flatten()
                at = own.to_numpy().view(_U)
                hit = np.flatnonzero(np.any([f.test(at, 0) for f in first.values()], axis=0)) if len(at) else np.empty(0, np.int64)
                found = batch.column(0).flatten().take(pa.array(hit))
                yield pa.RecordBatch.from_arrays([found.field(0), found.field(1), own.take(pa.array(hit))], ["host", "prefix", "value"])

        # the listed keys that occur and about FP_TARGET others
        found = valued.select("keys", "value").mapInArrow(passing, "host string, prefix string, value long").distinct().collect()
        every = set(of.values())
        if len(every) < len(of) or any(r["value"] in every and (r["host"], r["prefix"]) not in of for r in found):
            continue
        met = np.array([r["value"] for r in found], np.int64).view(_U)
        cascades = []
        for v, x in values.items():
            others = np.setdiff1d(np.concatenate([met, *values.values()]), x)
            cascades.append((v, Cascade.build(x, first[v], others[first[v].test(others, 0)])))
        return seed, cascades


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host, path, rule, verdict`` to ``pages``.

    ``rules`` are (verdict, host, path prefix); the prefix need not begin with a slash and may be
    empty.  A rule fits its host and all subdomains when the url's path starts with its prefix;
    the longest fitting rule wins (host and prefix together, of equal ones the longer host), a
    repeated rule counts once and its first verdict holds.  A url that no rule fits gets
    ``default``.  Null urls and urls without ``://`` have empty host and path and fit no rule
    (a rule with an empty host fits nothing).  Repeated rows stay; columns of ``pages`` with the
    new names are replaced, others kept.  An empty table gives an empty result.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"the rule list is broadcast; it has {len(rules)} rules, more than {MAX_RULES}")
    listed: dict[tuple[str, str], str] = {}
    for verdict, host, prefix in rules:
        if host:
            listed.setdefault((host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), prefix), verdict)
    host, path = split_url(F.col(f"`{url_col}`").cast("string"))
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in {"host", "path", "rule", "verdict"}]
    if not listed:
        return pages.select(*kept, host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels, lengths = max(h.count(".") + 1 for h, _ in listed), sorted({len(p) for _, p in listed})
    # names that no column of the pages has
    mark = "_" * (max(map(len, pages.columns)) + 1)
    parts = pages.select(*kept, host.alias(f"{mark}h"), path.alias(f"{mark}p"))
    keyed = parts.withColumn(f"{mark}keys", candidate_keys(F.col(f"{mark}h"), F.col(f"{mark}p"), labels, lengths))
    seed, cascades = _cascades(pages.sparkSession, keyed.select(F.col(f"{mark}keys").alias("keys")), listed)

    @F.arrow_udf("at int, verdict string")
    def judge(values: pa.Array) -> pa.Array:
        """The first key in each row that a cascade holds."""
        own, off = values.flatten().to_numpy().view(_U), values.offsets.to_numpy()
        off = off - off[0]
        at, verdict = np.full(len(values), np.iinfo(np.int32).max, np.int32), np.full(len(values), default, object)
        row = np.repeat(np.arange(len(values)), np.diff(off))
        for name, cascade in cascades:
            hit = np.flatnonzero(cascade.contains(own))
            rows, begin = np.unique(row[hit], return_index=True)
            place = (hit[begin] - off[rows] + 1).astype(np.int32)
            better = place < at[rows]
            at[rows[better]], verdict[rows[better]] = place[better], name
        none = at == np.iinfo(np.int32).max
        return pa.StructArray.from_arrays([pa.array(at, mask=none), pa.array(verdict.tolist(), pa.string())], ["at", "verdict"])

    keys, found = F.col(f"{mark}keys"), F.col(f"{mark}found")
    judged = keyed.withColumn(f"{mark}found", judge(F.transform(keys, lambda c: key_value(c["host"], c["prefix"], seed))))
    rule = F.get(keys, found["at"] - 1)
    return judged.select(*kept, F.col(f"{mark}h").alias("host"), F.col(f"{mark}p").alias("path"), F.concat(rule["host"], rule["prefix"]).alias("rule"), found["verdict"].alias("verdict"))
