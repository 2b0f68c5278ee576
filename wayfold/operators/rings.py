"""Rings of area relations, assembled from open member ways: one small group for each relation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RINGS = "rel long, role string, ring int, refs array<bigint>"


def chain(ways: list[list[int]]) -> list[list[int]]:
    """Closed rings of node ids from ways in member order.

    A closed way is a ring.  Otherwise the ring starts at the first unused way and is extended
    by the first unused way that starts at its open end, else by the first that ends there,
    reversed; when neither exists the ring is closed as it is.
    """
    rings: list[list[int]] = []
    left = [w for w in ways if len(w) >= 2]
    starts: dict[int, list[int]] = {}
    ends: dict[int, list[int]] = {}
    for i, w in enumerate(left):
        starts.setdefault(w[0], []).append(i)
        ends.setdefault(w[-1], []).append(i)
    used = [False] * len(left)

    def take(index: dict[int, list[int]], node: int) -> int | None:
        places = index.get(node, [])
        while places and used[places[0]]:
            places.pop(0)
        return places[0] if places else None

    for i, way in enumerate(left):
        if used[i]:
            continue
        used[i] = True
        ring = list(way)
        while ring[0] != ring[-1]:
            j = take(starts, ring[-1])
            if j is not None:
                more = left[j]
            else:
                j = take(ends, ring[-1])
                if j is None:
                    break
                more = left[j][::-1]
            used[j] = True
            ring += more[1:]
        rings.append(ring if ring[0] == ring[-1] else [*ring, ring[0]])
    return rings


def assemble_rings(members: DataFrame) -> DataFrame:
    """``rel, role, ring, refs`` from ``rel, pos, role, refs``; any role but inner counts as outer."""

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["pos"])
        out: dict[str, list] = {"rel": [], "role": [], "ring": [], "refs": []}
        for role in ("outer", "inner"):
            for ring in chain([r["refs"] for r in rows if r["refs"] and r["role"] == role]):
                out["rel"].append(rows[0]["rel"])
                out["role"].append(role)
                out["ring"].append(len(out["ring"]))
                out["refs"].append(ring)
        return pa.table({"rel": pa.array(out["rel"], pa.int64()), "role": pa.array(out["role"], pa.string()), "ring": pa.array(out["ring"], pa.int32()), "refs": pa.array(out["refs"], pa.list_(pa.int64()))})

    roles = members.select("rel", "pos", F.when(F.col("role") == "inner", "inner").otherwise("outer").alias("role"), "refs")
    return roles.groupBy("rel").applyInArrow(build, RINGS)
