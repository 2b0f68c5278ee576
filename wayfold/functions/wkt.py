"""WKT in SQL expressions and WKB in one Arrow UDF, from ``kind`` and ``parts``."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SRID

#: Geometry type numbers of the WKB format.
WKB_KIND = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3, "MULTIPOINT": 4, "MULTILINESTRING": 5, "MULTIPOLYGON": 6}


def to_wkt(kind: Column | str = "kind", parts: Column | str = "parts") -> Column:
    kind, parts = (F.col(c) if isinstance(c, str) else c for c in (kind, parts))
    xy = lambda p: F.concat(p["lon"].cast("string"), F.lit(" "), p["lat"].cast("string"))
    line = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, xy), ", "), F.lit(")"))
    rings = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, line), ", "), F.lit(")"))
    several = lambda f: F.concat(F.lit("("), F.array_join(F.transform(parts, f), ", "), F.lit(")"))
    first = F.element_at(parts, 1)
    body = (
        F.when(kind.isin("POINT", "LINESTRING"), line(F.element_at(first, 1)))
        .when(kind == "POLYGON", rings(first))
        .when(kind.isin("MULTIPOINT", "MULTILINESTRING"), several(lambda p: line(F.element_at(p, 1))))
        .when(kind == "MULTIPOLYGON", several(rings))
    )
    return F.concat(kind, F.lit(" "), body)


def _points(points) -> bytes:
    return struct.pack(f"<I{2 * len(points)}d", len(points), *[x for p in points for x in (p["lon"], p["lat"])])


def wkb(kind: str | None, parts) -> bytes | None:
    if kind is None or parts is None:
        return None
    head = lambda k: struct.pack("<BI", 1, WKB_KIND[k])
    if kind == "POINT":
        return head(kind) + struct.pack("<2d", parts[0][0][0]["lon"], parts[0][0][0]["lat"])
    if kind == "LINESTRING":
        return head(kind) + _points(parts[0][0])
    if kind == "POLYGON":
        return head(kind) + struct.pack("<I", len(parts[0])) + b"".join(_points(r) for r in parts[0])
    return head(kind) + struct.pack("<I", len(parts)) + b"".join(wkb(kind[5:], [p]) for p in parts)


@F.arrow_udf(T.BinaryType())
def to_wkb(kind: pa.Array, parts: pa.Array) -> pa.Array:
    return pa.array([wkb(k, p) for k, p in zip(kind.to_pylist(), parts.to_pylist(), strict=True)], pa.binary())


def ewkb(kind: str | None, parts) -> bytes | None:
    """WKB whose type number is marked and followed by the reference system's number."""
    plain = wkb(kind, parts)
    return None if plain is None else plain[:1] + struct.pack("<II", WKB_KIND[kind] | 0x20000000, SRID) + plain[5:]


@F.arrow_udf(T.BinaryType())
def to_ewkb(kind: pa.Array, parts: pa.Array) -> pa.Array:
    return pa.array([ewkb(k, p) for k, p in zip(kind.to_pylist(), parts.to_pylist(), strict=True)], pa.binary())
