"""Writes extracts for the round-trip tests; covers what the reader must understand."""

import lzma
import struct
import zlib


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def zig(n):
    return (n << 1) ^ (n >> 63)


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def packed(values, signed=False, delta=False):
    last, out = 0, b""
    for v in values:
        x = v - last if delta else v
        last = v
        out += varint(zig(x) if signed else x)
    return out


class Strings:
    def __init__(self):
        self.list = [""]

    def __call__(self, s):
        if s not in self.list:
            self.list.append(s)
        return self.list.index(s)


def _info(e, dense=False):
    out = b""
    for n, k in ((1, "version"), (2, "timestamp"), (3, "changeset")):
        if e.get(k) is not None:
            out += field(n, e[k])
    return field(4, out) if out else b""


def _tags(e, s):
    t = e.get("tags", {})
    return (field(2, packed([s(k) for k in t])) + field(3, packed([s(v) for v in t.values()]))) if t else b""


def node(e, s, unit=1):
    return field(1, zig(e["id"])) + _tags(e, s) + _info(e) + field(8, zig(e["lat"])) + field(9, zig(e["lon"]))


def way(e, s):
    return field(1, e["id"]) + _tags(e, s) + _info(e) + field(8, packed(e["refs"], True, True))


def relation(e, s):
    m = e["members"]
    return field(1, e["id"]) + _tags(e, s) + _info(e) + field(8, packed([s(x[2]) for x in m])) + field(9, packed([x[0] for x in m], True, True)) + field(10, packed([x[1] for x in m]))


def dense(nodes, s):
    out = field(1, packed([n["id"] for n in nodes], True, True))
    if any(n.get("version") for n in nodes):
        out += field(5, field(1, packed([n["version"] for n in nodes])) + field(2, packed([n["timestamp"] for n in nodes], True, True)) + field(3, packed([n["changeset"] for n in nodes], True, True)))
    out += field(8, packed([n["lat"] for n in nodes], True, True)) + field(9, packed([n["lon"] for n in nodes], True, True))
    if any(n.get("tags") for n in nodes):
        kv = []
        for n in nodes:
            for k, v in n.get("tags", {}).items():
                kv += [s(k), s(v)]
            kv.append(0)
        out += field(10, packed(kv))
    return out


def block(groups, granularity=None, lat_offset=None, lon_offset=None, date_granularity=None):
    """groups: lists of (field number, bytes maker taking Strings)."""
    s = Strings()
    bodies = [b"".join(field(n, make(s)) for n, make in group) for group in groups]
    out = field(1, b"".join(field(1, x.encode()) for x in s.list)) + b"".join(field(2, b) for b in bodies)
    for n, v in ((17, granularity), (18, date_granularity), (19, lat_offset), (20, lon_offset)):
        if v is not None:
            out += field(n, v)
    return out


def blob(data, codec="zlib"):
    if codec == "raw":
        return field(1, data)
    body = {"zlib": zlib.compress, "lzma": lzma.compress}.get(codec, zlib.compress)(data)
    return field(2, len(data)) + field({"zlib": 3, "lzma": 4, "lz4": 6}[codec], body)


def framed(kind, body, index=False):
    head = field(1, kind.encode()) + (field(2, b"index") if index else b"") + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def extract(blocks, required=("OsmSchema-V0.6", "DenseNodes"), optional=("Sort.Type_then_ID",)):
    """blocks: (data, codec, index)."""
    header = b"".join(field(4, r.encode()) for r in required) + b"".join(field(5, o.encode()) for o in optional)
    return framed("OSMHeader", blob(header)) + b"".join(framed("OSMData", blob(d, c), i) for d, c, i in blocks)
