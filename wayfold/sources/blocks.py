"""Blobs and primitive blocks of the ``.osm.pbf`` format to rows."""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Iterator
from functools import cached_property
from typing import BinaryIO

import numpy as np
import pyarrow as pa

from .wire import fields, fields_of, messages, packed, packed_spans, read_varint, signed64, spread, zigzag

#: Required features that a reader must know; fixed values of the format.
KNOWN_FEATURES = {"OsmSchema-V0.6", "DenseNodes"}
NANO = 1_000_000_000
#: Fields of a group that hold each kind of element.
NUMBERS = {"nodes": {1, 2}, "ways": {3}, "relations": {4}}


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())


def blob_headers(f: BinaryIO) -> Iterator[tuple[str, int, int]]:
    """(type, offset, size) of every blob, by seeking from header to header."""
    while True:
        head = f.read(4)
        if not head:
            return
        if len(head) < 4:
            raise ValueError("truncated file")
        kind, size = "", 0
        for number, value in fields(f.read(int.from_bytes(head, "big"))):
            if number == 1:
                kind = bytes(value).decode()
            elif number == 3:
                size = value
        at = f.tell()
        yield kind, at, size
        f.seek(at + size)


def inflate(blob: bytes) -> bytes:
    for number, value in fields(blob):
        if number == 1:
            return bytes(value)
        if number == 3:
            return zlib.decompress(value)
        if number == 4:
            return lzma.decompress(value)
        if number == 7:
            try:
                import zstandard
            except ImportError as e:
                raise NotImplementedError("zstd blobs need the zstandard package") from e
            return zstandard.ZstdDecompressor().decompressobj().decompress(bytes(value))
        if number in (5, 6):
            raise NotImplementedError("bzip2 and lz4 blobs are not supported")
    raise ValueError("blob without data")


def header_features(block: bytes) -> tuple[list[str], list[str]]:
    """(required, optional) features; an unknown required one is an error."""
    required = [bytes(v).decode() for n, v in fields(block) if n == 4]
    optional = [bytes(v).decode() for n, v in fields(block) if n == 5]
    unknown = set(required) - KNOWN_FEATURES
    if unknown:
        raise NotImplementedError(f"required features {sorted(unknown)} are not supported")
    return required, optional


class Block:
    """One decoded primitive block; elements are decoded column by column, all messages of a group at once."""

    def __init__(self, data: bytes):
        self._table: memoryview = memoryview(b"")
        self.raw = np.frombuffer(data, np.uint8)
        self.groups: list[memoryview] = []
        self._at: list[int] = []
        self.granularity, self.date_granularity, self.lat_offset, self.lon_offset = 100, 1000, 0, 0
        whole = memoryview(data)
        numbers, starts, ends = messages(whole)
        for number, start, end in zip(numbers.tolist(), starts.tolist(), ends.tolist(), strict=True):
            if number == 1:
                self._table = whole[start:end]
            elif number == 2:
                self.groups.append(whole[start:end])
                self._at.append(start)
        for number, value in fields(data):
            if number == 17:
                self.granularity = value
            elif number == 18:
                self.date_granularity = value
            elif number == 19:
                self.lat_offset = signed64(value)
            elif number == 20:
                self.lon_offset = signed64(value)

    @cached_property
    def strings(self) -> pa.Array:
        return pa.array([bytes(s).decode("utf-8") for n, s in fields(self._table) if n == 1], pa.string())

    @cached_property
    def _own(self) -> np.ndarray:
        """A number for each place of the table, alike for like strings."""
        return self.strings.dictionary_encode().indices.to_numpy()

    def kinds(self) -> set[str]:
        """The kinds of elements that occur."""
        numbers = {n for g in self.groups for n in np.unique(messages(g)[0]).tolist()}
        return {kind for kind, own in NUMBERS.items() if own & numbers}

    def columns(self, kind: str) -> Iterator[dict[str, pa.Array]]:
        """The elements of a kind, each group's as columns."""
        for group, at in zip(self.groups, self._at, strict=True):
            numbers, starts, ends = messages(group, at)
            if kind == "nodes":
                for i in np.flatnonzero(numbers == 2):
                    yield self._dense(group[starts[i] - at : ends[i] - at])
            mine = numbers == {"nodes": 1, "ways": 3, "relations": 4}[kind]
            if mine.any():
                yield self._elements(kind, starts[mine], ends[mine])

    def _degrees(self, raw: np.ndarray, offset: int) -> pa.Array:
        return pa.array((raw * self.granularity + offset) / NANO)

    def _texts(self, places: np.ndarray) -> pa.Array:
        return self.strings.take(pa.array(places))

    def _tags(self, keys: np.ndarray, values: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Maps from the places of keys and values; of a key that an element repeats the last value stays."""
        if len(keys) and max(keys.max(), values.max()) >= len(self.strings) or min(keys.min(initial=0), values.min(initial=0)) < 0:
            raise IndexError("a tag's string is not in the table")
        row = np.repeat(np.arange(len(counts)), counts)
        own = row * len(self.strings) + self._own[keys] if len(keys) else row
        _, first = np.unique(own, return_index=True)
        if len(first) < len(own):
            last = len(own) - 1 - np.unique(own[::-1], return_index=True)[1]
            order = np.argsort(first)
            keys, values, counts = keys[first[order]], values[last[order]], np.bincount(row[first], minlength=len(counts))
        return pa.MapArray.from_arrays(_offsets(counts), self._texts(keys), self._texts(values))

    def _elements(self, kind: str, starts: np.ndarray, ends: np.ndarray) -> dict[str, pa.Array]:
        n = len(starts)
        numbers: dict[str, np.ndarray] = {c: np.zeros(n, np.int64) for c in ("id", "version", "timestamp", "changeset", "lat", "lon")}
        seen = {c: np.zeros(n, bool) for c in numbers}
        spans = {f: (np.zeros(n, np.int64), np.zeros(n, np.int64)) for f in (2, 3, *({"nodes": (), "ways": (8,), "relations": (8, 9, 10)}[kind]))}
        plain = {1: "id"} | ({8: "lat", 9: "lon"} if kind == "nodes" else {})

        def take(name: str, rows: np.ndarray, values: np.ndarray, size: np.ndarray) -> None:
            if (size >= 0).any():
                raise ValueError(f"{name} is no number")
            numbers[name][rows], seen[name][rows] = values.astype(np.int64), True

        for rows, number, value, at, size in fields_of(self.raw, starts, ends):
            for f in np.unique(number).tolist():
                m = number == f
                if f in plain:
                    take(plain[f], rows[m], value[m], size[m])
                elif (f in spans or f == 4) and (size[m] < 0).any():
                    raise ValueError(f"field {f} is not packed")
                elif f in spans:
                    spans[f][0][rows[m]], spans[f][1][rows[m]] = at[m], size[m]
                elif f == 4:
                    for r, name, v, _, s in fields_of(self.raw, at[m], at[m] + size[m]):
                        for g, own in ((1, "version"), (2, "timestamp"), (3, "changeset")):
                            take(own, rows[m][r[name == g]], v[name == g], s[name == g])
        read = lambda f, **how: packed_spans(self.raw, *spans[f], **how)
        numbers["timestamp"] *= self.date_granularity
        out = {c: pa.array(numbers[c], mask=~seen[c]) for c in ("id", "version", "timestamp", "changeset")}
        (keys, counts), (values, others) = read(2), read(3)
        if (counts != others).any():
            raise ValueError("a tag lacks its key or value")
        out["tags"] = self._tags(keys, values, counts)
        if kind == "nodes":
            if not seen["id"].all():
                raise ValueError("a node lacks its id")
            out["id"] = pa.array(zigzag(numbers["id"].view(np.uint64)))
            out["lat"] = self._degrees(zigzag(numbers["lat"].view(np.uint64)), self.lat_offset)
            out["lon"] = self._degrees(zigzag(numbers["lon"].view(np.uint64)), self.lon_offset)
        elif kind == "ways":
            refs, counts = read(8, signed=True, delta=True)
            out["refs"] = pa.ListArray.from_arrays(_offsets(counts), pa.array(refs))
        else:
            (roles, counts), (refs, b), (types, c) = read(8), read(9, signed=True, delta=True), read(10)
            if (counts != b).any() or (counts != c).any():
                raise ValueError("a member lacks its role, reference or type")
            members = pa.StructArray.from_arrays([pa.array(refs), pa.array(types).cast(pa.int32()), self._texts(roles)], ["ref", "type", "role"])
            out["members"] = pa.ListArray.from_arrays(_offsets(counts), members)
        return out

    def _dense(self, value: memoryview) -> dict[str, pa.Array]:
        part = dict(fields(value))
        ids = packed(part.get(1, b""), signed=True, delta=True)
        n = len(ids)
        out = {
            "id": pa.array(ids),
            "lat": self._degrees(packed(part.get(8, b""), signed=True, delta=True), self.lat_offset),
            "lon": self._degrees(packed(part.get(9, b""), signed=True, delta=True), self.lon_offset),
        }
        pairs = packed(part.get(10, b""))
        # zeros end each node's keys and values; one that is a value leaves an odd number before it
        ends = np.flatnonzero(pairs == 0)
        sizes = np.diff(ends, prepend=-1) - 1
        if len(ends) != n or (sizes % 2).any():
            ends = np.array(self._ends(pairs, n), np.int64)
            sizes = np.diff(ends, prepend=-1) - 1
        counts = np.zeros(n, np.int64)
        counts[: len(sizes)] = sizes // 2
        texts = pairs[spread(ends - sizes, sizes)]
        out["tags"] = self._tags(texts[::2], texts[1::2], counts)
        info = dict(fields(part[5])) if 5 in part else {}
        for number, name, how in ((1, "version", {}), (2, "timestamp", {"signed": True, "delta": True}), (3, "changeset", {"signed": True, "delta": True})):
            found = packed(info[number], **how) if number in info else None
            out[name] = pa.nulls(n, pa.int64()) if found is None else pa.array(found * self.date_granularity if name == "timestamp" else found)
        if {len(c) for c in out.values()} != {n}:
            raise ValueError("dense nodes with columns of unlike length")
        return out

    @staticmethod
    def _ends(pairs: np.ndarray, n: int) -> list[int]:
        """Places of the zeros that stand where a key would (string 0 is empty and is no key)."""
        ends, at = [], 0
        zero = pairs == 0
        while len(ends) < n and at < len(pairs):
            if zero[at]:
                ends.append(at)
                at += 1
            else:
                at += 2
        return ends


__all__ = ["Block", "blob_headers", "header_features", "inflate", "read_varint"]
