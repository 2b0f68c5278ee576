"""Vectorised protobuf wire decoding with numpy; 64-bit clean throughout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def varints(buf: bytes | memoryview) -> np.ndarray:
    """All varints of a packed field as uint64."""
    raw = np.frombuffer(buf, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    ends = np.flatnonzero(raw < 0x80)
    if not len(ends) or ends[-1] != len(raw) - 1:
        raise ValueError("truncated varint")
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    if place.max() > 9:
        raise ValueError("varint longer than ten bytes")
    return np.add.reduceat((raw & 0x7F).astype(np.uint64) << (place * 7).astype(np.uint64), starts)


def zigzag(values: np.ndarray) -> np.ndarray:
    return ((values >> np.uint64(1)) ^ (~(values & np.uint64(1)) + np.uint64(1))).astype(np.int64)


def packed(buf: bytes | memoryview, signed: bool = False, delta: bool = False) -> np.ndarray:
    values = varints(buf)
    values = zigzag(values) if signed else values.astype(np.int64)
    return np.cumsum(values) if delta else values


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``start .. start + length - 1`` of all spans, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def varints_at(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One varint at each place of ``raw`` as uint64, and the places after them."""
    value, after, open_ = np.zeros(len(at), np.uint64), at.copy(), np.arange(len(at))
    for k in range(10):
        if len(open_) and after[open_].max() >= len(raw):
            raise ValueError("truncated varint")
        byte = raw[after[open_]]
        value[open_] |= (byte & 0x7F).astype(np.uint64) << np.uint64(7 * k)
        after[open_] += 1
        open_ = open_[byte >= 0x80]
        if not len(open_):
            return value, after
    raise ValueError("varint longer than ten bytes")


def packed_spans(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, signed: bool = False, delta: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The packed fields in many spans of ``raw``: all values one after the other, and how many each span has."""
    flat = raw[spread(starts, lengths)]
    ends = np.cumsum(lengths)
    last = flat < 0x80
    if not last[ends[lengths > 0] - 1].all():
        raise ValueError("truncated varint")
    before = np.concatenate([[0], np.cumsum(last)])
    counts = before[ends] - before[ends - lengths]
    values = packed(flat, signed)
    if delta and len(values):
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
        values = total[1:] - np.repeat(total[np.cumsum(counts) - counts], counts)
    return values, counts


def fields_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The next field of every message of ``raw`` at a time: (messages, numbers, varints, starts, lengths).

    Varints have length -1; the others are bytes.  Fields of a message come in their order.
    """
    rows, at = np.flatnonzero(starts < ends), starts[starts < ends]
    while len(rows):
        key, at = varints_at(raw, at)
        kind, number = key & np.uint64(7), (key >> np.uint64(3)).astype(np.int64)
        wrong = np.setdiff1d(kind, [0, 1, 2, 5])
        if len(wrong):
            raise ValueError(f"wire type {wrong[0]} is not used in this format")
        value, size = np.zeros(len(rows), np.uint64), np.full(len(rows), -1)
        lead = np.flatnonzero((kind == 0) | (kind == 2))
        value[lead], at[lead] = varints_at(raw, at[lead])
        size[kind == 2] = value[kind == 2].astype(np.int64)
        size[kind == 1], size[kind == 5] = 8, 4
        after = at + np.maximum(size, 0)
        if (after > ends[rows]).any() or (size < -1).any():
            raise ValueError("truncated message")
        yield rows, number, value, at, size
        more = after < ends[rows]
        rows, at = rows[more], after[more]


def messages(buf: bytes | memoryview, base: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, starts, ends) of the length-delimited fields of ``buf``; places count from ``base``."""
    numbers, starts, ends = [], [], []
    at, end = 0, len(buf)
    while at < end:
        key, at = read_varint(buf, at) if buf[at] >= 0x80 else (buf[at], at + 1)
        kind = key & 7
        if kind == 2:
            size, at = read_varint(buf, at) if buf[at] >= 0x80 else (buf[at], at + 1)
            numbers.append(key >> 3)
            starts.append(at)
            at += size
            ends.append(at)
        elif kind == 0:
            _, at = read_varint(buf, at)
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError(f"wire type {kind} is not used in this format")
    if at > end:
        raise ValueError("truncated message")
    return np.array(numbers, np.int64), np.array(starts, np.int64) + base, np.array(ends, np.int64) + base


def read_varint(buf: bytes | memoryview, at: int) -> tuple[int, int]:
    """One varint as an unsigned Python integer, and the place after it."""
    value = shift = 0
    while True:
        byte = buf[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
        shift += 7


def signed64(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def unzigzag(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def fields(buf: bytes | memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(field number, value): an unsigned integer or the bytes of a length-delimited or fixed field."""
    buf = memoryview(buf)
    at, end = 0, len(buf)
    while at < end:
        key, at = read_varint(buf, at)
        kind = key & 7
        if kind == 0:
            value, at = read_varint(buf, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = buf[at : at + size], at + size
        elif kind == 2:
            size, at = read_varint(buf, at)
            value, at = buf[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} is not used in this format")
        yield key >> 3, value
