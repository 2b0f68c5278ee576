"""Elements to ``.osm.pbf`` files: each task writes one complete extract of its rows.

Blocks hold at most ``BLOCK`` elements of one kind, nodes as dense nodes; blobs are zlib-packed.
A repeated task writes a file of another name, and only files that were reported stay.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pbf import _system
from .wire import spread

BLOCK = 8000
GRANULARITY = 100


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only where that is unset on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="wayfold-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/wayfold-{name}-{uuid.uuid4().hex}"


def _varints(values: Iterable[int] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after the other, and how many each has."""
    u = np.asarray(values, np.int64).view(np.uint64)
    width = max(1, -(-int(u.max(initial=0)).bit_length() // 7))
    parts = u[:, None] >> (np.arange(width, dtype=np.uint64) * np.uint64(7))
    used = np.concatenate([np.ones((len(u), 1), bool), parts[:, 1:] > 0], axis=1)
    out = (parts & np.uint64(0x7F)).astype(np.uint8)
    out[:, :-1] |= (used[:, 1:] * np.uint8(0x80)).astype(np.uint8)
    return out[used], used.sum(axis=1)


def _zigzag(x: np.ndarray) -> np.ndarray:
    return (x << 1) ^ (x >> 63)


def packed_varints(values: Iterable[int] | np.ndarray, signed: bool = False, delta: bool = False) -> bytes:
    """A packed field: zigzag if ``signed``, differences if ``delta``."""
    x = np.asarray(values, np.int64)
    if delta:
        x = np.diff(x, prepend=np.int64(0))
    return _varints(_zigzag(x) if signed else x)[0].tobytes()


def _number(field: int, value: int) -> bytes:
    return packed_varints([field << 3, value])


def _bytes(field: int, value: bytes) -> bytes:
    return packed_varints([field << 3 | 2, len(value)]) + value


@dataclass
class Pieces:
    """A piece of bytes for each element: all one after the other, and their lengths."""

    data: np.ndarray
    sizes: np.ndarray

    @classmethod
    def beside(cls, *parts: Pieces) -> Pieces:
        """The parts' pieces of each element behind each other."""
        sizes = np.stack([p.sizes for p in parts], axis=1)
        ends = np.cumsum(sizes).reshape(sizes.shape)
        out = np.empty(ends[-1, -1] if len(ends) else 0, np.uint8)
        for i, p in enumerate(parts):
            out[spread(ends[:, i] - p.sizes, p.sizes)] = p.data
        return cls(out, sizes.sum(axis=1))

    @classmethod
    def numbers(cls, field: int, values: np.ndarray, there: np.ndarray | None = None) -> Pieces:
        """A field with a number, nothing for elements where it is not there."""
        there = np.ones(len(values), bool) if there is None else there
        sizes = np.zeros((len(values), 2), np.int64)
        (head, sizes[there, 0]), (body, sizes[there, 1]) = _varints(np.full(there.sum(), field)), _varints(values[there])
        return cls.beside(cls(head, sizes[:, 0]), cls(body, sizes[:, 1]))

    @classmethod
    def packed(cls, values: np.ndarray, counts: np.ndarray, signed: bool = False, delta: bool = False) -> Pieces:
        """A packed field's content: so many of the values for each element."""
        x, ends = np.asarray(values, np.int64), np.cumsum(counts)
        if delta and len(x):
            first = (ends - counts)[counts > 0]
            steps = np.diff(x, prepend=np.int64(0))
            steps[first] = x[first]
            x = steps
        data, sizes = _varints(_zigzag(x) if signed else x)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return cls(data, total[ends] - total[ends - counts])

    def field(self, number: int, empty: bool = True) -> Pieces:
        """The pieces as a field of bytes; empty ones stay out unless ``empty``."""
        return Pieces.beside(Pieces.numbers(number << 3 | 2, self.sizes, None if empty else self.sizes > 0), self)


def _lists(column: pa.Array, *parts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """How many entries each list has (none if it is null), and the entries of all lists."""
    at = column.offsets.to_numpy().astype(np.int64)
    counts = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
    places = pa.array(spread(at[:-1], counts))
    return counts, [p.take(places) for p in parts]


def _longs(column: pa.Array, what: str) -> np.ndarray:
    if column.null_count:
        raise ValueError(f"{what} must not be null")
    return column.cast(pa.int64()).to_numpy()


def _millis(column: pa.Array) -> pa.Array:
    """Milliseconds since 1970; times without a zone are UTC."""
    kind = column.type
    return pc.round(pc.divide(column.cast(pa.timestamp("us", kind.tz)).cast(pa.int64()).cast(pa.float64()), 1000.0), round_mode="half_to_even").cast(pa.int64()) if pa.types.is_timestamp(kind) else column.cast(pa.int64())


def _info(rows: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Version, milliseconds and changeset, each with where it is there."""
    columns = [rows["version"].cast(pa.int64()), _millis(rows["timestamp"]), rows["changeset"].cast(pa.int64())]
    return [(c.fill_null(0).to_numpy(), c.is_valid().to_numpy(zero_copy_only=False)) for c in columns]


def block(kind: str, rows: pa.RecordBatch) -> bytes:
    """A primitive block of one group; dates in milliseconds."""
    tagged, (keys, values) = _lists(rows["tags"], rows["tags"].keys, rows["tags"].items)
    if keys.null_count or values.null_count:
        raise ValueError("keys and values of tags must not be null")
    texts = [keys.cast(pa.string()), values.cast(pa.string())]
    if kind == "relations":
        inner = rows["members"].values
        listed, (refs, types, roles) = _lists(rows["members"], *(inner.field(inner.type.get_field_index(c)) for c in ("ref", "type", "role")))
        texts.append(roles.cast(pa.string()).fill_null(""))
    coded = pa.concat_arrays([pa.array([""]), *texts]).dictionary_encode()
    at = np.cumsum([1, *(len(x) for x in texts)])
    keys, values, *roles = np.split(coded.indices.to_numpy().astype(np.int64)[1:], at[1:-1] - 1)
    ids, info = _longs(rows["id"], "ids"), _info(rows)
    if kind == "nodes":
        group = _bytes(2, _dense(rows, ids, info, tagged, keys, values))
    else:
        tags = [Pieces.packed(x, tagged).field(n, empty=False) for n, x in ((2, keys), (3, values))]
        about = Pieces.beside(*(Pieces.numbers(n << 3, *x) for n, x in enumerate(info, 1))).field(4, empty=False)
        if kind == "ways":
            counts, (refs,) = _lists(rows["refs"], rows["refs"].values)
            own = [Pieces.packed(_longs(refs, "references"), counts, True, True).field(8)]
        else:
            own = [Pieces.packed(roles[0], listed).field(8), Pieces.packed(_longs(refs, "references"), listed, True, True).field(9), Pieces.packed(_longs(types, "types"), listed).field(10)]
        group = Pieces.beside(Pieces.numbers(8, ids), *tags, about, *own).field(3 if kind == "ways" else 4).data.tobytes()
    table = b"".join(_bytes(1, x.encode()) for x in coded.dictionary.to_pylist())
    return _bytes(1, table) + _bytes(2, group) + _number(17, GRANULARITY) + _number(18, 1)


def _dense(rows: pa.RecordBatch, ids: np.ndarray, info: list, tagged: np.ndarray, keys: np.ndarray, values: np.ndarray) -> bytes:
    raw = lambda c: np.round(rows[c].cast(pa.float64()).to_numpy() * (1e9 / GRANULARITY)).astype(np.int64)
    body = _bytes(1, packed_varints(ids, True, True))
    if info[0][1].any():
        kinds = [packed_varints(x, n > 0, n > 0) for n, (x, _) in enumerate(info)]
        body += _bytes(5, b"".join(_bytes(n + 1, k) for n, k in enumerate(kinds)))
    body += _bytes(8, packed_varints(raw("lat"), True, True)) + _bytes(9, packed_varints(raw("lon"), True, True))
    if not len(keys):
        return body
    # each node's keys and values in turn, then a zero
    sizes = tagged * 2
    pairs = np.zeros(sizes.sum() + len(sizes), np.int64)
    pairs[spread(np.cumsum(sizes + 1) - sizes - 1, sizes)] = np.stack([keys, values], axis=1).ravel()
    return body + _bytes(10, packed_varints(pairs))


def framed(name: str, body: bytes) -> bytes:
    blob = _number(2, len(body)) + _bytes(3, zlib.compress(body))
    head = _bytes(1, name.encode()) + _number(3, len(blob))
    return len(head).to_bytes(4, "big") + head + blob


def header() -> bytes:
    return framed("OSMHeader", _bytes(4, b"OsmSchema-V0.6") + _bytes(4, b"DenseNodes") + _bytes(5, b"Has_Metadata"))


def _writer(kind: str, path: str) -> Callable:
    def run(batches):
        made, held, n, out = f"{path}/{kind}-{uuid.uuid4().hex}.osm.pbf", [], 0, None
        system, inner = _system(made)

        def flush(rows: pa.RecordBatch):
            nonlocal out
            if out is None:
                out = system.open_output_stream(inner)
                out.write(header())
            out.write(framed("OSMData", block(kind, rows)))

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                rows = pa.concat_batches(held)
                for start in range(0, n - BLOCK + 1, BLOCK):
                    flush(rows.slice(start, BLOCK))
                held, n = [rows.slice(n - n % BLOCK)], n % BLOCK
        if n:
            flush(pa.concat_batches(held))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([made])], ["path"])

    return run


def write_pbf(frames: dict[str, DataFrame], path: str) -> list[str]:
    """Write ``nodes``, ``ways`` and ``relations`` as extracts in the folder ``path`` and return the files, one for each task with rows.

    Rows of null id, and nodes without coordinates, have no form in an extract and stay out.
    """
    system, inner = _system(path)
    system.create_dir(inner, recursive=True)
    made: list[str] = []
    for kind, frame in frames.items():
        good = frame.filter(F.col("id").isNotNull() & (F.col("lon").isNotNull() & F.col("lat").isNotNull() if kind == "nodes" else F.lit(True)))
        made += [r[0] for r in good.mapInArrow(_writer(kind, path), "path string").collect()]  # one name for each task
    return made
