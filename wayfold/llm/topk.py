"""Exact top-k search by the three-phase uniform threshold (TPUT) over dimension lists.

A vector's score is the sum of its partial inner products over ``lists`` slices of the
dimensions; each slice is one sorted list of partial scores.

1. gather: every block of vectors sends, for each query, the entries that head one of its
   lists, with their whole scores; the k-th best of all is a safe cutoff.
2. the cutoff goes back to the blocks; an entry whose partial score is below cutoff / lists in
   every list cannot reach the cutoff, so only entries at or above it are collected, and of
   those only the ones whose upper bound (unseen parts count as the threshold) reaches it.
   A query whose slices' lengths, times the block's longest, stay below its cutoff leaves the
   block before anything is multiplied.
3. the remaining entries' missing parts are resolved exactly and ranked.

All arithmetic is on integers: vectors are quantised before the search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

BLOCK = 4096
QUERY_BLOCK = 512
_EXACT = float(1 << 53)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, v array<double>`` of integers floor(scale * x); rows that take no part are gone."""
    v = F.col(f"`{vector_col}`")
    ok = v.isNotNull() & (F.size(v) > 0) & F.col(f"`{id_col}`").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    whole = lambda y: F.when(F.abs(y) < F.lit(_EXACT), F.floor(y).cast("double")).otherwise(y)  # noqa: E731  beyond, every double is an integer
    return vectors.filter(ok).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, lambda x: whole(scaled(x))).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _blocks(size: int):
    """Pack rows ``id, v`` of each dimension into rows ``dim, ids, body`` of at most ``size`` vectors."""

    def pack(batches):
        held: dict[int, list] = {}
        for batch in batches:
            ids, col = batch.column(0).to_numpy(), batch.column(1)
            lengths = col.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                held.setdefault(int(dim), []).append((ids[at], _matrix(col.take(pa.array(at)), int(dim))))
            for dim in [d for d, parts in held.items() if sum(len(p[0]) for p in parts) >= size]:
                yield from _flush(dim, held.pop(dim), size)
        for dim, parts in held.items():
            yield from _flush(dim, parts, size)

    return pack


def _flush(dim: int, parts: list, size: int):
    ids, body = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    for a in range(0, len(ids), size):
        yield pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([ids[a : a + size].astype(np.int64).tobytes()]), pa.array([np.ascontiguousarray(body[a : a + size]).tobytes()])],
            ["dim", "ids", "body"],
        )


def _inner(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products: by BLAS where doubles hold them exactly, else in Python integers."""
    bound = (np.abs(q).max(initial=0) * np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if bound < _EXACT:
        return q @ v.T
    exact = np.array([[int(x) for x in row] for row in q], object).reshape(q.shape)
    other = np.array([[int(x) for x in row] for row in v], object).reshape(v.shape)
    return exact @ other.T


def _slices(dim: int, lists: int) -> list[slice]:
    cuts = np.linspace(0, dim, min(lists, max(1, dim)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _tile(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    dim = row["dim"]
    read = lambda name, kind: np.frombuffer(row[name], kind)
    return read("q_ids", np.int64), read("q_body", np.float64).reshape(-1, dim), read("ids", np.int64), read("body", np.float64).reshape(-1, dim)


_OUT = "query_id long, vec_id long, score long"


def _rows(q, v, s):
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(q, np.int64)), pa.array(np.asarray(v, np.int64)), pa.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in s] if s.dtype == object else s.astype(np.int64), pa.int64())], ["query_id", "vec_id", "score"])


def _gather(k: int, lists: int):
    def phase1(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q, ids, v = _tile(row)
                parts = [_inner(q[:, s], v[:, s]) for s in _slices(row["dim"], lists)]
                total = sum(parts[1:], parts[0])
                width = min(k + 1, len(ids))  # one more: a query's own row does not count
                heads = np.concatenate([np.argpartition(-p.astype(np.float64), width - 1, axis=1)[:, :width] for p in parts], axis=1)
                flat = np.unique(np.repeat(np.arange(len(q_ids)), heads.shape[1]) * len(ids) + heads.ravel())
                qi, vi = flat // len(ids), flat % len(ids)
                keep = q_ids[qi] != ids[vi]
                yield from _best(q_ids, ids, qi[keep], vi[keep], total, k)

    return phase1


def _order(qi: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """By query, falling score, id; integers beyond doubles are compared as Python integers."""
    if score.dtype != object:
        return np.lexsort((ids, -score, qi))
    return np.array(sorted(range(len(qi)), key=lambda i: (qi[i], -score[i], ids[i])), np.int64)


def _best(q_ids, ids, qi, vi, total, k):
    """The k best of the given entries of each query, ties to the smaller id."""
    score = total[qi, vi]
    order = _order(qi, score, ids[vi])
    qi, vi, score = qi[order], vi[order], score[order]
    place = np.arange(len(qi)) - np.searchsorted(qi, qi)
    top = place < k
    yield _rows(q_ids[qi[top]], ids[vi[top]], score[top])


def _resolve(k: int, lists: int):
    def phase23(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q, ids, v = _tile(row)
                known = dict(zip(np.frombuffer(row["c_ids"], np.int64).tolist(), np.frombuffer(row["cuts"], np.float64).tolist(), strict=True))
                cut = np.array([known.get(int(i), -np.inf) for i in q_ids])
                cut = np.where(np.abs(cut) < _EXACT, cut, np.nextafter(cut, -np.inf))  # as a double it may have been rounded up
                spans = _slices(row["dim"], lists)
                within = lambda bound, cut: bound + np.abs(bound) * 1e-9 + 1 >= cut  # noqa: E731  sums of doubles may be rounded
                length = lambda x: np.stack([np.linalg.norm(x[:, s], axis=1) for s in spans])
                reach = within((length(q) * length(v).max(axis=1, initial=0)[:, None]).sum(0), cut)
                if not reach.any():
                    continue
                q_ids, q, cut = q_ids[reach], q[reach], cut[reach]
                limit = np.where(np.isfinite(cut), np.floor(cut / len(spans)), -np.inf)[:, None]
                parts = [_inner(q[:, s], v[:, s]) for s in spans]
                upper = np.zeros((len(q_ids), len(ids)))
                seen = np.zeros(upper.shape, bool)
                for p in parts:
                    hit = p >= limit
                    seen |= hit
                    upper += np.where(hit, p.astype(np.float64), limit)
                qi, vi = np.nonzero(seen & (within(upper, cut[:, None]) | ~np.isfinite(cut)[:, None]))
                total = np.zeros(len(qi), parts[0].dtype)
                for p in parts:
                    total = total + p[qi, vi]
                keep = (q_ids[qi] != ids[vi]) & (total >= cut[qi])
                qi, vi, total = qi[keep], vi[keep], total[keep]
                order = _order(qi, total, ids[vi])
                qi, vi, total = qi[order], vi[order], total[order]
                top = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
                yield _rows(q_ids[qi[top]], ids[vi[top]], total[top])

    return phase23


def topk_search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, lists: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best rows of ``vectors``, its own id excepted.

    Score: inner product of the vectors' floor(scale * x), an exact integer.  Ties go to the
    smaller id; a query with fewer than k candidates gets them all; scores beyond a long stop
    at its ends.  Null and empty vectors, vectors with null, NaN or infinite components and
    null ids take no part; a query meets only vectors of its own length; repeated ids among the vectors are separate candidates;
    of queries that repeat an id the least vector asks (by its components from the first).
    Empty tables give an empty result; other columns are ignored.

    The vectors are packed into blocks where they are read and each block meets each block
    of queries once per phase; neither side is collected or broadcast by hand.
    """
    block_schema = "dim int, ids binary, body binary"
    asked = materialize(quantised(queries, id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v")), "topk-asked")
    q = materialize(asked.repartition(max(1, -(-asked.count() // QUERY_BLOCK))).mapInArrow(_blocks(QUERY_BLOCK), block_schema).withColumn("qb", F.monotonically_increasing_id()), "topk-q")
    v = quantised(vectors, id_col, vector_col, scale).mapInArrow(_blocks(BLOCK), block_schema)
    named = q.select("dim", "qb", F.col("ids").alias("q_ids"), F.col("body").alias("q_body"))
    keys = q.groupBy("dim").agg(F.collect_list("qb").alias("qbs"))  # one id for each QUERY_BLOCK queries
    dealt = v.join(keys, "dim").withColumn("qb", F.explode("qbs")).drop("qbs")
    tiles = dealt.join(named, ["dim", "qb"])
    heads = tiles.select("dim", "q_ids", "q_body", "ids", "body").mapInArrow(_gather(k, lists), _OUT)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    cutoffs = heads.withColumn("r", F.row_number().over(ranked)).filter(F.col("r") == k).select("query_id", F.col("score").cast("double").alias("cut"))
    members = q.select("qb", "ids").mapInArrow(_unpack, "qb long, query_id long")
    packed = members.join(cutoffs, "query_id").groupBy("qb").agg(F.collect_list(F.struct("query_id", "cut")).alias("c"))
    with_cuts = materialize(named.join(packed, "qb", "left").mapInArrow(_pack_cuts, "dim int, qb long, q_ids binary, q_body binary, c_ids binary, cuts binary"), "topk-cut")
    final = dealt.join(with_cuts, ["dim", "qb"]).select("dim", "q_ids", "q_body", "ids", "body", "c_ids", "cuts").mapInArrow(_resolve(k, lists), _OUT)
    return final.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unpack(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["qb"])), pa.array(ids)], ["qb", "query_id"])


def _pack_cuts(batches):
    for batch in batches:
        rows = batch.to_pylist()
        pairs = [[(c["query_id"], c["cut"]) for c in r["c"] or ()] for r in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r["dim"] for r in rows], pa.int32()), pa.array([r["qb"] for r in rows], pa.int64()), pa.array([r["q_ids"] for r in rows], pa.binary()), pa.array([r["q_body"] for r in rows], pa.binary()),
             pa.array([np.array([p[0] for p in ps], np.int64).tobytes() for ps in pairs], pa.binary()), pa.array([np.array([p[1] for p in ps], np.float64).tobytes() for ps in pairs], pa.binary())],
            ["dim", "qb", "q_ids", "q_body", "c_ids", "cuts"],
        )
