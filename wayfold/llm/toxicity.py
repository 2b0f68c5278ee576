"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams of a whole text (lower-cased ASCII, blanks as one
kind), hashed into ``BUCKETS``.  A bucket's log-count ratio comes from the smoothed shares of
toxic and clean training texts that hold it; the buckets with the most evidence are kept,
scaled by their ratios and weighted by logistic regression.  Scoring looks up one fixed-size
table, so a long text costs time, not memory per n-gram.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, labelled_sample
from .scratch import map_texts

SIZES = (3, 4, 5, 6)
BITS = 20
BUCKETS = 1 << BITS
FEATURES = 4096
MAX_TRAIN = 8000
CHUNK = 1 << 18
_K = np.uint32(0x01000193)
_G = np.uint32(0x9E3779B1)
_FOLD = np.arange(1 << 16, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def ngram_places(texts: list[str], table: np.ndarray | None = None):
    """(row, bucket) of n-gram occurrences; with a table only of buckets where it is not 0."""
    joined = "".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.where(chars < len(_FOLD), _FOLD[np.minimum(chars, len(_FOLD) - 1)], chars)
    rows, buckets = [], []
    h = chars.copy()
    for n in range(2, max(SIZES) + 1):
        if len(chars) < n:
            break
        h = h[:-1] * _K + chars[n - 1 :]
        if n not in SIZES:
            continue
        b = ((h ^ np.uint32(n * 0x5BD1E995 % (1 << 32))) * _G) >> np.uint32(32 - BITS)
        at = np.flatnonzero(table[b]) if table is not None else np.arange(len(b))
        row = np.searchsorted(ends, at, "right")
        inside = at + n <= ends[np.minimum(row, len(ends) - 1)]
        rows.append(row[inside])
        buckets.append(b[at[inside]])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    return np.concatenate(rows), np.concatenate(buckets)


def _spans(texts: list[str], table: np.ndarray | None = None):
    """(first text, last text, distinct (text, bucket)): a long text in overlapping stretches that hold every n-gram."""
    for a, b in _chunks(texts):
        long = texts[a] if b - a == 1 and len(texts[a]) > CHUNK else None
        if long is None:
            yield a, b, *distinct_pairs(*ngram_places(texts[a:b], table))
            continue
        seen = np.empty(0, np.int64)
        for at in range(0, len(long), CHUNK):
            _, bucket = ngram_places([long[at : at + CHUNK + max(SIZES) - 1]], table)
            seen = np.union1d(seen, bucket)
        yield a, b, np.zeros(len(seen), np.int64), seen.astype(np.int64)


def distinct_pairs(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = np.unique((row.astype(np.int64) << BITS) | bucket)
    return pair >> BITS, pair & (BUCKETS - 1)


def _chunks(texts: list[str]):
    """Runs of texts of about ``CHUNK`` characters; a longer text stands alone."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if i > first and held + len(t) > CHUNK:
            yield first, i
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield first, len(texts)


def fit(sample: DataFrame) -> dict:
    """Weights of the hashed n-grams, and the intercept, from ``text, y`` rows (bounded by the caller)."""

    def counts(batches):
        held = np.zeros((2, BUCKETS), np.int32)
        n = [0, 0]
        for batch in batches:
            texts, y = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), int)
            for a, b, row, bucket in _spans(texts):
                for c in (0, 1):
                    held[c] += np.bincount(bucket[y[a:b][row] == c], minlength=BUCKETS).astype(np.int32)
                    n[c] += int((y[a:b] == c).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n[0]]), pa.array([n[1]]), pa.array([zlib.compress(held.tobytes(), 1)])], ["n0", "n1", "counts"])

    df, n0, n1 = np.zeros((2, BUCKETS)), 0, 0
    for r in map_texts(sample, counts, "n0 long, n1 long, counts binary").toArrow().to_pylist():  # one row of bounded size for each of the sample's few partitions
        df += np.frombuffer(zlib.decompress(r["counts"]), np.int32).reshape(2, BUCKETS)
        n0, n1 = n0 + r["n0"], n1 + r["n1"]
    if not n0 or not n1:
        return {"table": np.zeros(BUCKETS, np.float32), "bias": float(np.log((n1 + 0.5) / (n0 + 0.5)))}
    p, q = (df[1] + 1) / (n1 + 2), (df[0] + 1) / (n0 + 2)
    ratio = np.log(p / q)
    # evidence: the log-likelihood ratio of toxic and clean counts of the bucket
    evidence = df[1] * np.log(np.maximum(df[1], 1e-9) / ((df[0] + df[1] + 1e-9) * n1 / (n0 + n1))) + df[0] * np.log(np.maximum(df[0], 1e-9) / ((df[0] + df[1] + 1e-9) * n0 / (n0 + n1)))
    evidence[df.sum(0) < 4] = 0
    chosen = np.sort(np.argsort(-evidence, kind="stable")[:FEATURES])
    chosen = chosen[evidence[chosen] > 6]
    lookup = np.zeros(BUCKETS, np.int32)
    lookup[chosen] = np.arange(1, len(chosen) + 1)

    def selected(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b, row, bucket in _spans(texts, lookup):
                cut = np.searchsorted(row, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([pa.array([lookup[bucket[cut[i] : cut[i + 1]]].astype(np.int32).tobytes() for i in range(b - a)], pa.binary()), batch.column(1).slice(a, b - a)], ["ids", "y"])

    ids, y = [], []
    for r in map_texts(sample, selected, "ids binary, y int").toArrow().to_pylist():  # at most the sample's bound of rows
        ids.append(np.frombuffer(r["ids"], np.int32) - 1)
        y.append(r["y"])
    weight, bias = _logistic(ids, np.array(y, float), ratio[chosen])
    table = np.zeros(BUCKETS, np.float32)
    table[chosen] = weight * ratio[chosen]
    return {"table": table, "bias": bias}


def _logistic(ids: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, steps: int = 400, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Adam on the logistic loss of f = presence * ratio, from naive Bayes weights of a tenth."""
    row = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    col = np.concatenate(ids) if len(row) else np.empty(0, int)
    value = ratio[col]
    w, b = np.full(len(ratio), 0.1), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, value * w[col], len(y)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        gw = np.bincount(col, value * g[row], len(w)) + l2 * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.02 * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        b -= 0.02 * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    return w, float(b)


def score_texts(model: dict, texts: list[str]) -> np.ndarray:
    table, out = model["table"], np.empty(len(texts))
    for a, b, row, bucket in _spans(texts, table):
        z = np.bincount(row, table[bucket], b - a) + model["bias"]
        out[a:b] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return out


def toxicity_model(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> dict:
    """Fit on at most ``max_train`` labelled documents outside the held-out fold."""
    return fit(labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), 3) != 1, max_train))


def score_toxicity(docs: DataFrame, model: dict, threshold: float = 0.7, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of ``docs`` plus the two named ones (replacing columns of those names).

    A null text scores as the empty text: the model's intercept.  Whole texts are scored;
    equal texts score alike; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in names]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index("text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields] + [f"`{names[0]}` double", f"`{names[1]}` int"])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                s = score_texts(model, [t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*kept, *names])

    return map_texts(frame, run, schema)
