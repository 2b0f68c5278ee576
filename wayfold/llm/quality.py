"""Quality classifier: gated-attention multiple-instance learning over a document's passages.

A document is a bag of passages of ``PASSAGE`` words.  Every passage is described by its words,
hashed into ``BUCKETS`` shares, and by numbers taken from its bytes (kinds of characters, word
lengths, repetition inside the passage and within the document), and encoded by a small network
whose weights for words and numbers are learned together; attention weights
``softmax(w . (tanh(V z) * sigmoid(U z)))`` are learned from document labels alone, and the
weighted passage representation is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import buffers, runs, shingles, words
from .labelled import fold, labelled_sample
from .scratch import map_texts

PASSAGE = 40
MAX_TRAIN = 8000
HIDDEN, GATE = 24, 12
#: Words are hashed into so many columns.
BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
#: Passages of one labelled document that training reads, evenly spaced; scores read all.
MAX_PASSAGES = 64
_KINDS = ["letter", "upper", "digit", "symbol", "stop", "wide", "newline", "bar"]


def _kinds() -> np.ndarray:
    kind = np.full(256, -1, np.int8)
    for i, chars in enumerate([range(97, 123), range(65, 91), range(48, 58), b"#$%&*<>{}[]\\^~_=+@/", b".,;:!?'\"()-", range(128, 256), b"\n", b"|"]):
        kind[list(chars)] = i
    return kind


KIND = _kinds()
NUMBERS = len(_KINDS) + 8
WIDTH = NUMBERS + BUCKETS


def passage_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of features and each document's offsets into them; a text without words is one row of zeros."""
    value, s, e, word_off = words(data, offsets)
    n_words = np.diff(word_off)
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    off = np.concatenate([[0], np.cumsum(n_pass)])
    x = np.zeros((int(off[-1]), WIDTH), np.float32)
    if not len(value):
        return x, off
    doc = np.repeat(np.arange(len(n_words)), n_words)
    inner = np.arange(len(value)) - word_off[doc]
    of = off[doc] + inner // PASSAGE  # passage of each word
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    used = of[first]
    count = np.diff(np.concatenate([first, [len(of)]])).astype(np.float32)
    last = np.concatenate([first[1:], [len(of)]]) - 1
    # bytes of a passage: from its first word to the next passage of the document, or its last word
    begin, stop = s[first], e[last]
    kind = KIND[data]
    length = np.maximum(1, stop - begin).astype(np.float32)
    for k in range(len(_KINDS)):
        sums = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])
        x[used, k] = (sums[stop] - sums[begin]) / length
    size = (e - s).astype(np.float32)
    mean = lambda z: np.add.reduceat(z.astype(np.float32), first) / count
    same = np.zeros(len(value), bool)
    same[1:] = (value[1:] == value[:-1]) & (doc[1:] == doc[:-1])
    at = len(_KINDS)
    x[used, at] = np.log1p(count) / 4
    x[used, at + 1] = mean(size) / 10
    x[used, at + 2] = np.log1p(np.maximum.reduceat(size, first)) / 4
    x[used, at + 3] = mean(same)
    pair = np.unique(value ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.zeros(len(value), np.float32)
    distinct[pair] = 1
    x[used, at + 4] = mean(distinct)
    three, three_off = shingles(value, word_off, 3)
    row = np.repeat(np.arange(len(n_words)), np.diff(three_off))
    new = np.zeros(len(three), np.float32)
    new[np.unique(three ^ (row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)[1]] = 1
    seen = np.zeros(len(value), np.float32)
    seen[word_off[row] + np.arange(len(three)) - three_off[row]] = 1 - new  # a shingle that stood in the document before
    x[used, at + 5] = mean(seen)
    lone = ~((kind[s] == 0) | (kind[s] == 1) | (kind[s] == 5) | (kind[s] == 2))
    x[used, at + 6] = mean(lone)
    tail = kind[e - 1]
    x[used, at + 7] = mean((tail == 3) | (tail == 7))
    # square roots of the words' shares: rows of length 1 whatever the passage's size
    place = np.repeat(np.arange(len(first)), count.astype(np.int64)) * BUCKETS + (value >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    shares = np.bincount(place, minlength=len(first) * BUCKETS).reshape(-1, BUCKETS) / count[:, None]
    x[used, NUMBERS:] = np.sqrt(shares)
    return x, off


class Attention:
    """The network; parameters are a dict of arrays, gradients are written out by hand."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def start(cls, seed: int, mean: np.ndarray, scale: np.ndarray) -> Attention:
        r = np.random.default_rng(seed)
        init = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        return cls({"mean": mean, "scale": scale, "W": init(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "w": init(GATE), "c": init(HIDDEN), "d": np.zeros(1)})

    def forward(self, x: np.ndarray, off: np.ndarray) -> dict:
        p, first = self.p, off[:-1]
        x = (x - p["mean"]) / p["scale"]
        z = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(z @ p["V"]), 1 / (1 + np.exp(-(z @ p["U"])))
        a = (t * g) @ p["w"]
        n = np.diff(off)
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), n))
        a /= np.repeat(np.add.reduceat(a, first), n)
        bag = np.add.reduceat(a[:, None] * z, first)
        return {"x": x, "z": z, "t": t, "g": g, "a": a, "bag": bag, "logit": bag @ p["c"] + p["d"][0], "n": n, "first": first}

    def score(self, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x, off)["logit"], -500, 500)))

    def gradients(self, f: dict, error: np.ndarray) -> dict[str, np.ndarray]:
        p, n, first = self.p, f["n"], f["first"]
        d_bag = np.repeat(error[:, None] * p["c"], n, axis=0)
        d_a = (d_bag * f["z"]).sum(1)
        d_s = f["a"] * (d_a - np.repeat(np.add.reduceat(f["a"] * d_a, first), n))
        d_t, d_g = d_s[:, None] * p["w"] * f["g"], d_s[:, None] * p["w"] * f["t"]
        d_t *= 1 - f["t"] ** 2
        d_g *= f["g"] * (1 - f["g"])
        d_z = d_bag * f["a"][:, None] + d_t @ p["V"].T + d_g @ p["U"].T
        d_z *= 1 - f["z"] ** 2
        return {"W": f["x"].T @ d_z, "b": d_z.sum(0), "V": f["z"].T @ d_t, "U": f["z"].T @ d_g, "w": (f["t"] * f["g"]).T @ d_s, "c": f["bag"].T @ error, "d": np.array([error.sum()])}


def _bags(batches):
    for batch in batches:
        data, off = buffers(batch.column(0))
        for a, b in runs(off):
            x, rows = passage_features(data[off[a] : off[b]], off[a : b + 1] - off[a])
            chosen = [np.unique(np.linspace(rows[i], rows[i + 1] - 1, MAX_PASSAGES).astype(np.int64)) for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c].tobytes() for c in chosen], pa.binary()), batch.column(1).slice(a, b - a)], ["x", "y"])


def fit(sample: DataFrame, epochs: int = 12, batch: int = 64, seed: int = 5) -> Attention:
    """Train on ``text, y`` rows (bounded by the caller) with Adam; numbers of at most ``MAX_PASSAGES`` passages a text, not the texts, come to the driver."""
    bags = sorted(((np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH), r["y"]) for r in map_texts(sample, _bags, "x binary, y int").toArrow().to_pylist()), key=lambda b: (b[1], b[0].shape, b[0].tobytes()))
    if not bags:
        model = Attention.start(seed, np.zeros(WIDTH), np.ones(WIDTH))
        model.p["c"][:] = 0
        return model
    every = np.concatenate([b[0] for b in bags])
    model = Attention.start(seed, every.mean(0, dtype=np.float64), every.std(0, dtype=np.float64) + 1e-2)
    del every
    y = np.array([b[1] for b in bags], float)
    r = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(bags))
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for a in range(0, len(bags), batch):
            own = order[a : a + batch]
            off = np.concatenate([[0], np.cumsum([len(bags[i][0]) for i in own])])
            f = model.forward(np.concatenate([bags[i][0] for i in own]), off)
            error = (1 / (1 + np.exp(-np.clip(f["logit"], -40, 40))) - y[own]) / len(own)
            step += 1
            for k, g in model.gradients(f, error).items():
                g = g + 1e-5 * model.p[k]
                m[k], v2[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v2[k] + 0.001 * g * g
                model.p[k] = model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def quality_model(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Attention:
    """Fit on at most ``max_train`` labelled documents outside the held-out fold."""
    return fit(labelled_sample(docs, labels, "quality", fold(F.col("doc_id"), 5) != 0, max_train))


def score_quality(docs: DataFrame, model: Attention, threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs``.

    A null or empty text is a bag of one passage of zeros; rows that repeat a doc_id are scored each.  Whole texts are scored,
    however long; equal texts score alike; an empty table gives an empty result; other
    columns are ignored.
    """

    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column(1))
            for a, b in runs(off):
                s = np.round(model.score(*passage_features(data[off[a] : off[b]], off[a : b + 1] - off[a])), 9)  # not the order of summation
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(texts, run, "doc_id long, score double, predicted int")
