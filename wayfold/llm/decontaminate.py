"""Benchmark decontamination by latent semantic retrieval.

The columns of the TF-IDF matrix are the benchmark's words (no other word can add to a cosine
with a benchmark item), its rows all passages of the corpus and the benchmark.  Three scans:

1. document frequencies of the columns over every 16-word block of the corpus;
2. Y = A'A R for a random R, summed over all passages: the range of a randomised SVD, whose
   Nystroem form gives the right singular vectors without another scan;
3. every overlapping 32-word window is folded into the latent space and compared with every
   item window by cosine; candidates are checked by the longest common subsequence of their
   informative words and, in the paraphrase zone, by the words of the item's answer.

Only tables of the benchmark's size travel: df, Y and the latent word vectors.  Benchmarks
larger than ``BLOCK_ITEMS`` items are searched block by block, one set of scans each.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import IS_SEPARATOR, buffers, runs, words
from .scratch import map_texts, materialize, packed_row, sum_arrays

STEP = 16
RANK, OVER = 192, 32
MAX_DF = 0.02
FEWEST, RAREST, LEAST_WEIGHT = 4, 8, 0.1
COSINE = 0.35
SURE, LIKELY, ANSWER = 0.7, 0.5, 0.6
BLOCK_ITEMS = 20_000
_U = np.uint64


def _words_of(texts: list[str]) -> np.ndarray:
    return words(*buffers(pa.array(texts, pa.string())), IS_SEPARATOR)[0]


class Vocabulary:
    """Word values of the benchmark in an open-addressing table."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = max(12, int(len(self.values) * 8).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.probes = 1
        for i, v in enumerate(self.values.tolist()):
            at, step = v >> (64 - self.bits), 1
            while self.slots[at] >= 0:
                at, step = (at + 1) & (len(self.slots) - 1), step + 1
            self.slots[at] = i
            self.probes = max(self.probes, step)

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, column) of the words that are in the vocabulary."""
        at = np.arange(len(value))
        slot = (value >> _U(64 - self.bits)).astype(np.int64)
        places, columns = [], []
        for _ in range(self.probes):
            got = self.slots[slot]
            some = got >= 0
            at, slot, got = at[some], slot[some], got[some]
            if not len(at):
                break
            hit = self.values[got] == value[at]
            places.append(at[hit])
            columns.append(got[hit])
            at, slot = at[~hit], (slot[~hit] + 1) & (len(self.slots) - 1)
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place, column = np.concatenate(places), np.concatenate(columns).astype(np.int64)
        order = np.argsort(place, kind="stable") if len(places) > 1 else slice(None)
        return place[order], column[order]


def _entries(column: pa.Array, vocab: Vocabulary):
    """For each chunk: first row, (row, word number in row, column) of vocabulary words, words of each row."""
    data, off = buffers(column)
    for a, b in runs(off):
        value, _, _, word_off = words(data[off[a] : off[b]], off[a : b + 1] - off[a], IS_SEPARATOR)
        place, col = vocab.find(value)
        row = np.searchsorted(word_off, place, "right") - 1
        yield a, b, row, place - word_off[row], col, np.diff(word_off)


def segment_sums(table: np.ndarray, index: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``table[index]`` from each ``first`` to the next: all segments' k-th rows at once, long tails alone."""
    count = np.diff(np.append(first, len(index)))
    out = table[index[first]].astype(np.float32)
    for k in range(1, min(int(count.max(initial=0)), 64)):
        at = np.flatnonzero(count > k)
        out[at] += table[index[first[at] + k]]
    for at in np.flatnonzero(count > 64):
        rest, hits = np.unique(index[first[at] + 64 : first[at] + count[at]], return_counts=True)
        out[at] += hits.astype(np.float32) @ table[rest]
    return out


class Item:
    def __init__(self, item_id: int, text: str, vocab: Vocabulary, weight: np.ndarray):
        value = _words_of([text])
        self.id, self.n = item_id, len(value)
        _, self.all = vocab.find(value)
        self.cols = self.all[weight[self.all] > 0]
        self.plain = len(self.cols) < FEWEST  # too few informative words: every word of the item counts
        if self.plain:
            self.cols = self.all
        self.masks: dict[int, int] = {}
        for i, c in enumerate(self.cols.tolist()):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        # the answer: what follows the last question mark or, without one, the last sentence
        tail = text.rstrip().rstrip(".!?").rpartition("?")[2] if "?" in text.rstrip()[:-1] else re.split(r"[.!?]\s", text.strip())[-1]
        _, answer = vocab.find(_words_of([tail]))
        self.answer = set(answer[weight[answer] > 0].tolist()) or set(answer.tolist())

    def common(self, cols: list[int]) -> int:
        """Length of the longest common subsequence, by bit-parallel dynamic programming."""
        full = (1 << len(self.cols)) - 1
        v = full
        for c in cols:
            m = self.masks.get(c)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
        return len(self.cols) - v.bit_count()

    def windows(self, weight: np.ndarray) -> list[np.ndarray]:
        """Columns of the item's 32-word windows, 16 words apart, the last one at its end."""
        starts = sorted({*range(0, max(1, self.n - 2 * STEP + 1), STEP), max(0, self.n - 2 * STEP)})
        return [self.all[s : s + 2 * STEP] for s in starts]


def _latent(y: np.ndarray, random: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors of A from Y = A'A R (Nystroem): columns x at most ``rank``."""
    q, _ = np.linalg.qr(y)
    core = random.T @ y
    core = (core + core.T) / 2
    half = q.T @ y
    small = half @ np.linalg.pinv(core, rcond=1e-8, hermitian=True) @ half.T
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-values)[:rank]
    top = top[values[top] > 1e-9 * max(values.max(), 1e-30)]
    return q @ vectors[:, top]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, cosine, overlap`` for each document that holds a benchmark item or a paraphrase.

    Whole texts are searched, in lower case, as bare words between blanks and ASCII punctuation.
    ``overlap`` is the share of the item's informative words in the
    longest common subsequence.  Null or empty texts hold nothing; items without words leak
    nowhere; equal items are found each; repeated documents are separate rows; a null doc_id
    stays null; empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, cosine double, overlap double"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("text")).filter("text is not null")
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text"))
    count = items.count()
    blocks = max(1, -(-count // BLOCK_ITEMS))
    found = None
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == k).toArrow().to_pylist()
        part = _search(texts, sorted(((r["item_id"], r["text"]) for r in own), key=lambda r: (r[0] is None, r)), schema)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)


def _search(texts: DataFrame, items: list[tuple[int, str]], schema: str) -> DataFrame | None:
    sc = texts.sparkSession.sparkContext
    if not items:
        return None
    values = _words_of([t for _, t in items])
    if not len(values):
        return None
    vocab = sc.broadcast(Vocabulary(values))
    n = len(vocab.value.values)

    def frequencies(batches):
        df, total = np.zeros(n, np.int64), 0
        for batch in batches:
            for _, _, row, at, col, size in _entries(batch.column(0), vocab.value):
                total += int((-(-size // STEP)).sum())
                block = (row << 40) + at // STEP
                if len(col):
                    order = np.argsort(col, kind="stable")  # blocks stay in order within a column
                    b, c = block[order], col[order]
                    new = np.ones(len(c), bool)
                    new[1:] = (c[1:] != c[:-1]) | (b[1:] != b[:-1])
                    df += np.bincount(c[new], minlength=n)
        yield packed_row(0, np.concatenate([df, [total]]))

    summed = sum_arrays(map_texts(texts.select("text"), frequencies, "part int, task int, body binary"), "int64").get(0)
    if summed is None:
        return None
    df, total = summed[:-1], max(1, int(summed[-1]))
    weight = np.log((total + 1) / (df + 1)).astype(np.float32)
    natural = np.maximum(weight, LEAST_WEIGHT)
    weight[df > max(MAX_DF * total, 20)] = 0
    kept = [Item(i, t, vocab.value, weight) for i, t in items]
    kept = [i for i in kept if i.n]
    # an item that leaked often makes its own words frequent: the rarest words of such windows keep their weight
    rare = []
    for item in kept:
        for win in item.windows(weight):
            if np.count_nonzero(weight[win] > 0) < FEWEST:
                own = np.unique(win)
                rare.append(own[np.argsort(df[own], kind="stable")[:RAREST]])
    if rare:
        rare = np.unique(np.concatenate(rare))
        weight[rare] = natural[rare]
    if not kept:
        return None
    if not (weight > 0).any():
        weight[:] = 1

    width = min(n, RANK + OVER)
    random = np.random.default_rng(11).standard_normal((n, width)).astype(np.float32)
    folded = sc.broadcast(random * weight[:, None])
    w = sc.broadcast(weight)

    def gram(passage: np.ndarray, col: np.ndarray, out: np.ndarray) -> None:
        """out += A'A R of the given entries, sorted by passage."""
        first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        rows = segment_sums(folded.value, col, first)
        of = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(col)]])))
        order = np.argsort(col, kind="stable")
        c = col[order]
        cut = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        out[c[cut]] += segment_sums(rows, of[order], cut) * w.value[c[cut], None]

    def ranges(batches):
        y = np.zeros((n, width))
        for batch in batches:
            for _, _, row, at, col, _ in _entries(batch.column(0), vocab.value):
                live = w.value[col] > 0
                if live.any():
                    gram(((row << 40) + at // (2 * STEP))[live], col[live], y)
        yield packed_row(0, y.astype(np.float32))

    y = sum_arrays(map_texts(texts.select("text"), ranges, "part int, task int, body binary"), "float32")[0].astype(np.float64).reshape(n, width)
    windows = [(k, win) for k, item in enumerate(kept) for win in item.windows(weight)]
    own = np.zeros((n, width))
    cols = np.concatenate([win for _, win in windows])
    gram(np.repeat(np.arange(len(windows)), [len(win) for _, win in windows]), cols, own)
    # the benchmark's own passages weigh as much as the corpus, so that its rare items are in the space
    y += own * (np.abs(y).sum() / max(np.abs(own).sum(), 1e-30) if y.any() else 1)
    vectors = (_latent(y, random, RANK) * weight[:, None]).astype(np.float32)
    target = np.stack([vectors[win].sum(0) for _, win in windows])
    length = np.linalg.norm(target, axis=1)
    good = length > 1e-6
    target, owner = target[good] / length[good, None], np.array([k for k, _ in windows])[good]
    if not len(owner):
        return None
    model = sc.broadcast((vectors, target, owner, kept))
    fewest = max(2, int(0.3 * min(min(len(win[weight[win] > 0]) for _, win in windows if (weight[win] > 0).any()), 2 * STEP)))

    def search(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found: list[tuple] = []
            for a, _, row, at, col, _ in _entries(batch.column(1), vocab.value):
                _leaks(ids, a, row, at, col, w.value, fewest, model.value, found)
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["doc_id", "item_id", "cosine", "overlap"])

    return map_texts(texts, search, schema)


def _leaks(ids, a, row, at, col, weight, fewest, model, found) -> None:
    vectors, target, owner, items = model
    every = row, at, col
    live = weight[col] > 0
    row, at, col = row[live], at[live], col[live]
    if not len(col):
        return
    block = (row << 40) + at // STEP
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    key, count = block[first], np.diff(np.concatenate([first, [len(col)]]))
    # windows of two neighbouring blocks: each block with the next; the first block's window also stands for one before it
    follows = np.zeros(len(key), bool)
    follows[:-1] = key[1:] == key[:-1] + 1
    both = count + np.where(follows, np.concatenate([count[1:], [0]]), 0)
    chosen = np.flatnonzero(both >= fewest)
    if not len(chosen):
        return
    needed = np.unique(np.concatenate([chosen, chosen[follows[chosen]] + 1]))
    ends = first + count
    # a word that is said again and again must not outweigh the others: within a block it counts once in four
    fresh = np.ones(len(col), bool)
    for lag in (1, 2, 3):
        fresh[lag:] &= (col[lag:] != col[:-lag]) | (block[lag:] != block[:-lag])
    at_fresh = np.concatenate([[0], np.cumsum(fresh)])
    begin, held = at_fresh[first[needed]], at_fresh[ends[needed]] - at_fresh[first[needed]]
    cut = np.concatenate([[0], np.cumsum(held)])
    index = np.arange(cut[-1]) + np.repeat(begin - cut[:-1], held)
    sums = np.zeros((len(key), vectors.shape[1]), np.float32)
    sums[needed] = segment_sums(vectors, col[fresh][index], cut[:-1])
    size, length = np.array([len(i.cols) for i in items]), np.array([i.n for i in items])
    plain = np.array([i.plain for i in items])
    places = (row << 40) + at
    for c0 in range(0, len(chosen), 4096):
        c = chosen[c0 : c0 + 4096]
        win = sums[c] + np.where(follows[c, None], sums[np.minimum(c + 1, len(key) - 1)], 0)
        norm = np.linalg.norm(win, axis=1)
        cosine = (win @ target.T) / np.maximum(norm, 1e-9)[:, None]
        wi, ti = np.nonzero(cosine >= COSINE)
        of, r = owner[ti], key[c[wi]] >> 40
        start = (key[c[wi]] & ((1 << 40) - 1)) * STEP
        # the stretch of words around the window in which the item may lie; too few words cannot overlap enough
        base, near = r << 40, np.maximum(start - length[of], 0)
        lo, hi = np.searchsorted(places, base + near), np.searchsorted(places, base + start + 2 * STEP + length[of])
        likely = np.flatnonzero((hi - lo >= LIKELY * size[of]) | plain[of])
        best: dict[tuple[int, int], tuple[float, float]] = {}
        for i in likely[np.argsort(-cosine[wi[likely], ti[likely]], kind="stable")].tolist():
            who, own = int(r[i]), int(of[i])
            item, got = items[own], best.get((who, own))
            if got and got[1] >= 1:
                continue
            if item.plain:
                low, high = np.searchsorted((every[0] << 40) + every[1], [base[i] + near[i], base[i] + start[i] + 2 * STEP + item.n])
                around = every[2][low:high].tolist()
            else:
                around = col[lo[i] : hi[i]].tolist()
            overlap = item.common(around) / len(item.cols)
            if overlap >= SURE or overlap >= LIKELY and len(item.answer.intersection(around)) >= ANSWER * len(item.answer):
                if not got or overlap > got[1]:
                    best[who, own] = (float(cosine[wi[i], ti[i]]), overlap)
        merged = {(ids[a + r], items[k].id, r): v for (r, k), v in best.items()}
        for (doc, item, r), (cos, overlap) in merged.items():
            found.append((doc, item, cos, overlap, r))


def leaked_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each (doc_id, item_id): the best cosine and overlap."""
    return materialize(find_leaks(docs, benchmark), "leaks").groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("overlap").alias("overlap"))
