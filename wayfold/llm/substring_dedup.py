"""Substring dedup with compact windows.

A text is its sequence of ``n``-word shingles; the least passage is ``t`` shingles.  For one hash
function the text's Cartesian tree over the shingles' hashes has, for every node, the widest
interval in which the node is the minimum: all passages inside that hold the node share that
min-hash.  Nodes whose interval is at least ``t`` long are the compact windows.  A *signature*
is a pair of min-hashes; its window is the intersection of two nodes' intervals, for every pair
of nodes that some passage of ``t`` shingles holds.

1. Windows of all documents meet on their signature.  An aggregate with partial sums in each task
   finds a signature's first document and drops those that only one document has.
2. Every other window is joined to the first document's window of its group, so a group costs
   its size, not its square.  Intervals of two documents on one diagonal are joined and verified
   on the shingles themselves, trimmed to the passages that really repeat.
3. The first document of a group need not hold the passage that later ones share, or not at its
   first place.  A passage of ``t`` shingles is *settled* when all but ``unlike`` of them lie in one
   verified passage.  Windows with passages that are not, in groups of three documents or more or whose first
   document has several windows of the signature, are listed, and with them the windows of their
   groups, but for passages that a verified keeper has word for word: its own window has the same
   signature and stands for them.  Two passages of ``t`` shingles that share all but ``unlike`` of them have one of their
   ``unlike + 1`` least shingles in common, under any order (prefix filter); here shingles of one
   text or of no open passage come first, which meet nobody, then those that few listed texts hold (in steps of ``SMALL``
   times), so that a common line only counts where next to nothing rarer stands beside it.  A shingle
   of at most ``SMALL`` texts brings all of them together.  Of one that more hold, windows that are
   equal but for such shingles are one class, for which its first document stands: a third text's
   open passage shares as much with each of them.  Open passages meet the first documents of their
   own class and of the group, then the first ones of 4, 16 and more parts of the classes, until they
   are settled or have met every class; no number bounds a group.  One link that the order before
   found is known to be left out (README).

No step depends on how rows are dealt over files, tasks or batches.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import buffers, mix, runs, shingles, words
from .jaccard import id_filter
from .scratch import TEXT_BYTES, map_texts, materialize

#: Signatures of two hash functions each.
BANDS = 3
GRID = 64
DRIFT = 32
SMALL = 8
_U = np.uint64
_LOW = _U((1 << 20) - 1)
#: A window's place: the first node's position, the second one's distance, the signature's number and whether its text has it again.
_POS, _DIST, _AGAIN = 24, 19, 8


def _seed(f: int) -> np.uint64:
    return _U((f + 1) * 0x9E3779B97F4A7C15 % (1 << 64))


def sliding_minimum(x: np.ndarray, t: int) -> np.ndarray:
    """Minimum of every ``t`` neighbours, from block-wise prefix and suffix minima."""
    n = len(x)
    if n < t:
        return x[:0]
    padded = np.full(-(-n // t) * t, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, t)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - t + 1], ahead[t - 1 : n])


def smaller_before(value: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Place of the nearest smaller value before each one in its row, or -1: all chains of greater ones are jumped at once."""
    if not len(value):
        return np.empty(0, np.int64)
    # each row begins with a 0 that is smaller than all
    begins = np.concatenate([[True], row[1:] != row[:-1]])
    shift = np.cumsum(begins)
    live = np.arange(len(value)) + shift
    own = live
    padded = np.zeros(len(value) + int(shift[-1]), np.uint64)
    padded[live] = value
    at = np.arange(len(padded)) - 1
    while len(live := live[padded[at[live]] > padded[live]]):
        at[live] = at[at[live]]
    found = at[own]
    return np.where(padded[found] > 0, found - shift, -1)


def passages(off: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, row) of every passage of ``t`` shingles; positions count the chunk's shingles."""
    count = np.maximum(0, np.diff(off) - t + 1)
    row = np.repeat(np.arange(len(count)), count)
    return np.arange(len(row)) + np.repeat(off[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count), row


def ordered(value: np.ndarray, f: int, level: np.ndarray | None = None) -> np.ndarray:
    """Hashes under function ``f``, above them the shingles' levels (0 to 15); of equal ones the leftmost is the smaller."""
    h = mix(value + _seed(f))
    if level is not None:
        h = (h >> _U(4)) | (level.astype(np.uint64) << _U(60))
    return (h & ~_LOW) | (np.arange(len(value), dtype=np.uint64) & _LOW)


def minima(h: np.ndarray, start: np.ndarray, row: np.ndarray, t: int) -> tuple[np.ndarray, ...]:
    """(node of each passage, place of each node's first passage, centre and least hash of each node)."""
    low = sliding_minimum(h, t)[start]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    centre = start[at] + ((low[at] & _LOW).astype(np.int64) - start[at]) % (1 << 20)
    return np.cumsum(new) - 1, at, centre, low[at]


def tree_intervals(off: np.ndarray, row: np.ndarray, centre: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the nodes' intervals in their rows' Cartesian trees.

    The nodes are those whose interval is at least one passage long, which are the minima of
    passages; such a node's ancestors are as long, so the tree over them alone has the same intervals.
    """
    before = smaller_before(least, row)
    after = smaller_before(least[::-1], -row[::-1])[::-1]
    first = np.where(before >= 0, centre[before] + 1, off[row])
    last = np.where(after >= 0, centre[np.minimum(len(row) - 1 - after, len(row) - 1)] - 1, off[row + 1] - 1)
    return first, last


def signature_windows(value: np.ndarray, off: np.ndarray, start: np.ndarray, row: np.ndarray, t: int, band: int) -> tuple[np.ndarray, ...]:
    """(row, key, centre, other centre, first, last) of one signature's windows; positions within the row."""
    f, g = 2 * band, 2 * band + 1
    (one, at1, c1, least1), (two, at2, c2, least2) = (minima(ordered(value, k), start, row, t) for k in (f, g))
    new = np.ones(len(start), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    one, two = one[new], two[new]
    key = mix(value[c1[one]] * _seed(f + 41) + mix(value[c2[two]] ^ _seed(g + 41)))
    (a1, b1), (a2, b2) = tree_intervals(off, row[at1], c1, least1), tree_intervals(off, row[at2], c2, least2)
    row = row[at1][one]
    base = off[row]
    return row, key, c1[one] - base, c2[two] - base, np.maximum(a1[one], a2[two]) - base, np.minimum(b1[one], b2[two]) - base


def _rows(column: pa.Array, n: int):
    data, off = buffers(column)
    for a, b in runs(off):
        value, _, _, word_off = words(data[off[a] : off[b]], off[a : b + 1] - off[a])
        counts = np.diff(word_off)
        shingle, s_off = shingles(value, word_off, n)
        yield a, b, shingle, s_off, counts


def _each(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingles) of texts, or of the shingles that ``_of_ids`` stored for them."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        data, off = buffers(column)
        for i in range(len(column)):
            yield i, data[off[i] : off[i + 1]].view(np.uint64)
        return
    for a, b, value, off, counts in _rows(column, n):
        for i in range(a, b):
            yield i, value[off[i - a] : off[i - a + 1]] if counts[i - a] >= n else value[:0]


def _emit(n: int, t: int, heads: bool, keep: Callable[[pa.Array], pa.Array] | None = None):
    """Windows ``key, doc, place, extent`` (first and last shingle); as ``heads`` only a text's first window of each signature, with ``keep`` only those whose key passes."""
    if t >= 1 << _DIST:
        raise ValueError(f"passages of {1 << _DIST} shingles and more have no place")

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, _, value, off, _ in _rows(batch.column(1), n):
                if len(value) >= 1 << 31:
                    raise ValueError("a text of more than 2**31 shingles has no place")
                start, row = passages(off, t)
                for band in range(BANDS if len(start) else 0):
                    of, key, c1, c2, first, last = signature_windows(value, off, start, row, t, band)
                    columns = [key.view(np.int64), ids[a + of], (c1 << _POS) | ((c2 - c1 + (1 << _DIST)) << 4) | band, (first << 32) | last]
                    if heads:
                        once, times = np.unique(key ^ mix(of.astype(np.uint64)), return_index=True, return_counts=True)[1:]
                        columns[2][once] |= np.where(times > 1, _AGAIN, 0)
                        once.sort()
                        columns = [c[once] for c in columns]
                    found = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "doc", "place", "extent"])
                    yield found.filter(keep(found.column(0))) if keep else found

    return run


def _starts(t: int, least: int):
    """``doc_id, starts``: runs ``a, b, open`` of starts of passages in listed windows, but of those that a keeper has word for word; open are those of open windows that no verified passage settles."""

    def run(batches):
        for batch in batches:
            docs, found = [], []
            for doc, rows, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                begin, end, is_open = (rows.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                end, done, copied = end - t + 2, np.empty((2, 0), np.int64), np.empty((2, 0), np.int64)
                if spans.is_valid:
                    done = np.stack([spans.values.field(k).to_numpy(zero_copy_only=False) for k in range(2)])
                    copied = done[:, spans.values.field(2).to_numpy(zero_copy_only=False).astype(bool)] + [[0], [2 - t]]
                    done = done[:, done[1] - done[0] + 1 >= least] + [[least - t], [2 - least]]
                edge = np.unique(np.concatenate([begin, end, *done, *copied]))
                held = (_depth(edge, begin, end) > 0) & (_depth(edge, *copied) == 0)
                opened = (_depth(edge, begin[is_open], end[is_open]) > 0) & (_depth(edge, *done) == 0)
                at = np.flatnonzero(held[:-1])
                docs.append(doc)
                found.append([{"a": int(edge[i]), "b": int(edge[i + 1]), "open": bool(opened[i])} for i in at])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("open", pa.bool_())])))], ["doc_id", "starts"])

    return run


def _depth(edge: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many ranges hold the stretch from each edge to the next."""
    step = np.bincount(np.searchsorted(edge, begin), minlength=len(edge)) - np.bincount(np.searchsorted(edge, end), minlength=len(edge))
    return np.cumsum(step)


def _chosen(rows: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a passage in one text whether it is listed, and whether it is open."""
    a, b, is_open = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    a, b = np.clip(a, 0, size), np.clip(b, 0, size)
    own, every = is_open.astype(bool), np.arange(size + 1)
    return _depth(every, a, b)[:size] > 0, _depth(every, a[own], b[own])[:size] > 0


def _held(n: int, t: int, keep: Callable[[pa.Array], pa.Array] | None = None):
    """``shingle, doc``: the distinct shingles of the passages that a document's listed windows hold and ``keep`` passes; without ``keep`` those of the open passages."""

    def run(batches):
        for batch in batches:
            ids, docs, held = batch.column(0).to_pylist(), [], []
            for i, own in _each(batch.column(1), n):
                if len(own) < t:
                    continue
                starts = _chosen(batch.column(2)[i].values, len(own) - t + 1)[0 if keep else 1]
                step = np.zeros(len(own) + 1, np.int64)
                step[: len(starts)] += starts
                step[t : t + len(starts)] -= starts
                held.append(np.unique(own[np.cumsum(step)[:-1] > 0]))
                docs.append(np.full(len(held[-1]), ids[i], np.int64))
            if held:
                found = pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64)), pa.array(np.concatenate(docs))], ["shingle", "doc"])
                yield found.filter(keep(found.column(0))) if keep else found

    return run


def _anew(n: int, t: int, size: int, most: np.ndarray):
    """Least shingles of the listed passages, as rows of ``PREFIXES``."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, own in _each(batch.column(1), n):
                if len(own) < t:
                    continue
                starts, is_open = _chosen(batch.column(2)[i].values, len(own) - t + 1)
                marks = batch.column(3)[i].values
                known = marks.field(0).to_numpy().view(np.uint64)
                order = np.argsort(known)
                at = order[np.minimum(np.searchsorted(known, own, sorter=order), len(known) - 1)]
                level = np.where(known[at] == own, marks.field(1).to_numpy()[at], 0)
                start = np.flatnonzero(starts)
                if len(start):
                    place, *columns = prefixes(own, level, start, is_open[start], t, size, most)
                    shared = level[place] > 0
                    place, columns = place[shared], [c[shared] for c in columns]
                    often, same = level[place] > 1, np.zeros(len(place), np.uint64)
                    same[often] = contents(own, level, columns[0][often], columns[1][often])
                    arrays = [own[place].view(np.int64), np.full(len(place), ids[i], np.int64), place, *columns, often, same.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in arrays], ["key", "doc", "place", "low", "high", "first", "last", "common", "same"])

    return run


#: A shingle's place, the passages of the starts ``low`` to ``high - t + 1`` that have it among their least, the open ones of them (-1: none),
#: and of a common shingle the value of the stretch ``low`` to ``high``.
PREFIXES = "key long, doc long, place long, low long, high long, first long, last long, common boolean, same long"


def places_before(own: np.ndarray) -> np.ndarray:
    """The last place before each one with the same shingle, or -1."""
    order = np.argsort(own, kind="stable")
    again = own[order[1:]] == own[order[:-1]]
    before = np.full(len(own), -1)
    before[order[1:][again]] = order[:-1][again]
    return before


def contents(own: np.ndarray, level: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One value for each stretch ``low`` to ``high``: equal for equal shingles in equal order.

    Shingles of level 0, which no other text or no open passage has, count as equal where they are new in the stretch, and where
    they are not: any third text's open passage shares as much with the one stretch as with the other.
    """
    before = places_before(own)
    out = np.empty(len(low), np.uint64)
    size = high - low + 1
    step = max(1, (1 << 18) // max(1, int(size.max(initial=1))))
    for i in range(0, len(low), step):
        n = size[i : i + step]
        cut = np.cumsum(n) - n
        nth = np.arange(int(n.sum())) - np.repeat(cut, n)
        at = np.repeat(low[i : i + step], n) + nth
        value = np.where(level[at] > 0, own[at], np.where(before[at] < at - nth, _U(1), _U(2)))
        out[i : i + step] = mix(np.add.reduceat(mix(value ^ mix(nth.astype(np.uint64) + _seed(1))), cut) ^ n.astype(np.uint64))
    return out


def prefixes(own: np.ndarray, level: np.ndarray, start: np.ndarray, is_open: np.ndarray, t: int, size: int, most: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """``place, low, high, first, last`` of the ``size`` least different shingles of the passages that begin at ``start``.

    Places of one shingle that are less than ``t`` apart are one row.  A passage of k different shingles is open to nobody
    if more than ``most[k]`` of them are of level 0, which no other text has.
    """
    h = (mix(own + _seed(0)) >> _U(4)) | (level.astype(np.uint64) << _U(60))
    before = places_before(own)
    none, top = len(own), np.iinfo(np.uint64).max
    low, high, first, last = np.full(none, none), np.full(none, -1), np.full(none, none), np.full(none, -1)
    windows, earlier = (np.lib.stride_tricks.sliding_window_view(x, t) for x in (h, before))
    step = max(1, (1 << 18) // t)
    for i in range(0, len(start), step):
        s = start[i : i + step]
        x = windows[s]
        x[earlier[s] >= s[:, None]] = top  # a shingle counts once in a passage
        bound = np.partition(x, size - 1, axis=1)[:, size - 1 :][:, :1]
        row, k = np.nonzero((x <= bound) & (x < top))
        hopeful = is_open[i : i + step]
        if most is not None:
            hopeful = hopeful & ((x >> _U(60) == 0).sum(axis=1) <= most[(x < top).sum(axis=1)])
        own_open = hopeful[row]
        begin, at = s[row], s[row] + k
        np.minimum.at(low, at, begin)
        np.maximum.at(high, at, begin)
        np.minimum.at(first, at[own_open], begin[own_open])
        np.maximum.at(last, at[own_open], begin[own_open])
    at = np.flatnonzero(high >= 0)
    at = at[np.lexsort((at, own[at]))]
    new = np.ones(len(at), bool)
    new[1:] = (own[at[1:]] != own[at[:-1]]) | (at[1:] - at[:-1] >= t)
    head = np.flatnonzero(new)
    first, last = np.minimum.reduceat(first[at], head), np.maximum.reduceat(last[at], head)
    return at[head], np.minimum.reduceat(low[at], head), np.maximum.reduceat(high[at], head) + t - 1, np.where(last < 0, -1, first), last


def _at(place: Column) -> Column:
    return F.shiftright(place, _POS)


def _lined(place: Column, extent: Column, k_place: Column, k_extent: Column) -> list[Column]:
    """``low, high, shift``: what two windows with one signature have in common, in the first one's positions."""
    shift = _at(k_place) - _at(place)
    last = lambda e: e.bitwiseAND(F.lit(0xFFFFFFFF))
    low = F.greatest(F.shiftright(extent, 32), F.shiftright(k_extent, 32) - shift)
    return [low.alias("low"), F.least(last(extent), last(k_extent) - shift).alias("high"), shift.alias("shift"), shift.alias("s0"), shift.alias("s1")]


def _hull(place: Column, extent: Column, t: int) -> list[Column]:
    """``low, high``: first and last shingle of a window's passages of ``t`` shingles."""
    one = _at(place)
    two = one + F.shiftright(place, 4).bitwiseAND(F.lit((1 << (_DIST + 1)) - 1)) - F.lit(1 << _DIST)
    low = F.greatest(F.shiftright(extent, 32), F.greatest(one, two) - (t - 1))
    return [low.alias("low"), F.least(extent.bitwiseAND(F.lit(0xFFFFFFFF)), F.least(one, two) + (t - 1)).alias("high")]


def repeated_passages(docs: DataFrame, min_words: int = 50, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, first_word, last_word, kept_doc_id, kept_first_word, kept_last_word, similarity``.

    One row for each passage of at least ``min_words`` words whose set of ``n``-word shingles
    has a Jaccard similarity of num/den or more with a passage of a document with a smaller
    doc_id, which keeps it.  Words as in the Jaccard join; positions count words from 0, both
    ends included.  Passages repeated only inside one document are not reported.  Null, empty
    and short texts have no passages; long texts are searched whole; rows with a null doc_id
    take no part (no smaller id can keep them); rows that repeat a doc_id are one document's
    texts and are not compared with each other; equal hashes in one text go to the leftmost;
    an empty table gives an empty result; other columns are ignored.
    """
    t = min_words - n + 1
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    # no shuffle is read again after its table is written
    texts.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    schema = "key long, doc long, place long, extent long"
    heads = map_texts(texts, _emit(n, t, True), schema).groupBy("key")
    heads = heads.agg(F.min("doc").alias("kept"), F.max("doc").alias("last"), F.min_by("place", "doc").alias("k_place"), F.min_by("extent", "doc").alias("k_extent"), F.count("*").alias("docs"))
    shared = materialize(heads.filter("kept < last").drop("last"), "signatures")
    # windows that surely meet nobody are not shuffled again
    keep = id_filter(shared.select(F.col("key").alias("doc_id")))
    met = materialize(map_texts(texts, _emit(n, t, False, keep), schema).join(shared, "key"), "met")

    lined = met.filter("doc > kept").select("doc", "kept", *_lined(F.col("place"), F.col("extent"), F.col("k_place"), F.col("k_extent")))
    found = materialize(_verified(texts, _pieces(lined), n, t, num, den), "found")
    # a group of two whose first document has the signature once has nothing else to meet
    crowded = met.filter((F.col("docs") > 2) | (F.col("k_place").bitwiseAND(F.lit(_AGAIN)) > 0))
    found = _later(texts, crowded.select("key", "doc", "kept", *_hull(F.col("place"), F.col("extent"), t)), found, n, t, num, den)
    # two lanes of one passage may give the same stretch
    keeper = F.min(F.struct("kept_doc_id", "kept_first_word", "kept_last_word", "similarity")).alias("k")
    return found.groupBy("doc_id", "first_word", "last_word").agg(keeper).select("doc_id", "first_word", "last_word", "k.*")


def _spans(found: DataFrame, n: int) -> DataFrame:
    return found.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_set(F.struct(F.col("first_word").alias("a"), (F.col("last_word") - n + 1).alias("b"), "verbatim")).alias("spans"))


def _settled(first: Column, last: Column, t: int, least: int) -> Column:
    """Whether one of ``spans`` holds ``least`` of the shingles of each passage with a start from ``first`` to ``last``."""
    holds = lambda s, x: F.least(s["b"], x + (t - 1)) - F.greatest(s["a"], x) + 1 >= least
    return F.coalesce(F.exists("spans", lambda s: holds(s, first) & holds(s, last)), F.lit(False))


def _unsettled(rows: DataFrame, first: Column, last: Column, found: DataFrame, n: int, t: int, least: int) -> DataFrame:
    """Rows of passages with starts ``first`` to ``last`` that no passage of ``found`` settles."""
    return rows.join(_spans(found, n), "doc", "left").filter(~_settled(first, last, t, least)).drop("spans")


def unlike(n: int, t: int, num: int, den: int) -> int:
    """Most shingles of a passage of ``t`` that one with J >= num/den may lack.

    J >= num/den leaves both sides together (den - num)/num shingles for each shared one; words
    put in, left out or changed between shared ones break ``n - 1`` shingles or more of either side.
    """
    return max(0, (t * (den - num) - (n - 1) * num) // den)


def _later(texts: DataFrame, crowded: DataFrame, found: DataFrame, n: int, t: int, num: int, den: int) -> DataFrame:
    """``found`` and the passages that it leaves open, against all other members of their groups."""
    least = t - unlike(n, t, num, den)
    # what its keeper has word for word is met there: the keeper's window has the same signature
    copied = F.exists("spans", lambda s: s["verbatim"] & (s["a"] <= F.col("low")) & (s["b"] >= F.col("high")))
    is_open = (F.col("doc") > F.col("kept")) & ~_settled(F.col("low"), F.col("high") - (t - 1), t, least)
    crowded = crowded.join(_spans(found, n), "doc", "left").filter(~F.coalesce(copied, F.lit(False)))
    crowded = materialize(crowded.select("key", "doc", "low", "high", is_open.alias("open")), "crowded")
    left = crowded.filter("open")
    if left.isEmpty():
        return found
    groups = crowded.join(left.select("key").distinct(), "key", "left_semi").select("doc", "low", "high", "open")
    listed = groups.groupBy("doc").agg(F.collect_set(F.struct("low", "high", "open")).alias("rows"))
    listed = materialize(map_texts(listed.join(_spans(found, n), "doc", "left").select("doc", "rows", "spans"), _starts(t, least), "doc_id long, starts array<struct<a: long, b: long, open: boolean>>").filter(F.size("starts") > 0), "listed")
    if listed.filter(F.exists("starts", lambda x: x["open"])).isEmpty():
        return found
    own = materialize(_of_ids(texts, listed.select("doc_id"), n).join(listed, "doc_id"), "shingles")

    # levels: 0 for a shingle of one text or of no open passage, 1 for up to SMALL texts, above them one more for each SMALL times as many
    sought = materialize(map_texts(own.filter(F.exists("starts", lambda x: x["open"])), _held(n, t), "shingle long, doc long").select(F.col("shingle").alias("doc_id")), "sought")
    held = materialize(map_texts(own, _held(n, t, id_filter(sought)), "shingle long, doc long"), "held")
    more = F.greatest(F.lit(1), F.ceil(F.log("texts") / float(np.log(max(2, SMALL)))) - 1)
    level = F.when(F.col("texts") <= SMALL, F.lit(1)).otherwise(F.least(F.lit(15), 1 + more)).cast("long")
    shared = held.groupBy("shingle").agg(F.count("*").alias("texts")).filter("texts > 1").withColumn("level", level)
    marks = held.join(shared.select("shingle", "level"), "shingle").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set(F.struct("shingle", "level")).alias("marks"))
    windows = map_texts(own.join(marks, "doc_id").select("doc_id", "shingles", "starts", "marks"), _anew(n, t, t - least + 1, np.arange(t + 1) * (den - num) // den), PREFIXES)
    windows = materialize(windows, "windows")
    wanted = windows.groupBy("key").agg(F.min("doc").alias("least"), F.max(F.when(F.col("last") >= 0, F.col("doc"))).alias("top")).filter("top > least")
    windows = materialize(windows.join(wanted.drop("top"), "key"), "windows")

    own = own.select("doc_id", "shingles")
    other_columns = ["key", F.col("doc").alias("kept"), F.col("place").alias("k_place"), F.col("low").alias("k_low"), F.col("high").alias("k_high")]
    other = lambda rows: rows.select(*other_columns)
    line = lambda rows: rows.filter("kept < doc").select("doc", "kept", "low", "high", F.expr("k_place - place").alias("shift"), F.expr("k_low - low").alias("s0"), F.expr("k_high - high").alias("s1"))
    pending = windows.filter("last >= 0 and doc > least")
    rare = pending.filter("not common").join(other(windows.filter("not common")), "key")  # at most SMALL documents hold the shingle
    # the first document's one of equal windows stands for all: others share as much with it, and word for word copies settle each other
    alike = windows.filter("common").groupBy("key", "same", "least").agg(F.min(F.struct("doc", "place", "low", "high")).alias("first"))
    alike = materialize(alike.select("key", "same", "least", "first.*"), "alike")
    members = alike.join(alike.groupBy("key").agg(F.count("*").alias("rows")), "key")
    pending = pending.filter("common").join(members.select("same", "rows", *other_columns), ["key", "same"])
    copies, pending = pending.filter("kept < doc"), pending.drop("kept", "k_place", "k_low", "k_high")
    part = materialize(_verified(own, _pieces(line(rare).unionByName(line(copies)).unionByName(line(pending.join(other(members.filter("doc = least")), "key")))), n, t, num, den), "found")
    found, parts = found.unionByName(part), 1
    before = members.filter("doc = least").select("key", "doc").distinct()  # whom all pending ones have met
    pending = _unsettled(pending, F.col("first"), F.col("last"), part, n, t, least)
    while not (pending := materialize(pending.filter(F.col("rows") > parts), "pending")).isEmpty():
        parts *= 4
        # the first documents of 4, 16, ... parts of a group, at last all of its unlike windows
        firsts = members.filter(F.col("rows") > parts).groupBy("key", F.pmod(F.xxhash64("doc"), F.lit(parts)).alias("by")).agg(F.min("doc").alias("doc")).drop("by")
        one = members.join(firsts, ["key", "doc"], "left_semi").unionByName(members.filter(F.col("rows") <= parts)).join(before, ["key", "doc"], "left_anti")
        before = firsts
        part = materialize(_verified(own, _pieces(line(pending.join(other(one), "key"))), n, t, num, den), "found")
        found = found.unionByName(part)
        pending = _unsettled(pending, F.col("first"), F.col("last"), part, n, t, least)
    return found


def _pieces(lined: DataFrame) -> DataFrame:
    """The stretches of two documents near one diagonal, joined, with the keeper's stretch; verification parts what does not belong together."""
    lined = lined.withColumn("lane", F.round(F.col("shift") / DRIFT).cast("long"))
    pieces = lined.groupBy("doc", "kept", "lane").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("s0").alias("s0"), F.max("s1").alias("s1"))
    # the keeper's stretch on a grid that grows with its length: few different ones for each document
    begin, end = F.greatest(F.lit(0).cast("long"), F.col("low") + F.col("s0") - GRID), F.col("high") + F.col("s1") + GRID
    grid = F.expr(f"shiftleft(1L, greatest({GRID.bit_length() - 1}, cast(floor(log2(greatest(1, high - low + s1 - s0))) as int) - 2))")
    k_low, k_high = F.floor(begin / grid) * grid, (F.floor(end / grid) + 1) * grid - 1
    return materialize(pieces.select("doc", "kept", "low", "high", k_low.cast("long").alias("k_low"), k_high.cast("long").alias("k_high")), "pieces")


def _verified(texts: DataFrame, pieces: DataFrame, n: int, t: int, num: int, den: int) -> DataFrame:
    """The passages that the pieces' stretches really share; one stretch of each side travels for each piece."""

    def cut(batches):
        for batch in batches:
            ids, asked = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out: list[tuple] = []
            for i, own in _each(batch.column(1), n):
                for q in asked[i]:
                    begin = max(0, q["low"] - t)
                    body = own[begin : q["high"] + t + 1]
                    if len(body):
                        out.append((ids[i], begin, q["kept"], q["k_low"], q["k_high"], body.tobytes()))
                if len(out) >= 256:
                    yield _stretches(out)
                    out = []
            yield _stretches(out)

    def ask(rows: DataFrame, who: str) -> DataFrame:
        wanted = rows.groupBy(F.col(who).alias("doc_id")).agg(F.collect_list(F.struct("low", "high", "kept", "k_low", "k_high")).alias("asked"))
        chosen = _of_ids(texts, materialize(rows.select(F.col(who).alias("doc_id")).distinct(), "chosen", narrow=True))
        return map_texts(chosen.join(wanted, "doc_id").select(*texts.columns, "asked"), cut, "doc long, begin long, kept long, k_low long, k_high long, body binary")

    # a keeper's stretch is cut once, however many documents ask for it
    kept = pieces.select("kept", "k_low", "k_high").distinct().select("kept", (F.col("k_low") + t).alias("low"), (F.col("k_high") - t).alias("high"), "k_low", "k_high")
    kept = materialize(ask(kept, "kept").select("kept", "k_low", "k_high", F.col("begin").alias("k_begin"), F.col("body").alias("k_body")), "kept")
    both = ask(pieces, "doc").join(kept, ["kept", "k_low", "k_high"])

    def verify(batches):
        for batch in batches:
            found: list[tuple] = []
            doc, begin, keeper, k_begin = (batch.column(k).to_pylist() for k in range(4))
            (body, off), (k_body, k_off) = buffers(batch.column(4)), buffers(batch.column(5))
            for i in range(batch.num_rows):
                own, kept = body[off[i] : off[i + 1]].view(np.uint64), k_body[k_off[i] : k_off[i + 1]].view(np.uint64)
                for x, y, kx, ky, sim in shared_passages(own, 0, len(own) - 1, kept, t, num, den):
                    verbatim = sim == 1 and stands_in(own[x : y + 1], kept)
                    found.append((doc[i], begin[i] + x, begin[i] + y + n - 1, keeper[i], k_begin[i] + kx, k_begin[i] + ky + n - 1, sim, verbatim))
            kinds = [pa.int64()] * 6 + [pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], ["doc_id", "first_word", "last_word", "kept_doc_id", "kept_first_word", "kept_last_word", "similarity", "verbatim"])

    schema = "doc_id long, first_word long, last_word long, kept_doc_id long, kept_first_word long, kept_last_word long, similarity double, verbatim boolean"
    return map_texts(both.select("doc", "begin", "kept", "k_begin", "body", "k_body"), verify, schema)


def _stretches(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k == 5 else pa.int64()) for k in range(6)], ["doc", "begin", "kept", "k_low", "k_high", "body"])


def _of_ids(texts: DataFrame, chosen: DataFrame, n: int = 0) -> DataFrame:
    """The chosen documents' rows; with ``n`` their texts' shingles in place of the texts, which are not valued again."""
    keep = id_filter(chosen)

    def run(batches):
        for batch in batches:
            batch = batch.filter(keep(batch.column(0)))
            if not n:
                yield batch
                continue
            ids, docs, held, size = batch.column(0).to_numpy(), [], [], 0
            for i, own in _each(batch.column(1), n):
                docs.append(ids[i])
                held.append(own.tobytes())
                size += len(held[-1])
                if size >= TEXT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(held, pa.binary())], ["doc_id", "shingles"])
                    docs, held, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(held, pa.binary())], ["doc_id", "shingles"])

    return map_texts(texts, run, "doc_id long, shingles binary" if n else "doc_id long, {} {}".format(*texts.dtypes[1]))


def longest(hit: np.ndarray, miss: int) -> tuple[int, int]:
    """First and last hit of the longest stretch with at least ``miss`` hits for each miss; (0, -1) without hits."""
    sums = np.concatenate([[0], np.cumsum(np.where(hit, 1, -miss))])
    best_after = np.maximum.accumulate(sums[::-1])[::-1]
    end = np.searchsorted(-best_after, -sums, "right") - 1  # the last place whose sum is no smaller
    start = int(np.argmax(end - np.arange(len(sums))))
    inside = np.flatnonzero(hit[start : end[start]])
    return (start + int(inside[0]), start + int(inside[-1])) if len(inside) else (0, -1)


def stands_in(part: np.ndarray, whole: np.ndarray) -> bool:
    """Whether ``whole`` has ``part`` in one piece."""
    at = np.flatnonzero(whole[: max(0, len(whole) - len(part) + 1)] == part[0])
    return any(np.array_equal(whole[i : i + len(part)], part) for i in at.tolist())


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _held_by(x: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(x), bool)
    return ascending[np.minimum(np.searchsorted(ascending, x), len(ascending) - 1)] == x


def shared_passages(own: np.ndarray, low: int, high: int, kept: np.ndarray, t: int, num: int, den: int) -> list[tuple]:
    """(first, last, kept first, kept last, similarity) of the passages that ``own[low..high]`` shares with ``kept``.

    The longest stretch at the asked similarity is tried first, then denser ones down to
    unbroken runs, at last the least passages with most hits; what is left on both sides of a
    found passage is searched again.
    """
    found, todo = [], [(max(0, low - t), min(len(own), high + t + 1))]
    # of either of two stretches with J >= num/den, a share of num/den are hits; of one length, 2 num / (num + den)
    loosest, even = (max(1, k * num // max(1, den - num)) for k in (1, 2))
    every = np.sort(kept)
    while todo:
        begin, end = todo.pop()
        part = own[begin:end]
        if len(part) < t or len(kept) < t * num // den:
            continue
        hit = _held_by(part, every)
        tries = (loosest, even, 4 * even, len(part))
        for miss, (a, b) in itertools.chain(((m, longest(hit, m)) for m in tries), _densest(hit, t, t * num // den, tries)):
            if b - a + 1 < t:
                continue
            left = _distinct(part[a : b + 1])
            x, y = longest(_held_by(kept, left), miss)
            right = _distinct(kept[x : y + 1])
            inter = int(_held_by(left, right).sum())
            union = len(left) + len(right) - inter
            if y - x + 1 >= t * num // den and den * inter >= num * union:
                found.append((begin + a, begin + b, x, y, inter / union))
                todo += [(begin, begin + a), (begin + b + 1, end)]
                break
    return found


def _densest(hit: np.ndarray, t: int, fewest: int, tries: tuple[int, ...]) -> Iterator[tuple[int, tuple[int, int]]]:
    """The first and the last one of the stretches of ``t`` with most hits, for each of ``tries``; none with fewer than ``fewest``."""
    sums = np.concatenate([[0], np.cumsum(hit)])
    hits = sums[t:] - sums[:-t]
    most = int(hits.max(initial=0))
    if fewest <= most < t:
        best = np.flatnonzero(hits == most)
        for a in sorted({int(best[0]), int(best[-1])}):
            for miss in tries:
                yield miss, (a, a + t - 1)
