"""Token counts by rank-synchronous array merging of byte-pair merges.

Texts are cut into pre-tokens; pre-tokens not seen before are held as one ragged numpy array
of symbols, and in each round every pre-token merges all places of its own lowest-rank pair
at once.  The symbols that survive are counted.  Counts of seen pre-tokens are kept in a
bounded table per Python worker, so memory does not grow with the corpus.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import REMEMBERED_BY, map_texts

#: The pre-token pattern of the rank files; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 400_000
_NONE = np.int64(1) << 40


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Ranks of pairs in an open-addressing table of numpy arrays; symbols 0-255 are bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]) or spec.get("normalizer"):
            raise ValueError("only byte-level vocabularies without normaliser are counted here")
        # PATTERN is what the byte-level pre-tokeniser's own pattern stands for
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if (before.get("type"), before.get("use_regex", True), before.get("add_prefix_space")) != ("ByteLevel", True, False) or model["type"] != "BPE":
            raise ValueError("only BPE over the byte-level pre-tokeniser's own pattern is counted here")
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("a vocabulary with affixes, dropout, byte fallback or ignored merges is not counted here")
        letters = _byte_letters()
        symbol = {bytes([b]): b for b in range(256)}
        as_bytes = lambda s: bytes(letters[c] for c in s)
        left, right, made = [], [], []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (as_bytes(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            new = symbol.setdefault(a + b, 256 + rank)
            left.append(symbol[a])
            right.append(symbol[b])
            made.append(new)
        self.made = np.array(made, np.int64)
        self.mask = (1 << 18) - 1
        keys = (np.array(left, np.int64) << 20) | np.array(right, np.int64)
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.ranks = np.full(self.mask + 1, _NONE, np.int64)
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            slot = (self._slot(keys[todo]) + step) & self.mask
            free = self.keys[slot] == -1
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.ranks[slot[put]] = keys[todo[put]], todo[put]
            todo, step = todo[~put], step + 1
            if len(todo) and put.sum() == 0 and step > self.mask:
                raise ValueError("merge table is full")
        self.probes = step

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 20) | right
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], _NONE)
        open_ = np.flatnonzero((out == _NONE) & (self.keys[slot] != -1))
        for step in range(1, self.probes):
            if not len(open_):
                break
            s = (slot[open_] + step) & self.mask
            hit = self.keys[s] == keys[open_]
            out[open_[hit]] = self.ranks[s[hit]]
            open_ = open_[~hit & (self.keys[s] != -1)]
        return out

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that survive in each pre-token."""
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        result = size.copy()
        sym = np.frombuffer(b"".join(tokens), np.uint8).astype(np.int64)
        row = np.repeat(np.arange(len(tokens)), size)
        rank = self._ranks(sym, row)
        while True:
            best = np.full(len(tokens), _NONE, np.int64)
            np.minimum.at(best, row, rank)
            # sequences with no pair left are finished and leave the arrays
            live = best[row] != _NONE
            if not live.all():
                sym, row, rank = sym[live], row[live], rank[live]
            if not len(sym):
                return result
            hit = rank == best[row]
            # of overlapping equal pairs (a a a) every second one from the left merges
            at = np.flatnonzero(hit)
            run = np.concatenate([[True], at[1:] != at[:-1] + 1])
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            np.subtract.at(result, row[at], 1)
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            touched[at[at > 0] - 1] = True  # if that one is gone, it belongs to a merge two places back
            sym, row, rank, touched = sym[keep], row[keep], rank[keep], touched[keep]
            fix = np.flatnonzero(touched)
            rank[fix] = self._ranks_at(sym, row, fix)

    def _ranks(self, sym: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self._ranks_at(sym, row, np.arange(len(sym)))

    def _ranks_at(self, sym: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), _NONE, np.int64)
        ok = at < len(sym) - 1
        ok[ok] = row[at[ok]] == row[at[ok] + 1]
        out[ok] = self.rank(sym[at[ok]], sym[at[ok] + 1])
        return out


@lru_cache(maxsize=2)
def _merges(path: str) -> Merges:
    return Merges(path)


_seen: dict[str, dict[str, int]] = {}
REMEMBERED_BY["token_counts"] = _seen


_CUT = regex.compile(r"(?<=\S) (?=\S)")


def segments(text: str, limit: int = 1 << 19) -> list[str]:
    """A long text in parts of about ``limit`` characters, cut before single blanks, where pre-tokens always end."""
    parts, at = [], 0
    while len(text) - at > limit and (cut := _CUT.search(text, at + limit)):
        parts.append(text[at : cut.start()])
        at = cut.start()
    return [*parts, text[at:]] if parts else [text]


class Counter:
    def __init__(self, path: str):
        self.merges = _merges(path)
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(map(regex.escape, self.merges.special))).split if self.merges.special else None
        self.known = _seen.setdefault(path, {})

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; a long one is counted part by part."""
        if all(len(t or "") <= 1 << 20 for t in texts):
            return self._count(texts)
        return [sum(sum(self._count([p])) for p in segments(t)) if t and len(t) > 1 << 20 else self._count([t])[0] for t in texts]

    def _count(self, texts: list[str | None]) -> list[int]:
        pieces, extra = [], []
        for t in texts:
            t = t or ""
            specials = 0
            found: list[str] = []
            if self.cut and any(x in t for x in self.merges.special):
                parts = self.cut(t)
                specials = len(parts) - 1
                for p in parts:
                    found += self.find(p)
            else:
                found = self.find(t)
            pieces.append(found)
            extra.append(specials)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = list({w for found in pieces for w in found if w not in known})
        for a in range(0, len(new), 50_000):
            part = new[a : a + 50_000]
            known.update(zip(part, self.merges.counts([w.encode() for w in part]).tolist(), strict=True))
        get = known.__getitem__
        return [sum(map(get, found)) + n for found, n in zip(pieces, extra, strict=True)]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    ``tokenizer`` is the path of a byte-level vocabulary that every executor can read.  A null
    text is the empty text (0 bytes, 0 tokens); whole texts are counted, whatever their
    length; strings of special tokens count as one token; repeated rows stay separate; an
    empty table gives an empty result.  Other columns are ignored.
    """

    def run(batches):
        counter = Counter(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a in range(0, len(ids), 512):
                part = texts.slice(a, 512).to_pylist()
                n = counter.count(part)
                size = [len(t.encode()) if t else 0 for t in part]
                yield pa.RecordBatch.from_arrays([ids.slice(a, 512), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(texts, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", "token_counts")
