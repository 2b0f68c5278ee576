"""Token-ID output: Arrow files of fixed-size-list batches, written and read without copies.

The ids of all documents, in ascending doc_id order, are one stream; every shard holds one
range of documents as sequences of ``seq_len`` ids plus a mask of the same shape, the last
sequence of a shard padded under a false mask.  Files are uncompressed Arrow IPC files with
batches of ``batch_rows`` sequences, so id number p of a shard lies in batch
``p // (seq_len * batch_rows)`` at a known place and is read by slicing a memory map.

A task writes its shard under a name of its own and reports it with the index rows; a repeated
task writes another file, and only reported files are ever read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bytetext import FOLD, buffers, runs
from .scratch import REMEMBERED_BY, fresh_dir, map_texts, materialize
from .token_counts import segments

REMEMBERED = 600_000
#: Bytes that are cut into pieces at once.
CHUNK = 4 << 20

#: What a vocabulary must say for its texts to be cut at blanks and where the kind of ASCII bytes changes (fixed values of the format).
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: Kinds of bytes: blanks, letters, digits, punctuation, and what keeps its whole word together: bytes
#: beyond ASCII and control bytes (the normaliser's), the apostrophe (the pattern's), "<" (special strings').
BLANK, LETTER, DIGIT, MARK, ODD = range(5)
_KIND = np.full(256, ODD, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0D]] = BLANK
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[48:58] = DIGIT
_KIND[[*range(33, 39), *range(40, 48), 58, 59, *range(61, 65), *range(91, 97), *range(123, 127)]] = MARK


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(pieces of the texts, each text's first piece): runs of ASCII letters in lower case, single digits, runs of punctuation, and whole words that hold an odd byte."""
    kind = _KIND[data]
    edge = kind == DIGIT
    edge[1:] |= kind[1:] != kind[:-1]
    begins = off[:-1][off[:-1] < off[1:]]
    edge[begins] = True
    at = np.flatnonzero(edge)
    own = kind[at]
    # a word begins after a blank or with its text
    word = (own == BLANK) | (kind[np.maximum(at, 1) - 1] == BLANK)
    word[np.searchsorted(at, begins)] = True
    group = np.cumsum(word) - 1
    whole = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
    whole[group[own == ODD]] = True
    kept = word | ~whole[group]
    at, own, odd = at[kept], own[kept], whole[group[kept]]
    size = np.diff(at, append=len(data))
    said = own != BLANK
    flat, size, odd = data[kind != BLANK], size[said], odd[said]
    low = FOLD[flat]
    if odd.any():
        low = np.where(np.repeat(odd, size), flat, low)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    cut = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(low)])
    return cut, np.searchsorted(at[said], off)


INDEX = "shard int, path string, doc_id long, local_start long, n_tokens long"


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _cuts(path: str) -> bool:
    """Whether a vocabulary's texts may be encoded piece by piece."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    plain = model.get("type") == "BPE" and not model.get("dropout") and spec.get("post_processor") is None and spec.get("truncation") is None and spec.get("padding") is None
    # a special string holds "<" and no blank, so the word around it is one piece
    marked = all("<" in t["content"] and not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] for t in spec.get("added_tokens", []))
    return plain and marked and spec.get("normalizer") == _NORMALIZER and spec.get("pre_tokenizer") == _PRE_TOKENIZER


#: For each vocabulary, pieces and their packed ids: the newer generation and the one before it.
_seen: dict[str, list[dict[str, bytes]]] = {}
REMEMBERED_BY["token_output"] = _seen


class Encoder:
    """Ids of whole texts from the library, remembered for each piece.

    A vocabulary with the normaliser and pattern above gives the same ids for a text and for its
    ``pieces``: pre-tokens never reach over a blank or a change of kind, and special strings stay
    in one piece.  Other vocabularies are encoded text by text.  Two generations of at most
    ``REMEMBERED`` pieces bound the memory: a piece that is met again moves to the newer one.
    """

    def __init__(self, path: str):
        self.lib = _tokenizer(path)
        self.kind = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        self.generations = _seen.setdefault(path, [{}, {}])
        self.by_piece = _cuts(path)

    def pack(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Packed ids of each text; a long one is encoded part by part where that gives the same ids."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_piece:
            return [np.array(e.ids, self.kind).tobytes() for e in self.lib.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
        data, off = buffers(column)
        out: list[bytes] = []
        for a, b in runs(off, CHUNK):
            if b - a == 1 and off[b] - off[a] > CHUNK:
                parts = pa.array(segments(column[a].as_py(), CHUNK), pa.string())
                # an unbroken part may still be long: it has no blank to be cut at
                out.append(b"".join(self._pack(*buffers(parts.slice(i, 1)))[0] for i in range(len(parts))))
            else:
                out += self._pack(data[off[a] : off[b]], off[a : b + 1] - off[a])
        return out

    def _pack(self, data: np.ndarray, off: np.ndarray) -> list[bytes]:
        cut, first = pieces(data, off)
        coded = cut.dictionary_encode()
        found = coded.dictionary.to_pylist()
        ids = pa.array(self._ids(found), pa.binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1][first].tolist() if len(ids) else [0] * len(first)
        body = memoryview(ids.buffers()[2]) if len(ids) else memoryview(b"")
        return [bytes(body[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]

    def _ids(self, found: list[bytes]) -> list[bytes]:
        """Packed ids of each of some unlike pieces."""
        if len(self.generations[0]) > REMEMBERED:
            self.generations[:] = [{}, self.generations[0]]
        known, before = self.generations
        out = list(map(known.get, found))
        todo = []
        for i, ids in enumerate(out):
            if ids is None:
                ids = before.get(found[i])
                if ids is None:
                    todo.append(i)
                else:
                    out[i] = known[found[i]] = ids
        for a in range(0, len(todo), 4096):
            part = todo[a : a + 4096]
            e = self.lib.encode([found[i].decode() for i in part], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, self.kind).tobytes()
            cut = (np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(part) + 1)) * self.kind.itemsize).tolist()
            for i, s, t in zip(part, cut[:-1], cut[1:], strict=True):
                out[i] = known[found[i]] = ids[s:t]
        return out


def _open(uri: str):
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    """Appends ids to one Arrow file of fixed-size lists."""

    def __init__(self, uri: str, kind: np.dtype, seq_len: int, batch_rows: int):
        self.fs, self.path = _open(uri)
        self.seq_len, self.full, self.kind = seq_len, seq_len * batch_rows, kind
        self.schema = pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(kind), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.sink = self.fs.open_output_stream(self.path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.parts: list[bytes] = []
        self.held = 0

    def append(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.held += len(ids) // self.kind.itemsize
        if self.held >= self.full:
            self._write(last=False)

    def _write(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.parts), self.kind)
        at = 0
        while len(ids) - at >= self.full or last and at < len(ids):
            own = ids[at : at + self.full]
            at += len(own)
            mask = np.ones(len(own), bool)
            if short := -len(own) % self.seq_len:
                own, mask = np.concatenate([own, np.zeros(short, self.kind)]), np.concatenate([mask, np.zeros(short, bool)])
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (own, mask)]
            self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.parts, self.held = [ids[at:].tobytes()], len(ids) - at

    def close(self) -> None:
        self._write(last=True)
        self.file.close()
        self.sink.close()


class ShardReader:
    """Random access to a shard; batches are views of the memory map."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.seq_len = self.file.schema.field("input_ids").type.list_size
        self.full = self.seq_len * self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self._at, self._ids, self._mask = -1, None, None

    def _batch(self, k: int) -> tuple[np.ndarray, pa.Array]:
        if k != self._at:
            batch = self.file.get_batch(k)
            self._at, self._ids, self._mask = k, batch.column(0).flatten().to_numpy(), batch.column(1).flatten()
        return self._ids, self._mask

    def read(self, start: int, n: int) -> np.ndarray:
        parts = []
        while n > 0:
            ids, mask = self._batch(start // self.full)
            at = start % self.full
            own = ids[at : at + n]
            if not mask.slice(at, len(own)).to_numpy(zero_copy_only=False).all():
                raise ValueError("an indexed id lies under a false mask")
            parts.append(own)
            start, n = start + len(own), n - len(own)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence number ``i`` and its mask."""
        ids, mask = self._batch(i * self.seq_len // self.full)
        at = i * self.seq_len % self.full
        return ids[at : at + self.seq_len], mask.slice(at, self.seq_len).to_numpy(zero_copy_only=False)


def write_token_files(docs: DataFrame, tokenizer: str, out_dir: str | None = None, seq_len: int = 2048, end_id: int = 1, batch_rows: int = 64, text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id``, write shards to ``out_dir`` and return their index.

    The index has ``shard, path, doc_id, local_start, n_tokens, start``; ``start`` counts the ids
    of all documents before.  A null text is the empty text (only the end id); null doc_ids
    come first; rows with one doc_id follow each other, ordered by text; an empty table
    writes nothing; other columns are ignored.  ``out_dir`` must be shared by all executors
    and is a new folder in the shared scratch folder by default.
    """
    spark = docs.sparkSession
    out_dir = out_dir or fresh_dir(spark, "tokens")
    fs, path = _open(out_dir)
    fs.create_dir(path, recursive=True)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        .repartitionByRange(width, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )

    def encode(batches):
        encoder, writer, at = Encoder(tokenizer), None, 0
        shard = TaskContext.get().partitionId()
        uri = f"{out_dir}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}.arrow"
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                ids = batch.column(0).slice(a, 1024)
                packed = encoder.pack(batch.column(1).slice(a, 1024))
                writer = writer or ShardWriter(uri, encoder.kind, seq_len, batch_rows)
                counts = []
                for p in packed:
                    writer.append(p + end)
                    counts.append(len(p) // encoder.kind.itemsize + 1)
                starts = at + np.concatenate([[0], np.cumsum(counts)])
                at = int(starts[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(counts), shard, np.int32)), pa.array([uri] * len(counts)), ids, pa.array(starts[:-1].astype(np.int64)), pa.array(counts, pa.int64())],
                    ["shard", "path", "doc_id", "local_start", "n_tokens"],
                )
        if writer:
            writer.close()

    index = materialize(map_texts(ordered, encode, INDEX, "token_output"), "token-index")
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return index.join(totals.select("shard", before.alias("before")), "shard").withColumn("start", F.col("before") + F.col("local_start")).drop("before")


def read_token_files(index: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``, from the ids that the files give back for each index row."""

    def read(batches):
        uri, reader = None, None
        for batch in batches:
            paths, at, n = (batch.column(i).to_pylist() for i in (4, 2, 3))
            crc = []
            for p, s, k in zip(paths, at, n, strict=True):
                if p != uri:
                    uri, reader = p, ShardReader(p)
                crc.append(zlib.crc32(reader.read(s, k).astype("<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return index.select("doc_id", "start", "local_start", "n_tokens", "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
