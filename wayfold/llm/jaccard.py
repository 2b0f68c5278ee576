"""N-gram Jaccard join: exact links between documents whose shingle sets are alike.

1. One pass gives every document's set a class name (equal sets are one class, so copies
   meet only as one row; two independent sums tell unlike sets apart) and counts shingles in a fixed-size sketch.
2. Shingles are ordered by (sketched count, value).  Two sets with Jaccard >= t share one of
   the first n - ceil(t n) + 1 of either: that prefix filter is exact for any common order;
   the sketch only keeps frequent shingles out of prefixes, so no common passage makes a
   large group.
3. Classes that share a prefix shingle are cut into bands of compatible sizes; equal bands
   are one tile.  Groups above ``SMALL`` members are merged into clusters first and dealt as
   pairs of size-sorted blocks, so no task holds more than two blocks.
4. In a tile, hashed bitmaps bound every overlap from above by their bit counts.  Members
   that no partner may reach leave; the rest regroups by what may still link, equal groups
   are one tile again, and only their sets travel.
5. Sets are intersected exactly, pairs already connected are skipped, and a tile gives a
   spanning forest of its links, never all pairs.

Components of the links are found by distributed label propagation.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import buffers, distinct_sorted, mix, runs, shingles, words
from .components import components
from .scratch import map_texts, materialize, sum_arrays

SKETCH_BITS = 20
SKETCH_PARTS = 16
SMALL = 64
BLOCK = 256
#: Clusters of more than so many blocks meet so many centres of each size band first.
DIRECT, CENTERS = 8, 16
BITMAP = (256, 16384)
#: Bits of a set's name, and how many sets may share one with another set.
CLASS_BITS, MAX_APART = 64, 100_000
_U = np.uint64


def _sets(column: pa.Array, n: int):
    """(first row, last row, values, offsets) of the rows' distinct shingles, chunk by chunk."""
    data, off = buffers(column)
    for a, b in runs(off):
        value, _, _, word_off = words(data[off[a] : off[b]], off[a : b + 1] - off[a])
        yield a, b, *distinct_sorted(*shingles(value, word_off, n))


def _sums(value: np.ndarray, off: np.ndarray, seed: int) -> np.ndarray:
    sums = np.concatenate([[_U(0)], np.cumsum(mix(value ^ _U(seed)), dtype=np.uint64)])
    return mix((sums[off[1:]] - sums[off[:-1]]) + np.diff(off).astype(np.uint64))


class Classes:
    """Names of sets: equal sets have one name, unlike sets never share one.

    A name is a 64-bit sum over the set.  Where two sets of the corpus have one sum, a second,
    independent sum tells them apart, and all but one of them are renamed; ``apart`` lists those few.
    """

    def __init__(self, bits: int = 64, apart: dict[tuple[int, int], int] | None = None):
        self.bits, self.apart = bits, apart or {}
        self.hit = np.array(sorted({c for c, _ in self.apart}), np.int64)

    def sums(self, value: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (_sums(value, off, 0xA5A5A5A55A5A5A5A) >> _U(64 - self.bits)).view(np.int64), _sums(value, off, 0x3C6EF372FE94F82B).view(np.int64)

    def names(self, value: np.ndarray, off: np.ndarray) -> np.ndarray:
        one, two = self.sums(value, off)
        if len(self.hit):
            for i in np.flatnonzero(np.isin(one, self.hit)):
                one[i] = self.apart.get((int(one[i]), int(two[i])), one[i])
        return one

    @classmethod
    def of(cls, info: DataFrame, bits: int) -> Classes:
        """Names that fit the corpus: ``info`` has both sums (``cls, other``) of every set."""
        mixed = info.groupBy("cls").agg(F.min("other").alias("least"), F.max("other").alias("most")).filter("least <> most")
        mixed = materialize(mixed.select("cls", "least"), "mixed", narrow=True)  # hardly ever a row: the sets meet it only where there is one
        if mixed.isEmpty():
            return cls(bits)
        rest = info.select("cls", "other").distinct().join(mixed, "cls").filter("other <> least").select("cls", "other").limit(MAX_APART + 1).collect()
        if len(rest) > MAX_APART:  # of n sets, about n * n / 2**65 are expected
            raise ValueError(f"more than {MAX_APART} sets share a 64-bit sum with another one")
        return cls(bits, {(r["cls"], r["other"]): int(mix(mix(np.array([r["other"]], np.int64).view(_U)) ^ np.array([r["cls"]], np.int64).view(_U)).view(np.int64)[0]) for r in rest})


def _bitmaps(value: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Each set's hashed bitmap, a power of two of about two bits for each member within ``BITMAP``."""
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        bits = min(max(BITMAP[0], 1 << max(0, 2 * (b - a) - 1).bit_length()), BITMAP[1])
        held = np.zeros(bits, bool)
        held[(value[a:b] & _U(bits - 1)).astype(np.int64)] = True
        out.append(np.packbits(held).tobytes())
    return out


def _aligned(maps: list[bytes]) -> np.ndarray:
    """Bitmaps folded to the smallest length among them: each half is or-ed onto the other."""
    least = min(map(len, maps))
    out = np.empty((len(maps), least), np.uint8)
    for i, m in enumerate(maps):
        out[i] = np.bitwise_or.reduce(np.frombuffer(m, np.uint8).reshape(-1, least), axis=0)
    return out.view(np.uint64)


def _place(value: np.ndarray) -> np.ndarray:
    return (value >> _U(64 - SKETCH_BITS)).astype(np.int64)


def _describe(n: int, classes: Classes):
    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint64)
        task = TaskContext.get().partitionId()
        names = ["doc_id", "n", "cls", "other", "bits", "part", "task", "counts"]
        for batch in batches:
            ids = batch.column(0)
            for a, b, value, off in _sets(batch.column(1), n):
                counts += np.bincount(_place(value), minlength=len(counts)).astype(np.uint64)
                k = b - a
                one, two = classes.sums(value, off)
                yield pa.RecordBatch.from_arrays([ids.slice(a, k), pa.array(np.diff(off)), pa.array(one), pa.array(two), pa.array(_bitmaps(value, off), pa.binary()), pa.array(np.full(k, -1, np.int32)), pa.array(np.full(k, task, np.int32)), pa.nulls(k, pa.binary())], names)
        if counts.any():
            cut = np.split(counts, SKETCH_PARTS)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(SKETCH_PARTS, pa.int64())] * 4, pa.nulls(SKETCH_PARTS, pa.binary()), pa.array(np.arange(SKETCH_PARTS, dtype=np.int32)), pa.array(np.full(SKETCH_PARTS, task, np.int32)), pa.array([zlib.compress(c.tobytes(), 1) for c in cut], pa.binary())], names)

    return run


def _sketch(described: DataFrame) -> np.ndarray:
    """Sum of the tasks' sketches; the result has a fixed size."""
    parts = sum_arrays(described.filter("part >= 0").select("part", "task", F.col("counts").alias("body")), "uint64")
    empty = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.uint64)
    return np.minimum(np.concatenate([parts.get(k, empty) for k in range(SKETCH_PARTS)]), 0xFFFFFFFF).astype(np.uint32)


def _prefixes(n: int, num: int, den: int, sketch, classes: Classes):
    def run(batches):
        rank = np.minimum(sketch.value, (1 << 24) - 1).astype(np.uint64)
        done: set[int] = set()
        for batch in batches:
            for _, _, value, off in _sets(batch.column(0), n):
                cls, size = classes.names(value, off), np.diff(off)
                fresh = []
                for i, c in enumerate(cls.tolist()):
                    if size[i] and c not in done:
                        done.add(c)
                        fresh.append(i)
                if len(done) > 1_000_000:
                    done.clear()
                own = np.zeros(len(size), bool)
                own[fresh] = True
                row = np.repeat(np.arange(len(size)), size)
                order = np.argsort((row.astype(np.uint64) << _U(42)) | (rank[_place(value)] << _U(18)) | (value >> _U(46)), kind="stable")
                place = np.arange(len(row)) - off[row]
                want = size - -(-num * size // den) + 1
                take = (place < want[row]) & own[row]
                row, value = row[take], value[order[take]]
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(cls[row]), pa.array(size[row].astype(np.int32))], ["token", "cls", "n"])

    return run


def _bands(num: int, den: int):
    """Cut each shingle's members where the next larger size is out of reach; name tiles by their members."""

    def run(batches):
        for batch in batches:
            tiles, members = [], []
            for group in batch.column(0).to_pylist():
                band = [group[0]]
                for m in group[1:]:
                    if num * m["n"] > den * band[-1]["n"]:
                        _tile_of(band, tiles, members)
                        band = []
                    band.append(m)
                _tile_of(band, tiles, members)
            yield pa.RecordBatch.from_arrays([pa.array(tiles, pa.int64()), pa.array(members, pa.int64())], ["tile", "cls"])

    return run


def _tile_of(band: list[dict], tiles: list[int], members: list[int]) -> None:
    if len(band) > 1:
        own = np.array([m["cls"] for m in band], np.int64)
        tile = int(mix(np.array([np.bitwise_xor.reduce(mix(own.view(np.uint64))) + _U(len(own))]))[0].view(np.int64))
        tiles += [tile] * len(own)
        members += own.tolist()


def may_link(ids: np.ndarray, size: np.ndarray, maps: np.ndarray, side: np.ndarray, num: int, den: int) -> np.ndarray:
    """A label for each row, equal where bit counts leave a chain of possible links; -1 for rows without any."""
    order = np.lexsort((ids, size))
    size, maps, side = size[order], maps[order], side[order]
    m = len(ids)
    across = len(np.unique(side)) > 1
    root, alive = np.arange(m), np.zeros(m, bool)
    for i in range(m - 1):
        last = int(np.searchsorted(size, den * size[i] // num, "right"))
        j = np.arange(i + 1, last)
        j = j[((root[j] != root[i]) | ~alive[i]) & ((side[j] != side[i]) | (not across))]
        if not len(j):
            continue
        both = size[j] + size[i]
        most = (both - np.bitwise_count(maps[j] ^ maps[i]).sum(1, dtype=np.int64)) // 2
        j = j[(den + num) * most >= num * both]
        if len(j):
            alive[i] = alive[j] = True
            root[np.isin(root, root[j])] = root[i]
    label = np.empty(m, np.int64)
    label[order] = np.where(alive, root, -1)
    return label


def overlap_links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning links of the pairs with den * |A n B| >= num * |A u B|; with two sides only pairs across."""
    size = np.array([len(s) for s in sets])
    order = np.lexsort((ids, size))
    ids, side, size, sets = ids[order], side[order], size[order], [sets[i] for i in order]
    m = len(ids)
    maps = _aligned(_bitmaps(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)])))
    across = len(np.unique(side)) > 1
    root, links = np.arange(m), []
    for i in range(m - 1):
        last = int(np.searchsorted(size, den * size[i] // num, "right"))
        j = np.arange(i + 1, last)
        j = j[(root[j] != root[i]) & ((side[j] != side[i]) | (not across))]
        if not len(j):
            continue
        both = size[j] + size[i]
        most = (both - np.bitwise_count(maps[j] ^ maps[i]).sum(1, dtype=np.int64)) // 2
        j = j[(den + num) * most >= num * both]
        if not len(j):
            continue
        flat = np.concatenate([sets[x] for x in j])
        at = np.searchsorted(sets[i], flat)
        hit = (at < size[i]) & (sets[i][np.minimum(at, size[i] - 1)] == flat)
        inter = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(size[j])[:-1]]), dtype=np.int64)
        for x in j[den * inter >= num * (size[j] + size[i] - inter)]:
            if root[x] != root[i]:
                links.append((int(ids[i]), int(ids[x])))
                root[root == root[x]] = root[i]
    return links


def jaccard_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    A document's set are its distinct ``n``-word shingles (A-Z lower-cased; words are runs
    outside ``\\x20\\x09-\\x0D``); with fewer words the whole sequence is the one shingle; a null
    or blank text has the empty set and is linked with nothing.  Two documents link when
    den * |A n B| >= num * |A u B|.  component_id is the smallest doc_id that links reach.
    Rows with equal sets are linked, repeated rows too; null doc_ids are linked but never
    smallest (a component of null ids only has a null id).  An empty table gives an empty
    result; long texts are read whole; other columns are ignored.  Shingles are compared by
    64-bit values, whole sets by two of them.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n long, cls long, other long, bits binary, part int, task int, counts binary"
    described = materialize(map_texts(texts, _describe(n, Classes(CLASS_BITS)), schema), "described")
    info = described.filter("part < 0").select("doc_id", "n", "cls", "other", "bits")
    classes = Classes.of(info, CLASS_BITS)
    if classes.apart:
        renamed = spark.createDataFrame([(c, o, x) for (c, o), x in classes.apart.items()], "cls long, other long, renamed long")
        info = info.join(renamed, ["cls", "other"], "left").withColumn("cls", F.coalesce("renamed", "cls"))
    info = info.select("doc_id", "n", "cls", "bits")
    links = _class_links(spark, texts, info, described, n, num, den, classes)
    info = info.drop("bits")
    roots = components(links)
    # ids of classes with an empty set stay out of every link
    smallest = info.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first_id"))
    rooted = smallest.join(roots.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rooted = materialize(rooted.select("cls", "first_id", "root"), "rooted", narrow=True)
    # a table of its own: joined in a stage without the aggregate, a giant component is split
    least = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "least", narrow=True)
    named = rooted.join(least, "root").select(F.col("cls").alias("c"), "component_id")
    linked = info.join(named, (info["cls"] == F.col("c")) & (info["n"] > 0), "left")
    return linked.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _class_links(spark: SparkSession, texts: DataFrame, info: DataFrame, described: DataFrame, n: int, num: int, den: int, classes: Classes) -> DataFrame:
    sketch = spark.sparkContext.broadcast(_sketch(described))  # 2 ** SKETCH_BITS counters, whatever the input
    prefixes = map_texts(texts.select("text"), _prefixes(n, num, den, sketch, classes), "token long, cls long, n int")
    once = materialize(prefixes.dropDuplicates(["token", "cls"]), "prefixes")
    several = once.groupBy("token").agg(F.count("*").alias("m"), F.min("cls").alias("center")).filter("m > 1")
    shared = materialize(once.join(materialize(several, "several"), "token"), "shared")

    groups = shared.filter(F.col("m") <= SMALL).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("n", "cls"))).alias("members"))
    tiles = groups.select("members").mapInArrow(_bands(num, den), "tile long, cls long").dropDuplicates(["tile", "cls"]).withColumn("side", F.lit(0))
    hot = shared.filter(F.col("m") > SMALL).select("token", "cls", "n", "center", F.col("cls").alias("comp"))

    def link(tiles: DataFrame) -> DataFrame:
        return materialize(_tile_links(texts, info, tiles, n, num, den, classes), "links", narrow=True)

    if hot.isEmpty():
        return link(tiles)
    found, before = None, None
    while True:
        placed, large = _placed(hot)
        left = placed.filter("large").count() if large else 0
        # centres again while each round halves what it leaves; then block by block
        star = left > 0 and (before is None or 2 * left <= before)
        more = _block_tiles(placed.filter("not large") if star else placed, num, den)
        if star:
            more = more.unionByName(_star_tiles(placed.filter("large"), num, den, 0 if before is None else left))
        new = link(more if found is not None else more.unionByName(tiles))
        found = new if found is None else found.unionByName(new)
        if not star:
            return found
        before = left
        hot = _apart(hot.join(placed.filter("large").select("cls"), "cls", "left_semi"), components(found))
        if hot.isEmpty():
            return found


def _tile_links(texts: DataFrame, info: DataFrame, tiles: DataFrame, n: int, num: int, den: int, classes: Classes) -> DataFrame:
    """Spanning links ``a, b`` of each tile: bit counts first, then the sets that they leave."""
    tiles = materialize(tiles, "tiles", narrow=True)
    # copies are added up in their own tasks before they meet; a semi-join would be pushed below that
    maps = info.filter("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))

    def thin(table: pa.Table) -> pa.Table:
        cls, side = table.column("cls").to_numpy(), table.column("side").to_numpy()
        label = may_link(cls, table.column("n").to_numpy(), _aligned(table.column("bits").to_pylist()), side, num, den)
        tile = np.full(len(cls), table.column("tile")[0].as_py())
        if not side.any():  # a whole group: what may still link is named by its members
            for x in np.unique(label[label >= 0]):
                own = label == x
                tile[own] = mix(np.array([np.bitwise_xor.reduce(mix(cls[own].view(np.uint64))) + _U(own.sum())]))[0].view(np.int64)
        own = label >= 0
        return pa.table({"tile": tile[own], "cls": cls[own], "side": side[own]})

    rest = tiles.join(maps, "cls").groupBy("tile").applyInArrow(thin, "tile long, cls long, side int").dropDuplicates(["tile", "cls", "side"])
    tiles = materialize(rest, "tiles", narrow=True)
    first = info.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    chosen = materialize(first.join(tiles.select("cls").distinct(), "cls").select("cls", "doc_id"), "wanted", narrow=True)
    keep = id_filter(chosen)

    def sets(batches):
        for batch in batches:
            wanted = batch.column(1).filter(keep(batch.column(0)))
            for a, b, value, off in _sets(wanted, n):
                yield pa.RecordBatch.from_arrays([pa.array(classes.names(value, off)), pa.array([value[off[i] : off[i + 1]].tobytes() for i in range(b - a)], pa.binary())], ["cls", "body"])

    bodies = map_texts(texts, sets, "cls long, body binary").join(chosen.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])
    bodies = materialize(bodies, "bodies")

    def verify(table: pa.Table) -> pa.Table:
        found = overlap_links(table.column("cls").to_numpy(), [np.frombuffer(x, np.uint64) for x in table.column("body").to_pylist()], table.column("side").to_numpy(), num, den)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return tiles.join(bodies, "cls").groupBy("tile").applyInArrow(verify, "a long, b long")


def _placed(hot: DataFrame) -> tuple[DataFrame, bool]:
    """``cls, n, comp, root, band, large`` of the classes of hot groups, and whether any is large.

    ``root`` names a cluster of overlapping groups, ``band`` a range of like sizes; a cluster of
    more than ``DIRECT`` blocks is large.
    """
    roots = components(hot.select(F.col("center").alias("a"), F.col("cls").alias("b")))
    size = hot.groupBy("cls").agg(F.max("n").alias("n"), F.max("comp").alias("comp"))
    banded = size.join(roots.select(F.col("id").alias("cls"), "root"), "cls").withColumn("band", F.floor(F.log("n") / F.lit(np.log(1.05).item())).cast("long"))
    banded = materialize(banded, "banded", narrow=True)
    large = materialize(banded.groupBy("root").count().filter(F.col("count") > DIRECT * BLOCK).select(F.col("root").alias("r")), "large", narrow=True)
    return banded.join(large, F.col("root") == F.col("r"), "left").select("cls", "n", "comp", "root", "band", F.col("r").isNotNull().alias("large")), not large.isEmpty()


def _dealt(placed: DataFrame, *key: str) -> DataFrame:
    """``placed`` with a ``block`` of about ``BLOCK`` classes: each (root, band, key) is dealt by a hash of the class, nothing is gathered."""
    blocks = placed.groupBy("root", "band", *key).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = placed.join(blocks, ["root", "band", *key])
    return dealt.withColumn("block", F.struct("band", *key, F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("k"))).drop("blocks")


def _star_tiles(placed: DataFrame, num: int, den: int, seed: int) -> DataFrame:
    """Tiles of one block (side 0) and the centres of compatible size (side 1): at most ``CENTERS`` of a band, drawn by hash."""
    dealt = materialize(_dealt(placed).select("cls", "n", "root", "band", "block"), "placed", narrow=True)
    drawn = F.xxhash64("cls", F.lit(seed))
    centers = dealt.groupBy("root", "band", F.pmod(drawn, F.lit(CENTERS)).alias("slot")).agg(F.min_by(F.struct("cls", "n"), F.struct(drawn, "cls")).alias("c"))
    span = dealt.groupBy("root", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    meets = span.join(centers.select("root", "c.cls", "c.n"), "root").filter((F.col("n") * num <= F.col("high") * den) & (F.col("low") * num <= F.col("n") * den))
    tile = F.xxhash64("root", "block").alias("tile")
    return dealt.select(tile, "cls", F.lit(0).alias("side")).union(meets.select(tile, "cls", F.lit(1).alias("side")))


def _block_tiles(placed: DataFrame, num: int, den: int) -> DataFrame:
    """Tiles of all pairs of blocks of one cluster that hold compatible sizes.

    Components of at least ``BLOCK`` classes have blocks of their own, which do not meet each other.
    """
    own = placed.groupBy("root", "band", "comp").count().filter(F.col("count") >= BLOCK).select("root", "band", "comp", F.lit(True).alias("own"))
    marked = placed.join(own, ["root", "band", "comp"], "left").withColumn("one", F.coalesce("own", F.lit(False)))
    marked = marked.select("cls", "n", "root", "band", "one", F.when(F.col("one"), F.col("comp")).otherwise(F.lit(0)).alias("of"))
    dealt = materialize(_dealt(marked, "one", "of").select("cls", "n", "root", "one", "of", "block"), "placed", narrow=True)
    span = dealt.groupBy("root", "block", "one", "of").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left = span.select("root", F.col("block").alias("i"), "high", F.col("one").alias("one_i"), F.col("of").alias("of_i"))
    right = span.select("root", F.col("block").alias("j"), "low", "one", "of")
    # both sides are one row for each block; the block of smaller sizes comes first
    same = F.col("one_i") & F.col("one") & (F.col("of_i") == F.col("of"))
    pairs = left.join(right, "root").filter((F.col("i") <= F.col("j")) & (F.col("low") * num <= F.col("high") * den) & ~same)
    pairs = pairs.withColumn("tile", F.xxhash64("root", "i", "j"))
    sides = pairs.select("root", F.col("i").alias("block"), "tile", F.lit(0).alias("side")).union(pairs.filter("i < j").select("root", F.col("j").alias("block"), "tile", F.lit(1).alias("side")))
    return dealt.join(sides, ["root", "block"]).select("tile", "cls", "side")


def _apart(hot: DataFrame, joined: DataFrame) -> DataFrame:
    """The hot groups whose classes are in several components still, each class with its ``comp``."""
    named = hot.drop("comp").join(joined.select(F.col("id").alias("cls"), F.col("root").alias("comp")), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    named = materialize(named, "hot")
    mixed = named.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least <> most")
    return materialize(named.join(mixed.select("token"), "token", "left_semi").select("token", "cls", "n", "center", "comp"), "hot")


def id_filter(chosen: DataFrame) -> Callable[[pa.Array], pa.Array]:
    """A test whether ids may be in ``chosen`` (nulls always may): a bitmap of bounded size, broadcast."""
    bits = 1 << min(26, max(16, (16 * chosen.count()).bit_length()))

    def mark(batches):
        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = (mix(batch.column(0).drop_null().to_numpy().view(np.uint64)) & _U(bits - 1)).astype(np.int64)
            np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if held.any():
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(held.tobytes(), 1)], pa.binary())], ["bits"])

    held = np.zeros(bits // 8, np.uint8)
    for r in chosen.select("doc_id").coalesce(16).mapInArrow(mark, "bits binary").toArrow().to_pylist():  # at most 16 rows of at most 8 MB
        held |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    shared = chosen.sparkSession.sparkContext.broadcast(held)

    def keep(ids: pa.Array) -> pa.Array:
        at = (mix(ids.fill_null(0).to_numpy().view(np.uint64)) & _U(bits - 1)).astype(np.int64)
        ok = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return pa.array(ok | ids.is_null().to_numpy(zero_copy_only=False))

    return keep
