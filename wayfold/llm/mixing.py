"""Mixing sources to target weights: weighted sampling without replacement, in SQL functions only.

Efraimidis-Spirakis: a document's key is an exponential variate divided by its quality weight;
ascending keys within a source are a weighted sample of any length.  Sizes are prefix-summed
in that order up to the source's budget.  Complete epochs come first, the remainder selects
by key.  A source's order is cut into ranges of the key, as many as its rows ask for and of about
equal numbers of rows, so a source with a third of all rows is spread over many tasks; only
per-range sums meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

RANGE_ROWS = 2000
#: Characters that lower a document's weight; fixed values.
_SYMBOLS = "#$%&*|<>{}[]\\^~_=+@"


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """In [0.25, 1]: the fourth power of the share of characters that are no junk symbols."""
    share = F.length(F.translate(text, _SYMBOLS, "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.25), F.coalesce(share * share * share * share, F.lit(0.25)))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the md5 of the key: the same in every run, task and engine."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 17, text_col: str = "text", quality: Column | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``.

    Sources in code-point order (null last, a source of its own) weigh ``weights``, repeating.
    Targets share the sum of all sizes; none exceeds ``max_epochs`` times its source's size and
    the excess is shared again by weight.  ``taken`` is whole epochs of the size plus what the
    fractional pass takes; the document on the boundary gives the words still missing, so a
    source's taken words are its target rounded down.  Null or empty texts have size 0 and
    take 0; repeated rows are separate rows; ties of the key are broken by doc_id and size.
    ``quality`` must be positive; without it the share of junk symbols decides.
    An empty table gives an empty result.  Other columns of ``docs`` are ignored.
    """
    text = F.col(text_col)
    weight = quality if quality is not None else quality_weight(text)
    sized = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), weight.alias("w"))
    sized = sized.withColumn("key", -F.log(uniform(F.col("doc_id"), seed)) / F.col("w"))
    sized = ranged(materialize(sized, "mix"))

    by_range = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    by_range = by_range.withColumn("before", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)

    inner = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    bounds = by_range.join(targets, by_range["source"].eqNullSafe(targets["source"])).select(by_range["source"].alias("b_source"), F.col("range").alias("b_range"), "before", "source_size", "target")
    joined = placed.join(bounds, placed["source"].eqNullSafe(F.col("b_source")) & (F.col("range") == F.col("b_range")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.floor(F.col("target")).cast("long") - epochs * F.col("source_size") - F.col("before") - F.col("inner")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    return joined.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", taken.alias("taken"), F.col("source"), epochs.alias("epochs"))


def ranged(sized: DataFrame) -> DataFrame:
    """Add ``range``: ascending in ``key`` within a source, with about ``RANGE_ROWS`` rows in each.

    Keys of rows of weight w are below x with probability 1 - exp(-w x).  A source's rows of each
    weight (in steps of a fourth of a power of two) are counted, so the share of its keys below x
    is known without sorting them; that share, a growing function of x, names the range.
    """
    step = F.least(F.lit(24), F.greatest(F.lit(-24), F.floor(F.log2("w") * 4)))
    counted = sized.groupBy("source", step.alias("step")).agg(F.count("*").alias("n"), F.avg("w").alias("w"))
    law = counted.groupBy("source").agg(F.collect_list(F.struct("n", "w")).alias("law"), F.sum("n").alias("docs"))
    law = materialize(law.select(F.col("source").alias("l_source"), "law", F.col("docs").cast("double").alias("docs"), F.ceil(F.col("docs") / RANGE_ROWS).cast("int").alias("ranges")), "law", narrow=True)
    below = F.aggregate("law", F.lit(0.0), lambda total, x: total + x["n"] * (1 - F.exp(-x["w"] * F.col("key")))) / F.col("docs")
    placed = sized.join(law, sized["source"].eqNullSafe(law["l_source"]))
    return placed.withColumn("range", F.least(F.col("ranges") - 1, F.floor(below * F.col("ranges")).cast("int"))).drop("l_source", "law", "docs", "ranges", "w")


def source_targets(sources: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Water-filling over the table of sources: target = min(cap, level * weight).

    One row per source: the table is the aggregate of all rows and is as small as the number
    of sources.  With caps in ascending order of cap / weight, the level is the share that is
    left for the sources not yet capped, at the first place where the next one is not capped.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = len(weights)
    place = (F.row_number().over(order) - 1) % n
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    t = sources.withColumn("w", weight).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    ratio = F.col("cap") / F.col("w")
    everything = Window.partitionBy()
    up = Window.orderBy(ratio, F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("ratio", ratio).withColumn("all_size", F.sum("source_size").over(everything).cast("double")).withColumn("all_w", F.sum("w").over(everything))
    t = t.withColumn("cap_before", F.coalesce(F.sum("cap").over(up), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("w").over(up), F.lit(0.0)))
    t = t.withColumn("level", (F.col("all_size") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")))
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything)["level"]
    return t.withColumn("fill", first).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("fill") * F.col("w"), F.col("cap"))).alias("target"))
