"""Mixing sources to target weights, by words.

The size of a document is its number of words. Sources get weights in order; their targets share
the given total by weight, none above ``cap`` times its source's size (the excess is shared anew
among the others). Within a source documents stand in the order of a hash of their id; this order
is cut into ranges of the hash, sums of ranges give every range's first word, and a window within
a range gives each document's. A target of ``e`` whole sizes and a rest takes every document ``e``
times, and once more those before the rest's end; the document at the end is cut there, so each
source's words meet its target to within one word.

Ranges split a source of any size into tasks; there are so many that one holds about ``RANGE`` rows at
most. Sums of (source, range) are the only thing that meets in one place for each source.

Defined results: null text has size 0; null source is a source of its own, after all others; a
null ``doc_id`` hashes like an empty text; rows that repeat are documents of their own; a source
without words has target 0; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import written

RANGE = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``(source, source_size)`` with ``target``.

    Sources reach their cap in the order of ``cap * size / weight``. With the first k of this order
    at their caps, the level of the others is (total - caps) / (weights left); the sources at their
    cap are those whose ratio is at most the level that holds from them on. One row for each source:
    a window over all of them is small.
    """
    everything = Window.partitionBy()
    ordered = sizes.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    rows = ordered.withColumn("w", pick).withColumn("top", F.col("source_size") * F.lit(float(cap)))
    rows = rows.withColumn("ratio", F.col("top") / F.col("w")).withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    upto = Window.orderBy("ratio", "i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("tops", F.coalesce(F.sum("top").over(upto), F.lit(0.0)))
    rows = rows.withColumn("ws", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
    rows = rows.withColumn("level", (F.col("total") - F.col("tops")) / F.col("ws"))
    capped = F.col("ratio") <= F.col("level")
    # the level that the first source below its cap has holds for all of them
    rows = rows.withColumn("held", F.min(F.when(~capped, F.struct("ratio", "i", "level"))).over(everything)["level"])
    return rows.select("source", "source_size", F.when(capped, F.col("top")).otherwise(F.col("held") * F.col("w")).alias("target"))


def mix_key(seed: str = "") -> Column:
    """The hash that orders documents of a source."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def placed(docs: DataFrame, weights: tuple[int, ...], share: float, cap: float, seed: str) -> DataFrame:
    """Every document with ``start``, the words of its source before it, and its source's epochs and rest.

    ``nth`` counts rows of equal key, id and size from 0.
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), mix_key(seed).alias("key"))
    sized = written(sized, "sized")
    most = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    digits = max(2, ceil(log(max(most, 1) / RANGE, 16)))
    sized = sized.withColumn("bucket", F.substring("key", 1, digits))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    goals = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, cap)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "source_size", "target")
    )
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
    rows = sized.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0))).withColumn("nth", F.row_number().over(ordered) - F.rank().over(ordered))
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target")).cast("long") - epochs * F.col("source_size")
    return rows.select("doc_id", "source", "size", "key", "nth", "source_size", "target", (F.col("before") + F.col("own")).alias("start"), epochs.alias("epochs"), rest.alias("rest"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, cap: float = 3.0, seed: str = "") -> DataFrame:
    """Each document with the words that the mix takes of it."""
    more = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("start")))
    rows = placed(docs, weights, share, cap, seed)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + more).cast("long").alias("taken"))


def cut_points(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, cap: float = 3.0, seed: str = "") -> DataFrame:
    """One row a source: whole epochs, the document at which the rest ends, and the words it gives then.

    Documents before it in the order of ``(key, doc_id, size)`` are taken once more. With these rows
    the mix of texts is a map over them. Rows that equal the cut give ``words`` together, one after
    another. A source whose rest is all of it has one more epoch; one without a rest has no cut (null).
    """
    rows = placed(docs, weights, share, cap, seed)
    # a rest that is rounded up to the whole source ends at no document: it is one more epoch
    one_more = (F.col("source_size") > 0) & (F.col("rest") >= F.col("source_size"))
    rows = rows.withColumn("epochs", F.col("epochs") + one_more.cast("long")).withColumn("rest", F.when(one_more, 0).otherwise(F.col("rest")))
    at = (F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("size"))
    words = F.col("rest") - F.col("start") + F.col("nth") * F.col("size")
    found = F.min(F.when(at, F.struct(F.struct("key", "doc_id", "size").alias("cut"), words.alias("words"))))
    return rows.groupBy("source").agg(F.max("epochs").alias("epochs"), found.alias("at")).select("source", "epochs", "at.cut", F.coalesce("at.words", F.lit(0)).alias("words"))
