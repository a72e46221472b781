"""Removal of word windows that occur more than once, found by difference-cover anchors.

A difference cover D modulo v holds, for any two places i and j, an offset below v that takes both
into D. So if two windows of ``length`` words are equal, both hold equal anchors of
``length - v + 1`` words that start at places of D (modulo v) in their own document. Only anchors
at such places are hashed and shuffled, about 1 / sqrt(v) of all places. Windows around an anchor
that occurs again are then hashed whole and counted; a window without such an anchor has no equal.

Texts that are equal form a class: all of its words go (if there are enough for a window), and
only the class's least id takes part in the search. Occurrences of an anchor or window are read in
sorted order with their neighbours; what a sample finds to be very common is known to occur again
and dealt over all tasks. Hashes have 64 bits.

Defined results: null or empty text, or one without words, keeps nothing and removes nothing; a
text of fewer words than a window stays whole; a null ``doc_id`` is a document like any other; rows
that repeat are copies of each other; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import drop, written, written_path
from ._words import powers, mix, rolling, slices, words

# fixed values: perfect difference sets, by their modulus
COVERS = {
    1: (0,),
    7: (1, 2, 4),
    13: (0, 1, 3, 9),
    21: (3, 6, 7, 12, 14),
    31: (1, 5, 11, 24, 25, 27),
}
BROADCAST_IDS = 1_000_000
SAMPLE, HOT, SALTS = 64, 8, 1024  # about 500 rows of one hash are hot


def cover(length: int) -> tuple[int, np.ndarray]:
    """Modulus and set: the largest that leaves anchors of two fifths of the window."""
    v = max(x for x in COVERS if x == 1 or x <= 0.6 * length)
    return v, np.array(COVERS[v])


def _sequence(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A hash of each document's whole word sequence."""
    base = 0xC2B2AE3D27D4EB4F
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(h * powers(base, max(len(h), 1))[: len(h)], dtype=np.uint64)]
    inverse = powers(pow(base, -1, 1 << 64), len(h) + 1)
    return mix((sums[cuts[1:]] - sums[cuts[:-1]]) * inverse[cuts[:-1]] + (cuts[1:] - cuts[:-1]).astype(np.uint64))


def _id():
    """Names a text in all joins together with ``t``, some bits of the text's hash."""
    return F.coalesce(F.col("doc_id"), F.xxhash64("text")).alias("id"), F.xxhash64("text").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("t")


def _lists(parts: list[np.ndarray], kind: type) -> pa.Array:
    cuts = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)))


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """One row for each document: words, digests, and its anchors in the order of their places."""
    v, d = cover(length)
    width = length - v + 1
    at_cover = np.zeros(v, bool)
    at_cover[d] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column("text")):
                text = b.column("text").slice(lo, hi - lo)
                w = words(text)
                n = np.diff(w.cuts)
                place = np.arange(len(w.hashes)) - np.repeat(w.cuts[:-1], n)
                own = np.repeat(n, n)
                take = at_cover[place % v] & (place <= own - width) & (own >= length)
                grams = rolling(w.hashes, width, 3)
                found = grams[np.flatnonzero(take)].view(np.int64)
                cuts = np.r_[0, np.cumsum(take)][w.cuts].astype(np.int32)
                digests = [hashlib.sha256(b" ".join((x or "").encode().split())).hexdigest() for x in text.to_pylist()]
                yield pa.record_batch(
                    [*(b.column(c).slice(lo, hi - lo) for c in ("doc_id", "id", "t", "th")), pa.array(_sequence(w.hashes, w.cuts).view(np.int64)), pa.array(n.astype(np.int64)), pa.array(digests), pa.ListArray.from_arrays(pa.array(cuts), pa.array(found))],
                    ["doc_id", "id", "t", "th", "d1", "n_words", "sha", "anchors"],
                )

    rows = docs.select("doc_id", *_id(), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, "doc_id long, id long, t int, th long, d1 long, n_words long, sha string, anchors array<bigint>")


def candidate_windows(texts: DataFrame, length: int) -> DataFrame:
    """``(id, t, h, at)``: windows around the anchors listed in ``ks``."""
    v, d = cover(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column("text")):
                w = words(b.column("text").slice(lo, hi - lo))
                marks = np.zeros(len(w.hashes) + 1, np.int64)
                for i, ks in enumerate(b.column("ks").slice(lo, hi - lo)):
                    n = int(w.cuts[i + 1] - w.cuts[i])
                    if n < length:
                        continue
                    k = ks.values.to_numpy()
                    p = k // len(d) * v + d[k % len(d)]
                    np.add.at(marks, w.cuts[i] + np.clip(p - v + 1, 0, n - length + 1), 1)
                    np.add.at(marks, w.cuts[i] + np.clip(p + 1, 0, n - length + 1), -1)
                at = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
                doc = np.searchsorted(w.cuts, at, side="right") - 1
                h = rolling(w.hashes, length, 4)[at]
                for s in range(0, len(at), 100_000):
                    e = s + 100_000
                    rows = pa.array(doc[s:e])
                    yield pa.record_batch([b.column("id").slice(lo, hi - lo).take(rows), b.column("t").slice(lo, hi - lo).take(rows), pa.array(h[s:e].view(np.int64)), pa.array((at[s:e] - w.cuts[doc[s:e]]).astype(np.int32))], ["id", "t", "h", "at"])

    return texts.select("id", "t", "text", "ks").mapInArrow(run, "id long, t int, h long, at int")


def without(texts: DataFrame, length: int) -> DataFrame:
    """``(id, t, n_removed, kept)``: texts without the words of the windows that start at ``starts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                removed, kept = [], []
                for text, starts in zip(part.column("text").to_pylist(), part.column("starts"), strict=True):
                    own = text.encode().split()
                    marks = np.zeros(len(own) + 1, np.int64)
                    s = starts.values.to_numpy()
                    np.add.at(marks, s, 1)
                    np.add.at(marks, s + length, -1)
                    gone = np.cumsum(marks[:-1]) > 0
                    removed.append(int(gone.sum()))
                    kept.append(b" ".join([own[i] for i in np.flatnonzero(~gone).tolist()]).decode())
                yield pa.record_batch([part.column("id"), part.column("t"), pa.array(removed, pa.int64()), pa.array(kept)], ["id", "t", "n_removed", "kept"])

    return texts.select("id", "t", "text", "starts").mapInArrow(run, "id long, t int, n_removed long, kept string")


def _hot(rows: DataFrame, *place: str) -> DataFrame:
    """``h`` of very common anchors or windows, from one in ``SAMPLE`` rows by a hash of the place.

    What is seen twice occurs twice, so these need no search. The sample only decides which rows
    take that way; all others are searched.
    """
    seen = rows.where(F.pmod(F.xxhash64(*place), F.lit(SAMPLE)) == 0).select("h", *place).distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    hot = written(seen.where(F.col("n") >= HOT).select("h", F.lit(True).alias("hot")), "hot")
    return F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot


def _again(rows: DataFrame, hot: DataFrame, *place: str) -> DataFrame:
    """Rows whose ``h`` another place has too: in sorted order one of two neighbours is another place.

    Rows of a hot ``h`` are known to have another place and are dealt over all tasks.
    """
    rows = rows.join(hot, "h", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(*place), F.lit(SALTS))).otherwise(0).cast("int"))
    w = Window.partitionBy("h", "salt").orderBy(*place)
    here, before, after = F.struct(*place), F.lag(F.struct(*place)).over(w), F.lead(F.struct(*place)).over(w)
    return rows.select("*", here.alias("here"), before.alias("before"), after.alias("after")).where("hot OR before <> here OR after <> here").drop("here", "before", "after", "hot", "salt")


def dedup(docs: DataFrame, length: int = 35, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document, and with ``keep_text`` what is kept.

    With ``keep_text`` the kept words are joined by one space; it is null where nothing was removed.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    path = written_path(anchors(docs, length), "anchors")
    found = spark.read.parquet(path)
    classes = found.groupBy("th", "d1").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "t")).alias("rep"))
    classes = written(classes.select("th", "d1", "copies", F.col("rep.id").alias("id"), F.col("rep.t").alias("t")), "classes")
    places = found.select("id", "t", F.posexplode("anchors").alias("k", "h"))
    flagged = _again(places, _hot(places, "id", "t", "k"), "id", "t", "k").groupBy("id", "t").agg(F.collect_set("k").alias("ks"))
    flags = written(flagged.join(classes.select("id", "t", "copies"), ["id", "t"]), "flags")
    base = written(found.drop("anchors"), "words")
    drop(spark, path)

    named = docs.select(*_id(), "text")
    if flags.count() <= BROADCAST_IDS:
        named = named.join(F.broadcast(flags.select("id", "t")), ["id", "t"], "left_semi")
    # equal rows are copies: one of them is enough
    texts = written(named.join(flags, ["id", "t"]), "texts")
    windows = candidate_windows(texts.where("copies = 1").unionByName(texts.where("copies > 1").dropDuplicates(["id", "t"])), length)
    starts = _again(windows, _hot(windows, "id", "t", "at"), "id", "t", "at").groupBy("id", "t").agg(F.collect_list("at").alias("starts"))
    cut = without(texts.where("copies = 1").join(starts, ["id", "t"]), length)
    cut = cut.select("id", "t", F.col("n_removed").alias("gone"), F.sha2("kept", 256).alias("left_sha"), *(["kept"] if keep_text else []))

    rows = base.join(classes.select("th", "d1", "copies"), ["th", "d1"]).join(cut, ["id", "t"], "left")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= length)
    return rows.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
        *([F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept")] if keep_text else []),
    )
