"""Similarity join of documents by the Jaccard coefficient of their word n-grams.

N-grams are hashed to 64 bits; the order of the hashes is the global order, cut into fragments
(vertical partitioning). Two sets of sizes a and b whose coefficient reaches t differ in at most
``d = (a + b) (1 - t) / (1 + t)`` n-grams. Sizes fall into levels with a ratio of ``t``; a document
gives its fragments for its own level and the next, so that any two similar documents meet at one.

Candidates share a fragment that isn't empty. No similar pair is missed, because

* at a level whose pairs differ in at most d n-grams the order is cut into ``k = d + 1 + E``
  fragments, so E + 1 or more of them are equal in both sets (perhaps both empty); if one of the sets
  has at most E empty fragments, one of the equal ones isn't empty;
* E is what a set of the level's least size hardly exceeds, a number that depends on the level only.
  A set that exceeds it is cut once more, by the order of another hash, and again up to ``CUTS``
  times. At the first cut where one of a similar pair has at most E empty fragments both have given
  their fragments. Only at the last cut empty fragments count, too;
* of a set's fragments only the first are used (prefix filter): all are ordered by how often a sample
  of documents holds them, then by digest, empty ones last. Two lists of k fragments that agree in all
  but D of them have one in common among the first D + 1 of each; D is bounded by the set's own size
  and by the level's largest. So of the fragments that aren't empty, all but the first D + 1 may go.

The sample has a bounded number of fragments, so at any size there is a bounded number of fragments
that it holds often. For these it names one of their documents, the leader, too, so they need no
search, and no task reads all documents of one fragment. Copies in very large classes are left out
before fragments are shuffled, those in small ones after.

Equal sets are one class, of which the least id takes part. First every document of a fragment is
compared to its leader (where no sample names one: the least id), and what is similar is joined into components; then the
pairs of documents that have one leader, and that lie in different components, are compared. Before, a
sketch gives a lower bound of the difference: of the n-grams in each of 1024 cells of the order it
holds whether their number is odd, and every n-gram in which two sets differ changes one cell. Pairs
that remain are held against a second sketch, of two to four cells for each n-gram. Afterwards,
n-grams of candidate pairs are counted exactly: the overlaps of each fragment apart, then their sum.
No link between components is lost and pairs inside a component aren't formed again.

Defined results: null or empty text, or one without words, has an empty set and is linked with
nothing; a text of fewer than n words is one n-gram; rows of equal id are one document, linked by
any of its texts; a null id takes the component of its class, if that has an id; ids of 64 bits; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._graph import components
from ._scratch import drop, written, written_path
from ._skew import SAMPLE, SEEN, heavy, only, share
from ._words import mix, releasing, rolling, slices, words

SKETCH = 16  # words of 64 cells
EXACT = 4  # fragments in which overlaps of candidate pairs are counted
TILE = 1024  # documents of a block that a task compares with as many others
SMALL = 16  # blocks of up to so many documents are compared by a join
CUTS = 8  # orders by which a set is cut before its empty fragments count


def sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    for a, b in slices(texts):
        w = words(texts.slice(a, b - a), lower=True)
        grams = rolling(w.hashes, n, 1)
        for s, e in zip(w.cuts[:-1].tolist(), w.cuts[1:].tolist(), strict=True):
            if e - s >= n:
                yield np.unique(grams[s : e - n + 1])
            elif e > s:
                yield rolling(w.hashes[s:e], e - s, 2)
            else:
                yield grams[:0]


def max_difference(a_plus_b: int, num: int, den: int) -> int:
    return a_plus_b * (den - num) // (den + num)


def most_empty(n: int, d: int) -> int:
    """Empty fragments that ``n`` or more n-grams hardly exceed: the mean and two deviations, cut into d + 1 + E."""
    most = 0
    while most <= d + 4:
        k = d + 1 + most
        mean = k * exp(n * log1p(-1 / k)) if k > 1 else 0.0
        need = int(mean + 2 * sqrt(mean))
        if need <= most:
            return most
        most = need
    return d + 4


@lru_cache(None)
def levels(num: int, den: int, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each level: largest size, difference of its pairs (0: only equal sets are similar), and E."""
    tops, differences, empty, low, least = [], [], [], 1, 1
    while not tops or tops[-2 if len(tops) > 1 else -1] < upto:
        top = low * den // num
        d = max_difference(2 * top, num, den)
        tops.append(top)
        differences.append(d)
        empty.append(most_empty(least, d))
        least, low = low, top + 1  # sets of the level below take part
    return np.array(tops), np.array(differences), np.array(empty)


def rooms(n: np.ndarray | int, num: int, den: int, upto: int) -> list[np.ndarray]:
    """For a set's own level and the next: the most n-grams in which it and a similar one can differ there."""
    tops, differences, _ = levels(num, den, upto)
    own = np.searchsorted(tops, n)
    return [np.minimum(differences[i], (n + np.minimum(tops[i], n * den // num)) * (den - num) // (den + num)) for i in (own, own + 1)]


class Common:
    """Fragments that a sample holds often: digests in order, how often, and a document of each."""

    def __init__(self, keys: np.ndarray, seen: np.ndarray, leaders: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.seen, self.leaders = keys[order], seen[order], leaders[order]

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key here, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


NONE = Common(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))


def fragment_keys(s: np.ndarray, num: int, den: int, common: Common | None = NONE) -> np.ndarray:
    """Digests of the fragments of a set that its documents is indexed by; all of them if ``common`` is None."""
    upto = 1 << max(12, len(s).bit_length())
    _, differences, empty = levels(num, den, upto)
    own = int(np.searchsorted(levels(num, den, upto)[0], len(s)))
    keys, mixed = [s[:0]], mix(s)
    for level, room in zip((own, own + 1), rooms(len(s), num, den, upto), strict=True):
        d, allowed = int(differences[level]), int(empty[level])
        if not d:
            continue
        k = d + 1 + allowed
        for cut in range(CUTS):
            salt = np.uint64(level * 1_000_003 + cut * 7_368_787)
            place = s if not cut else mix(s + salt)
            frag, m = ((place >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32), mixed
            if cut:
                order = np.argsort(frag, kind="stable")
                frag, m = frag[order], m[order]
            at = np.flatnonzero(np.r_[True, frag[1:] != frag[:-1]])
            found = mix(np.add.reduceat(m, at) + mix(frag[at] + salt))
            enough = k - len(at) <= allowed
            if enough and common is not None and len(found) > room + 1:
                hot = common.places(found)
                found = found[np.lexsort((found, np.where(hot >= 0, common.seen[hot], 0) if len(common.keys) else hot))[: int(room) + 1]]
            keys.append(found)
            if enough:
                break
            if cut == CUTS - 1:
                none = np.setdiff1d(np.arange(k, dtype=np.uint64), frag[at])
                keys.append(mix(mix(none + salt) ^ np.uint64(0x5851F42D4C957F2D)))
    return np.concatenate(keys)


def fine_sketch(s: np.ndarray) -> np.ndarray:
    """Odd cells of a power of two of cells; xor of its halves is the sketch of half as many."""
    cells = 1 << max(6, (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def digests(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    if not len(s):
        return np.uint64(0), np.uint64(0)
    return np.add.reduce(mix(s + np.uint64(1))), np.add.reduce(mix(s ^ np.uint64(0xA0761D6478BD642F)))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(k) for k in parts])].astype(np.int32)), pa.array(np.concatenate(parts)))


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """Size, digests and sketches of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1)):
                size, pairs, sketch, fine = [], [], [], []
                for s in sets(b.column(1).slice(lo, hi - lo), n):
                    size.append(len(s))
                    pairs.append(digests(s))
                    odd = np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=SKETCH * 64) & 1
                    sketch.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
                    fine.append(fine_sketch(s))
                both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array(np.array(size, np.int64)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), _lists(sketch), _lists(fine)], ["doc_id", "n", "d1", "d2", "sketch", "fine"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), "doc_id long, n long, d1 long, d2 long, sketch array<bigint>, fine array<bigint>")


def fragments(docs: DataFrame, n: int, num: int, den: int, common: Common | None, copied: dict[tuple[int, int], int]) -> DataFrame:
    """``(rep, key, leader)`` of each document's fragments, as `fragment_keys` gives them; leaders of common ones.

    Of the classes ``copied`` (digests and least id) only documents of the least id give theirs.
    """
    held = docs.sparkSession.sparkContext.broadcast((common, copied))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, copied = held.value
        for b in batches:
            for lo, hi in slices(b.column(1)):
                names, keys = [], []
                for name, s in zip(b.column(0).slice(lo, hi - lo).to_pylist(), sets(b.column(1).slice(lo, hi - lo), n), strict=True):
                    if len(s) and (not copied or copied.get(tuple(int(x.view(np.int64)) for x in digests(s)), name) == name):
                        names.append(name)
                        keys.append(fragment_keys(s, num, den, common))
                if names:
                    flat = np.concatenate(keys)
                    hot = (common or NONE).places(flat)
                    leaders = pa.array((common or NONE).leaders[hot] if len((common or NONE).keys) else np.zeros(len(flat), np.int64), mask=hot < 0)
                    yield pa.record_batch([pa.array(np.repeat(np.array(names, np.int64), [len(k) for k in keys])), pa.array(flat.view(np.int64)), leaders], ["rep", "key", "leader"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(releasing(run), "rep long, key long, leader long")


def exploded_sets(docs: DataFrame, n: int) -> DataFrame:
    """``(id, v, n, frag, grams)``: each set, its digest and size, in ``EXACT`` fragments of the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1)):
                rows: tuple[list, ...] = ([], [], [], [], [])
                for name, s in zip(b.column(0).slice(lo, hi - lo).to_pylist(), sets(b.column(1).slice(lo, hi - lo), n), strict=True):
                    frag = (s >> np.uint64(62)).astype(np.int64)
                    cut = np.searchsorted(frag, np.arange(EXACT + 1))
                    digest = np.add.reduce(mix(s)) if len(s) else np.uint64(0)
                    for f in range(EXACT):
                        if cut[f + 1] > cut[f]:
                            for column, value in zip(rows, (name, digest, len(s), f, s[cut[f] : cut[f + 1]].view(np.int64)), strict=True):
                                column.append(value)
                if rows[0]:
                    cuts = np.r_[0, np.cumsum([len(x) for x in rows[4]])].astype(np.int32)
                    grams = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(rows[4])))
                    yield pa.record_batch([pa.array(rows[0], pa.int64()), pa.array(np.array(rows[1], np.uint64).view(np.int64)), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int32()), grams], ["id", "v", "n", "frag", "grams"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), "id long, v long, n long, frag int, grams array<bigint>")


def common_fragments(docs: DataFrame, sig: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> Common:
    """What a sample of about ``SAMPLE`` fragments, of whole documents, holds ``SEEN`` times or more."""
    sizes = sig.where("n > 0").groupBy("n").agg(F.count(F.lit(1)).alias("m")).toArrow()  # one row a size
    size, many = sizes.column("n").to_numpy(), sizes.column("m").to_numpy()
    total = sum(int((many * (r + 1)).sum()) for r in rooms(size, num, den, 1 << max(12, int(size.max(initial=1)).bit_length())))
    rate = min(1.0, SAMPLE / max(total, 1))
    drawn = sig.where("n > 0").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(rate * (1 << 40)))
    drawn = drawn.join(classes.select("d1", "d2", F.col("rep").alias("doc_id")), ["d1", "d2", "doc_id"], "left_semi").select("doc_id").distinct()
    rows = fragments(docs.join(F.broadcast(drawn), "doc_id", "left_semi"), n, num, den, None, {})  # fewer ids than fragments
    seen = rows.groupBy("key").agg(F.count(F.lit(1)).alias("seen"), F.min("rep").alias("leader")).where(F.col("seen") >= SEEN).toArrow()
    return Common(seen.column("key").to_numpy().view(np.uint64), seen.column("seen").to_numpy(), seen.column("leader").to_numpy())


def blocks(rows: DataFrame) -> DataFrame:
    """``(leader, rep)`` of the documents that share a fragment, without the leader itself."""
    salt = F.when(F.col("leader").isNotNull(), F.pmod(F.xxhash64("rep"), F.lit(1024))).otherwise(0).cast("int")
    same = Window.partitionBy("key", "salt")
    found = rows.withColumn("salt", salt).select("rep", F.coalesce("leader", F.min("rep").over(same)).alias("leader"))
    return found.where("leader <> rep").distinct()


def fine_close(a: str, b: str, num: int, den: int):
    """Fine sketches of rows ``a`` and ``b``, the longer folded, allow the threshold."""

    def folded(long, short):
        half = F.size(short)
        halves = F.zip_with(F.slice(long, F.lit(1), half), F.slice(long, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(long) == 2 * half, halves).otherwise(long)

    x, y = F.col(f"{a}.fine"), F.col(f"{b}.fine")
    differ = F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, u: s + F.coalesce(u, F.lit(0)))
    return differ * (den + num) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (den - num)


def refined(pairs: DataFrame, fines: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose fine sketches allow the threshold."""
    rows = pairs.select("a", "b").join(fines.alias("x"), F.col("a") == F.col("x.rep")).join(fines.alias("y"), F.col("b") == F.col("y.rep"))
    return rows.where(fine_close("x", "y", num, den)).select("a", "b").distinct()


def tile_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``(a, b)`` of large blocks that both sketches allow.

    A block of ``m`` documents is cut into parts of about ``TILE``; a task compares two parts.
    """
    parts = F.ceil(F.col("m") / TILE).cast("int")
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("leader", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "rep", "c", "n", "sketch", "fine")

    def run(table: pa.Table) -> pa.Table:
        part, rep, c, n = (table.column(k).to_numpy() for k in ("part", "rep", "c", "n"))
        sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH)
        lists = table.column("fine").combine_chunks()
        fine = lists.flatten().to_numpy().view(np.uint64)
        lens = lists.value_lengths().to_numpy().astype(np.int64)
        at = np.cumsum(lens) - lens
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        left, right = np.flatnonzero(part == x), np.flatnonzero(part == y)
        out = []
        for k in range(0, len(left), 64):
            i = left[k : k + 64]
            total = n[i][:, None] + n[right][None]
            allowed = total * (den - num)
            ok = (c[i][:, None] != c[right][None]) & (np.abs(n[i][:, None] - n[right][None]) * (den + num) <= allowed)
            if x == y:
                ok &= rep[i][:, None] < rep[right][None]
            u, v = np.nonzero(ok)
            for s in range(0, len(u), 1 << 14):
                iu, jv = i[u[s : s + (1 << 14)]], right[v[s : s + (1 << 14)]]
                room = (n[iu] + n[jv]) * (den - num)
                keep = np.bitwise_count(sketch[iu] ^ sketch[jv]).sum(1, dtype=np.int64) * (den + num) <= room
                iu, jv, room = iu[keep], jv[keep], room[keep]
                for li, lj in set(zip(lens[iu].tolist(), lens[jv].tolist(), strict=True)):
                    own = np.flatnonzero((lens[iu] == li) & (lens[jv] == lj))
                    step = max(1, (1 << 18) // max(li, lj))  # 2 MB of cells at a time
                    for o in range(0, len(own), step):
                        w = own[o : o + step]
                        f, g = fine[at[iu[w]][:, None] + np.arange(li)], fine[at[jv[w]][:, None] + np.arange(lj)]
                        f = f[:, :lj] ^ f[:, lj:] if li == 2 * lj else f
                        g = g[:, :li] ^ g[:, li:] if lj == 2 * li else g
                        good = w[np.bitwise_count(f ^ g).sum(1, dtype=np.int64) * (den + num) <= room[w]]
                        out.append(np.stack([rep[iu[good]], rep[jv[good]]], 1))
        found = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return pa.table({"a": found.min(1), "b": found.max(1)} if len(found) else {"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    return dealt.groupBy("leader", "x", "y").applyInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, repeated: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Pairs ``(a, b)`` whose exact overlap, summed over the fragments, reaches the threshold."""
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    own = only(docs, ids, "doc_id")
    # equal rows are one document
    again = repeated.select("doc_id")
    own = own.join(again, "doc_id", "left_anti").unionByName(own.join(again, "doc_id", "left_semi").distinct())
    path = written_path(exploded_sets(own, n), "grams")
    grams = docs.sparkSession.read.parquet(path)
    left, right = (grams.select(F.col("id").alias(x), "frag", *[F.col(c).alias(c + x) for c in ("v", "n", "grams")]) for x in "ab")
    partial = pairs.select("a", "b").join(left, "a").join(right, ["b", "frag"])
    partial = partial.select("a", "b", "va", "vb", "na", "nb", F.size(F.array_intersect("gramsa", "gramsb")).alias("m"))
    sums = partial.groupBy("a", "b", "va", "vb", "na", "nb").agg(F.sum("m").alias("both"))
    similar = sums.where(den * F.col("both") >= num * (F.col("na") + F.col("nb") - F.col("both")))
    found = written(similar.select("a", "b").distinct(), "verified")
    drop(docs.sparkSession, path)
    return found


def join_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document; similar: num / den or more."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sig = written(signatures(docs, n), "signatures")
    short = sig.select("doc_id", "n", "d1", "d2")
    classes = written(short.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    rep = classes.where("rep IS NOT NULL").select("rep").distinct()
    many = heavy(classes, "copies").toArrow().to_pylist()
    copied = {(r["d1"], r["d2"]): r["rep"] for r in many}
    rows = fragments(docs, n, num, den, common_fragments(docs, sig, classes, n, num, den), copied)
    shared = written(blocks(rows).join(rep, "rep", "left_semi"), "shared")
    # sketches are needed of documents that have met only
    met = written(shared.select("rep").union(shared.select("leader")).distinct(), "met")
    sketched = only(sig.where("n > 0"), met.withColumnRenamed("rep", "doc_id"), "doc_id")
    both = written(sketched.select(F.col("doc_id").alias("rep"), "n", "sketch", "fine"), "sketches")
    sketches, fines = both.select("rep", "n", "sketch"), both.select("rep", "n", "fine")

    # rows of one id and different sets are one document
    digest = F.struct("d1", "d2")
    repeated = short.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min(F.when(F.col("n") > 0, digest)).alias("x"), F.max(F.when(F.col("n") > 0, digest)).alias("y"))
    repeated = written(repeated.where("rows > 1").select("doc_id", (F.col("x") != F.col("y")).alias("several")), "repeated")
    several = short.where("n > 0").join(repeated.where("several"), "doc_id", "left_semi").join(classes, ["d1", "d2"]).select(F.col("doc_id").alias("b"), F.col("rep").alias("a")).distinct()

    def close(a: str, b: str):
        """Sizes and sketches allow the pair."""
        differ = [F.bit_count(F.get(f"{a}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{b}.sketch", F.lit(i)))) for i in range(SKETCH)]
        total = F.col(f"{a}.n") + F.col(f"{b}.n")
        return (F.abs(F.col(f"{a}.n") - F.col(f"{b}.n")) * (den + num) <= total * (den - num)) & (sum(differ[1:], differ[0]) * (den + num) <= total * (den - num))

    stars = shared.select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")).distinct()
    stars = stars.join(sketches.alias("p"), F.col("a") == F.col("p.rep")).join(sketches.alias("q"), F.col("b") == F.col("q.rep")).where(close("p", "q"))
    stars = written(refined(stars.select("a", "b").distinct(), fines, num, den), "stars")
    links = written(verified(stars, docs, repeated, n, num, den).unionByName(several.where("a <> b").select("a", "b")), "links")
    found = components(links)

    # documents of one fragment have its leader in common: blocks by that one hold all candidates, once for each
    placed = shared.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("leader", "rep", F.coalesce("component", "rep").alias("c"))
    placed = written(placed, "placed")
    sizes = placed.groupBy("leader").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi")
    open_rows = placed.join(sizes.select("leader", "m"), "leader").join(both, "rep")
    few = open_rows.where(F.col("m") <= SMALL)
    p, q = few.alias("p"), few.alias("q")
    near = (F.col("p.leader") == F.col("q.leader")) & (F.col("p.rep") < F.col("q.rep")) & (F.col("p.c") != F.col("q.c")) & close("p", "q") & fine_close("p", "q", num, den)
    more = p.join(q, near).select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b"))
    more = more.unionByName(tile_pairs(open_rows.where(F.col("m") > SMALL), num, den))
    more = written(more.distinct().join(stars, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        links = written(links.unionByName(verified(more, docs, repeated, n, num, den)), "links")
        found = components(links)
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "copies", F.coalesce("component", "rep").alias("component"))
    result = share(short.where("n > 0"), written(named, "named"), ["d1", "d2"], "copies").select("doc_id", "n", "component")
    return result.unionByName(short.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component"))).toDF("doc_id", "n_shingles", "component_id")
