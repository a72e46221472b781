"""Exact top-k by inner product over a bit-sliced index.

Components become integers ``floor(scale * x)``. A block of candidates is indexed by slices: for
each dimension and binary digit a bitmap over the block's rows. A query's scores over the whole
block are sums of slices, weighted by the binary digits of the query's components: slices of equal
weight are added three at a time by full adders (bitwise and, or, exclusive or) until each weight
has one slice, which are the slices of the scores. The best k rows are then picked from the most
significant slice downward; rows that tie at the boundary are resolved exactly, by the smaller id.

Work is dealt as tiles of a block of queries and a block of candidates, both of bounded size; a tile
builds the index of its block once for up to ``query_block`` queries, so a vector is sent once for each
so many queries, in the narrowest integers that hold all components. Where there are fewer tiles than
partitions, queries are dealt into more blocks. The best k of each query in each tile meet in a last
ranking of at most k rows a tile.

Defined results: vectors that are null or hold null or non-finite components take no part; a query
is compared to vectors of its own length; equal scores rank by the smaller id; a row whose id equals
the query's is the query's own; a null id takes no part; repeated rows are candidates as often as
they occur, and one query; rows of one id with different vectors are queries of their own, each with
its ranks; scores that leave 64 bits raise an error; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESULT = "query_id long, query long, vec_id long, score long"


class SlicedIndex:
    """Bit slices of an integer matrix (rows: candidates in ascending order of id)."""

    def __init__(self, rows: np.ndarray) -> None:
        self.n, self.dims = rows.shape
        self.low = int(rows.min()) if rows.size else 0
        self.width = max(1, int(int(rows.max()) - self.low).bit_length()) if rows.size else 1
        shifted = (rows - self.low).astype(np.uint64)
        self.words = -(-self.n // 64)
        full = np.zeros(self.words * 64, bool)
        full[: self.n] = True
        self.all = self._pack(full)
        self.slices = np.zeros((self.dims, self.width, self.words), np.uint64)
        for d in range(self.dims):
            for b in range(self.width):
                bits = np.zeros(self.words * 64, bool)
                bits[: self.n] = (shifted[:, d] >> np.uint64(b)) & np.uint64(1)
                self.slices[d, b] = self._pack(bits)
        self.inverse = self.slices ^ self.all

    @staticmethod
    def _pack(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, bitorder="little").view(np.uint64)

    @staticmethod
    def rows_of(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    def scores(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least first, of a number that orders the block's rows as their inner products do.

        A negative component is taken as its magnitude times the inverted slices: the same up to a
        constant of the query.
        """
        at: list[list[np.ndarray]] = [[] for _ in range(self.width + 70)]
        for d, q in enumerate(query.tolist()):
            source = self.slices[d] if q > 0 else self.inverse[d]
            q, shift = abs(q), 0
            while q:
                if q & 1:
                    for b in range(self.width):
                        at[shift + b].append(source[b])
                q >>= 1
                shift += 1
        out: list[np.ndarray] = []
        for weight, held in enumerate(at):
            while len(held) > 2:
                a, b, c = held.pop(), held.pop(), held.pop()
                u = a ^ b
                held.insert(0, u ^ c)
                u &= c
                u |= a & b
                at[weight + 1].append(u)
            if len(held) == 2:
                a, b = held
                held[:] = [a ^ b]
                at[weight + 1].append(a & b)
            out.append(held[0] if held else None)
        while out and out[-1] is None:
            out.pop()
        return out

    def top(self, query: np.ndarray, k: int, but: np.ndarray) -> np.ndarray:
        """Rows of the k best, without those in bitmap ``but``; boundary ties by the smaller row."""
        sure = np.zeros(self.words, np.uint64)
        maybe = self.all & ~but
        for s in reversed(self.scores(query)):
            if s is None:
                continue
            higher = maybe & s
            trial = sure | higher
            n = int(np.bitwise_count(trial).sum())
            if n > k:
                maybe = higher
            else:
                sure = trial
                maybe = maybe & ~s
                if n == k:
                    maybe = np.zeros_like(maybe)
                    break
        found = self.rows_of(sure)
        return np.r_[found, self.rows_of(maybe)[: k - len(found)]]


def tile_top(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], k: int) -> tuple[list, list, list]:
    """Best k of each query among a block; both are (ids, integer matrix)."""
    order = np.argsort(rows[0], kind="stable")
    ids, matrix = rows[0][order], rows[1][order].astype(np.int64)
    queries = (queries[0], queries[1].astype(np.int64))
    index = SlicedIndex(matrix)
    largest = [max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0 for m in (matrix, queries[1])]
    if largest[0] * largest[1] * matrix.shape[1] >= 1 << 63:
        raise OverflowError("scores don't fit 64 bits")
    out: tuple[list, list, list] = ([], [], [])
    for q, vector in zip(queries[0].tolist(), queries[1], strict=True):
        but = np.zeros(index.words, np.uint64)
        for row in range(int(np.searchsorted(ids, q)), int(np.searchsorted(ids, q, side="right"))):
            but[row // 64] |= np.uint64(1 << (row % 64))
        best = index.top(vector, k, but)
        out[0].append(np.full(len(best), q))
        out[1].append(ids[best])
        out[2].append(matrix[best] @ vector)
    return out


def top_k(vectors: DataFrame, k: int = 20, scale: float = 64.0, every: int = 20, query_block: int = 8192, row_block: int = 32_768) -> DataFrame:
    """``query_id, rank, vec_id, score``: queries are the rows whose id is divisible by ``every``."""
    usable = "vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    rows = vectors.select("vec_id", "embedding").where(usable).select("vec_id", F.size("embedding").alias("dims"), ints.alias("v"))
    is_query = F.col("vec_id") % every == 0
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi")).first()
    kind, dtype = next(((t, d) for t, d, b in (("smallint", np.int16, 15), ("int", np.int32, 31)) if n["n"] and n["lo"] is not None and -(1 << b) <= n["lo"] and n["hi"] < 1 << b), ("bigint", np.int64))
    rows = rows.withColumn("v", F.col("v").cast(f"array<{kind}>"))
    blocks = max(1, -(-n["n"] // row_block))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-n["q"] // query_block), min(-(-tasks // blocks), -(-n["q"] // 64)))
    tiles = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    place = lambda m: F.pmod(F.xxhash64("vec_id", "v"), F.lit(m)).cast("int")
    asked = rows.where(is_query).distinct().select("dims", place(groups).alias("g"), tiles(blocks).alias("b"), F.lit(True).alias("asks"), "vec_id", F.xxhash64("v").alias("query"), "v")
    held = rows.select("dims", tiles(groups).alias("g"), place(blocks).alias("b"), F.lit(False).alias("asks"), "vec_id", F.lit(0).cast("long").alias("query"), "v")

    def run(table: pa.Table) -> pa.Table:
        dims = table.column("dims")[0].as_py()
        asks, ids, query = (table.column(c).to_numpy() for c in ("asks", "vec_id", "query"))
        flat = np.concatenate([c.flatten().to_numpy() for c in table.column("v").chunks]) if table.num_rows else np.empty(0, dtype)
        matrix = flat.reshape(-1, dims)
        names = [f.split()[0] for f in RESULT.split(", ")]
        if not asks.any() or asks.all():
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        q, v, s = tile_top((ids[asks], matrix[asks]), (ids[~asks], matrix[~asks]), k)
        which = np.repeat(query[asks], [len(x) for x in q])
        return pa.table(dict(zip(names, (np.concatenate(q).astype(np.int64), which, np.concatenate(v).astype(np.int64), np.concatenate(s).astype(np.int64)), strict=True)))

    best = asked.unionByName(held).groupBy("dims", "g", "b").applyInArrow(run, RESULT)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
