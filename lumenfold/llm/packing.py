"""Best-fit packing of documents into sequences of fixed length.

Documents become pieces: a document of at most ``capacity`` ids is one piece; a longer one is cut
so that every piece but the first has ``capacity`` ids. Only the histogram of piece lengths, at
most ``capacity`` numbers, reaches the driver. There the configuration linear program (one column
for each multiset of lengths that fits, one covering row for each length) is solved by
multiplicative weights: prices of lengths fall by the share of them that is covered, and the columns
of each round come from a knapsack dynamic program under these prices. Of the columns within
``near`` of the best one each is used by a bounded step, rounded to a whole number and never beyond
what is left of a length; as the rows fill, ``near`` is widened. The few pieces (a few in a hundred)
that no such column takes are placed by best fit decreasing, on counts. The prices give a lower bound
of the number of sequences. The driver's work depends on ``capacity``, not on the number of documents.

Pieces get their ranks within a length from counts of (length, bucket) and a window within each,
so that no length, however common, is in one task. A table of runs (bounded by the number of
columns used) turns a rank into sequence and offset.

Defined results: null or empty text is one piece that holds the end id alone; rows that repeat
are packed as often as they occur; a null ``doc_id`` is packed like any other; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import written
from ._tokens import encoded
from ._words import releasing

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

Pattern = tuple[int, ...]  # the lengths in one sequence, longest first


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: only the first may be shorter than ``capacity``."""
    first = (n - 1) % capacity + 1 if n else 0
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def to_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 2) -> DataFrame:
    """Token pieces of every document, without the ids themselves but with their checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, rows = b.column(0).to_pylist(), []
            for doc, ids in zip(names, encoded(b.column(1), tokenizer, end_id), strict=True):
                raw = ids.astype("<u4").tobytes()
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), PIECES)


def price_fill(prices: np.ndarray, lens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: the best value within each capacity, and the length added last (0: none)."""
    value = np.full(capacity + 1, -1.0)
    value[lens] = prices
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for w in range(1, capacity + 1):
        got = value[1 : w + 1] + best[w - 1 :: -1]
        k = int(got.argmax())
        best[w], last[w] = (got[k], k + 1) if got[k] >= best[w - 1] else (best[w - 1], 0)
    return best, last


Step = tuple[Pattern, int]  # a column and how often it is used


def solve(counts: np.ndarray, step: float = 0.1, eta: float = 0.6, bend: float = 1.05, near: float = 0.01, widest: float = 1.0) -> tuple[list[list[Step]], float]:
    """Whole columns that hold no more than ``counts`` (index: length) by round, and a lower bound of the optimum.

    A round uses at most a ``step`` of each length (one at least). Prices start a little above
    proportion for long lengths (``bend``), so that these aren't left to the end.
    """
    capacity = len(counts) - 1
    need, left = counts.astype(float), counts.astype(np.int64)
    base = (np.arange(capacity + 1) / capacity) ** bend
    steps: list[list[Step]] = []
    bound = float(need @ np.arange(capacity + 1)) / max(capacity, 1)
    while left.any() and near < widest:
        lens = np.flatnonzero(left)
        prices = np.zeros(capacity + 1)
        prices[lens] = base[lens] * np.exp(eta * (left[lens] / need[lens] - 1))
        best, last = price_fill(prices[lens], lens, capacity)
        bound = max(bound, float(need @ prices) / best[capacity])
        room = np.minimum(left, np.maximum(1, np.ceil(step * need)).astype(np.int64))
        found: list[Step] = []
        for n in lens[::-1].tolist():
            if not room[n] or prices[n] + best[capacity - n] < (1 - near) * best[capacity]:
                continue
            column, w = [n], capacity - n
            while w > 0:
                column += [int(last[w])] if last[w] else []
                w -= max(1, int(last[w]))
            held, copies = np.unique(column, return_counts=True)
            if times := int((room[held] // copies).min()):
                found.append((tuple(sorted(column, reverse=True)), times))
                left[held] -= copies * times
                room[held] -= copies * times
        steps.append(found)
        if sum(len(p) * m for p, m in found) < 0.02 * (left.sum() + 1):
            near *= 1.5
    return steps, bound


def best_fit(counts: np.ndarray) -> dict[Pattern, int]:
    """Best fit decreasing over counts of lengths: bins with the same content are one entry."""
    capacity = len(counts) - 1
    gaps: dict[int, dict[Pattern, int]] = defaultdict(dict)  # free space: contents and how many
    for n in range(capacity, 0, -1):
        left = int(counts[n])
        for gap in sorted(g for g in gaps if g >= n):
            for held in list(gaps[gap]):
                if not left:
                    break
                bins = gaps[gap].pop(held)
                each = gap // n
                full = min(bins, left // each)
                rest = left - full * each if full < bins else 0
                for k, m in ((each, full), (rest, 1 if rest else 0)):
                    if m:
                        new = gaps[gap - k * n]
                        new[held + (n,) * k] = new.get(held + (n,) * k, 0) + m
                        left -= k * m
                        bins -= m
                if bins:
                    gaps[gap][held] = gaps[gap].get(held, 0) + bins
        if left:
            each = capacity // n
            for k, m in ((each, left // each), (left % each, 1 if left % each else 0)):
                if m:
                    gaps[capacity - k * n][(n,) * k] = gaps[capacity - k * n].get((n,) * k, 0) + m
    out: dict[Pattern, int] = defaultdict(int)
    for held in gaps.values():
        for p, m in held.items():
            out[p] += m
    return dict(out)


def plan(counts: np.ndarray) -> tuple[dict[Pattern, int], float, float]:
    """Whole sequences that hold exactly ``counts``, a lower bound, and the program's share of short pieces.

    The rounded program places all that its rounds place, or nine tenths of the pieces and more: of
    its last rounds, those are left to best fit that best fit does with fewer sequences.
    """
    counts = np.asarray(counts, np.int64)
    capacity = len(counts) - 1
    short = counts.copy()
    short[capacity] = 0
    steps, bound = solve(short)
    left, total, tried, used = short.copy(), int(short.sum()), [], 0
    for i, found in enumerate(steps):
        for p, m in found:
            used += m
            for n in p:
                left[n] -= m
        if i == len(steps) - 1 or (10 * left.sum() <= total and i % 4 == 0):
            tried.append((used + sum(best_fit(left).values()), -i))
    out: dict[Pattern, int] = defaultdict(int, {(capacity,): int(counts[capacity])} if counts[capacity] else {})
    placed = 0
    if tried:
        left = short.copy()
        for p, m in (s for found in steps[: 1 - min(tried)[1]] for s in found):
            out[p] += m
            placed += m * len(p)
            for n in p:
                left[n] -= m
        for p, m in best_fit(left).items():
            out[p] += m
    return dict(out), bound + int(counts[capacity]), placed / max(total, 1)


def runs(patterns: dict[Pattern, int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence, copies in a sequence and first offset of each run."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for p, times in sorted(patterns.items(), reverse=True):
        offset = 0
        for n in sorted(set(p), reverse=True):
            copies = p.count(n)
            rows[n].append((ranks[n], sequence, copies, offset))
            ranks[n] += copies * times
            offset += copies * n
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in rows.items()}


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``, from 0 within each length, no length being in one task."""
    buckets = max(32, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sums = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (
        dealt.withColumn("place", F.row_number().over(within))
        .join(sums, ["length", "bucket"])
        .withColumn("rank", (F.col("before") + F.col("place") - 1).cast("long"))
        .select(*pieces.columns, "rank")
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``."""
    pieces = written(to_pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    table = runs(plan(counts)[0])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own = length == n
                first, seq, copies, off = table[int(n)]
                r = np.searchsorted(first, rank[own], side="right") - 1
                k = rank[own] - first[r]
                sequence[own] = seq[r] + k // copies[r]
                offset[own] = off[r] + k % copies[r] * n
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(pieces).mapInArrow(place, PIECES + ", sequence_id long, offset long")
