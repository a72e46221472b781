"""Token ids in grammar-compressed shards (Re-Pair) with random access.

Documents are range-partitioned and sorted by ``doc_id``; each partition is cut into shards of
about ``shard_tokens`` ids. Within a shard frequent pairs of neighbouring symbols are replaced by
nonterminals, round after round, until no pair pays for its rule or all 16-bit symbols are used; pairs
never span two documents. A shard is one binary value,
written by Spark's Parquet writer into the given folder, so that any store that Spark reaches
will do, and holds, little-endian:

    b"RPS1", u32 documents, u32 rules, u32 symbols, u32 first nonterminal
    u16 left, u16 right of every rule (a rule only names earlier nonterminals)
    u32 expansion length of every rule
    u32 first symbol of every document, and their number at the end
    u32 ids of every document
    u16 symbols of all documents

Expansion lengths make a document, or a range of ids inside it, decodable without the rest.

Defined results: null or empty text is the end id alone; null ``doc_id`` sorts first; rows that
repeat are written as often as they occur; other columns are ignored; an empty table gives no
shards and an empty result.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import _made, shared_dir
from ._tokens import encoded, ragged
from ._words import releasing

MAGIC = b"RPS1"
SYMBOLS = 1 << 16
SHARDS = "part int, shard int, first_id long, n_ids long, doc_ids array<bigint>, payload binary"


CELLS = 1 << 18
PAYS = 5  # a rule takes 8 bytes and saves 2 for each occurrence


def replace_frequent(seq: np.ndarray, end: int, first: int, at_least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """One round: the most frequent pairs, as codes ``left << 16 | right``, become ``first``, ``first + 1``, ...

    Pairs are first counted in a table of hashes; those in the fullest cells, twice as many as pairs
    are wanted, are sorted and counted exactly; if none of them is frequent, those in all cells are. Of
    pairs that share a cell the most frequent one is taken, of overlapping occurrences every second;
    pairs of which no occurrence is left get no symbol.
    """
    code = (seq[:-1].astype(np.uint32) << np.uint32(16)) | seq[1:]
    cell = (code * np.uint32(2654435761)) >> np.uint32(14)
    counts = np.bincount(cell, minlength=CELLS)
    # the largest level that twice as many cells reach
    reach = np.cumsum(np.bincount(np.minimum(counts, 1 << 16))[::-1])[::-1]
    full = int(np.count_nonzero(reach >= 2 * most)) - 1
    for level in sorted({max(full, at_least), at_least}, reverse=True):
        heavy = code[(counts >= level)[cell]]
        heavy = heavy[(heavy >> np.uint32(16) != end) & (heavy & np.uint32(0xFFFF) != end)]
        found, n = np.unique(heavy, return_counts=True)
        found, n = found[n >= at_least], n[n >= at_least]
        if len(found):
            break
    pairs = found[np.lexsort((found, -n))[:most]]
    own = (pairs * np.uint32(2654435761)) >> np.uint32(14)
    pairs = pairs[np.sort(np.unique(own, return_index=True)[1])]
    if not len(pairs):
        return seq, pairs
    slot = np.full(CELLS, -1, np.int32)
    slot[(pairs * np.uint32(2654435761)) >> np.uint32(14)] = np.arange(len(pairs))
    k = slot[cell]
    at = np.flatnonzero(k >= 0)
    at = at[pairs[k[at]] == code[at]]
    new_run = np.r_[True, np.diff(at) > 1]
    run_at = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
    at = at[(np.arange(len(at)) - run_at) % 2 == 0]
    used, own = np.unique(k[at], return_inverse=True)
    pairs = pairs[used]
    out = seq.copy()
    out[at] = first + own
    stay = np.ones(len(seq), bool)
    stay[at + 1] = False
    return out[stay], pairs


def compress(docs: list[np.ndarray], vocabulary: int, rounds: int | None = None, most: int = 1024, at_least: int = PAYS) -> bytes:
    """The shard of these documents' ids. ``vocabulary`` ids precede the nonterminals.

    Rounds go on until no pair occurs ``at_least`` times or the symbols run out, or for ``rounds``.
    """
    end = SYMBOLS - 1
    n_ids = np.array([len(d) for d in docs], np.uint32)
    seq = np.empty(int(n_ids.sum(dtype=np.int64)) + len(docs), np.uint16)
    ends = np.cumsum(n_ids.astype(np.int64) + 1) - 1
    mask = np.ones(len(seq), bool)
    mask[ends] = False
    seq[ends] = end
    if len(docs):
        seq[mask] = np.concatenate(docs)
    rules = np.empty(0, np.uint32)
    for _ in itertools.count() if rounds is None else range(rounds):
        room = min(most, end - vocabulary - len(rules))
        if room <= 0 or len(seq) < 2:
            break
        seq, pairs = replace_frequent(seq, end, vocabulary + len(rules), at_least, room)
        if not len(pairs):
            break
        rules = np.r_[rules, pairs]
    left, right = (rules >> np.uint32(16)).astype(np.uint16), rules.astype(np.uint16)
    lens = rule_lengths(left, right, vocabulary)
    stops = np.flatnonzero(seq == end)
    starts = np.r_[0, stops[:-1] + 1] - np.arange(len(docs)) if len(docs) else np.empty(0)
    body = seq[seq != end]
    return b"".join([MAGIC, struct.pack("<4I", len(docs), len(rules), len(body), vocabulary), left.astype("<u2").tobytes(), right.astype("<u2").tobytes(), lens.astype("<u4").tobytes(), np.r_[starts, len(body)].astype("<u4").tobytes(), n_ids.astype("<u4").tobytes(), body.astype("<u2").tobytes()])


def rule_lengths(left: np.ndarray, right: np.ndarray, vocabulary: int) -> np.ndarray:
    lens = np.ones(vocabulary + len(left), np.int64)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        lens[vocabulary + i] = lens[a] + lens[b]
    return lens[vocabulary:]


class Shard:
    """Reader of one shard's bytes."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("not a shard of this format")
        docs, rules, symbols, self.vocabulary = struct.unpack_from("<4I", payload, 4)
        at = 20

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.left, self.right = take(rules, "<u2"), take(rules, "<u2")
        self.rule_len, self.starts, self.n_ids = take(rules, "<u4"), take(docs + 1, "<u4"), take(docs, "<u4")
        self.symbols = take(symbols, "<u2")
        self._expansions()

    def _expansions(self) -> None:
        """All expansions behind each other: ids expand to themselves, each rule to its two parts."""
        size = np.r_[np.ones(self.vocabulary, np.int64), self.rule_len.astype(np.int64)]
        self.to = np.cumsum(size)
        self.frm = self.to - size
        flat = np.empty(int(self.to[-1]) if len(self.to) else 0, np.uint16)
        flat[: self.vocabulary] = np.arange(self.vocabulary)
        frm, to = self.frm.tolist(), self.to.tolist()
        for i, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True), self.vocabulary):
            mid = frm[i] + to[a] - frm[a]
            flat[frm[i] : mid] = flat[frm[a] : to[a]]
            flat[mid : to[i]] = flat[frm[b] : to[b]]
        self.flat = flat

    def ids(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of a document; only the symbols that overlap them are expanded."""
        own = self.symbols[self.starts[doc] : self.starts[doc + 1]]
        if start == 0 and stop is None:
            return ragged(self.flat, self.frm[own], self.to[own])
        ends = np.cumsum(self.to[own] - self.frm[own])
        stop = int(self.n_ids[doc]) if stop is None else min(stop, int(self.n_ids[doc]))
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        part = ragged(self.flat, self.frm[own[a:b]], self.to[own[a:b]])
        skipped = int(ends[a - 1]) if a else 0
        return part[start - skipped : stop - skipped]

    def __len__(self) -> int:
        return len(self.n_ids)


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, shard_tokens: int = 1 << 20) -> None:
    """Encode all documents and write their shards as a table under ``path``."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
        if vocabulary >= SYMBOLS - 1:
            raise ValueError("this format holds vocabularies of up to 65,534 ids")
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, before, size
            row = pa.record_batch([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([compress(held, vocabulary)], pa.binary())], ["part", "shard", "first_id", "n_ids", "doc_ids", "payload"])
            shard, before, size = shard + 1, before + size, 0
            names.clear()
            held.clear()
            return row

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), encoded(b.column(1), tokenizer, end_id), strict=True):
                names.append(doc)
                held.append(ids.astype(np.uint16))
                size += len(ids)
                if size >= shard_tokens:
                    yield flush()
        if names:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(releasing(run), SHARDS).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document, decoded from the shards under ``path``."""
    shards = spark.read.schema(SHARDS).parquet(path)
    # one row for each partition of the writer, which the driver could list anyway
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    firsts, at = {}, 0
    for part, n in totals:
        firsts[part] = at
        at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(row["payload"])
                crcs = [zlib.crc32(shard.ids(k).astype("<u4").tobytes()) for k in range(len(shard))]
                n = shard.n_ids.astype(np.int64)
                starts = firsts[row["part"]] + row["first_id"] + np.cumsum(n) - n
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(n), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(releasing(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write shards under ``path`` (default: a new folder of the shared one) and read them back."""
    spark = docs.sparkSession
    if path is None:
        path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
        _made.append((spark, path))
    write_shards(docs, tokenizer, path, end_id)
    return read_documents(spark, path)
