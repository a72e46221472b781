"""URL filter: rules on hosts and paths, and exact membership in a list by a cascade of Bloom filters.

A cascade answers membership without error for keys of a known universe: its first level holds
the listed keys, the second the universe's keys that pass the first without being listed, the
third the listed keys that pass the second, and so on until nobody passes wrongly. A key is
listed if it leaves the cascade at an even level. The universe is every distinct host of the
table and every domain above it, so a page asks the cascade for its host and each parent domain;
nothing is joined.

A key is known to the levels by two 64-bit hashes. The universe's hashes are written once; each level
reads only the keys that its predecessors have left: the list, and a ``rate`` of the level before.
A level's bits are gathered by an aggregate over words of 64 bits. What is broadcast is the cascade
itself, whose size is known before it is built. Where it would exceed ``max_bytes``, keys are dealt
into parts by a hash, and the parts' cascades are built and asked one after another: exact for lists
of any size.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is
allowed; rows that repeat give rows that repeat; other columns are ignored; without rules none fits; an
empty list allows whatever no rule fits; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import written
from ._words import mix

MOST_LEVELS = 1000  # never reached but by two keys with the same hashes, which is an error


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains; the url's path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    """One Bloom filter: a power of two of bits in 64-bit words."""

    words: np.ndarray
    hashes: int
    seed: int

    def positions(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        return bit_positions(a, b, len(self.words) * 64, self.hashes, self.seed)

    def passes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        for p in self.positions(a, b):
            ok &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return ok


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domains(name: Column) -> Column:
    """The host and every domain above it: ``a.b.c`` gives ``a.b.c``, ``b.c``, ``c``."""
    parts = F.split(name, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def bit_positions(a: np.ndarray, b: np.ndarray, bits: int, hashes: int, seed: int) -> list[np.ndarray]:
    """Places of keys with hashes ``a`` and ``b`` (unsigned) in a filter of a power of two of bits."""
    first = mix(a ^ mix(b + np.uint64(seed)))
    step = mix(b + mix(a + np.uint64(seed))) | np.uint64(1)
    return [(first + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(hashes)]


def hashes_of(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit("second")).alias("b")


def filter_bits(n: int, rate: float) -> int:
    return 1 << max(6, math.ceil(math.log2(max(n, 1) * -math.log(rate) / math.log(2) ** 2)))


def _unsigned(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy().view(np.uint64)


def build_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter over the ``n`` distinct keys with hashes ``a`` and ``b``."""
    bits, hashes = filter_bits(n, rate), max(1, round(-math.log2(rate)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.sort(np.concatenate(bit_positions(_unsigned(b, "a"), _unsigned(b, "b"), bits, hashes, seed)))
            word, one = p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63))
            at = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(p) else np.empty(0, np.int64)
            values = np.bitwise_or.reduceat(one, at) if len(p) else one
            yield pa.record_batch([pa.array(word[at].view(np.int64)), pa.array(values.view(np.int64))], ["w", "v"])

    found = keys.select("a", "b").mapInArrow(run, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()  # at most `bits` / 64 rows
    words = np.zeros(bits // 64, np.uint64)
    words[found.column("w").to_numpy()] = found.column("v").to_numpy().view(np.uint64)
    return Level(words, hashes, seed)


def passing(keys: DataFrame, level: Level) -> DataFrame:
    """Rows ``a, b`` that the level lets through."""
    held = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(held.value.passes(_unsigned(b, "a"), _unsigned(b, "b"))))

    return keys.select("a", "b").mapInArrow(run, "a long, b long")


def build_cascade(inside: DataFrame, outside: DataFrame, rate: float = 0.01) -> list[Level]:
    """Levels over listed keys and the universe's other keys, both distinct, with hashes ``a`` and ``b``."""
    levels: list[Level] = []
    keys, others = inside, outside
    while n := keys.count():
        if len(levels) == MOST_LEVELS:
            raise RuntimeError("a listed key and another have the same hashes")
        levels.append(build_level(keys, n, rate, len(levels) + 1))
        keys, others = written(passing(others, levels[-1]), "passed"), keys
    return levels


def contains(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact for keys of the universe: the first level that a key fails decides."""
    out, open_ = np.zeros(len(a), bool), np.arange(len(a))
    for i, level in enumerate(levels):
        ok = level.passes(a[open_], b[open_])
        out[open_[~ok]] = i % 2 == 1
        open_ = open_[ok]
    out[open_] = len(levels) % 2 == 1
    return out


def any_listed(rows: DataFrame, levels: list[Level], part: int, parts: int) -> Column:
    """Is one of the keys with hashes in arrays ``as`` and ``bs`` listed, of those dealt to ``part``?"""
    held = rows.sparkSession.sparkContext.broadcast(levels)

    @F.arrow_udf("boolean")
    def test(first: pa.Array, second: pa.Array) -> pa.Array:
        a, b = (x.flatten().to_numpy().view(np.uint64) for x in (first, second))
        row = np.repeat(np.arange(len(first)), first.value_lengths().to_numpy())
        own = np.flatnonzero((a >> np.uint64(8)) % np.uint64(parts) == part) if parts > 1 else np.arange(len(a))
        out = np.zeros(len(first), bool)
        out[row[own[contains(held.value, a[own], b[own])]]] = True
        return pa.array(out)

    return test("as", "bs")


def judge(pages: DataFrame, rules: tuple[Rule, ...], listed: tuple[str, ...] | DataFrame, rate: float = 0.01, max_bytes: int = 64 << 20) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page; ``listed`` may be a table with a column ``key``."""
    spark = pages.sparkSession
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    names = listed if isinstance(listed, DataFrame) else spark.createDataFrame([(x,) for x in sorted(set(listed))], "key string")
    universe = rows.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("key"), F.lit(False).alias("listed"))
    keys = universe.unionByName(names.where("key IS NOT NULL").select("key", F.lit(True).alias("listed")))
    keys = written(keys.groupBy("key").agg(F.max("listed").alias("listed")).select(*hashes_of(F.col("key")), "listed"), "keys")
    n = {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
    # the first two levels and, smaller by the rate every two levels, the others
    size = sum(filter_bits(m, rate) for m in (n.get(True, 0), int(n.get(False, 0) * rate))) / 8 / (1 - rate)
    parts = max(1, math.ceil(size / max_bytes))

    fits = F.array_compact(
        F.array(
            *[
                F.when(((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path)), F.struct(F.lit(len(r.text)).alias("n"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")))
                for r in rules
            ]
        )
    )
    found = domains(F.col("host"))
    rows = rows.withColumn("best", F.array_max(fits.cast("array<struct<n:int,rule:string,verdict:string>>")))
    rows = rows.select("*", F.transform(found, lambda d: hashes_of(d)[0]).alias("as"), F.transform(found, lambda d: hashes_of(d)[1]).alias("bs"), F.lit(False).alias("own"))
    for part in range(parts):
        own = keys.where(F.shiftrightunsigned("a", 8) % parts == part) if parts > 1 else keys
        levels = build_cascade(own.where("listed").select("a", "b"), own.where("NOT listed").select("a", "b"), rate)
        rows = rows.withColumn("own", F.col("own") | any_listed(rows, levels, part, parts))
        rows = written(rows, "judged") if parts > 1 else rows
    return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.when(F.col("own"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
