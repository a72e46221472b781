"""Words of whole Arrow columns of text as 64-bit hashes, without a loop over words.

A word is a longest run of bytes other than space and tab to carriage return. Its hash is a
polynomial over byte values drawn once from a fixed seed, taken as a difference of running sums
and then mixed with the word's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _VALUES.copy()
_LOWER[65:91] = _VALUES[97:123]
_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 1 << 20:  # longer texts are rare; a worker keeps 8 MB a base at most
            _powers[base] = have
    return have[:n]


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives Arrow's unused memory back; workers wait for the next task with what they hold."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """``starts``/``ends``: byte places in ``data``; document i has words ``cuts[i]`` to ``cuts[i + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    cuts: np.ndarray


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a column of strings; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    parts = texts.buffers()
    offsets = np.frombuffer(parts[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(parts[2], np.uint8)[offsets[0] : offsets[-1]] if parts[2] is not None and len(texts) else np.empty(0, np.uint8)
    return offsets - (offsets[0] if len(offsets) else 0), data


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes, or one row that is longer."""
    offsets, _ = buffers(texts)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, to
        at = to


def words(texts: pa.Array, lower: bool = False, spaces: bytes | None = None) -> Words:
    """Runs of bytes between spaces, or between the bytes ``spaces``."""
    offsets, data = buffers(texts)
    if not len(data):
        none = np.empty(0, np.int64)
        return Words(data, none, none, none.astype(np.uint64), np.zeros(len(texts) + 1, np.int64))
    inside = ~_SPACE[data] if spaces is None else ~np.isin(np.arange(256), list(spaces))[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER if lower else _VALUES)[data] * powers(_P, len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_INVERSE, len(data))[starts]
    h = mix(h + (ends - starts).astype(np.uint64))
    return Words(data, starts, ends, h, np.searchsorted(starts, offsets))


def rolling(h: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hash of ``h[i : i + n]`` for every i for which it exists, in the order of its parts."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    sums = np.empty(len(h) + 1, np.uint64)
    sums[0] = 0
    base = (0xD6E8FEB86659FD93 + 2 * salt) & ((1 << 64) - 1) | 1
    np.cumsum(h * powers(base, len(h)), out=sums[1:])
    count = len(h) - n + 1
    return mix((sums[n:] - sums[:count]) * powers(pow(base, -1, 1 << 64), len(h))[:count] + np.uint64(n))
