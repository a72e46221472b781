"""Byte-level BPE ids of whole texts, with a cache of space-delimited chunks.

A byte-level pre-tokenizer never joins a white-space character to the non-space characters before
it, so a text may be cut before any white space that follows a non-space, and the parts encoded
alone give the same ids; nor does it join an ASCII letter to a sign other than the apostrophe. A
chunk starts at a run of ASCII white space, or at a sign after a letter, and ends before the next.
Most chunks repeat, so each worker encodes a chunk once, keeps its ids in a flat array under two
64-bit hashes of its bytes, and gathers the ids of whole texts from there. All of it works on
arrays over about a megabyte of text at a time. Texts with other white space, and texts that hold an
added token of the tokenizer (which is matched before any pre-tokenizer), are encoded in one piece.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._words import _SPACE, _VALUES, buffers, mix, powers, slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_OTHER = np.random.Generator(np.random.PCG64(20250607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0xE7037ED1A0B428DB
_INVERSE = pow(_BASE, -1, 1 << 64)
ROW = 200  # chunks encoded in one call's text
_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_SIGN[list(b'!"#$%&()*+,-./:;<=>?@[]^_`{|}~')] = True


def odd_spaces(data: np.ndarray) -> np.ndarray:
    """Places of white space outside ASCII, in UTF-8."""
    padded = np.r_[data, np.zeros(2, np.uint8)]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    a, b, c = padded[lead], padded[lead + 1], padded[lead + 2]
    general = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    found = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | general | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return lead[found]


class ChunkEncoder:
    """``add_special_tokens=False`` ids of texts; ``cap`` bounds the chunks that a worker keeps."""

    def __init__(self, path: str, cap: int = 2_000_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # one character of a vocabulary entry is one byte
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.cap = cap
        self._reset()

    def _reset(self) -> None:
        self.keys = np.empty(0, np.uint64)  # sorted first hashes; second hashes and places in `ends` beside them
        self.checks = np.empty(0, np.uint64)
        self.places = np.empty(0, np.int32)
        self.flat = np.empty(1 << 16, np.int32)
        self.ends = np.zeros(1 << 14, np.int32)  # ends[i + 1]: end of chunk i in flat
        self.n = 0

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """int32 ids of each text, in order."""
        return self.encode_column(pa.array(texts, pa.string()))

    def encode_column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for lo, hi in slices(texts):
            if len(self.keys) > self.cap:
                self._reset()
            yield from self._slice(texts.slice(lo, hi - lo))

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        offsets, data = buffers(texts)
        if not len(data):
            yield from (self.flat[:0] for _ in range(len(texts)))
            return
        whole = np.zeros(len(texts), bool)  # texts that are encoded in one piece
        whole[np.searchsorted(offsets, odd_spaces(data), side="right") - 1] = True
        for token in self.added:
            whole |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        space = _SPACE[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[1:] |= _SIGN[data[1:]] & _LETTER[data[:-1]]
        begin |= first[:-1]
        starts = np.flatnonzero(begin)
        ends = np.r_[starts[1:], len(data)]
        if whole.any():
            cut = ~np.repeat(whole, np.diff(offsets))[starts]
            starts, ends = starts[cut], ends[cut]
        at = self._places(data, space, starts, ends)
        lens = self.ends[at + 1] - self.ends[at]
        # the ids of all chunks behind each other
        cuts = np.r_[0, np.cumsum(lens, dtype=np.int64)]
        ids = self.flat[np.repeat(self.ends[at] - cuts[:-1], lens) + np.arange(cuts[-1])]
        docs = cuts[np.searchsorted(starts, offsets)]
        for i, (a, b) in enumerate(zip(docs[:-1].tolist(), docs[1:].tolist(), strict=True)):
            if whole[i]:
                yield np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.int32)
            else:
                yield ids[a:b]

    def _places(self, data: np.ndarray, space: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of chunks in the cache; unknown ones are encoded first."""
        power, size = powers(_BASE, len(data)), (ends - starts).astype(np.uint64)
        back = powers(_INVERSE, len(data))[starts]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * power, out=sums[1:])
        h = mix((sums[ends] - sums[starts]) * back + size)
        np.cumsum(_OTHER[data] * power, out=sums[1:])
        check = (sums[ends] - sums[starts]) * back
        keys, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        checks = check[where]
        k = np.searchsorted(self.keys, keys)
        known = k < len(self.keys)
        known[known] = self.keys[k[known]] == keys[known]
        if (self.checks[k[known]] != checks[known]).any() or (checks[inverse] != check).any():
            raise RuntimeError("two chunks have one 64-bit hash")
        out = np.empty(len(keys), np.int32)
        out[known] = self.places[k[known]]
        new = np.flatnonzero(~known)
        if len(new):
            a, b = starts[where[new]], ends[where[new]]
            joinable = space[a] & ~space[b - 1]
            new = np.r_[new[joinable], new[~joinable]]
            a, b = np.r_[a[joinable], a[~joinable]], np.r_[b[joinable], b[~joinable]]
            out[new] = self.n + np.arange(len(new), dtype=np.int32)
            self._append(data, a, b, int(joinable.sum()))
            order = np.sort(new)
            self.keys = np.insert(self.keys, k[order], keys[order])
            self.checks = np.insert(self.checks, k[order], checks[order])
            self.places = np.insert(self.places, k[order], out[order])
        return out[inverse]

    def _append(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, joinable: int) -> None:
        """Encode chunks; the first ``joinable`` of them in rows, which the tokens' lengths part again."""
        size = ends - starts
        raw = ragged(data, starts, ends).tobytes()
        cuts = np.r_[0, np.cumsum(size)]
        marks = [*range(0, joinable, ROW), *range(joinable, len(size) + 1)]
        rows = [raw[cuts[a] : cuts[b]].decode() for a, b in zip(marks, marks[1:], strict=False)]
        found = [e.ids for i in range(0, len(rows), 1000) for e in self.tokenizer.encode_batch_fast(rows[i : i + 1000], add_special_tokens=False)]
        ids = np.fromiter((x for part in found for x in part), np.int32, sum(map(len, found)))
        # every chunk ends where a token ends
        stops = np.searchsorted(np.cumsum(self.n_bytes[ids]), cuts[1:]) + 1
        at = int(self.ends[self.n])
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(size) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[at : at + len(ids)] = ids
        self.ends[self.n + 1 : self.n + 1 + len(size)] = at + stops
        self.n += len(size)


def ragged(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """flat[starts[0]:ends[0]], flat[starts[1]:ends[1]], ... in one array."""
    lens = ends - starts
    total = int(lens.sum())
    if not total:
        return flat[:0]
    before = np.cumsum(lens) - lens
    return flat[np.repeat(starts - before, lens) + np.arange(total)]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of this file; its cache lasts from task to task."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def encoded(texts: pa.Array, path: str, end_id: int | None) -> Iterator[np.ndarray]:
    """Ids of an Arrow column of texts (null: empty), each followed by ``end_id``."""
    for ids in encoder(path).encode_column(texts):
        yield ids if end_id is None else np.append(ids, np.int32(end_id))
