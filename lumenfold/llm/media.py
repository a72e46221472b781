"""Media columns: WAV values, their spectra, and fingerprints of pairs of spectral peaks.

A text's bytes, padded by ``pad`` bytes of 255 up to a positive multiple, become the 8-bit samples
of a mono WAV written by the ``wave`` module: the media column. Reading goes through ``wave``
too. Features come from the samples that were read: a short-time Fourier transform with a Hann
window, the strongest bin of each band of each frame as a peak if it stands out of its band, and
pairs of a peak with all peaks of the next frames. The last frame is filled up by holding the last
sample, which is silence. A pair is coded as (first bin, second bin, distance
in frames); arrays hold the codes and the frames at which they start.

Each document is on its own, so nothing is shuffled; frames of a long one go through the transform
in blocks.

Defined results: null or empty text is ``pad`` bytes of 255, silence without a peak; a null
``doc_id`` is kept; rows that repeat give rows that repeat; equal texts have equal values; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = 512
HOP = 256
# fixed values: bands of bins in which a frame can have a peak
BANDS = (2, 16, 48, 112, 240)
REACH = 3  # frames in which a peak is paired
BLOCK = 1024  # frames at a time
_HANN = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def n_frames(n_samples: int) -> int:
    """Frames that hold all samples."""
    return 1 + -(-max(0, n_samples - FRAME) // HOP)


def peaks(samples: np.ndarray) -> np.ndarray:
    """The peak's bin for each frame and band; -1 where the band has none."""
    count = n_frames(len(samples))
    x = (samples.astype(np.float32) - 128.0) / 128.0
    x = np.r_[x, np.full(FRAME + (count - 1) * HOP - len(x), x[-1] if len(x) else 0, np.float32)]
    out = np.empty((count, len(BANDS) - 1), np.int16)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for at in range(0, count, BLOCK):
        spectrum = np.fft.rfft(frames[at : at + BLOCK] * _HANN, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        for k, (a, b) in enumerate(zip(BANDS, BANDS[1:], strict=False)):
            band = power[:, a:b]
            best = band.argmax(axis=1)
            height = band[np.arange(len(band)), best]
            out[at : at + BLOCK, k] = np.where(height > 3.0 * band.mean(axis=1) + 1e-3, best + a, -1)
        # a constant only leaks into the lowest band
        out[at : at + BLOCK][np.ptp(frames[at : at + BLOCK], axis=1) == 0] = -1
    return out


def fingerprints(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of peak pairs and the frames where they start, ordered by frame, distance and bands."""
    p = peaks(samples).astype(np.int32)
    codes, times = [], []
    for dt in range(1, min(REACH, len(p) - 1) + 1):
        for a in range(p.shape[1]):
            for b in range(p.shape[1]):
                first, second = p[:-dt, a], p[dt:, b]
                at = np.flatnonzero((first >= 0) & (second >= 0))
                codes.append((first[at] << 17) | (second[at] << 8) | dt)
                times.append(at.astype(np.int32))
    if not codes:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    c, t = np.concatenate(codes), np.concatenate(times)
    order = np.argsort(t, kind="stable")
    return c[order], t[order]


def _rows(b: pa.RecordBatch, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a few MB."""
    size = at = 0
    for i, n in enumerate(b.column(1).to_pylist() if pa.types.is_integer(b.column(1).type) else [0] * b.num_rows):
        size += n
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < b.num_rows:
        yield at, b.num_rows


def encode(docs: DataFrame, pad: int = 576) -> DataFrame:
    """``(doc_id, n_bytes, media)``: the media column of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in _rows(b):
                part, media = b.slice(lo, hi - lo), []
                for text in part.column("text").to_pylist():
                    raw = (text or "").encode()
                    media.append(to_wav(raw + b"\xff" * (-len(raw) % pad if raw else pad)))
                yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """What reading the media column gives: payload digests, peak pairs and their frames."""
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames int, codes array<int>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in _rows(b):
                part = b.slice(lo, hi - lo)
                rows = []
                for value in part.column("media"):
                    stored = value.as_buffer().to_pybytes()
                    payload = from_wav(stored)
                    c, t = fingerprints(np.frombuffer(payload, np.uint8))
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), n_frames(len(payload)), c, t))
                cols = list(zip(*rows, strict=True))
                lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in col])].astype(np.int32)), pa.array(np.concatenate(col))) for col in cols[6:]]
                plain = [pa.array(col, t) for col, t in zip(cols[:6], (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32()), strict=True)]
                yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), *plain, *lists], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "codes", "times"])

    return media.mapInArrow(run, kinds)
