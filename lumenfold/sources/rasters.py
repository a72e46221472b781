"""Page rasters: ``(page_id, category, width, height, pixels BINARY)``, one gray page a row.

Rasters come from images (Spark's ``image`` and ``binaryFile`` sources), from texts (each
character a pixel) or from vectors. Pages that a renderer makes fit the same schema.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import MAX_EDGE, MAX_PIXELS, InputError, ResourceLimit, UnsupportedInput

RASTER = "page_id long, category string, width int, height int, pixels binary"


def from_texts(rows: DataFrame, width: int = 64) -> DataFrame:
    """``(page_id, category, text)`` as pages: code point modulo 256, row by row; white fills the last row.

    Texts that are null or empty have no page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kinds, heights, pixels = [], [], [], []
            for page, kind, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if text:
                    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint8)
                    height = -(-len(points) // width)
                    body = np.full(width * height, 255, np.uint8)
                    body[: len(points)] = points
                    ids.append(page)
                    kinds.append(kind)
                    heights.append(height)
                    pixels.append(body.tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array([width] * len(ids), pa.int32()), pa.array(heights, pa.int32()), pa.array(pixels, pa.binary())], ["page_id", "category", "width", "height", "pixels"])

    return rows.select("page_id", "category", "text").mapInArrow(run, RASTER)


def luma(bands: list[np.ndarray]) -> np.ndarray:
    """Gray of red, green and blue by the integer form of the usual video weights (2126, 7152, 722)."""
    r, g, b = (x.astype(np.int64) for x in bands)
    return ((2126 * r + 7152 * g + 722 * b) // 10_000).astype(np.uint8)


def from_images(spark: SparkSession, path: str) -> DataFrame:
    """Gray pages of the images under ``path``, with ``origin`` instead of an id."""
    images = spark.read.format("image").load(path).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.to_pylist():
                data = np.frombuffer(x["data"], np.uint8).reshape(x["height"], x["width"], x["nChannels"])
                gray = data[:, :, 0] if x["nChannels"] == 1 else luma([data[:, :, 2], data[:, :, 1], data[:, :, 0]])
                rows.append((x["origin"], x["width"], x["height"], gray.tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["origin", "width", "height", "pixels"])

    return images.select("origin", "width", "height", "nChannels", "data").mapInArrow(run, "origin string, width int, height int, pixels binary")


def png_bytes(page: np.ndarray) -> bytes:
    """An 8-bit gray PNG."""
    h, w = page.shape
    raw = np.zeros((h, w + 1), np.uint8)
    raw[:, 1:] = page

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 9)) + chunk(b"IEND", b"")


# fixed values: samples a pixel by the colour type of a PNG
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of a PNG without their filters; ``step`` bytes are a pixel."""
    out = np.zeros((len(raw), raw.shape[1] - 1), np.uint8)
    for y, (kind, line) in enumerate(zip(raw[:, 0].tolist(), raw[:, 1:], strict=True)):
        above = out[y - 1] if y else np.zeros(out.shape[1], np.uint8)
        if kind == 0:
            out[y] = line
        elif kind == 1:
            for c in range(step):
                out[y, c::step] = np.cumsum(line[c::step], dtype=np.uint8)
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            own, up = line.tolist(), above.tolist()
            for x, value in enumerate(own):
                left, upleft = (own[x - step], up[x - step]) if x >= step else (0, 0)
                if kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    best = left + up[x] - upleft
                    guess = min((abs(best - left), 0, left), (abs(best - up[x]), 1, up[x]), (abs(best - upleft), 2, upleft))[2]
                own[x] = (value + guess) % 256
            out[y] = own
        else:
            raise InputError("unknown filter in a PNG")
    return out


def png_samples(data: bytes) -> tuple[tuple[int, int, int, int], np.ndarray, bytes, bool]:
    """``(width, height, depth, colour type)``, samples (height, width, channels), palette, and whether alpha is given.

    Limits are checked before anything is decompressed.
    """
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise InputError("not a PNG")
    at, body, head, extra = 8, [], None, {}
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
            if max(head[:2]) > MAX_EDGE or head[0] * head[1] > MAX_PIXELS:
                raise ResourceLimit("a page has too many pixels", width=head[0], height=head[1])
        elif kind == b"IDAT":
            body.append(part)
        elif kind in (b"PLTE", b"tRNS"):
            extra[kind] = part
        at += 12 + n
    if head is None or head[3] not in CHANNELS or not head[0] or not head[1]:
        raise InputError("the PNG has no valid header")
    w, h, depth, colour, _, _, interlaced = head
    if interlaced:
        raise UnsupportedInput("interlaced PNGs aren't read")
    n = CHANNELS[colour]
    width = -(-w * n * depth // 8)
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)[: h * (width + 1)].reshape(h, width + 1)
    except (zlib.error, ValueError) as e:
        raise InputError("the PNG is damaged", reason=e) from e
    rows = _unfiltered(raw, max(1, n * depth // 8))
    if depth == 16:
        samples = rows.view(">u2").astype(np.uint16)
    elif depth == 8:
        samples = rows
    else:
        bits = np.unpackbits(rows, axis=1)[:, : w * n * depth].reshape(h, -1, depth)
        samples = (bits * (1 << np.arange(depth)[::-1]).astype(np.uint8)).sum(2, dtype=np.uint8)
    return (w, h, depth, colour), samples.reshape(h, w, n), extra.get(b"PLTE", b""), colour in (4, 6) or b"tRNS" in extra


def decode_png(data: bytes) -> np.ndarray:
    """Gray pixels of a PNG of any colour type and depth; alpha is dropped."""
    (_, _, depth, colour), samples, palette, _ = png_samples(data)
    if colour == 3:
        table = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        if samples.max(initial=0) >= len(table):
            raise InputError("the PNG's palette is too short")
        return luma([table[samples[:, :, 0], c] for c in range(3)])
    if depth == 16:
        samples = ((samples.astype(np.uint32) + 128) // 257).astype(np.uint8)
    elif depth < 8:
        samples = samples * np.uint8(255 // ((1 << depth) - 1))
    return luma([samples[:, :, c] for c in range(3)]) if colour in (2, 6) else samples[:, :, 0].copy()


def gray_png(data: bytes) -> np.ndarray:
    """The pixels of a PNG that is 8-bit gray without alpha."""
    (_, _, depth, colour), samples, _, alpha = png_samples(data)
    if (depth, colour) != (8, 0) or alpha:
        raise InputError("ground truth must be an opaque 8-bit gray PNG")
    return samples[:, :, 0].copy()


def decoded(files: DataFrame, column: str, truth: str | None = None) -> DataFrame:
    """``files`` with PNGs in ``content`` decoded: ``width``, ``height`` and ``column``.

    With ``truth``, a polarity, pixels are a mask of bytes 0 and 1.
    """
    others = [c for c in files.columns if c != "content"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a page at a time
                data = b.column("content")[i].as_buffer().to_pybytes()
                page = decode_png(data) if truth is None else truth_mask(gray_png(data), truth).astype(np.uint8)
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in others), pa.array([page.shape[1]], pa.int32()), pa.array([page.shape[0]], pa.int32()), pa.array([page.tobytes()], pa.binary())], [*others, "width", "height", column])

    return files.select(*others, "content").mapInArrow(run, f"{schema}, width int, height int, {column} binary")


def truth_mask(page: np.ndarray, polarity: str = "black_is_zero") -> np.ndarray:
    """Ground truth from pixels that are 0 or 255 only."""
    if polarity not in ("black_is_zero", "black_is_255", "black_is255"):
        raise InputError(f"unknown polarity {polarity}")
    if not np.isin(page, (0, 255)).all():
        raise InputError("ground truth may hold 0 and 255 only")
    return page == (0 if polarity == "black_is_zero" else 255)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and SHA-256 of every file under ``path``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
