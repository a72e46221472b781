"""Deterministic PDF files of Group 4 pages, and structural checks of their bytes.

A file holds a catalog, a page tree, and for each page a page object, a content stream that draws
the image over the whole page, and the image. Nothing in it depends on time or place.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..model import OutputError
from . import g4


def _number(x: float) -> str:
    return f"{x:.4f}".rstrip("0").rstrip(".")


def _stream(entries: str, body: bytes) -> bytes:
    return f"<<{entries} /Length {len(body)}>>\nstream\n".encode() + body + b"\nendstream"


def build(pages: list[tuple[int, int, float, float, bytes]]) -> bytes:
    """``(width, height, width in points, height in points, coded image)`` of each page, in order."""
    if not pages:
        raise OutputError("a document needs a page")
    objects = [b"<</Type /Catalog /Pages 2 0 R>>", b"<</Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (3 + 3 * i) for i in range(len(pages))) + b"] /Count %d>>" % len(pages)]
    for i, (w, h, wp, hp, data) in enumerate(pages):
        first = 3 + 3 * i
        objects.append(f"<</Type /Page /Parent 2 0 R /MediaBox [0 0 {_number(wp)} {_number(hp)}] /Resources <</XObject <</Im0 {first + 2} 0 R>>>> /Contents {first + 1} 0 R>>".encode())
        objects.append(_stream("", f"q {_number(wp)} 0 0 {_number(hp)} 0 0 cm /Im0 Do Q".encode()))
        image = f"/Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /DeviceGray /BitsPerComponent 1 /Decode [1 0] /Filter /CCITTFaxDecode /DecodeParms <</K -1 /Columns {w} /Rows {h} /BlackIs1 true>>"
        objects.append(_stream(image, data))
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer\n<</Size %d /Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, at)
    return bytes(out)


def structure(data: bytes) -> dict[str, object]:
    """What a bilevel file must hold, what it must not, its pages and their sizes in points."""
    boxes = re.findall(rb"/MediaBox \[0 0 ([0-9.]+) ([0-9.]+)\]", data)
    has = [m in data for m in (b"/CCITTFaxDecode", b"/BitsPerComponent 1", b"/K -1")]
    return {
        "bilevel": all(has) and not any(m in data for m in (b"/DCTDecode", b"/JBIG2Decode", b"/JPXDecode")),
        "pages": len(re.findall(rb"/Type /Page\b", data)),
        "rotated": b"/Rotate" in data,
        "sizes": [(float(a), float(b)) for a, b in boxes],
    }


def check(data: bytes, expected: list[tuple[float, float]], tolerance: float = 0.1) -> None:
    """Raise unless the file is bilevel, unrotated and has pages of these sizes."""
    found = structure(data)
    if not found["bilevel"] or found["rotated"]:
        raise OutputError("not a bilevel Group 4 document")
    if found["pages"] != len(expected) or any(abs(a - c) > tolerance or abs(b - d) > tolerance for (a, b), (c, d) in zip(found["sizes"], expected, strict=False)):
        raise OutputError("pages differ from what was expected", pages=found["pages"], expected=len(expected))


@lru_cache(None)
def container_overhead() -> tuple[int, int]:
    """Bytes of a document and of each page besides images, from documents of one and two pages."""
    page = (8, 8, 72.0, 72.0, g4.encode(np.zeros((8, 8), bool)))
    one, two = len(build([page])), len(build([page, page]))
    each = two - one - len(page[4])
    return one - len(page[4]) - each, each


STAGES = ("prepare_us", "binarize_us", "encode_us")
DOCUMENT = "doc_id long, pages int, pdf binary, output_bytes long, total_pixels long, black_pixels long, coded_bytes long, largest_page int, slowest_page int, " + ", ".join(f"{k} long" for k in STAGES) + ", median_page_us double"


def documents(masks: DataFrame, dpi: int = 300) -> DataFrame:
    """One PDF for each ``doc_id`` of ``(doc_id, page_index, width, height, packed)`` in page order, and its totals.

    Page sizes are ``width_points`` and ``height_points`` where given, else the pixels at ``dpi``. Stage
    timings of pages (``prepare_us``, ``binarize_us``) are summed where given; coding is timed here.
    """
    from .kernels import unpack_bits

    columns = [c for c in ("doc_id", "page_index", "width", "height", "packed", "width_points", "height_points", "black_pixels", *STAGES[:2]) if c in masks.columns]

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["page_index"])
        pages, spent, coded = [], [], []
        for r in rows:
            begin = time.perf_counter_ns()
            data = g4.encode(unpack_bits(r["packed"], r["width"], r["height"]))
            spent.append([r.get(k) or 0 for k in STAGES[:2]] + [(time.perf_counter_ns() - begin) // 1000])
            size = [r.get(k + "_points") or r[k] * 72 / dpi for k in ("width", "height")]
            pages.append((r["width"], r["height"], *size, data))
            coded.append((len(data), r["page_index"]))
        data = build(pages)
        check(data, [p[2:4] for p in pages])
        total = [sum(x) for x in spent]
        slowest = max(zip(total, [r["page_index"] for r in rows], strict=True))[1]
        stages = [sum(x[k] for x in spent) for k in range(3)]
        row = (rows[0]["doc_id"], len(rows), data, len(data), sum(p[0] * p[1] for p in pages), sum(r.get("black_pixels") or 0 for r in rows), sum(n for n, _ in coded), max(coded)[1], slowest, *stages, float(np.median(total)))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table({f.split()[0]: pa.array([v], k) for f, v, k in zip(DOCUMENT.split(", "), row, kinds, strict=True)})

    return masks.select(*columns).groupBy("doc_id").applyInArrow(run, DOCUMENT)


def structures(pdfs: DataFrame) -> DataFrame:
    """``(doc_id, pages, bilevel, pdf_bytes)`` of a column of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(structure(x.as_py()), len(x.as_py())) for x in b.column("pdf")]
            yield pa.record_batch([b.column("doc_id"), pa.array([s["pages"] for s, _ in found], pa.int32()), pa.array([s["bilevel"] for s, _ in found], pa.bool_()), pa.array([n for _, n in found], pa.int64())], ["doc_id", "pages", "bilevel", "pdf_bytes"])

    return pdfs.select("doc_id", "pdf").mapInArrow(run, "doc_id long, pages int, bilevel boolean, pdf_bytes long")
