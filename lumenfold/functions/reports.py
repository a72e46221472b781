"""Column rules of geometry, metrics and reports, as Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import DPIS, MAX_RENDERED_PIXELS, InvalidParameter


def points_to_pixels(points: Column, dpi: int) -> Column:
    """Rounded half away from zero, at least 1."""
    return F.greatest(F.lit(1), F.round(points.cast("double") / 72.0 * dpi).cast("int"))


def page_pixels(width: Column, height: Column, dpi: int) -> Column:
    """``(width_px, height_px)``; null where the page is out of range at this resolution."""
    w, h = points_to_pixels(width, dpi), points_to_pixels(height, dpi)
    ok = (width > 0) & (height > 0) & (w.cast("long") * h <= MAX_RENDERED_PIXELS)
    return F.when(ok, F.struct(w.alias("width_px"), h.alias("height_px")))


def rotation(degrees: Column) -> Column:
    """0, 90, 180 or 270; null for other angles."""
    d = F.pmod(degrees, F.lit(360))
    return F.when(d.isin(0, 90, 180, 270), d)


def sanitized(text: Column) -> Column:
    """Without control characters, trimmed, at most 512 characters; null if nothing is left."""
    clean = F.substring(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1F\x7F-\x9F]", ""), r"^\s+|\s+$", ""), 1, 512)
    return F.when(clean != "", clean)


def same_source(a: Column, b: Column) -> Column:
    """Identities ``(path, length, sha256)`` are of one content: lengths are equal, then hashes, or paths where a hash wasn't taken.

    False where what decides is null.
    """
    hashed = a["sha256"].isNotNull() & b["sha256"].isNotNull()
    named = F.when(hashed, a["sha256"] == b["sha256"]).otherwise(a["path"] == b["path"])
    return F.coalesce((a["length"] == b["length"]) & named, F.lit(False))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def display_path(path: str, mode: str, base: str | None = None) -> str | None:
    """A path as a report shows it: ``basename``, ``relative`` to a base, ``absolute`` or ``omit``."""
    if mode == "omit":
        return None
    name = path.rsplit("/", 1)[-1]
    if mode == "relative" and base and path.startswith(base.rstrip("/") + "/"):
        return path[len(base.rstrip("/")) + 1 :]
    return path if mode == "absolute" else name


def ratio(part: Column, whole: Column, none: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(none))


def f_measure(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1; never NaN. Without ink on either side all are 1."""
    none = (tp + fp + fn) == 0
    precision = F.when(none, 1.0).otherwise(ratio(tp.cast("double"), tp + fp))
    recall = F.when((tp + fn) == 0, 1.0).otherwise(ratio(tp.cast("double"), tp + fn))
    f1 = F.when(precision + recall > 0, 2.0 * precision * recall / (precision + recall)).otherwise(0.0)
    return {"precision": precision, "recall": recall, "f1": f1}


def psnr(fp: Column, fn: Column, pixels: Column) -> Column:
    """In decibels; null for a perfect match."""
    return F.when(fp + fn > 0, 10.0 * F.log10(pixels / (fp + fn)))


# reciprocal distances of the five classes of neighbours, and how many each has
_CLASSES = ((1, 4), (2, 4), (4, 4), (5, 8), (8, 4))
_NORM = sum(n * d**-0.5 for d, n in _CLASSES)


def drd(classes: list[Column], blocks: Column) -> Column:
    """Distance-reciprocal distortion from counts by class; not divided where no block is mixed."""
    total = sum((c * (d**-0.5 / _NORM) for c, (d, _) in zip(classes[1:], _CLASSES[1:], strict=True)), classes[0] * (1 / _NORM))
    return total / F.greatest(blocks, F.lit(1))


def reduction(before: Column, after: Column) -> dict[str, Column]:
    """Saved bytes stop at 0; the fraction may be negative, and is null without a size before."""
    return {"absolute_bytes_saved": F.greatest(F.lit(0).cast("long"), before - after), "size_reduction_fraction": F.when(before > 0, 1.0 - after / before)}


def estimate_error(estimated: Column, actual: Column) -> dict[str, Column]:
    gap = F.abs(estimated - actual)
    return {"absolute_error_bytes": gap, "relative_error_fraction": F.when(actual == 0, 0.0).otherwise(gap / actual)}


def outliers(value: dict[str, Column], median: dict[str, Column]) -> Column:
    """Flags of a page against its document's medians, in a fixed order."""
    tests = [
        ("large_output", (median["bytes"] > 0) & (value["bytes"] > 2.0 * median["bytes"])),
        ("slow_processing", (median["us"] > 0) & (value["us"] > 2.0 * median["us"])),
        ("high_ink_ratio", value["ink"] > median["ink"] + 0.15),
        ("low_ink_ratio", value["ink"] < median["ink"] - 0.15),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))


def human_bytes(n: Column) -> Column:
    """Bytes, KB or MB to one place."""
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1_000_000, F.format_string("%.1f KB", n / 1000.0)).otherwise(F.format_string("%.1f MB", n / 1e6))


def parse_selection(text: str, page_count: int) -> list[int]:
    """0-based page indices of ``all``, ``3``, ``1-5`` or ``1,3,8-12``, sorted, once each."""
    text = text.strip()
    if text.lower() == "all":
        return list(range(page_count))
    terms = text.split(",")
    if len(terms) > 10_000:
        raise InvalidParameter("a selection may have 10,000 terms")
    found: set[int] = set()
    for term in terms:
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", term)
        if not m:
            raise InvalidParameter(f"not a page or a range: {term!r}")
        a, b = int(m[1]), int(m[2] or m[1])
        if a < 1 or b < a or b > page_count or b - a >= 1_000_000:
            raise InvalidParameter(f"pages must lie within 1 and {page_count}: {term!r}")
        found.update(range(a - 1, b))
    return sorted(found)


def selected(page_index: Column, text: Column) -> Column:
    """Is a 0-based index in the selection of a row? For selections that differ by row."""
    terms = F.transform(F.split(text, ","), lambda t: F.split(F.trim(t), r"\s*-\s*"))
    number = page_index + 1
    within = F.exists(terms, lambda t: (number >= F.get(t, 0).try_cast("int")) & (number <= F.coalesce(F.get(t, 1), F.get(t, 0)).try_cast("int")))
    return F.when(F.lower(F.trim(text)) == "all", True).otherwise(F.coalesce(within, F.lit(False)))


def sample_indices(pages: Column, samples: int) -> Column:
    """Evenly spaced 0-based indices: first and last page included, each once; all if there are few."""
    samples = resolve_sample_count(samples)
    if samples == 1:
        return F.when(pages > 0, F.array(F.lit(0)))
    d = samples - 1
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(d)), lambda i: F.floor((i * (pages - 1) + d // 2) / d).cast("int")))
    return F.when(pages <= 0, F.expr("array()")).when(pages <= samples, F.sequence(F.lit(0), pages.cast("int") - 1)).otherwise(spread)


def resolve_sample_count(n: int | None) -> int:
    """Default 8; 1 to 32."""
    return 8 if n is None else min(max(n, 1), 32)


def check_dpi(dpi: int) -> int:
    if dpi not in DPIS:
        raise InvalidParameter(f"dpi must be one of {DPIS}", dpi=dpi)
    return dpi
