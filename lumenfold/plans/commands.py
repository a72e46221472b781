"""The public commands over documents of rasters.

``pages`` is ``(doc_id long, page_index int, width int, height int, pixels binary)``; documents are
independent, so each command is a pass over pages and one aggregate by document.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import reports as R
from ..model import DPIS, PRESETS, Run
from ..operators import g4, kernels, pages, pdf
from ..sources.sinks import preview as png

PAGE = "doc_id long, page_index int, width int, height int, threshold int, pixel_count long, black_pixels long, min_gray int, max_gray int, mean_gray double, std_gray double, ccitt_bytes long, packed binary, error string, width_points double, height_points double, prepare_us long, binarize_us long"


def info() -> dict[str, object]:
    """What the engine offers."""
    return {"name": "lumenfold", "version": "0.1", "dpi": list(DPIS), "methods": ["otsu", "sauvola", "manual"], "presets": sorted(PRESETS)}


def inspect(rows: DataFrame) -> DataFrame:
    """``(doc_id, page_index, width_points, height_points, rotation)`` with pixels at each resolution."""
    sizes = {d: R.page_pixels(F.col("width_points"), F.col("height_points"), d) for d in DPIS}
    return rows.select("doc_id", "page_index", R.rotation(F.col("rotation")).alias("rotation"), *[v.alias(f"pixels_{d}") for d, v in sizes.items()])


def processed(rows: DataFrame, run: Run, encode: bool = True, keep: bool = False) -> DataFrame:
    """Every page through the run; a page that fails has an error and no measures."""
    run.validate()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in PAGE.split(", ")]
        for b in batches:
            out = []
            for p in b.to_pylist():
                head, points = (p["doc_id"], p["page_index"], p["width"], p["height"]), (p["width_points"], p["height_points"])
                try:
                    begin = time.perf_counter_ns()
                    gray = np.frombuffer(p["pixels"], np.uint8).reshape(p["height"], p["width"])
                    ready = pages.prepared(gray, run)
                    between = time.perf_counter_ns()
                    mask, t = pages.masked(ready, run)
                    spent = ((between - begin) // 1000, (time.perf_counter_ns() - between) // 1000)
                    mean = float(ready.sum(dtype=np.int64)) / ready.size
                    std = float(np.sqrt(max(float((ready.astype(np.int64) ** 2).sum()) / ready.size - mean * mean, 0.0)))
                    out.append((*head, t, mask.size, int(mask.sum()), int(ready.min()), int(ready.max()), mean, std, len(g4.encode(mask)) if encode else None, kernels.pack_bits(mask) if keep else None, None, *points, *spent))
                except (ValueError, TypeError) as e:  # a bad page is counted; the others go on
                    out.append((*head, *[None] * 9, str(e), *points, None, None))
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return rows.select("doc_id", "page_index", "width", "height", "pixels", *_points(rows)).mapInArrow(work, PAGE)


def _points(rows: DataFrame) -> list[Column]:
    """Size in points of the upright page, of ``width_points``, ``height_points`` and ``rotation`` where given."""
    if not {"width_points", "height_points"} <= set(rows.columns):
        return [F.lit(None).cast("double").alias(k) for k in ("width_points", "height_points")]
    turned = F.coalesce(R.rotation(F.col("rotation")) % 180 == 90, F.lit(False)) if "rotation" in rows.columns else F.lit(False)
    w, h = F.col("width_points").cast("double"), F.col("height_points").cast("double")
    return [F.when(turned, h).otherwise(w).alias("width_points"), F.when(turned, w).otherwise(h).alias("height_points")]


def analyze(rows: DataFrame, run: Run, selection: str = "all", page_limit: int = 1_000_000) -> DataFrame:
    """Totals by document over the selected pages."""
    if selection.strip().lower() != "all":
        rows = rows.where(F.col("page_index").isin(R.parse_selection(selection, page_limit)))
    done = processed(rows, run)
    return done.groupBy("doc_id").agg(
        F.count(F.when(F.col("error").isNull(), 1)).alias("pages_analyzed"),
        F.count("error").alias("pages_failed"),
        F.sum("pixel_count").alias("total_pixels"),
        F.sum("black_pixels").alias("total_black_pixels"),
        F.sum("ccitt_bytes").alias("total_ccitt_bytes"),
        F.max_by("page_index", F.struct("ccitt_bytes", "page_index")).alias("largest_page"),
    )


def estimate(rows: DataFrame, run: Run, samples: int | None = None) -> DataFrame:
    """Output size of each document from a few evenly spaced pages; only those are processed."""
    n = R.resolve_sample_count(samples)
    sizes = rows.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("pages"), F.sum(F.col("width").cast("long") * F.col("height")).alias("pixels"))
    order = rows.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index")) - 1)
    chosen = order.join(sizes.select("doc_id", "pages"), "doc_id").where(F.array_contains(R.sample_indices(F.col("pages"), n), F.col("at")))
    sampled = processed(chosen, run).where("error IS NULL").withColumn("bpp", F.col("ccitt_bytes") / F.col("pixel_count"))
    stats = sampled.groupBy("doc_id").agg(F.count(F.lit(1)).alias("samples"), F.avg("bpp").alias("mean"), F.min("bpp").alias("least"), F.max("bpp").alias("most"), F.percentile("bpp", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    fixed, each = pdf.container_overhead()
    few = F.col("samples") < 4
    size = lambda bpp: F.floor(F.col("pixels") * bpp).cast("long") + fixed + each * F.col("pages")
    low, high = F.when(few, F.col("least")).otherwise(F.get("q", 0)), F.when(few, F.col("most")).otherwise(F.get("q", 1))
    out = sizes.join(stats, "doc_id").withColumns({"central": size(F.col("mean")), "lo": size(low), "hi": size(high)})
    return out.select("doc_id", "pages", "samples", F.when(few, "min_max").otherwise("quartiles").alias("range_method"), F.col("central").alias("estimated_output_bytes"), F.least("lo", "central").alias("estimated_lower_bytes"), F.greatest("hi", "central").alias("estimated_upper_bytes"), F.lit(run.fingerprint()).alias("settings_fingerprint"))


def process(rows: DataFrame, run: Run) -> DataFrame:
    """One checked PDF a document, with its totals and stage timings; a page that fails stops the query."""
    done = processed(rows, run, encode=False, keep=True)
    sound = done.withColumn("packed", F.when(F.col("error").isNull(), F.col("packed")).otherwise(F.raise_error(F.col("error")).cast("binary")))
    return pdf.documents(sound, run.dpi)


def process_report(documents: DataFrame, run: Run, inputs: DataFrame | None = None, estimates: DataFrame | None = None) -> DataFrame:
    """What processing made of each document.

    ``inputs`` is ``(doc_id, input_bytes)`` and gives what was saved; ``estimates``, of `estimate`, how
    far the estimate was from the result.
    """
    out = documents.drop("pdf").withColumn("fingerprint", F.lit(run.validate().fingerprint()))
    out = out.withColumns({"bytes_per_page": F.col("output_bytes") / F.col("pages"), "black_ratio": R.ratio(F.col("black_pixels").cast("double"), F.col("total_pixels"))})
    if inputs is not None:
        saved = R.reduction(F.col("input_bytes"), F.col("output_bytes"))
        out = out.join(inputs.select("doc_id", "input_bytes"), "doc_id", "left").withColumns(saved | {"reduction_percent": 100.0 * saved["size_reduction_fraction"]})
    if estimates is not None:
        gap = R.estimate_error(F.col("estimated_output_bytes"), F.col("output_bytes"))
        out = out.join(estimates.select("doc_id", "estimated_output_bytes"), "doc_id", "left").withColumns(gap)
    return out


def preview(rows: DataFrame, run: Run, doc_id: int, page_index: int) -> bytes:
    """One binarized page as a PNG."""
    page = processed(rows.where((F.col("doc_id") == doc_id) & (F.col("page_index") == page_index)), run, encode=False, keep=True).first()
    return png(kernels.unpack_bits(page["packed"], page["width"], page["height"]))
