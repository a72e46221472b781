"""Pages through runs: one Arrow pass over packed rasters, and relations over its rows.

A page never leaves its row, so thresholds, windows and codecs need no shuffle; what is shuffled
is one short row for each page and run. Global thresholds need the histogram only, and are
relational from there on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import reports as R
from ..model import Run
from . import g4, kernels

ROI = "array<struct<roi_id:string,x:int,y:int,width:int,height:int,tag:string>>"
MEASURED = (
    "run_id string, pos int, page_id long, category string, width int, height int, threshold int, black long, out_sum long, "
    "tp long, fp long, fn long, tn long, d1 long, d2 long, d4 long, d5 long, d8 long, blocks long, encoded_bytes long, "
    "rois array<struct<roi_id:string,tag:string,tp:bigint,fp:bigint,fn:bigint,tn:bigint,d1:bigint,d2:bigint,d4:bigint,d5:bigint,d8:bigint,blocks:bigint>>"
)


def prepared(page: np.ndarray, run: Run) -> np.ndarray:
    """Contrast, then background, then median."""
    page = kernels.contrast(page, run.contrast)
    if run.background_normalization:
        page = kernels.flatten_background(page, run.background_radius)
    return kernels.median3(page) if run.median_denoise else page


def binarized(page: np.ndarray, run: Run) -> tuple[np.ndarray, int | None]:
    """The mask and, for global methods, the threshold."""
    return masked(prepared(page, run), run)


def masked(page: np.ndarray, run: Run) -> tuple[np.ndarray, int | None]:
    """As `binarized`, of a page that is prepared."""
    if run.method == "sauvola":
        mask, t = kernels.sauvola(page, run.window_size, run.k, run.dynamic_range), None
    else:
        t = run.threshold if run.method == "manual" else kernels.otsu(kernels.histogram(page))
        mask = page <= t
    return kernels.despeckle(mask, run.speckle_pixels), t


def _scores(out: np.ndarray, truth: np.ndarray) -> tuple[int, ...]:
    return (*kernels.confusion(out, truth), *kernels.drd_counts(out, truth), kernels.nonuniform_blocks(truth))


def measure(rasters: DataFrame, runs: tuple[Run, ...], truth: Run | None = None, encode: bool = False) -> DataFrame:
    """One row for each run and page.

    Truth is the column ``truth`` (bytes 0 and 1) where ``rasters`` has it, else the mask of the run
    ``truth``. A column ``rois`` gives regions; each is scored as a page of its own.
    """
    for r in runs:
        r.validate()
    columns = [c for c in ("page_id", "category", "width", "height", "pixels", "truth", "rois") if c in rasters.columns]
    schema = _arrow(MEASURED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p in b.to_pylist():
                page = np.frombuffer(p["pixels"], np.uint8).reshape(p["height"], p["width"])
                own = np.frombuffer(p["truth"], np.uint8).reshape(page.shape).astype(bool) if p.get("truth") is not None else binarized(page, truth)[0] if truth else None
                for pos, r in enumerate(runs):
                    ready = prepared(page, r)
                    mask, t = masked(ready, r)
                    rois = []
                    for x in p.get("rois") or ():
                        at = np.s_[x["y"] : x["y"] + x["height"], x["x"] : x["x"] + x["width"]]
                        rois.append(dict(zip(("roi_id", "tag", "tp", "fp", "fn", "tn", "d1", "d2", "d4", "d5", "d8", "blocks"), (x["roi_id"], x["tag"], *_scores(mask[at], own[at])), strict=True)))
                    scores = _scores(mask, own) if own is not None else (None,) * 10
                    rows.append((r.run_id, pos, p["page_id"], p["category"], p["width"], p["height"], t, int(mask.sum()), int(ready.sum(dtype=np.int64)), *scores, len(g4.encode(mask)) if encode else None, rois))
            cols = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return rasters.select(*columns).mapInArrow(run, MEASURED)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def histograms(rasters: DataFrame) -> DataFrame:
    """``(page_id, category, v, n)`` of the gray values that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [np.bincount(np.frombuffer(x.as_buffer(), np.uint8), minlength=256) for x in b.column("pixels")]
            flat = np.concatenate(counts).astype(np.int64) if counts else np.empty(0, np.int64)
            at = np.flatnonzero(flat)
            page = pa.array(at // 256)
            yield pa.record_batch([b.column("page_id").take(page), b.column("category").take(page), pa.array((at % 256).astype(np.int32)), pa.array(flat[at])], ["page_id", "category", "v", "n"])

    return rasters.select("page_id", "category", "pixels").mapInArrow(run, "page_id long, category string, v int, n long")


def otsu_thresholds(hist: DataFrame) -> DataFrame:
    """``(page_id, category, threshold)`` by running sums over the histogram; ties go to the lowest."""
    upto = Window.partitionBy("page_id", "category").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    page = Window.partitionBy("page_id", "category")
    sums = hist.select(
        "page_id",
        "category",
        "v",
        F.sum("n").over(upto).alias("b"),
        F.sum(F.col("v") * F.col("n")).over(upto).alias("bs"),
        F.sum("n").over(page).alias("t"),
        F.sum(F.col("v") * F.col("n")).over(page).alias("ts"),
    )
    gap = F.col("bs") / F.col("b") - (F.col("ts") - F.col("bs")) / (F.col("t") - F.col("b"))
    variance = F.when(F.col("b") < F.col("t"), F.col("b").cast("double") * (F.col("t") - F.col("b")).cast("double") * gap * gap)
    best = F.max(F.when(variance > 0, F.struct(variance.alias("var"), (-F.col("v")).alias("low"))))
    return sums.groupBy("page_id", "category").agg(best.alias("best")).select("page_id", "category", F.coalesce(-F.col("best.low"), F.lit(0)).alias("threshold"))


def gray_stats(hist: DataFrame, value: Column | None = None) -> DataFrame:
    """Least, largest, mean and population deviation of gray values, or of ``value`` of them."""
    rows = hist.withColumn("w", F.col("v") if value is None else value)
    sums = rows.groupBy("page_id").agg(F.min("w").alias("min_gray"), F.max("w").alias("max_gray"), F.sum("n").alias("c"), F.sum(F.col("w") * F.col("n")).alias("s"), F.sum(F.col("w") * F.col("w") * F.col("n")).alias("q"))
    mean = F.col("s") / F.col("c")
    return sums.select("page_id", "min_gray", "max_gray", mean.alias("mean_gray"), F.sqrt(F.greatest(F.col("q") / F.col("c") - mean * mean, F.lit(0.0))).alias("std_gray"))


def contrasted(v: Column, amount: float) -> Column:
    """Contrast about 128 in single precision."""
    if amount == 0:
        return v
    factor = F.lit(float(np.float32(1) + np.float32(amount))).cast("float")
    moved = (factor * (v.cast("float") - F.lit(128.0).cast("float")) + F.lit(128.0).cast("float")).cast("double")
    return F.greatest(F.lit(0), F.least(F.lit(255), F.round(moved).cast("int")))


def scored(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1, PSNR, distortion and coded size of measured rows."""
    c = F.col
    return rows.withColumns(
        R.f_measure(c("tp"), c("fp"), c("fn"))
        | {
            "psnr_db": R.psnr(c("fp"), c("fn"), c("tp") + c("fp") + c("fn") + c("tn")),
            "drd": R.drd([c(f"d{d}") for d in kernels.DISTANCES], c("blocks")),
        }
    )


def aggregate(rows: DataFrame, *keys: str, more: tuple[Column, ...] = ()) -> DataFrame:
    """Macro and micro F1, means and extremes over pages of each group, and ``more`` aggregates."""
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("page_count"),
        F.avg("f1").alias("macro_f1"),
        F.avg("precision").alias("mean_precision"),
        F.avg("recall").alias("mean_recall"),
        F.avg("psnr_db").alias("mean_psnr_db"),
        F.count(F.when(F.col("psnr_db").isNull(), 1)).alias("perfect_psnr_page_count"),
        F.avg("drd").alias("mean_drd"),
        F.percentile("drd", 0.5).alias("median_drd"),
        F.max("drd").alias("max_drd"),
        *[F.sum(k).alias(k) for k in ("tp", "fp", "fn")],
        *more,
    )
    micro = R.f_measure(F.col("tp"), F.col("fp"), F.col("fn"))["f1"]
    return sums.withColumn("micro_f1", micro).drop("tp", "fp", "fn")


def worst_columns() -> tuple[Column, ...]:
    """The page of lowest F1 (first of equals), of highest distortion and of most ink (last of equals)."""
    return (
        F.min_by("page_id", F.struct("f1", "page_id")).alias("lowest_f1_page"),
        F.max_by("page_id", F.struct("drd", "page_id")).alias("highest_drd_page"),
        F.max_by("page_id", F.struct("black", "page_id")).alias("most_ink_page"),
    )


def worst(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id").agg(*worst_columns())


def roi_rows(rows: DataFrame) -> DataFrame:
    """Measured regions as rows of their own."""
    return rows.select("run_id", "page_id", "category", F.inline("rois"))
