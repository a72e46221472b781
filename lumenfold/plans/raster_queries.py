"""Queries over page rasters made of ``documents``, and their DuckDB twins.

Every document's whole text is a page of width 64: code point modulo 256, row by row, white to the
end of the last row. Truth of the metric queries is the mask of a manual threshold, which tests the
metrics and says nothing of any method's quality.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import attach
from ..functions import reports as R
from ..model import Run
from ..operators import kernels, pages
from ..sources import rasters

OTSU, SAUVOLA, MANUAL = Run("otsu"), Run("sauvola", method="sauvola"), Run("manual", method="manual", threshold=105)
TRUTH = Run("truth", method="manual", threshold=110)
RUNS = (OTSU, SAUVOLA, MANUAL)


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = attach(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return rasters.from_texts(docs.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("category"), "text"))


def _hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.histograms(_rasters(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str, runs: tuple[Run, ...] = RUNS) -> DataFrame:
    return pages.scored(pages.measure(_rasters(spark, sf_dir), runs, TRUTH))


def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.otsu_thresholds(_hist(spark, sf_dir)).select("page_id", "threshold")


def otsu_ink_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = _hist(spark, sf_dir)
    inked = hist.join(pages.otsu_thresholds(hist).drop("category"), "page_id")
    sums = inked.groupBy("category").agg(F.countDistinct("page_id").alias("pages"), F.sum(F.when(F.col("v") <= F.col("threshold"), F.col("n")).otherwise(0)).alias("black"), F.sum("n").alias("pixels"))
    return sums.select(F.col("category").alias("lang"), "pages", "black", "pixels", R.ratio(F.col("black").cast("double"), F.col("pixels")).alias("black_ratio"))


def manual_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hist(spark, sf_dir).groupBy("page_id").agg(F.sum(F.when(F.col("v") <= MANUAL.threshold, F.col("n")).otherwise(0)).alias("black"), F.sum("n").alias("pixels"))


def grayscale_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.gray_stats(_hist(spark, sf_dir))


def contrast_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.gray_stats(_hist(spark, sf_dir), pages.contrasted(F.col("v"), 0.25))


def _black(spark: SparkSession, sf_dir: str, run: Run) -> DataFrame:
    return pages.measure(_rasters(spark, sf_dir), (run,)).select("page_id", "black", "out_sum")


def sauvola_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _black(spark, sf_dir, SAUVOLA).select("page_id", "black")


def background_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Run("flat", method="manual", threshold=200, background_normalization=True, background_radius=5)
    return _black(spark, sf_dir, run)


def median_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _black(spark, sf_dir, Run("median", method="manual", threshold=105, median_denoise=True))


def despeckle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = (MANUAL, Run("clean", method="manual", threshold=MANUAL.threshold, despeckle="conservative"))
    rows = pages.measure(_rasters(spark, sf_dir), both)
    return rows.groupBy("page_id").agg(F.max(F.when(F.col("pos") == 0, F.col("black"))).alias("black_before"), F.max(F.when(F.col("pos") == 1, F.col("black"))).alias("black_after"))


def confusion_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.measure(_rasters(spark, sf_dir), RUNS, TRUTH)
    return rows.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])


def fmeasure_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("run_id", "page_id", "precision", "recall", "f1")


def psnr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("run_id", "page_id", "psnr_db", F.col("psnr_db").isNull().alias("perfect_match"))


def nonuniform_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.measure(_rasters(spark, sf_dir), (OTSU,), TRUTH).select("page_id", "blocks")


def drd_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, (OTSU, MANUAL)).select("run_id", "page_id", "drd")


def benchmark_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.aggregate(_scored(spark, sf_dir), "run_id").select("run_id", "page_count", "macro_f1", "micro_f1", "mean_precision", "mean_recall", "mean_psnr_db", "perfect_psnr_page_count")


def benchmark_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.aggregate(_scored(spark, sf_dir), "run_id", "category").select("run_id", "category", "page_count", "macro_f1", "micro_f1", "mean_precision", "mean_recall")


def worst_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.worst(_scored(spark, sf_dir)).select("run_id", "lowest_f1_page", "most_ink_page")


def _with_rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tagged halves of the whole page, and an untagged region over the middle that overlaps both."""
    rows = _rasters(spark, sf_dir)
    height = F.col("height")
    roi = lambda name, x, w, tag: F.struct(F.lit(name).alias("roi_id"), F.lit(x).alias("x"), F.lit(0).alias("y"), F.lit(w).alias("width"), height.alias("height"), F.lit(tag).cast("string").alias("tag"))
    return rows.withColumn("rois", F.array(roi("a", 0, 32, "left"), roi("b", 32, 32, "right"), roi("c", 20, 24, None)))


def _roi_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.scored(pages.roi_rows(pages.measure(_with_rois(spark, sf_dir), (OTSU, MANUAL), TRUTH)))


def roi_fmeasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roi_scored(spark, sf_dir).select("run_id", "page_id", "roi_id", "precision", "recall", "f1", "blocks")


def roi_tag_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.aggregate(_roi_scored(spark, sf_dir).where("tag IS NOT NULL"), "run_id", "tag").select("run_id", "tag", F.col("page_count").alias("roi_count"), "macro_f1", "micro_f1", "mean_precision", "mean_recall")


def bit_pack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and sum of the bytes of packed masks."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = []
            for p in b.to_pylist():
                page = np.frombuffer(p["pixels"], np.uint8).reshape(p["height"], p["width"])
                packed = np.frombuffer(kernels.pack_bits(page <= MANUAL.threshold), np.uint8)
                rows.append((p["page_id"], len(packed), int(packed.sum(dtype=np.int64))))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["page_id", "packed_bytes", "byte_sum"])

    return _rasters(spark, sf_dir).mapInArrow(run, "page_id long, packed_bytes long, byte_sum long")


def embedding_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Otsu thresholds of vectors as 8 x 8 pages, by label: relational from the pixel up."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    gray = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("x").cast("double") + 1) * 128).cast("int")))
    pixels = rows.select(F.col("vec_id").alias("page_id"), F.col("label").cast("string").alias("category"), F.explode("embedding").alias("x")).select("page_id", "category", gray.alias("v"))
    hist = pixels.groupBy("page_id", "category", "v").agg(F.count(F.lit(1)).alias("n"))
    t = pages.otsu_thresholds(hist)
    return t.groupBy("category").agg(F.count(F.lit(1)).alias("pages"), F.min("threshold").alias("least"), F.max("threshold").alias("most"), F.avg("threshold").alias("mean"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        otsu_threshold, otsu_ink_by_lang, manual_threshold, grayscale_stats, contrast_stats, sauvola_ink, background_normalize, median_denoise, despeckle_counts,
        confusion_by_method, fmeasure_pages, psnr_pages, nonuniform_blocks, drd_pages, benchmark_aggregate, benchmark_by_category, worst_pages, roi_fmeasure,
        roi_tag_aggregate, bit_pack_rows, embedding_otsu,
    )
    return {f.__name__: f for f in found}


# --- DuckDB ---------------------------------------------------------------------------------------

PX = """px AS MATERIALIZED (
  SELECT doc_id AS page_id, lang AS cat, CAST(i // 64 AS INTEGER) AS y, CAST(i % 64 AS INTEGER) AS x,
         CAST(CASE WHEN i < n THEN unicode(chars[i + 1]) % 256 ELSE 255 END AS INTEGER) AS v
  FROM (SELECT doc_id, lang, string_split(text, '') AS chars, length(text) AS n,
               unnest(range(0, (length(text) + 63) // 64 * 64)) AS i
        FROM documents WHERE length(text) > 0))"""
HIST = "hist AS (SELECT page_id, cat, v, count(*)::BIGINT AS n FROM px GROUP BY ALL)"
OTSU_CTE = """cum AS (
  SELECT page_id, cat, v, sum(n) OVER w AS b, sum(v * n) OVER w AS bs,
         sum(n) OVER p AS t, sum(v * n) OVER p AS ts
  FROM hist WINDOW p AS (PARTITION BY page_id, cat), w AS (PARTITION BY page_id, cat ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
variances AS (
  SELECT *, b::DOUBLE * (t - b)::DOUBLE * (bs::DOUBLE / b::DOUBLE - (ts - bs)::DOUBLE / (t - b)::DOUBLE) * (bs::DOUBLE / b::DOUBLE - (ts - bs)::DOUBLE / (t - b)::DOUBLE) AS var
  FROM cum WHERE b < t),
otsu AS (
  SELECT h.page_id, h.cat, coalesce(m.v, 0)::INTEGER AS threshold
  FROM (SELECT DISTINCT page_id, cat FROM hist) h
  LEFT JOIN (SELECT page_id, v FROM variances WHERE var > 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY var DESC, v) = 1) m USING (page_id))"""
SAUVOLA_CTE = """sh AS (
  SELECT page_id, y, x, v, sum(v) OVER w AS s, sum(v * v) OVER w AS q, count(*) OVER w AS n
  FROM px WINDOW w AS (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING)),
sv AS (
  SELECT page_id, y, x, v, sum(s) OVER w AS s, sum(q) OVER w AS q, sum(n) OVER w AS n
  FROM sh WINDOW w AS (PARTITION BY page_id, x ORDER BY y ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING)),
sauvola AS (
  SELECT page_id, y, x, v <= (s::DOUBLE / n::DOUBLE) * (1.0::DOUBLE + 0.2::FLOAT::DOUBLE
         * (sqrt(greatest(q::DOUBLE / n::DOUBLE - (s::DOUBLE / n::DOUBLE) * (s::DOUBLE / n::DOUBLE), 0.0::DOUBLE)) / 128.0::DOUBLE - 1.0::DOUBLE)) AS black
  FROM sv)"""
MASKS = f"""masks AS MATERIALIZED (
  SELECT 'otsu' AS run_id, px.page_id, cat, y, x, v <= threshold AS black, v <= {TRUTH.threshold} AS truth FROM px JOIN otsu USING (page_id, cat)
  UNION ALL SELECT 'manual', page_id, cat, y, x, v <= {MANUAL.threshold}, v <= {TRUTH.threshold} FROM px
  UNION ALL SELECT 'sauvola', page_id, px.cat, y, x, black, v <= {TRUTH.threshold} FROM px JOIN sauvola USING (page_id, y, x))"""
CONF = """conf AS (
  SELECT run_id, page_id, cat, count_if(black AND truth)::BIGINT AS tp, count_if(black AND NOT truth)::BIGINT AS fp,
         count_if(NOT black AND truth)::BIGINT AS fn, count_if(NOT black AND NOT truth)::BIGINT AS tn, count_if(black)::BIGINT AS ink
  FROM masks GROUP BY ALL)"""
_PRF = """CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp)::DOUBLE END::DOUBLE AS precision,
         CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fn)::DOUBLE END::DOUBLE AS recall"""
_F1 = "CASE WHEN precision + recall > 0 THEN 2.0::DOUBLE * precision * recall / (precision + recall) ELSE 0.0 END::DOUBLE AS f1"
SCORED = f"scored AS (SELECT *, {_F1} FROM (SELECT *, {_PRF} FROM conf))"
_ALL = ",\n".join((PX, HIST, OTSU_CTE, SAUVOLA_CTE, MASKS, CONF, SCORED))
_MICRO = """CASE WHEN sum(tp + fp + fn) = 0 THEN 1.0 WHEN sum(tp) = 0 THEN 0.0
         ELSE 2.0::DOUBLE * (sum(tp)::DOUBLE / sum(tp + fp)::DOUBLE) * (sum(tp)::DOUBLE / sum(tp + fn)::DOUBLE) / (sum(tp)::DOUBLE / sum(tp + fp)::DOUBLE + sum(tp)::DOUBLE / sum(tp + fn)::DOUBLE) END::DOUBLE AS micro_f1"""
_STATS = """page_id, min(w)::INTEGER AS min_gray, max(w)::INTEGER AS max_gray, sum(w * n)::DOUBLE / sum(n)::DOUBLE AS mean_gray,
  sqrt(greatest(sum(w * w * n)::DOUBLE / sum(n)::DOUBLE - (sum(w * n)::DOUBLE / sum(n)::DOUBLE) * (sum(w * n)::DOUBLE / sum(n)::DOUBLE), 0.0)) AS std_gray"""


def _box(radius: int) -> str:
    w = f"ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING"
    return f"""bh AS (SELECT page_id, y, x, v, sum(v) OVER w AS s, count(*) OVER w AS n FROM px WINDOW w AS (PARTITION BY page_id, y ORDER BY x {w})),
box AS (SELECT page_id, y, x, v, (sum(s) OVER w // sum(n) OVER w)::INTEGER AS m FROM bh WINDOW w AS (PARTITION BY page_id, x ORDER BY y {w}))"""


def _despeckle(most: int) -> str:
    """Labels spread over four neighbours in as many rounds as the largest component to remove has pixels."""
    parts = [f"l0 AS (SELECT page_id, y, x, v <= {MANUAL.threshold} AS k, CASE WHEN v <= {MANUAL.threshold} THEN y * 64 + x END AS l FROM px)"]
    near = lambda c: ", ".join(f"{f}({c}) OVER {w}" for w in ("r", "c") for f in ("lag", "lead"))
    over = "WINDOW r AS (PARTITION BY page_id, y ORDER BY x), c AS (PARTITION BY page_id, x ORDER BY y)"
    for i in range(most):
        parts.append(f"l{i + 1} AS (SELECT page_id, y, x, k, CASE WHEN k THEN least(l, {near('l')}) END AS l FROM l{i} {over})")
    differ = " OR ".join(f"coalesce({f}(l) OVER {w}, l) <> l" for w in ("r", "c") for f in ("lag", "lead"))
    parts.append(f"leaks AS (SELECT page_id, l, {differ} AS open FROM l{most} {over})")
    parts.append(f"gone AS (SELECT page_id, l, count(*) AS n FROM leaks WHERE l IS NOT NULL GROUP BY ALL HAVING count(*) <= {most} AND NOT bool_or(open))")
    return ",\n".join(parts)


def _drd_sql() -> str:
    offsets = ", ".join(f"({dy}, {dx}, {dy * dy + dx * dx})" for dy in range(-2, 3) for dx in range(-2, 3) if dy or dx)
    norm = "(4 + 4 / sqrt(2) + 4 / 2.0 + 8 / sqrt(5) + 4 / sqrt(8))"
    return f"""WITH {_ALL},
offsets(dy, dx, d2) AS (VALUES {offsets}),
flipped AS (SELECT run_id, page_id, y, x, black FROM masks WHERE black <> truth AND run_id <> 'sauvola'),
near AS (
  SELECT f.run_id, f.page_id, o.d2, count_if(coalesce(p.v <= {TRUTH.threshold}, false) <> f.black) AS n
  FROM flipped f CROSS JOIN offsets o LEFT JOIN px p ON p.page_id = f.page_id AND p.y = f.y + o.dy AND p.x = f.x + o.dx GROUP BY ALL),
total AS (SELECT run_id, page_id, sum(n / sqrt(d2)) / {norm} AS s FROM near GROUP BY ALL),
blocks AS (SELECT page_id, count(*) AS n FROM (SELECT page_id FROM px GROUP BY page_id, y // 8, x // 8 HAVING min(v <= {TRUTH.threshold}) <> max(v <= {TRUTH.threshold})) GROUP BY ALL)
SELECT c.run_id, c.page_id, (coalesce(t.s, 0) / greatest(coalesce(b.n, 0), 1))::DOUBLE AS drd
FROM conf c LEFT JOIN total t USING (run_id, page_id) LEFT JOIN blocks b USING (page_id) WHERE c.run_id <> 'sauvola'"""


def _roi_cte() -> str:
    return f"""WITH {_ALL},
pages AS (SELECT page_id, max(y) + 1 AS height FROM px GROUP BY ALL),
rois AS (SELECT page_id, roi_id, rx, rw, height AS rh, tag FROM pages, (VALUES ('a', 0, 32, 'left'), ('b', 32, 32, 'right'), ('c', 20, 24, NULL)) r(roi_id, rx, rw, tag)),
rconf AS (
  SELECT m.run_id, m.page_id, r.roi_id, r.tag, count_if(black AND truth)::BIGINT AS tp, count_if(black AND NOT truth)::BIGINT AS fp, count_if(NOT black AND truth)::BIGINT AS fn
  FROM masks m JOIN rois r ON m.page_id = r.page_id AND m.x >= rx AND m.x < rx + rw AND m.y < rh WHERE m.run_id <> 'sauvola' GROUP BY ALL),
rblocks AS (
  SELECT run_id, page_id, roi_id, count_if(lo <> hi)::BIGINT AS blocks FROM (
    SELECT m.run_id, m.page_id, r.roi_id, min(truth) AS lo, max(truth) AS hi
    FROM masks m JOIN rois r ON m.page_id = r.page_id AND m.x >= rx AND m.x < rx + rw AND m.y < rh WHERE m.run_id <> 'sauvola'
    GROUP BY m.run_id, m.page_id, r.roi_id, m.y // 8, (m.x - rx) // 8) GROUP BY ALL),
rscored AS (SELECT *, {_F1} FROM (SELECT *, {_PRF} FROM rconf))"""


def oracle_sql() -> dict[str, str]:
    hist = f"WITH {PX}, {HIST}"
    scored = f"WITH {_ALL}"
    contrast = "greatest(0, least(255, round(((1.25::FLOAT * (v::FLOAT - 128::FLOAT)) + 128::FLOAT)::DOUBLE)::INTEGER))"
    counted = f"count(*) AS page_count, avg(f1) AS macro_f1, {_MICRO}, avg(precision) AS mean_precision, avg(recall) AS mean_recall"
    cells = ", ".join(f"{f}(v, {k}) OVER r" for f, k in (("lag", 1), ("lead", 1)))
    return {
        "otsu_threshold": f"{hist}, {OTSU_CTE} SELECT page_id, threshold FROM otsu",
        "otsu_ink_by_lang": f"{hist}, {OTSU_CTE} SELECT cat AS lang, count(DISTINCT page_id) AS pages, sum(CASE WHEN v <= threshold THEN n ELSE 0 END)::BIGINT AS black, sum(n)::BIGINT AS pixels, sum(CASE WHEN v <= threshold THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE AS black_ratio FROM hist JOIN otsu USING (page_id, cat) GROUP BY cat",
        "manual_threshold": f"{hist} SELECT page_id, sum(CASE WHEN v <= {MANUAL.threshold} THEN n ELSE 0 END)::BIGINT AS black, sum(n)::BIGINT AS pixels FROM hist GROUP BY page_id",
        "grayscale_stats": f"{hist} SELECT {_STATS} FROM (SELECT page_id, v AS w, n FROM hist) GROUP BY page_id",
        "contrast_stats": f"{hist} SELECT {_STATS} FROM (SELECT page_id, {contrast} AS w, n FROM hist) GROUP BY page_id",
        "sauvola_ink": f"WITH {PX}, {SAUVOLA_CTE} SELECT page_id, count_if(black)::BIGINT AS black FROM sauvola GROUP BY page_id",
        "background_normalize": f"WITH {PX}, {_box(5)}, flat AS (SELECT page_id, greatest(0, least(255, v - m + 255)) AS w FROM box) SELECT page_id, count_if(w <= 200)::BIGINT AS black, sum(w)::BIGINT AS out_sum FROM flat GROUP BY page_id",
        "median_denoise": f"""WITH {PX}, rows3 AS (SELECT page_id, y, x, v, list_value(v, {cells}) AS t, max(y) OVER (PARTITION BY page_id) + 1 AS h FROM px WINDOW r AS (PARTITION BY page_id, y ORDER BY x)),
            nine AS (SELECT page_id, y, x, v, h, list_sort(list_concat(t, list_concat(lag(t) OVER c, lead(t) OVER c))) AS nine FROM rows3 WINDOW c AS (PARTITION BY page_id, x ORDER BY y)),
            med AS (SELECT page_id, CASE WHEN y = 0 OR x = 0 OR x = 63 OR y = h - 1 OR h < 3 THEN v ELSE nine[5] END AS w FROM nine)
            SELECT page_id, count_if(w <= 105)::BIGINT AS black, sum(w)::BIGINT AS out_sum FROM med GROUP BY page_id""",
        "despeckle_counts": f"WITH {PX}, {_despeckle(4)} SELECT p.page_id, p.n::BIGINT AS black_before, (p.n - coalesce(g.n, 0))::BIGINT AS black_after FROM (SELECT page_id, count_if(k) AS n FROM l0 GROUP BY ALL) p LEFT JOIN (SELECT page_id, sum(n) AS n FROM gone GROUP BY ALL) g USING (page_id)",
        "confusion_by_method": f"{scored} SELECT run_id, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn FROM conf GROUP BY run_id",
        "fmeasure_pages": f"{scored} SELECT run_id, page_id, precision, recall, f1 FROM scored",
        "psnr_pages": f"{scored} SELECT run_id, page_id, CASE WHEN fp + fn > 0 THEN 10.0::DOUBLE * log10((tp + fp + fn + tn)::DOUBLE / (fp + fn)::DOUBLE) END AS psnr_db, fp + fn = 0 AS perfect_match FROM conf",
        "nonuniform_blocks": f"WITH {PX}, b AS (SELECT page_id, min(v <= {TRUTH.threshold}) <> max(v <= {TRUTH.threshold}) AS mixed FROM px GROUP BY page_id, y // 8, x // 8) SELECT page_id, count_if(mixed)::BIGINT AS blocks FROM b GROUP BY page_id",
        "drd_pages": _drd_sql(),
        "benchmark_aggregate": f"{scored} SELECT run_id, {counted}, avg(CASE WHEN fp + fn > 0 THEN 10.0::DOUBLE * log10((tp + fp + fn + tn)::DOUBLE / (fp + fn)::DOUBLE) END) AS mean_psnr_db, count_if(fp + fn = 0)::BIGINT AS perfect_psnr_page_count FROM scored GROUP BY run_id",
        "benchmark_by_category": f"{scored} SELECT run_id, cat AS category, {counted} FROM scored GROUP BY run_id, cat",
        "worst_pages": f"{scored} SELECT run_id, arg_min(page_id, (f1, page_id)) AS lowest_f1_page, arg_max(page_id, (ink, page_id)) AS most_ink_page FROM scored GROUP BY run_id",
        "roi_fmeasure": f"{_roi_cte()} SELECT run_id, page_id, roi_id, precision, recall, f1, blocks FROM rscored JOIN rblocks USING (run_id, page_id, roi_id)",
        "roi_tag_aggregate": f"{_roi_cte()} SELECT run_id, tag, {counted.replace('page_count', 'roi_count')} FROM rscored WHERE tag IS NOT NULL GROUP BY run_id, tag",
        "bit_pack_rows": f"WITH {PX}, b AS (SELECT page_id, y, x // 8 AS k, sum(CASE WHEN v <= {MANUAL.threshold} THEN 1 << (7 - x % 8) ELSE 0 END) AS byte FROM px GROUP BY ALL) SELECT page_id, count(*)::BIGINT AS packed_bytes, sum(byte)::BIGINT AS byte_sum FROM b GROUP BY page_id",
        "embedding_otsu": f"""WITH hist AS (SELECT page_id, cat, v, count(*)::BIGINT AS n FROM (SELECT vec_id AS page_id, label::VARCHAR AS cat, greatest(0, least(255, floor((unnest(embedding)::DOUBLE + 1) * 128)::INTEGER)) AS v FROM embeddings) GROUP BY ALL), {OTSU_CTE}
            SELECT cat AS category, count(*) AS pages, min(threshold) AS least, max(threshold) AS most, avg(threshold) AS mean FROM otsu GROUP BY cat""",
    }
