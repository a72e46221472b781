"""Document and page reports, and size estimates; relational throughout, with DuckDB twins.

Pages of reports come from the order tables: an order is a document, its lines are pages in a full
order, and their measures stand for bytes, pixels, ink and durations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import attach
from ..functions import reports as R
from ..model import Run
from ..operators import kernels, pages, pdf
from ..sources import rasters, suite
from . import benchmark

SAMPLES = 4
_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_measure``: lines of orders as measured pages."""
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", *_ORDER).withColumn("page_index", F.row_number().over(w) - 1)
    return rows.select(
        F.col("l_orderkey").alias("doc_id"),
        "page_index",
        (F.col("l_quantity") * 1000 + 7).cast("long").alias("pixel_count"),
        (F.col("l_discount") + F.col("l_tax")).alias("ink"),
        F.floor("l_extendedprice").cast("long").alias("ccitt_bytes"),
        F.col("l_suppkey").alias("us"),
    )


def page_pixel_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of every part's size as a page, at each resolution; null where it is out of range."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") * 20.0).alias("w"), (F.col("p_retailprice") / 2.0).alias("h"))
    out = [R.page_pixels(F.col("w"), F.col("h"), d) for d in (300, 400, 600)]
    return rows.select("p_partkey", *[x["width_px"].alias(f"width_{d}") for x, d in zip(out, (300, 400, 600), strict=True)], *[x["height_px"].alias(f"height_{d}") for x, d in zip(out, (300, 400, 600), strict=True)])


def rotation_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select("p_partkey", R.rotation((F.col("p_size") - 25) * 90).alias("quarter"), R.rotation((F.col("p_size") - 25) * 45).alias("eighth"))


def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages 1, 3 and 5 to 6 of every document."""
    rows = _measures(spark, sf_dir).where(F.col("page_index").isin(R.parse_selection("1, 3,5-6", 1000)))
    return rows.select("doc_id", "page_index", "ccitt_bytes")


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _measures(spark, sf_dir)
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return rows.withColumn("n", n).where(F.array_contains(R.sample_indices(F.col("n"), SAMPLES), F.col("page_index")))


def sample_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir).select("doc_id", "page_index")


def bytes_per_pixel_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _measures(spark, sf_dir).withColumn("bpp", F.col("ccitt_bytes") / F.col("pixel_count"))
    q = rows.groupBy("doc_id").agg(F.percentile("bpp", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select("doc_id", *[F.get("q", i).alias(n) for i, n in enumerate(("p25", "p50", "p75"))])


FIXED, EACH = 500, 700  # container bytes of the query; a conversion measures its own


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, lower and upper extrapolation from the sampled pages to all pixels of a document."""
    totals = _measures(spark, sf_dir).groupBy("doc_id").agg(F.sum("pixel_count").alias("pixels"), F.count(F.lit(1)).alias("pages"), F.sum("ccitt_bytes").alias("actual"))
    sampled = _sampled(spark, sf_dir).withColumn("bpp", F.col("ccitt_bytes") / F.col("pixel_count"))
    # a mean of exact sums: independent of the order of rows
    stats = sampled.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("bpp").alias("mean"), F.min("bpp").alias("least"), F.max("bpp").alias("most"), F.percentile("bpp", F.array(F.lit(0.25), F.lit(0.75))).alias("q")
    )
    few = F.col("samples") < 4
    low, high = F.when(few, F.col("least")).otherwise(F.get("q", 0)), F.when(few, F.col("most")).otherwise(F.get("q", 1))
    # rounded first: the last digit of a mean depends on the order of its terms
    size = lambda bpp: F.floor(F.round(F.col("pixels") * F.greatest(bpp, F.lit(0.0)), 3)).cast("long") + FIXED + EACH * F.col("pages")
    rows = totals.join(stats, "doc_id").withColumns({"central": size(F.col("mean")), "lo": size(low), "hi": size(high)})
    return rows.select("doc_id", "pages", "samples", F.when(few, "min_max").otherwise("quartiles").alias("range_method"), "central", F.least("lo", "central").alias("lower"), F.greatest("hi", "central").alias("upper"), (F.col("actual") + FIXED + EACH * F.col("pages")).alias("actual"))


def size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _estimates(spark, sf_dir).drop("actual")


def estimate_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates joined to results of equal document and settings."""
    mark = F.lit(Run("e").validate().fingerprint())
    rows = _estimates(spark, sf_dir).withColumn("fingerprint", mark)
    actual = rows.select("doc_id", "fingerprint", "actual")
    both = actual.join(rows.select("doc_id", "fingerprint", "central"), ["doc_id", "fingerprint"], "left")
    return both.select("doc_id", F.col("central").alias("estimated"), "actual", *[v.alias(k) for k, v in R.estimate_error(F.col("central"), F.col("actual")).items()])


def page_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _measures(spark, sf_dir)
    medians = rows.groupBy("doc_id").agg(*[F.percentile(c, 0.5).alias(f"m_{k}") for k, c in (("bytes", "ccitt_bytes"), ("us", "us"), ("ink", "ink"))])
    value = {"bytes": F.col("ccitt_bytes"), "us": F.col("us"), "ink": F.col("ink")}
    flags = R.outliers(value, {k: F.col(f"m_{k}") for k in value})
    return rows.join(medians, "doc_id").select("doc_id", "page_index", F.array_join(flags, ",").alias("flags"))


def process_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _measures(spark, sf_dir).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("ccitt_bytes").alias("output_bytes"), F.sum("pixel_count").alias("source_bytes"), F.sum(F.round(F.round(F.col("ink") * F.col("pixel_count"), 6)).cast("long")).alias("black_pixels")
    )
    return rows.select("doc_id", "pages", "output_bytes", "source_bytes", "black_pixels", *[v.alias(k) for k, v in R.reduction(F.col("source_bytes"), F.col("output_bytes")).items()])


def extreme_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slowest and largest page (last of equals), smallest page (first of equals)."""
    at = lambda c: F.struct(c, "page_index")
    return _measures(spark, sf_dir).groupBy("doc_id").agg(F.max_by("page_index", at("us")).alias("slowest"), F.max_by("page_index", at("ccitt_bytes")).alias("largest"), F.min_by("page_index", at("ccitt_bytes")).alias("smallest"))


def duration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations of a user's events as pages of a document."""
    us = F.floor(F.col("value") * 1000).cast("long")
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count(us).alias("pages"), F.min(us).alias("least"), F.max(us).alias("most"), F.avg(us).alias("mean"), F.percentile(us, 0.5).alias("median"))


def metadata_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return rows.select("page_id", R.sanitized(F.col("html")).alias("title"), R.sanitized(F.lit(" \n\t ")).alias("nothing"), R.file_name(F.col("url")).alias("name"))


def source_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content identity of every document, and whether the one before it in id order is the same."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = rows.select("doc_id", F.octet_length("text").cast("long").alias("length"), F.sha2("text", 256).alias("sha256"))
    copies = ids.groupBy("length", "sha256").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))
    return ids.join(copies, ["length", "sha256"]).select("doc_id", "length", "sha256", "first_doc", "copies")


def source_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document beside the first of its length: one content or not. Hashes are taken of English texts only, sources stand for paths."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    length = F.octet_length("text").cast("long")
    identity = F.struct(F.col("source").alias("path"), length.alias("length"), F.when(F.col("lang") == "en", F.sha2("text", 256)).alias("sha256"))
    ids = rows.select("doc_id", length.alias("length"), identity.alias("own"))
    first = ids.groupBy("length").agg(F.min("doc_id").alias("first_doc"), F.min_by("own", "doc_id").alias("other"))
    return ids.join(first, "length").select("doc_id", "length", "first_doc", R.same_source(F.col("own"), F.col("other")).alias("same"))


def benchmark_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published comparison over the synthetic suite, rounded as it is published."""
    return _published(benchmark.golden(attach(spark)))


def benchmark_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same comparison from files: the suite is written as PNGs and manifests, read back and run."""
    dataset, profile = suite.write_suite(attach(spark), suite.shared_folder(spark, "lumenfold-suite"))
    return _published(benchmark.run_report(benchmark.from_manifests(spark, dataset, profile)))


def _published(rows: DataFrame) -> DataFrame:
    shown = ("macro_f1", "micro_f1", "mean_precision", "mean_recall", "mean_drd", "median_drd", "max_drd")
    return rows.select("run_id", "page_count", *[F.round(c, 4).alias(c) for c in shown], "perfect_psnr_page_count", "encoded_bytes", F.round("mean_bytes_per_megapixel", 1).alias("bytes_per_megapixel"))


def golden_rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = benchmark.page_results(benchmark.fixture_rasters(attach(spark)), benchmark.BASELINE_RUNS)
    return benchmark.roi_report(rows).select("run_id", "tag", F.col("page_count").alias("roi_count"), "macro_f1", "mean_drd")


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    docs = attach(spark).read.parquet(f"{sf_dir}/documents.parquet")
    gray = rasters.from_texts(docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("category"), "text"))

    def run(batches):
        for b in batches:
            rows = []
            for p in b.to_pylist():
                page = np.frombuffer(p["pixels"], np.uint8).reshape(p["height"], p["width"])
                rows.append((p["page_id"], p["category"], p["width"], p["height"], kernels.pack_bits(pages.binarized(page, Run("otsu"))[0])))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["page_id", "category", "width", "height", "packed"])

    return gray.mapInArrow(run, "page_id long, category string, width int, height int, packed binary")


def g4_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group 4 bytes of every document's page, and whether decoding gives the mask back."""
    import pyarrow as pa

    from ..operators import g4

    def run(batches):
        for b in batches:
            rows = []
            for p in b.to_pylist():
                mask = kernels.unpack_bits(p["packed"], p["width"], p["height"])
                data = g4.encode(mask)
                rows.append((p["page_id"], len(p["packed"]), len(data), bool((g4.decode(data, p["width"], p["height"]) == mask).all())))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["page_id", "packed_bytes", "g4_bytes", "same"])

    return _masks(spark, sf_dir).mapInArrow(run, "page_id long, packed_bytes long, g4_bytes long, same boolean")


def pdf_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PDF of ten pages for each ten documents in id order, and what its bytes hold."""
    rows = _masks(spark, sf_dir).select(F.floor(F.col("page_id") / 10).alias("doc_id"), F.col("page_id").alias("page_index"), "width", "height", "packed")
    return pdf.structures(pdf.documents(rows))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        page_pixel_size, rotation_normalize, page_selection, sample_pages, bytes_per_pixel_quartiles, size_estimate, estimate_comparison, page_outliers, process_totals,
        extreme_pages, duration_stats, metadata_sanitize, source_digests, source_identity, benchmark_golden, benchmark_manifest, golden_rois, g4_roundtrip, pdf_structure,
    )
    return {f.__name__: f for f in found}


PM = """pm AS (SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS INTEGER) AS page_index,
  CAST(l_quantity * 1000 + 7 AS BIGINT) AS pixel_count, l_discount + l_tax AS ink, CAST(floor(l_extendedprice) AS BIGINT) AS ccitt_bytes, l_suppkey AS us FROM lineitem)"""
SAMPLED = f"""n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM pm),
sampled AS (SELECT * FROM n WHERE n <= {SAMPLES} OR page_index IN (0, (n - 1 + 1) // 3, (2 * (n - 1) + 1) // 3, n - 1))"""
ESTIMATES = f"""totals AS (SELECT doc_id, sum(pixel_count)::BIGINT AS pixels, count(*) AS pages, sum(ccitt_bytes)::BIGINT AS actual FROM pm GROUP BY doc_id),
stats AS (SELECT doc_id, count(*) AS samples, avg(bpp) AS mean, min(bpp) AS least, max(bpp) AS most, quantile_cont(bpp, 0.25) AS q1, quantile_cont(bpp, 0.75) AS q3
  FROM (SELECT doc_id, ccitt_bytes::DOUBLE / pixel_count::DOUBLE AS bpp FROM sampled) GROUP BY doc_id),
sized AS (SELECT doc_id, pages, samples, actual + {FIXED} + {EACH} * pages AS actual,
  floor(round(pixels * mean, 3))::BIGINT + {FIXED} + {EACH} * pages AS central,
  floor(round(pixels * CASE WHEN samples < 4 THEN least ELSE q1 END, 3))::BIGINT + {FIXED} + {EACH} * pages AS lo,
  floor(round(pixels * CASE WHEN samples < 4 THEN most ELSE q3 END, 3))::BIGINT + {FIXED} + {EACH} * pages AS hi FROM totals JOIN stats USING (doc_id))"""


#: The published comparison: F1, precision, recall and distortion to four places, coded bytes exactly.
GOLDEN = """SELECT run_id, 12::BIGINT AS page_count, macro_f1::DOUBLE AS macro_f1, micro_f1::DOUBLE AS micro_f1, mean_precision::DOUBLE AS mean_precision, mean_recall::DOUBLE AS mean_recall,
  mean_drd::DOUBLE AS mean_drd, 0.0::DOUBLE AS median_drd, max_drd::DOUBLE AS max_drd, perfect::BIGINT AS perfect_psnr_page_count, bytes::BIGINT AS encoded_bytes, per_mp::DOUBLE AS bytes_per_megapixel
FROM (VALUES ('otsu-300', 0.9949, 0.9946, 0.9967, 0.9933, 0.1385, 1.1038, 10, 11568, 30125.0),
  ('sauvola-300-default', 0.9934, 0.9927, 0.9884, 0.9988, 0.2260, 1.6079, 10, 11551, 30080.7),
  ('manual-300-128', 0.9115, 0.9479, 0.9133, 0.9099, 1.5559, 17.0096, 9, 10989, 28617.2))
  g(run_id, macro_f1, micro_f1, mean_precision, mean_recall, mean_drd, max_drd, perfect, bytes, per_mp)"""
GOLDEN_ROIS = "SELECT run_id, tag, n::BIGINT AS roi_count, 1.0::DOUBLE AS macro_f1, 0.0::DOUBLE AS mean_drd FROM (VALUES ('otsu-300'), ('sauvola-300-default'), ('manual-300-128')) r(run_id), (VALUES ('diacritic', 63), ('apparatus', 9)) t(tag, n)"


def oracle_sql() -> dict[str, str]:
    px = lambda c, d: f"greatest(1, round({c} / 72.0 * {d})::INTEGER)"
    sizes = ", ".join(f"CASE WHEN w > 0 AND h > 0 AND {px('w', d)}::BIGINT * {px('h', d)} <= 400000000 THEN {px(c, d)} END AS {name}_{d}" for c, name in (("w", "width"), ("h", "height")) for d in (300, 400, 600))
    turn = lambda k: f"CASE WHEN ((((p_size - 25) * {k}) % 360) + 360) % 360 IN (0, 90, 180, 270) THEN ((((p_size - 25) * {k}) % 360) + 360) % 360 END"
    return {
        "benchmark_golden": GOLDEN,
        "benchmark_manifest": GOLDEN,
        "golden_rois": GOLDEN_ROIS,
        "page_pixel_size": f"SELECT p_partkey, {sizes} FROM (SELECT p_partkey, p_size * 20.0::DOUBLE AS w, p_retailprice / 2.0::DOUBLE AS h FROM part)",
        "rotation_normalize": f"SELECT p_partkey, {turn(90)} AS quarter, {turn(45)} AS eighth FROM part",
        "page_selection": f"WITH {PM} SELECT doc_id, page_index, ccitt_bytes FROM pm WHERE page_index IN (0, 2, 4, 5)",
        "sample_pages": f"WITH {PM}, {SAMPLED} SELECT doc_id, page_index FROM sampled",
        "bytes_per_pixel_quartiles": f"WITH {PM} SELECT doc_id, quantile_cont(b, 0.25) AS p25, quantile_cont(b, 0.5) AS p50, quantile_cont(b, 0.75) AS p75 FROM (SELECT doc_id, ccitt_bytes::DOUBLE / pixel_count::DOUBLE AS b FROM pm) GROUP BY doc_id",
        "size_estimate": f"WITH {PM}, {SAMPLED}, {ESTIMATES} SELECT doc_id, pages, samples, CASE WHEN samples < 4 THEN 'min_max' ELSE 'quartiles' END AS range_method, central, least(lo, central) AS lower, greatest(hi, central) AS upper FROM sized",
        "estimate_comparison": f"WITH {PM}, {SAMPLED}, {ESTIMATES} SELECT doc_id, central AS estimated, actual, abs(central - actual) AS absolute_error_bytes, CASE WHEN actual = 0 THEN 0.0 ELSE abs(central - actual)::DOUBLE / actual::DOUBLE END::DOUBLE AS relative_error_fraction FROM sized",
        "page_outliers": f"""WITH {PM}, m AS (SELECT doc_id, quantile_cont(ccitt_bytes::DOUBLE, 0.5) AS mb, quantile_cont(us::DOUBLE, 0.5) AS mu, quantile_cont(ink, 0.5) AS mi FROM pm GROUP BY doc_id)
            SELECT doc_id, page_index, array_to_string(list_filter([CASE WHEN mb > 0 AND ccitt_bytes > 2 * mb THEN 'large_output' END, CASE WHEN mu > 0 AND us > 2 * mu THEN 'slow_processing' END,
            CASE WHEN ink > mi + 0.15::DOUBLE THEN 'high_ink_ratio' END, CASE WHEN ink < mi - 0.15::DOUBLE THEN 'low_ink_ratio' END], lambda x: x IS NOT NULL), ',') AS flags FROM pm JOIN m USING (doc_id)""",
        "process_totals": f"""WITH {PM}, t AS (SELECT doc_id, count(*) AS pages, sum(ccitt_bytes)::BIGINT AS output_bytes, sum(pixel_count)::BIGINT AS source_bytes, sum(round(round(ink * pixel_count, 6))::BIGINT)::BIGINT AS black_pixels FROM pm GROUP BY doc_id)
            SELECT *, greatest(0, source_bytes - output_bytes) AS absolute_bytes_saved, CASE WHEN source_bytes > 0 THEN 1.0::DOUBLE - output_bytes::DOUBLE / source_bytes::DOUBLE END AS size_reduction_fraction FROM t""",
        "extreme_pages": f"WITH {PM} SELECT doc_id, arg_max(page_index, (us, page_index)) AS slowest, arg_max(page_index, (ccitt_bytes, page_index)) AS largest, arg_min(page_index, (ccitt_bytes, page_index)) AS smallest FROM pm GROUP BY doc_id",
        "duration_stats": "SELECT user_id, count(us) AS pages, min(us) AS least, max(us) AS most, avg(us) AS mean, quantile_cont(us::DOUBLE, 0.5) AS median FROM (SELECT user_id, floor(value * 1000)::BIGINT AS us FROM events) GROUP BY user_id",
        "metadata_sanitize": r"""SELECT page_id, nullif(substring(regexp_replace(regexp_replace(html, '[\x00-\x1F\x7F-\x{9F}]', '', 'g'), '^\s+|\s+$', '', 'g'), 1, 512), '') AS title, CAST(NULL AS VARCHAR) AS nothing, string_split(url, '/')[-1] AS name FROM pages""",
        "source_digests": "SELECT doc_id, strlen(text)::BIGINT AS length, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY text) AS first_doc, count(*) OVER (PARTITION BY text) AS copies FROM documents",
        "source_identity": """WITH d AS (SELECT doc_id, source, strlen(text)::BIGINT AS length, CASE WHEN lang = 'en' THEN sha256(text) END AS sha256 FROM documents),
f AS (SELECT length, min(doc_id) AS first_doc FROM d GROUP BY length)
SELECT d.doc_id, length, first_doc, coalesce(CASE WHEN d.sha256 IS NULL OR o.sha256 IS NULL THEN d.source = o.source ELSE d.sha256 = o.sha256 END, false) AS same
FROM d JOIN f USING (length) JOIN d o USING (length) WHERE o.doc_id = first_doc""",
    }
