"""The raster benchmark: every run over every page, metrics, aggregates and a report."""

from __future__ import annotations

import platform

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BASELINE_RUNS, Run
from ..operators import pages as P
from ..sources import fixtures, manifests, suite

FIXTURE = "page_id long, page_name string, category string, width int, height int, pixels binary, truth binary, " + f"rois {P.ROI}"


def fixture_rasters(spark: SparkSession) -> DataFrame:
    """The twelve synthetic pages; ``page_id`` is the place in the suite."""
    rows = [
        (i, p.page_id, p.page_id, fixtures.WIDTH, fixtures.HEIGHT, bytearray(p.gray.tobytes()), bytearray(p.truth.astype("uint8").tobytes()), [tuple(r) for r in p.rois])
        for i, p in enumerate(fixtures.pages())
    ]
    return spark.createDataFrame(rows, FIXTURE)


def page_results(rasters: DataFrame, runs: tuple[Run, ...]) -> DataFrame:
    rows = P.scored(P.measure(rasters, runs, encode=True))
    return rows.withColumn("bytes_per_megapixel", F.col("encoded_bytes") / (F.col("width").cast("long") * F.col("height") / 1e6))


def run_report(results: DataFrame) -> DataFrame:
    """Aggregates, worst pages and coded bytes of each run, in one pass over the results."""
    sizes = (F.min("pos").alias("pos"), F.sum("encoded_bytes").alias("encoded_bytes"), F.avg("bytes_per_megapixel").alias("mean_bytes_per_megapixel"))
    largest = F.max_by("page_id", F.struct("encoded_bytes", "page_id")).alias("largest_page")
    return P.aggregate(results, "run_id", more=(*sizes, *P.worst_columns(), largest)).orderBy("pos")


def roi_report(results: DataFrame) -> DataFrame:
    """Aggregates of tagged regions by run and tag."""
    return P.aggregate(P.scored(P.roi_rows(results)).where("tag IS NOT NULL"), "run_id", "tag")


def environment(spark: SparkSession) -> dict[str, str]:
    """What a report says of where it was made: no host, no user."""
    return {"os": platform.system().lower(), "arch": platform.machine(), "spark": spark.version}


def golden(spark: SparkSession) -> DataFrame:
    """The published comparison of three methods over the synthetic suite."""
    return run_report(page_results(fixture_rasters(spark), BASELINE_RUNS))


def validate(spark: SparkSession, dataset: str, profile: str, schemas: tuple[str, str] = (suite.DATASET, suite.PROFILE)) -> DataFrame:
    """The pages of a dataset, checked with their files, sizes and regions, and nothing run; a bad one stops the query."""
    manifests.load_profile(profile, schemas[1], spark)
    pages = manifests.load_pages(spark, manifests.load_dataset(dataset, schemas[0], spark))
    return pages.select("page_id", "page_name", "category", "width", "height", F.length("pixels").alias("pixels"), F.size("rois").alias("rois"))


def from_manifests(spark: SparkSession, dataset: str, profile: str, schemas: tuple[str, str] = (suite.DATASET, suite.PROFILE)) -> DataFrame:
    """Results of every run of a profile over every page of a dataset; see `run_report` and `roi_report`."""
    runs = manifests.load_profile(profile, schemas[1], spark)
    return page_results(manifests.load_pages(spark, manifests.load_dataset(dataset, schemas[0], spark)), runs)


def report_json(report: DataFrame) -> DataFrame:
    """One JSON envelope for each run; null fields are left out."""
    body = F.struct(*[F.col(c) for c in report.columns])
    return report.select(F.to_json(F.struct(F.lit("lumenfold-benchmark").alias("schema"), F.lit("1.0").alias("schema_version"), body.alias("result"))).alias("report"))
