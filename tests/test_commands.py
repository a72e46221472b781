"""Commands over documents of pages, and files on the driver."""

import numpy as np
import pytest

from lumenfold.model import PRESETS, OutputError, Run
from lumenfold.operators import g4, kernels, pdf
from lumenfold.plans import commands
from lumenfold.sources import rasters, sinks
from lumenfold.streaming import jobs

SCHEMA = "doc_id long, page_index int, width int, height int, pixels binary"


@pytest.fixture(scope="module")
def docs(spark):
    r = np.random.default_rng(5)
    rows = [(d, i, 40, 30, bytearray(np.where(r.random((30, 40)) < 0.1 * (i % 5), 20, 240).astype(np.uint8).tobytes())) for d in (1, 2) for i in range(12)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_process_and_preview(docs):
    rows, df = docs
    found = {r.doc_id: r for r in commands.process(df, Run("otsu")).collect()}
    assert set(found) == {1, 2} and found[1].pages == 12
    assert pdf.structure(bytes(found[1].pdf))["bilevel"]
    again = {r.doc_id: bytes(r.pdf) for r in commands.process(df, Run("otsu")).collect()}
    assert again == {k: bytes(r.pdf) for k, r in found.items()}
    gray = np.frombuffer(rows[3][4], np.uint8).reshape(30, 40)
    assert (rasters.gray_png(commands.preview(df, Run("otsu"), 1, 3)) == np.where(gray <= 128, 0, 255)).all()


def test_page_sizes_and_report(docs, spark):
    from pyspark.sql import functions as F

    _, df = docs
    sized = df.where("page_index < 3").withColumns({"width_points": F.lit(612.0), "height_points": F.lit(792.0), "rotation": F.when(F.col("page_index") == 1, -90).otherwise(0)})
    made = commands.process(sized, Run("otsu")).cache()
    assert pdf.structure(bytes(made.first().pdf))["sizes"] == [(612.0, 792.0), (792.0, 612.0), (612.0, 792.0)]
    sizes = spark.createDataFrame([(1, 100_000), (2, 10)], "doc_id long, input_bytes long")
    rows = {r.doc_id: r for r in commands.process_report(made, Run("otsu"), sizes, commands.estimate(sized, Run("otsu"), 8)).collect()}
    for r in rows.values():
        assert r.pages == 3 and r.total_pixels == 3 * 1200 and 0 < r.black_pixels < r.total_pixels and r.bytes_per_page == r.output_bytes / 3
        assert r.encode_us > 0 and r.median_page_us > 0 and r.largest_page in (0, 1, 2) and r.slowest_page in (0, 1, 2)
        assert r.relative_error_fraction < 0.05 and r.fingerprint == Run("otsu").fingerprint()
    assert rows[1].absolute_bytes_saved == 100_000 - rows[1].output_bytes and 0 < rows[1].reduction_percent < 100
    assert rows[2].absolute_bytes_saved == 0 and rows[2].reduction_percent < 0


def test_analyze_counts_failed_pages(docs, spark):
    _, df = docs
    bad = df.union(spark.createDataFrame([(1, 99, 40, 30, bytearray(b"x"))], SCHEMA))
    rows = {r.doc_id: r for r in commands.analyze(bad, Run("otsu")).collect()}
    assert (rows[1].pages_analyzed, rows[1].pages_failed, rows[2].pages_failed) == (12, 1, 0)
    assert {r.pages_analyzed for r in commands.analyze(df, Run("otsu"), "1,3-4").collect()} == {3}


def test_estimate_is_near(docs):
    rows, df = docs
    size = {r.doc_id: len(r.pdf) for r in commands.process(df, Run("otsu")).collect()}
    for r in commands.estimate(df, Run("otsu"), 8).collect():
        assert abs(r.estimated_output_bytes - size[r.doc_id]) < 0.25 * size[r.doc_id]
        assert r.estimated_lower_bytes <= r.estimated_output_bytes <= r.estimated_upper_bytes and r.range_method == "quartiles"
    whole = {r.doc_id: r.estimated_output_bytes for r in commands.estimate(df, Run("otsu"), 32).collect()}
    coded = sum(len(g4.encode(np.frombuffer(p[4], np.uint8).reshape(30, 40) <= 128)) for p in rows if p[0] == 1)
    fixed, each = pdf.container_overhead()
    assert abs(whole[1] - (coded + fixed + 12 * each)) <= 1


def test_presets_and_inspect(spark):
    assert all(r.validate() for r in PRESETS.values()) and set(commands.info()["presets"]) == set(PRESETS)
    row = commands.inspect(spark.createDataFrame([(1, 0, 612.0, 792.0, -90), (1, 1, 1e6, 1e6, 45)], "doc_id long, page_index int, width_points double, height_points double, rotation int")).orderBy("page_index").collect()
    assert row[0].pixels_300 == (2550, 3300) and row[0].rotation == 270 and row[1].pixels_300 is None and row[1].rotation is None


def test_files(tmp_path):
    target = tmp_path / "a.pdf"
    sinks.write_atomic(sinks.check_destination(None, target), b"one")
    assert target.read_bytes() == b"one" and sinks.leftovers(tmp_path) == []
    for source, to in ((target, target), (None, tmp_path), (None, target), (None, tmp_path / "no" / "a")):
        with pytest.raises(OutputError):
            sinks.check_destination(source, to)
    assert sinks.check_destination(None, target, overwrite=True) == target
    assert rasters.gray_png(sinks.preview(np.eye(3, dtype=bool)))[0].tolist() == [0, 255, 255]
    assert kernels.unpack_bits(kernels.pack_bits(np.eye(3, dtype=bool)), 3, 3).trace() == 3


def test_tags(spark):
    with jobs.tagged(spark, "work"):
        assert "work" in spark.getTags() and spark.range(5).count() == 5
    assert "work" not in spark.getTags()
    seen = []
    jobs.progress(spark, lambda done, total: seen.append((done, total)))
    assert seen and jobs.cancel(spark, "nothing") == []
