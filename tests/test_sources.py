"""Manifests, images and the published benchmark."""

import numpy as np
import pytest

from lumenfold.model import InputError, ResourceLimit, UnsupportedInput
from lumenfold.plans import benchmark, report_queries
from lumenfold.sources import fixtures, manifests, rasters, suite

HEAD = 'schema = "d"\nschema_version = "1.0"\nid = "x"\ntitle = "t"\nlicense = "l"\nprovenance = "p"\nground_truth_method = "g"\n'
PAGE = '[[pages]]\nid = "{0}"\ninput = "{1}"\nground_truth = "g.png"\ncategory = "c"\n'


def test_dataset_manifest(tmp_path, spark):
    f = tmp_path / "d.toml"
    f.write_text(HEAD + PAGE.format("a", "i/a.png") + PAGE.format("b", "b.png"))
    d = manifests.load_dataset(f, "d")
    assert [r.page_id for r in d.frame(spark).orderBy("pos").collect()] == ["a", "b"]
    for body, error in ((PAGE.format("a", "../x.png"), InputError), (PAGE.format("a", "x.png") * 2, InputError), ("", ResourceLimit)):
        f.write_text(HEAD + body)
        with pytest.raises(error):
            manifests.load_dataset(f, "d")
    with pytest.raises(InputError):
        manifests.load_dataset(f, "other")


def test_profile(tmp_path):
    f = tmp_path / "p.toml"
    f.write_text('schema = "p"\nschema_version = "1.0"\nid = "x"\n[[runs]]\nid = "o"\ndpi = 300\nmethod = "otsu"\n[[runs]]\nid = "s"\ndpi = 600\nmethod = "sauvola"\n')
    runs = manifests.load_profile(f, "p")
    assert [r.run_id for r in runs] == ["o", "s"] and runs[1].window_size == 33


def test_png_round_trip_and_image_source(tmp_path, spark):
    p = np.random.default_rng(2).integers(0, 256, (9, 13)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(rasters.png_bytes(p))
    assert (rasters.gray_png(rasters.png_bytes(p)) == p).all()
    row = rasters.from_images(spark, str(tmp_path)).first()
    assert (np.frombuffer(row.pixels, np.uint8).reshape(9, 13) == p).all()
    assert len(rasters.digests(spark, str(tmp_path)).first().sha256) == 64
    with pytest.raises(InputError):
        rasters.truth_mask(p)
    assert rasters.truth_mask(np.array([[0, 255]], np.uint8), "black_is_255").tolist() == [[False, True]]


def test_pngs_of_all_kinds():
    import struct
    import zlib

    r = np.random.default_rng(5)

    def png(samples, depth, colour, filters=None, plte=b""):
        h, w, n = samples.shape
        body = samples.astype(">u2").tobytes() if depth == 16 else samples.astype(np.uint8).tobytes() if depth == 8 else np.packbits(np.unpackbits(samples.astype(np.uint8)[:, :, 0, None], axis=2)[:, :, -depth:].reshape(h, -1), axis=1).tobytes()
        rows = np.frombuffer(body, np.uint8).reshape(h, -1)
        step, out = max(1, n * depth // 8), bytearray()
        for y in range(h):
            kind = filters[y % len(filters)] if filters else 0
            line, up = rows[y].astype(int), rows[y - 1].astype(int) if y else np.zeros(rows.shape[1], int)
            left, corner = (np.r_[np.zeros(step, int), x[:-step]] for x in (line, up))
            p = left + up - corner
            paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
            out += bytes([kind]) + ((line - (0, left, up, (left + up) // 2, paeth)[kind]) % 256).astype(np.uint8).tobytes()
        chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + (chunk(b"PLTE", plte) if plte else b"") + chunk(b"IDAT", zlib.compress(bytes(out))) + chunk(b"IEND", b"")

    gray = r.integers(0, 256, (11, 7, 1))
    for filters in (None, (0, 1, 2, 3, 4)):
        assert (rasters.decode_png(png(gray, 8, 0, filters)) == gray[:, :, 0]).all()
        assert (rasters.gray_png(png(gray, 8, 0, filters)) == gray[:, :, 0]).all()
        assert (rasters.decode_png(png(gray * 257, 16, 0, filters)) == gray[:, :, 0]).all()
        assert (rasters.decode_png(png(np.concatenate([gray, gray], 2), 8, 4, filters)) == gray[:, :, 0]).all()
        assert (rasters.decode_png(png(np.repeat(gray, 3, 2), 8, 2, filters)) == gray[:, :, 0]).all()
    assert (rasters.decode_png(png(gray % 2, 1, 0)) == gray[:, :, 0] % 2 * 255).all()
    assert (rasters.decode_png(png(gray % 4, 8, 3, plte=bytes([v for k in range(4) for v in (k * 50,) * 3]))) == gray[:, :, 0] % 4 * 50).all()
    with pytest.raises(InputError):
        rasters.gray_png(png(np.concatenate([gray, gray], 2), 8, 4))
    for w, h in ((20_001, 1), (20_000, 10_001)):
        with pytest.raises(ResourceLimit):
            rasters.decode_png(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", w, h, 8, 0, 0, 0, 0) + bytes(4))
    for bad in (b"", b"\x89PNG\r\n\x1a\n", png(gray, 8, 0)[:60]):
        with pytest.raises(InputError):
            rasters.decode_png(bad)


def test_benchmark_from_files(tmp_path, spark):
    dataset, profile = suite.write_suite(spark, str(tmp_path))
    rows = benchmark.validate(spark, dataset, profile).collect()
    assert len(rows) == 12 and all((r.width, r.height, r.pixels) == (160, 200, 32_000) for r in rows)
    assert sorted(r.page_name for r in rows) == sorted(p.page_id for p in fixtures.pages())
    results = benchmark.from_manifests(spark, dataset, profile)
    got = {r.run_id: r for r in benchmark.run_report(results).collect()}
    assert got["otsu-300"].encoded_bytes == 11568 and got["sauvola-300-default"].encoded_bytes == 11551 and got["manual-300-128"].encoded_bytes == 10989
    assert {round(r.macro_f1, 4) for r in got.values()} == {0.9949, 0.9934, 0.9115}
    tags = {(r.run_id, r.tag): (r.page_count, r.macro_f1) for r in benchmark.roi_report(results).collect()}
    assert tags["otsu-300", "diacritic"] == (63, 1.0) and tags["otsu-300", "apparatus"] == (9, 1.0)
    text = (tmp_path / "dataset.toml").read_text()
    suite.put(spark, dataset, text.replace("width = ", "width = 9", 1).encode())
    with pytest.raises(Exception, match="a region leaves its page"):
        benchmark.validate(spark, dataset, profile).collect()
    suite.put(spark, dataset, text.replace(".png", ".jpg", 1).encode())
    with pytest.raises(UnsupportedInput):
        benchmark.validate(spark, dataset, profile)


def test_fixture_ink():
    ink = {p.page_id: int(p.truth.sum()) for p in fixtures.pages()}
    assert (ink["clean_text"], ink["broken_strokes"], ink["dense_apparatus_density"], ink["synthetic_diacritic_detail"]) == (8400, 8200, 6312, 4144)


def test_published_benchmark(spark):
    rows = {r.run_id: r for r in report_queries.benchmark_golden(spark, "").collect()}
    o, s, m = rows["otsu-300"], rows["sauvola-300-default"], rows["manual-300-128"]
    assert (o.macro_f1, o.micro_f1, o.mean_drd, o.max_drd, o.encoded_bytes) == (0.9949, 0.9946, 0.1385, 1.1038, 11568)
    assert (s.macro_f1, s.micro_f1, s.mean_drd, s.max_drd, s.encoded_bytes) == (0.9934, 0.9927, 0.2260, 1.6079, 11551)
    assert (m.macro_f1, m.micro_f1, m.mean_drd, m.max_drd, m.encoded_bytes) == (0.9115, 0.9479, 1.5559, 17.0096, 10989)
    report = benchmark.golden(spark)
    low = {r.run_id: fixtures.pages()[r.lowest_f1_page].page_id for r in report.collect()}
    assert low == {"otsu-300": "blur", "sauvola-300-default": "blur", "manual-300-128": "faint_text"}
    assert benchmark.report_json(report).count() == 3


def test_texts_with_null_empty_and_wide_characters(spark):
    df = spark.createDataFrame([(1, "c", None), (2, "c", ""), (3, None, "a\U0001f600" * 40)], "page_id long, category string, text string")
    rows = rasters.from_texts(df).collect()
    assert [(r.page_id, r.width, r.height) for r in rows] == [(3, 64, 2)] and rows[0].pixels[1] == 0x1F600 % 256 and rows[0].pixels[-1] == 255
