"""Page kernels against brute force, hand-computed cases and the relational forms."""

from collections import deque

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.functions import reports as R
from lumenfold.model import InvalidParameter, Run, sauvola_window_for_dpi
from lumenfold.operators import g4, kernels, pages, pdf

RNG = np.random.default_rng(11)


def page(h, w):
    return RNG.integers(0, 256, (h, w)).astype(np.uint8)


def window(p, y, x, r):
    return p[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].astype(np.int64)


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (7, 3), (20, 31)])
def test_windows_match_brute_force(shape):
    p = page(*shape)
    mean = np.array([[window(p, y, x, 2).sum() // window(p, y, x, 2).size for x in range(shape[1])] for y in range(shape[0])])
    assert (kernels.box_mean(p, 2) == mean).all()
    k = float(np.float32(0.2))
    local = np.zeros(shape, bool)
    for y in range(shape[0]):
        for x in range(shape[1]):
            w = window(p, y, x, 2)
            m = w.sum() / w.size
            local[y, x] = p[y, x] <= m * (1.0 + k * (np.sqrt(max((w * w).sum() / w.size - m * m, 0.0)) / 128.0 - 1.0))
    assert (kernels.sauvola(p, 5) == local).all()


def test_median_leaves_borders():
    p = page(9, 8)
    out = kernels.median3(p)
    assert (out[0] == p[0]).all() and (out[:, -1] == p[:, -1]).all()
    assert out[4, 4] == int(np.median(p[3:6, 3:6]))
    assert (kernels.median3(p[:2]) == p[:2]).all()


@pytest.mark.parametrize("most", [1, 4, 12])
def test_despeckle_matches_flood_fill(most):
    for _ in range(30):
        m = RNG.random((13, 17)) < 0.45
        out, seen = m.copy(), np.zeros_like(m)
        for y, x in zip(*np.nonzero(m), strict=True):
            if not seen[y, x]:
                queue, found = deque([(y, x)]), []
                seen[y, x] = True
                while queue:
                    a, b = queue.popleft()
                    found.append((a, b))
                    for u, v in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= u < 13 and 0 <= v < 17 and m[u, v] and not seen[u, v]:
                            seen[u, v] = True
                            queue.append((u, v))
                if len(found) <= most:
                    out[tuple(zip(*found, strict=True))] = False
        assert (kernels.despeckle(m, most) == out).all()


def test_uniform_pages():
    for v, black in ((0, True), (200, False)):
        p = np.full((4, 4), v, np.uint8)
        assert kernels.otsu(kernels.histogram(p)) == 0
        assert (p <= 0).all() == black
    assert not kernels.sauvola(np.full((9, 9), 128, np.uint8)).any()


def test_contrast_identity_and_rounding():
    p = np.arange(256, dtype=np.uint8).reshape(16, 16)
    assert kernels.contrast(p, 0.0) is p
    assert kernels.contrast(p, 0.5)[0, 0] == 0 and kernels.contrast(p, 0.5)[15, 15] == 255
    assert kernels.contrast(np.array([[129]], np.uint8), 0.5)[0, 0] == 130


def test_confusion_cases(spark):
    out, truth = np.array([[1, 1], [0, 0]], bool), np.array([[1, 0], [0, 0]], bool)
    assert kernels.confusion(out, truth) == (1, 1, 0, 2)
    with pytest.raises(ValueError):
        kernels.confusion(out, truth[:1])
    cases = [(1, 1, 0, 0.5, 1.0, 2 / 3), (0, 0, 3, 0.0, 0.0, 0.0), (0, 0, 0, 1.0, 1.0, 1.0), (0, 2, 0, 0.0, 1.0, 0.0), (4, 0, 0, 1.0, 1.0, 1.0)]
    rows = spark.createDataFrame([c[:3] for c in cases], "tp long, fp long, fn long").withColumns(R.f_measure(F.col("tp"), F.col("fp"), F.col("fn"))).collect()
    for r, c in zip(rows, cases, strict=True):
        assert (r.precision, r.recall, r.f1) == pytest.approx(c[3:])


def test_drd_against_direct_sum():
    out, truth = RNG.random((9, 11)) < 0.5, RNG.random((9, 11)) < 0.5
    total = 0.0
    norm = sum((dy * dy + dx * dx) ** -0.5 for dy in range(-2, 3) for dx in range(-2, 3) if dy or dx)
    for y, x in zip(*np.nonzero(out != truth), strict=True):
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                if dy or dx:
                    inside = 0 <= y + dy < 9 and 0 <= x + dx < 11
                    total += (bool(inside and truth[y + dy, x + dx]) != out[y, x]) * (dy * dy + dx * dx) ** -0.5 / norm
    counts = kernels.drd_counts(out, truth)
    assert sum(c * d**-0.5 for c, d in zip(counts, kernels.DISTANCES, strict=True)) / norm == pytest.approx(total)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 90), st.floats(0, 1), st.integers(0, 1 << 30))
def test_g4_round_trip(h, w, share, seed):
    m = np.random.default_rng(seed).random((h, w)) < share
    assert (g4.decode(g4.encode(m), w, h) == m).all()
    assert (kernels.unpack_bits(kernels.pack_bits(m), w, h) == m).all()


def test_g4_long_runs_and_bad_streams():
    for w in (2560, 5200):
        m = np.zeros((3, w), bool)
        m[1, 7 : w - 5] = True
        assert (g4.decode(g4.encode(m), w, 3) == m).all()
    for bad in (b"", b"\x00\x00\x00", b"\xff"):
        with pytest.raises(g4.G4Error):
            g4.decode(bad, 40, 9)


def test_relational_otsu_equals_kernel(spark):
    rasters = [(i, "c", 8, 8, bytearray((page(8, 8) // (i + 1)).tobytes())) for i in range(6)]
    df = spark.createDataFrame(rasters, "page_id long, category string, width int, height int, pixels binary")
    found = {r.page_id: r.threshold for r in pages.otsu_thresholds(pages.histograms(df)).collect()}
    for i, _, _, _, pixels in rasters:
        assert found[i] == kernels.otsu(np.bincount(np.frombuffer(pixels, np.uint8), minlength=256))


def test_pdf_is_deterministic_and_checked():
    one = [(16, 8, 72.0, 36.0, g4.encode(np.eye(8, 16, dtype=bool)))]
    data = pdf.build(one)
    assert data == pdf.build(one) and pdf.structure(data)["bilevel"]
    pdf.check(data, [(72.05, 36.0)])
    with pytest.raises(Exception, match="pages differ"):
        pdf.check(data, [(80.0, 36.0)])
    assert all(n > 0 for n in pdf.container_overhead())


def test_settings_are_validated():
    for bad in (Run("a", dpi=72), Run("a", method="manual"), Run("a", method="sauvola", window_size=4), Run("a", contrast=2.0), Run("a", despeckle="x")):
        with pytest.raises(InvalidParameter):
            bad.validate()
    assert [sauvola_window_for_dpi(d) for d in (300, 400, 600)] == [25, 33, 49]


def test_selection_and_samples(spark):
    assert R.parse_selection("1,3,2-4", 10) == [0, 1, 2, 3] and R.parse_selection("ALL", 3) == [0, 1, 2]
    for bad in ("", "0", "4-2", "11", "a"):
        with pytest.raises(InvalidParameter):
            R.parse_selection(bad, 10)
    rows = spark.createDataFrame([(100,), (5,), (1,), (0,)], "n int").select(R.sample_indices(F.col("n"), 8).alias("i")).collect()
    assert [list(r.i) for r in rows] == [[0, 14, 28, 42, 57, 71, 85, 99], [0, 1, 2, 3, 4], [0], []]
    px = spark.createDataFrame([(612.0, 792.0)], "w double, h double").select(R.page_pixels(F.col("w"), F.col("h"), 300).alias("p")).first().p
    assert (px.width_px, px.height_px) == (2550, 3300)


def test_same_source(spark):
    from pyspark.sql import functions as F

    cases = [
        (("a", 3, "x"), ("b", 3, "x"), True),
        (("a", 3, "x"), ("a", 3, "y"), False),
        (("a", 3, "x"), ("a", 4, "x"), False),
        (("a", 3, None), ("a", 3, "x"), True),
        (("a", 3, "x"), ("b", 3, None), False),
        (("a", 3, None), ("a", 3, None), True),
        ((None, 3, None), (None, 3, None), False),
        (("a", None, "x"), ("a", None, "x"), False),
    ]
    kind = "struct<path:string,length:long,sha256:string>"
    rows = spark.createDataFrame(cases, f"a {kind}, b {kind}, want boolean")
    assert rows.where(R.same_source(F.col("a"), F.col("b")) != F.col("want")).count() == 0
