"""Top-k against a full matrix product, media round trips, held-out accuracy of the classifier."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lumenfold.llm import media, quality, topk


def test_top_k(spark):
    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(np.round(r.normal(0, 0.15, (700, 16)), 1))]
    rows += [(701, None, 0), (702, [1.0] * 15 + [None], 0), (703, [1.0] * 15 + [float("nan")], 0), (720, [float("inf")] * 16, 0), (740, [0.5] * 16, 0), (741, [0.5] * 16, 0), (742, [0.1, 0.2], 0), (None, [0.5] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for g in topk.top_k(df, 20, 64.0, 20, query_block=16, row_block=128).collect():
        got.setdefault(g.query_id, []).append((g["rank"], g.vec_id, g.score))
    good = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    for q, v in good:
        if q % 20 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:20]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.top_k(df.limit(0)).count() == 0


def test_repeated_rows_are_one_query(spark):
    rows = [(20, [1.0, 0.0])] * 3 + [(20, [0.0, 1.0]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [0.25, 1000.0]), (3, [-1.0, -70000.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 4).collect()
    first = [(64 * 64, 1), (64 * 64, 1), (64 * 16, 2), (-64 * 64, 3)]  # of [1, 0]
    second = [(64 * 64000, 2), (64 * 32, 1), (64 * 32, 1), (-64 * 64 * 70000, 3)]  # of [0, 1]
    want = sorted((20, k + 1, i, s) for best in (first, second) for k, (s, i) in enumerate(best))
    assert sorted((g.query_id, g["rank"], g.vec_id, g.score) for g in got) == want


def test_sliced_index_ties_and_few_rows():
    index = topk.SlicedIndex(np.zeros((5, 3), np.int64))
    assert index.top(np.array([1, -2, 0]), 3, np.zeros(1, np.uint64)).tolist() == [0, 1, 2]
    assert index.top(np.array([0, 0, 0]), 9, np.array([1], np.uint64)).tolist() == [1, 2, 3, 4]


def test_media(make_docs, edge_rows):
    rows = edge_rows + [(20, "x" * 576), (21, "abc " * 30_000), (22, "x" * 576)]
    stored = media.encode(make_docs(rows), 576)
    assert sorted(str(g.doc_id) for g in stored.collect()) == sorted(str(r[0]) for r in rows)
    by = {}
    for g in media.features(stored).collect():
        by.setdefault(g.doc_id, []).append(g)
    for i, text in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        found = [g for g in by[i] if g.payload_sha256 == hashlib.sha256(payload).hexdigest()]
        assert found and found[0].n_bytes == len(raw) and found[0].tail_crc32 == zlib.crc32(payload[-32:]) and found[0].media_bytes == len(payload) + 44
    assert by[20][0][2:] == by[22][0][2:]
    assert media.features(media.encode(make_docs([]))).count() == 0


def test_a_tone_gives_pairs_of_its_bin():
    t = np.arange(8192)
    samples = (128 + 100 * np.sin(2 * np.pi * 32 * t / media.FRAME)).astype(np.uint8)
    assert (media.peaks(samples)[:, 1] == 32).all()
    codes, times = media.fingerprints(samples)
    assert len(codes) == len(times) > 0 and (np.diff(times) >= 0).all()
    assert media.from_wav(media.to_wav(samples.tobytes())) == samples.tobytes()


def test_every_sample_is_in_a_frame_and_every_band_is_paired():
    r = np.random.default_rng(9)
    for n in (1, 511, 512, 513, 576, 1152, 1728, 2304):
        x = r.integers(0, 256, n).astype(np.uint8)
        whole = np.r_[x, np.full(media.FRAME + (media.n_frames(n) - 1) * media.HOP - n, x[-1])]
        assert len(media.peaks(x)) == media.n_frames(n) and media.HOP * (media.n_frames(n) - 1) + media.FRAME >= n
        assert (media.peaks(x) == media.peaks(whole)).all()
    # texts that differ only in what was cut before
    a = r.integers(0, 256, 576).astype(np.uint8)
    b = a.copy()
    b[512:] = r.integers(0, 256, 64)
    assert media.fingerprints(a)[0].tolist() != media.fingerprints(b)[0].tolist()
    assert (media.peaks(np.full(576, 255, np.uint8)) == -1).all()
    x = r.integers(0, 256, 5000).astype(np.uint8)
    p = media.peaks(x).tolist()
    want = [(t, (u << 17) | (v << 8) | dt) for t in range(len(p)) for dt in range(1, 4) if t + dt < len(p) for u in p[t] if u >= 0 for v in p[t + dt] if v >= 0]
    codes, times = media.fingerprints(x)
    assert list(zip(times.tolist(), codes.tolist(), strict=True)) == want


def test_quality(make_docs, spark, edge_rows):
    r = random.Random(9)
    rows, labels = list(edge_rows), [(4, 1, 0), (None, 1, 0)]
    for i in range(100, 900):
        words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 9))) for _ in range(r.randint(20, 120))]
        good = r.random() < 0.8
        rows.append((i, " ".join(words).capitalize() + "." if good else " | ".join(w.upper() + "!!" for w in words)))
        if r.random() < 0.6:
            labels.append((i, int(good), 0))
    docs = make_docs(rows)
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(docs, truth).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3) for g in got)
    by = {g.doc_id: g for g in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows if i is not None)
    held = [(by[i].predicted, q) for i, q, _ in labels if i is not None and i >= 100 and by[i].held_out]
    assert len(held) > 30 and np.mean([p == q for p, q in held]) > 0.95
    again = {g.doc_id: g.score for g in quality.classify(docs, truth).collect()}
    assert all(again[i] == pytest.approx(by[i].score, abs=1e-6) for i in by)
    assert {g.score for g in quality.classify(docs, truth.limit(0)).collect()} == {0.5}
    assert quality.classify(make_docs([]), truth).count() == 0


def test_prior_without_negatives():
    r = np.random.default_rng(10)
    p, n = r.normal(2, 1, (2000, 6)), r.normal(-2, 1, (600, 6))
    unlabelled = np.vstack([r.normal(2, 1, (1400, 6)), n])
    assert abs(quality.estimate_prior(p, unlabelled) - 0.7) < 0.1
