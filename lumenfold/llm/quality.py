"""Quality classifier learnt from positives and unlabelled texts.

Features are rates over whole texts: classes of bytes and of neighbouring bytes, word lengths,
repeated words, word triples and lines. A network of one hidden layer minimises the non-negative
unbiased risk of positive-unlabelled learning with the logistic loss:

    pi R_p(+)  +  max(0, R_u(-) - pi R_p(-))

with trusted positives p, unlabelled web text u and the class prior pi. The prior is estimated from
the trusted labels' rate where they hold both classes; where they hold positives only, from the
least ratio of unlabelled to positive texts above a score. Labels other than positives aren't
used in any other way. Its output is the logit of the posterior, so the score is a probability.

Fitting reads at most about ``sample_rows`` positives and as many unlabelled texts (a documented
bound, drawn by a hash of the id over the whole tables); scoring is a map over all documents.

Defined results: null or empty text has the score of features that are all zero; a null ``doc_id``
isn't learnt from and is never held out; repeated rows have equal scores; of labels that
repeat an id the larger holds; other columns are ignored;
without any positive label every score is the prior, 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._words import releasing, rolling, slices, words

CLASSES = 12
_CLASS = np.full(256, 11, np.int64)  # other ASCII signs
_CLASS[0:32] = 10
for _k, _signs in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!?", b"'\"()-")):
    _CLASS[list(_signs)] = _k
_CLASS[128:] = 9
N_FEATURES = CLASSES + CLASSES * CLASSES + 12


def _rate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _distinct(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Distinct values of ``h`` in each document."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.empty(0, bool)
    return np.bincount(doc[new], minlength=docs)


def features(texts: pa.Array) -> np.ndarray:
    """A row of ``N_FEATURES`` for each text."""
    n = len(texts)
    w = words(texts)
    lines = words(texts, spaces=b"\n\r")
    from ._words import buffers

    offsets, data = buffers(texts)
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    kind = _CLASS[data]
    one = np.bincount(doc * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    inner = doc[1:] == doc[:-1]
    two = np.bincount((doc[1:] * CLASSES * CLASSES + kind[:-1] * CLASSES + kind[1:])[inner], minlength=n * CLASSES * CLASSES).reshape(n, -1)
    n_words = np.diff(w.cuts)
    own = np.repeat(np.arange(n), n_words)
    length = np.minimum(w.ends - w.starts, 100).astype(float)
    mean = _rate(np.bincount(own, length, n), n_words)
    square = _rate(np.bincount(own, length**2, n), n_words)
    grams = rolling(w.hashes, 3, 5)
    inside = (own[2:] == own[:-2]) if len(own) > 2 else np.empty(0, bool)
    gram_doc = own[:-2][inside] if len(own) > 2 else own[:0]
    n_lines = np.diff(lines.cuts)
    line_doc = np.repeat(np.arange(n), n_lines)
    shape = [
        np.log1p(n_words) / 10,
        np.log1p(size) / 12,
        mean / 10,
        np.sqrt(np.maximum(square - mean**2, 0)) / 10,
        _rate(np.bincount(own[length == 1], minlength=n), n_words),
        _rate(np.bincount(own[length >= 15], minlength=n), n_words),
        _rate(_distinct(w.hashes, own, n), n_words),
        _rate(_distinct(grams[inside] if len(own) > 2 else grams[:0], gram_doc, n), n_words - 2),
        _rate(_distinct(lines.hashes, line_doc, n), n_lines),
        np.log1p(n_lines) / 8,
        _rate(n_lines, n_words),
        (n_words < 8).astype(float),
    ]
    return np.hstack([_rate(one, size[:, None]), _rate(two, size[:, None]), np.stack(shape, 1)]).astype(np.float32)


def batches_of_features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    for lo, hi in slices(texts):
        yield lo, hi, features(texts.slice(lo, hi - lo))


def feature_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, x in batches_of_features(b.column(0)):
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), pa.array(x.ravel()))], ["x"])

    return docs.select("text").mapInArrow(releasing(run), "x array<float>")


@dataclass
class Model:
    """``center`` and ``spread`` scale features; one hidden layer follows."""

    center: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.spread, -8, 8)
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(float), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 32, steps: int = 1200, batch: int = 512, rate: float = 3e-3, decay: float = 1e-3, seed: int = 7) -> Model:
    """Minimise the non-negative risk by Adam; where it turns negative, step back up as the method asks."""
    rng = np.random.default_rng(seed)
    both = np.vstack([positive, unlabelled])
    center, spread = both.mean(0), both.std(0) + 1e-3
    k = both.shape[1]
    params = [rng.normal(0, np.sqrt(2 / k), (k, hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, np.sqrt(1 / hidden), hidden).astype(np.float32), np.array([np.log(prior / (1 - prior))], np.float32)]
    m, v, mean = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    zp, zu = (np.clip((x - center) / spread, -8, 8).astype(np.float32) for x in (positive, unlabelled))
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    for t in range(1, steps + 1):
        x = np.vstack([zp[rng.integers(0, len(zp), batch)], zu[rng.integers(0, len(zu), batch)]])
        h = np.maximum(x @ params[0] + params[1], 0)
        g = h @ params[2] + params[3]
        p, u = g[:batch], g[batch:]
        negative = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        if negative >= 0:
            dg = np.r_[-prior * sigmoid(-p) - prior * sigmoid(p), sigmoid(u)] / batch
        else:
            dg = np.r_[prior * sigmoid(p), -sigmoid(u)] / batch
        dh = np.outer(dg, params[2]) * (h > 0)
        grads = [x.T @ dh + decay * params[0], dh.sum(0), h.T @ dg + decay * params[2], dg.sum(keepdims=True)]
        step = rate * (1 - t / (steps + 1))
        for i, gr in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * gr
            v[i] = 0.999 * v[i] + 0.001 * gr**2
            params[i] = (params[i] - step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            if t > steps // 2:
                mean[i] += params[i] / (steps - steps // 2)
    return Model(center, spread, mean[0], mean[1], mean[2], float(mean[3][0]), prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of both above any score of a first fit."""
    model = fit(positive, unlabelled, 0.5, steps=400)
    p, u = np.sort(model.logits(positive)), np.sort(model.logits(unlabelled))
    at = np.quantile(p, np.linspace(0.05, 0.9, 40))
    above = lambda x: 1 - np.searchsorted(x, at) / len(x)
    error = 1 / np.sqrt(len(u))
    return float(np.clip(((above(u) + error) / np.maximum(above(p) - error, 1e-6)).min(), 0.05, 0.99))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _part(rows: DataFrame, most: int, n: int) -> DataFrame:
    """About ``most`` of the ``n`` rows, by a hash of the id."""
    return rows if n <= most else rows.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Model:
    """Fit on the rows of ``labels`` and ``docs`` that aren't held out."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy((F.col("quality") == 1).alias("quality")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = counts.get(True, 0), counts.get(False, 0)
    width = N_FEATURES
    nothing = Model(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), 0.0, 0.5)
    if not n1:
        return nothing
    trusted = _part(known.where("quality = 1").select("doc_id"), sample_rows, n1)  # bounded by sample_rows
    open_docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    marked = open_docs.join(F.broadcast(trusted.withColumn("trusted", F.lit(True))), "doc_id", "left")
    n = docs.count()
    web = F.pmod(F.xxhash64("doc_id", F.lit("web")), F.lit(1 << 30)) < int(min(1.0, sample_rows / max(n, 1)) * (1 << 30))
    taken = marked.withColumn("web", web).where("trusted OR web")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, x in batches_of_features(b.column("text")):
                cuts = np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES
                yield pa.record_batch([*(b.column(c).slice(lo, hi - lo) for c in ("doc_id", "h", "trusted", "web")), pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.ravel()))], ["doc_id", "h", "trusted", "web", "x"])

    rows = taken.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce("trusted", F.lit(False)).alias("trusted"), "web", "text")
    table = rows.mapInArrow(releasing(run), "doc_id long, h long, trusted boolean, web boolean, x array<float>").toArrow()
    if not table.num_rows:
        return nothing
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES)
    order = np.lexsort((table.column("h").to_numpy(), table.column("doc_id").to_numpy()))  # must not depend on tasks
    x, p, u = x[order], table.column("trusted").to_numpy()[order], table.column("web").to_numpy()[order]
    if not p.any() or not u.any():
        return nothing
    prior = float(np.clip(n1 / (n1 + n0), 0.02, 0.98)) if n0 else estimate_prior(x[p], x[u])
    return fit(x[p], x[u], prior)


def score(docs: DataFrame, model: Model, cut: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document, and columns to keep."""
    others = [c for c in keep if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", *others)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text" or "text" in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, x in batches_of_features(b.column("text")):
                part = b.slice(lo, hi - lo)
                if "text" not in keep:
                    part = part.drop_columns(["text"])
                s = model.scores(x)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= cut).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    return rows.mapInArrow(releasing(run), schema + ", score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.3, sample_rows: int = 20_000) -> DataFrame:
    return score(docs, learn(docs, labels, sample_rows), cut)
