"""The synthetic suite as files: PNG pages and masks, a dataset manifest and a profile."""

from __future__ import annotations

import json
import tempfile

import numpy as np
from pyspark.sql import SparkSession

from ..model import BASELINE_RUNS
from . import fixtures, manifests
from .rasters import png_bytes

DATASET, PROFILE = "lumenfold-dataset", "lumenfold-profile"


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file in any store that Spark reaches."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder that executors see: below the session's checkpoint folder, or a temporary one in local mode."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/{name}"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"{name}-")


def _toml(head: dict, table: str, rows: list[dict]) -> bytes:
    lines = [f"{k} = {json.dumps(v)}" for k, v in head.items()]
    for row in rows:
        lines.append(f"[[{table}]]")
        nested = {k: v for k, v in row.items() if isinstance(v, list)}
        lines += [f"{k} = {json.dumps(v)}" for k, v in row.items() if k not in nested]
        for key, parts in nested.items():
            for part in parts:
                lines += [f"[[{table}.{key}]]", *(f"{k} = {json.dumps(v)}" for k, v in part.items())]
    return "\n".join([*lines, ""]).encode()


def write_suite(spark: SparkSession, folder: str) -> tuple[str, str]:
    """Write all pages and both manifests; returns the manifests' paths."""
    pages = []
    for p in fixtures.pages():
        put(spark, f"{folder}/inputs/{p.page_id}.png", png_bytes(p.gray))
        put(spark, f"{folder}/truth/{p.page_id}.png", png_bytes(np.where(p.truth, 0, 255).astype(np.uint8)))
        regions = [{k: v for k, v in zip(("id", "x", "y", "width", "height", "tag"), (*(x if isinstance(x, str) else int(x) for x in r[:5]), r[5]), strict=True) if v is not None} for r in p.rois]
        pages.append({"id": p.page_id, "input": f"inputs/{p.page_id}.png", "ground_truth": f"truth/{p.page_id}.png", "category": p.page_id, "rois": regions})
    head = {"schema": DATASET, "schema_version": manifests.VERSION, "id": "synthetic", "title": "Synthetic pages", "license": "generated", "provenance": "generated", "ground_truth_method": "by construction", "ground_truth_polarity": "black_is_zero"}
    put(spark, f"{folder}/dataset.toml", _toml(head, "pages", pages))
    settings = [{k: v for k, v in {"id": r.run_id, "dpi": r.dpi, "method": r.method, "threshold": r.threshold}.items() if v is not None} for r in BASELINE_RUNS]
    put(spark, f"{folder}/profile.toml", _toml({"schema": PROFILE, "schema_version": manifests.VERSION, "id": "baseline"}, "runs", settings))
    return f"{folder}/dataset.toml", f"{folder}/profile.toml"
