"""Dataset and profile manifests (TOML), read and validated on the driver."""

from __future__ import annotations

import hashlib
import tomllib
from collections import Counter
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rasters
from ..model import MAX_PAGES, MAX_ROIS, MAX_RUNS, InputError, ResourceLimit, Run, UnsupportedInput

VERSION = "1.0"
PAGE = "page_id string, pos int, input string, ground_truth string, category string, tags array<string>, rois array<struct<roi_id:string,x:int,y:int,width:int,height:int,tag:string>>"


@dataclass(frozen=True)
class Dataset:
    root: str
    head: dict
    pages: tuple[dict, ...]
    digest: str

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(p["id"], i, p["input"], p["ground_truth"], p["category"], list(p.get("tags", [])), [(r["id"], r["x"], r["y"], r["width"], r["height"], r.get("tag")) for r in p.get("rois", [])]) for i, p in enumerate(self.pages)]
        return spark.createDataFrame(rows, PAGE)


def contained(root: Path, relative: str) -> Path:
    """A path below ``root``: no ``..``, not absolute, and no link that leads out."""
    p = Path(relative)
    if p.is_absolute() or ".." in p.parts:
        raise InputError("paths must stay inside the dataset", path=relative)
    full = (root / p).resolve()
    if not full.is_relative_to(root.resolve()):
        raise InputError("paths must stay inside the dataset", path=relative)
    return full


def _unique(ids: list[str], what: str) -> None:
    if twice := [k for k, n in Counter(ids).items() if n > 1]:
        raise InputError(f"{what} ids must be unique", ids=", ".join(sorted(twice)))


def _head(path: str | Path, schema: str, spark: SparkSession | None) -> tuple[dict, str]:
    raw = Path(path).read_bytes() if spark is None else bytes(spark.read.format("binaryFile").load(str(path)).first()["content"])
    try:
        data = tomllib.loads(raw.decode())
    except (UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise InputError("the manifest isn't valid TOML", reason=e) from e
    if data.get("schema") != schema or data.get("schema_version") != VERSION:
        raise InputError("unknown manifest schema or version", schema=data.get("schema"), version=data.get("schema_version"))
    return data, hashlib.sha256(raw).hexdigest()


def load_dataset(path: str | Path, schema: str, spark: SparkSession | None = None) -> Dataset:
    """The manifest at ``path``, whose ``schema`` name must be the given one; read by Spark if a session is given."""
    data, digest = _head(path, schema, spark)
    for key in ("id", "title", "license", "provenance", "ground_truth_method"):
        if not isinstance(data.get(key), str):
            raise InputError(f"{key} is missing")
    if data.get("ground_truth_polarity", "black_is_zero") not in ("black_is_zero", "black_is255", "black_is_255"):
        raise InputError("unknown polarity")
    pages = data.get("pages", [])
    if not 1 <= len(pages) <= MAX_PAGES:
        raise ResourceLimit(f"a dataset has 1 to {MAX_PAGES} pages", pages=len(pages))
    _unique([p["id"] for p in pages], "page")
    for p in pages:
        for key in ("input", "ground_truth"):
            contained(Path(path).parent, p[key])
            if Path(p[key]).suffix.lower() != ".png":
                raise UnsupportedInput("pages are PNG files", path=p[key])
        rois = p.get("rois", [])
        if len(rois) > MAX_ROIS:
            raise ResourceLimit(f"a page has up to {MAX_ROIS} regions", page=p["id"])
        _unique([r["id"] for r in rois], "region")
    return Dataset(str(path).rpartition("/")[0] or ".", data, tuple(pages), digest)


def load_profile(path: str | Path, schema: str, spark: SparkSession | None = None) -> tuple[Run, ...]:
    """The runs of a profile, each validated; their window defaults to 33 whatever the resolution."""
    data, _ = _head(path, schema, spark)
    rows = data.get("runs", [])
    if not 1 <= len(rows) <= MAX_RUNS:
        raise ResourceLimit(f"a profile has 1 to {MAX_RUNS} runs", runs=len(rows))
    _unique([r["id"] for r in rows], "run")
    out = []
    for r in rows:
        if r.get("method") != "sauvola" and {"k", "window_size", "dynamic_range"} & set(r):
            raise InputError("window, k and range are for sauvola only", run=r["id"])
        if "background_radius" in r and not r.get("background_normalization"):
            raise InputError("a radius needs background normalization", run=r["id"])
        out.append(Run(r["id"], **{k: v for k, v in r.items() if k != "id"}).validate())
    return tuple(out)


def load_pages(spark: SparkSession, dataset: Dataset) -> DataFrame:
    """Pages of a dataset with pixels, truth and regions; ``page_id`` is the place in the manifest.

    The manifest (``MAX_PAGES`` rows at most) is broadcast to the files; what is joined then are the
    two rasters of each page. Sizes and regions that don't fit stop the query.
    """
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+:)?/+", "/")  # noqa: E731  a file's path is spelt in several ways
    where = lambda c: plain(F.concat(F.lit(f"{dataset.root}/"), c))
    own = dataset.frame(spark).select(F.col("pos").cast("long").alias("page_id"), F.col("page_id").alias("page_name"), "category", "rois", where(F.col("input")).alias("input"), where(F.col("ground_truth")).alias("ground_truth"))

    def files(key: str) -> DataFrame:
        paths = sorted({f"{dataset.root}/{p[key]}" for p in dataset.pages})
        return spark.read.format("binaryFile").load(paths).select(plain(F.col("path")).alias(key), "content")

    named = F.broadcast(own.select("page_id", "page_name", "category", "rois", "input"))
    gray = rasters.decoded(files("input").join(named, "input").drop("input"), "pixels")
    listed = F.broadcast(own.select("page_id", "ground_truth"))
    truth = rasters.decoded(files("ground_truth").join(listed, "ground_truth").drop("ground_truth"), "truth", dataset.head.get("ground_truth_polarity", "black_is_zero"))
    both = gray.join(truth.select("page_id", "truth", F.col("width").alias("tw"), F.col("height").alias("th")), "page_id")
    fits = (F.col("width") == F.col("tw")) & (F.col("height") == F.col("th"))
    outside = F.exists("rois", lambda r: _outside(r, F.col("width"), F.col("height")))
    problem = F.when(~fits, F.lit("ground truth has another size than its page")).when(outside, F.lit("a region leaves its page"))
    sound = F.when(problem.isNotNull(), F.raise_error(F.concat(problem, F.lit(": "), F.col("page_name"))).cast("binary")).otherwise(F.col("pixels"))
    return both.select("page_id", "page_name", "category", "width", "height", sound.alias("pixels"), "truth", "rois")


def _outside(r: Column, width: Column, height: Column) -> Column:
    end = lambda a, n: r[a].cast("long") + r[n].cast("long")
    return (r["width"] < 1) | (r["height"] < 1) | (r["x"] < 0) | (r["y"] < 0) | (end("x", "width") > width) | (end("y", "height") > height)


def check_rois(pages: DataFrame) -> DataFrame:
    """Regions that are empty or leave their page, of pages with ``width`` and ``height``."""
    r = pages.select("page_id", "width", "height", F.explode("rois").alias("r"))
    return r.where(_outside(F.col("r"), F.col("width"), F.col("height"))).select("page_id", "r.roi_id")
