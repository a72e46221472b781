"""Intermediate tables in the folder that all executors share.

The folder is the one that the session names in ``spark.checkpoint.dir``. Only where the session
names none and runs in local mode (tests), a temporary folder is made.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if current := sc._jsc.sc().getCheckpointDir():
        if current.isDefined():
            return current.get().rstrip("/")
    if not sc.master.startswith(("local[", "local")) or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="lumenfold-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back: its lineage is cut."""
    return df.sparkSession.read.parquet(written_path(df, name))


def written_path(df: DataFrame, name: str) -> str:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to any more.

    It does so when the driver collects garbage, which may be long after a large shuffle is done with.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return
