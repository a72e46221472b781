"""Running queries under a tag, so that others can cancel them between stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started inside carry ``tag``."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> list[str]:
    """Interrupt all jobs with this tag; nothing that they write is committed."""
    return spark.interruptTag(tag)


def progress(spark: SparkSession, tell: Callable[[int, int], None]) -> None:
    """Tell the number of finished and of all tasks of the running stages."""
    tracker = spark.sparkContext.statusTracker()
    done = total = 0
    for stage in tracker.getActiveStageIds():
        if info := tracker.getStageInfo(stage):
            done, total = done + info.numCompletedTasks, total + info.numTasks
    tell(done, total)
