"""Keys that very many rows hold.

A sample of about ``SAMPLE`` rows holds fewer than ``SAMPLE / SEEN`` keys ``SEEN`` times, at any size of
the data, so a table of them can be broadcast; all other keys are small beside a task. What is common
decides only which way rows take, never a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 1 << 22
SEEN = 8
SMALL_BYTES = 64 << 20  # ids of up to so many bytes are broadcast
HEAVY = 1 << 16  # keys with more than this part of all rows are heavy; there are fewer than this


def heavy(table: DataFrame, count: str) -> DataFrame:
    """Rows of ``table`` whose ``count`` is more than 1 and a ``HEAVY`` part of all counts."""
    total = table.agg(F.sum(count)).first()[0] or 0
    return table.where(F.col(count) > max(1, total // HEAVY))


def share(rows: DataFrame, table: DataFrame, on: list[str], count: str) -> DataFrame:
    """``rows`` left-joined with ``table``, of which column ``count`` says how many rows each key has.

    Heavy keys are broadcast, so no task gets all rows of one.
    """
    hot = F.broadcast(heavy(table, count))
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(table.join(hot, on, "left_anti"), on, "left"))


def only(rows: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """``rows`` whose column ``on`` is in ``ids`` (``left_anti``: isn't), a written table of one distinct long.

    Small tables are broadcast. Otherwise both are shuffled, by a column that has one row in ``ids``.
    """
    return rows.join(F.broadcast(ids) if 8 * ids.count() <= SMALL_BYTES else ids, on, how)
