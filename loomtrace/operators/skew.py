"""Joins whose keys may be held by a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_ROWS = 1000
HEAVY_KEYS = 1000


def join_heavy(rows: DataFrame, table: DataFrame, keys: list[str], total: int, count: str = "n") -> DataFrame:
    """rows inner-joined with ``table``, which has one row a key and the number of the key's rows in ``count`` (dropped).

    Keys of over max(HEAVY_ROWS, total / HEAVY_KEYS) rows are HEAVY_KEYS at most: their part of the table is
    broadcast, so no task gathers a heavy key's rows; all other keys are joined as usual. ``table`` is read three
    times: give a written one."""
    bar = max(HEAVY_ROWS, total // HEAVY_KEYS)
    heavy = table.where(F.col(count) > bar).drop(count)
    light = table.where(F.col(count) <= bar).drop(count)
    if total <= HEAVY_ROWS or heavy.isEmpty():
        return rows.join(table.drop(count), keys)
    held = rows.join(F.broadcast(heavy), keys)
    return held.unionByName(rows.join(F.broadcast(heavy.select(keys)), keys, "left_anti").join(light, keys))
