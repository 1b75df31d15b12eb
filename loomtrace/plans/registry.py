"""All registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under its name, with its SQL oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


from loomtrace.plans import clustering, detections, evaluation, quality, reports, scenes, similarity, tracklets  # noqa: E402, F401, I001
from loomtrace.plans import documents  # noqa: E402, F401
