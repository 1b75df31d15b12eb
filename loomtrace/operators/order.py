"""Consecutive numbers in a global order, without one task that sorts all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.runtime import materialise


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with ``name`` 1, 2, ... (long) by the columns ``order``, which identify a row.

    Rows are dealt by range and numbered within each range; the ranges' sizes, one row a range, give the offsets."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = materialise(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_place", place), "numbered")
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    offsets = sizes.select("_part", before.alias("_before"))
    return held.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


QUANTILE_BINS = 1 << 16
DRIVER_VALUES = 1_000_000


def exact_quantiles(values: DataFrame, column: str, quantiles: tuple[float, ...], copies: int = 1, most: int = DRIVER_VALUES) -> list[float] | None:
    """Interpolated quantiles of a double column, every value counted ``copies`` times; None without values.

    Values are counted in bins, and the bin of a wanted rank is cut again until its distinct values are ``most`` at
    most or one; then those are read. ``values`` is read once a cut: give a written one. Nulls are ignored."""
    v = F.col(column)
    rows = values.where(v.isNotNull())
    whole = rows.agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).first()
    if not whole["n"]:
        return None
    found: dict[int, float] = {}

    def at(rank: int) -> float:
        if rank in found:
            return found[rank]
        low, high, before, inside = whole["low"], whole["high"], 0, whole["n"]
        while inside > most and low < high:
            part = F.least(F.floor((v - low) / (high - low) * QUANTILE_BINS), F.lit(QUANTILE_BINS - 1))
            counted = rows.where(v.between(low, high)).groupBy(part.alias("bin")).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).collect()  # QUANTILE_BINS rows at most
            for b in sorted(counted, key=lambda r: r["bin"]):
                if rank < before + b["n"]:
                    low, high, inside = b["low"], b["high"], b["n"]
                    break
                before += b["n"]
        for r in sorted(rows.where(v.between(low, high)).groupBy(v.alias("value")).agg(F.count("*").alias("n")).collect()):
            if rank < before + r["n"]:
                found[rank] = r["value"]
                return r["value"]
            before += r["n"]
        raise AssertionError("a rank lies among the values")

    out = []
    for q in quantiles:
        place = q * (copies * whole["n"] - 1)
        below, above = at(int(place // 1) // copies), at(int(-(-place // 1)) // copies)
        out.append(below + (above - below) * (place - place // 1))
    return out
