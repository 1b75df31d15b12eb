"""Clustering and scene metrics over label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.operators.graph import connected_components
from loomtrace.runtime import ship_package


def contingency(items: DataFrame) -> DataFrame:
    return items.groupBy("gt", "pred").agg(F.count("*").alias("n"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2.0


def adjusted_rand(items: DataFrame) -> DataFrame:
    """One row: adjusted_rand; 1 below two items and where the denominator vanishes."""
    cells = contingency(items)
    joint = cells.agg(F.sum(_pairs(F.col("n"))).alias("joint"), F.sum("n").alias("total"))
    sides = [cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias(name)) for c, name in (("gt", "a"), ("pred", "b"))]
    row = joint.crossJoin(sides[0]).crossJoin(sides[1])  # one row each
    expected = F.col("a") * F.col("b") / _pairs(F.col("total"))
    spread = (F.col("a") + F.col("b")) / 2 - expected
    value = F.when((F.col("total") < 2) | (spread == 0), 1.0).otherwise((F.col("joint") - expected) / spread)
    return row.select(F.round(value, 6).alias("adjusted_rand"))


def v_measure(items: DataFrame) -> DataFrame:
    """One row: homogeneity, completeness, v_measure."""
    cells = contingency(items)
    total = cells.agg(F.sum("n").alias("total"))

    def entropy(c: str, name: str) -> DataFrame:
        p = F.col("n") / F.col("total")
        return cells.groupBy(c).agg(F.sum("n").alias("n")).crossJoin(total).agg((-F.sum(p * F.log(p))).alias(name))

    sizes = [cells.groupBy(c).agg(F.sum("n").alias(f"n_{c}")) for c in ("gt", "pred")]
    both = cells.join(sizes[0], "gt").join(sizes[1], "pred").crossJoin(total)
    p = F.col("n") / F.col("total")
    shared = both.agg(F.sum(p * F.log(F.col("n") * F.col("total") / (F.col("n_gt") * F.col("n_pred")))).alias("mi"))
    row = shared.crossJoin(entropy("gt", "hg")).crossJoin(entropy("pred", "hp"))
    h = F.when(F.col("hg") <= 0, 1.0).otherwise(F.col("mi") / F.col("hg"))
    c = F.when(F.col("hp") <= 0, 1.0).otherwise(F.col("mi") / F.col("hp"))
    row = row.withColumn("h", h).withColumn("c", c)
    v = F.when(F.col("h") + F.col("c") <= 0, 0.0).otherwise(2 * F.col("h") * F.col("c") / (F.col("h") + F.col("c")))
    return row.select(F.round("h", 6).alias("homogeneity"), F.round("c", 6).alias("completeness"), F.round(v, 6).alias("v_measure"))


def purity(items: DataFrame) -> DataFrame:
    best = contingency(items).groupBy("pred").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return best.agg(F.round(F.sum("best") / F.sum("n"), 6).alias("purity"))


def label_scores(items: DataFrame) -> DataFrame:
    """label, precision, recall, f1 over the union of labels on either side."""
    cells = contingency(items)
    votes = cells.select("gt", "pred", "n", F.explode(F.array_distinct(F.array("gt", "pred"))).alias("label"))
    label = F.col("label")
    sums = votes.groupBy("label").agg(
        F.sum(F.when((F.col("gt") == label) & (F.col("pred") == label), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("gt") != label) & (F.col("pred") == label), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("gt") == label) & (F.col("pred") != label), F.col("n")).otherwise(0)).alias("fn"),
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    sums = sums.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return sums.select("label", "precision", "recall", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def assign(cost):
    """Row -> column of a least-cost assignment (Kuhn-Munkres with potentials); as many pairs as the shorter side."""
    import numpy as np

    cost = np.asarray(cost, float)
    if cost.size == 0:
        return {}
    if cost.shape[0] > cost.shape[1]:
        return {r: c for c, r in assign(cost.T).items()}
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        least, back, used = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        r, last = row, -1
        while True:
            gap = cost[r] - u[r] - v
            better = ~used & (gap < least)
            least[better], back[better] = gap[better], last
            free = np.where(used, np.inf, least)
            last = int(free.argmin())
            step = free[last]
            u[row] += step
            for c in np.flatnonzero(used):
                u[owner[c]] += step
                v[c] -= step
            least[~used] -= step
            used[last] = True
            if owner[last] < 0:
                break
            r = owner[last]
        while last >= 0:
            prior = back[last]
            owner[last] = owner[prior] if prior >= 0 else row
            last = prior
    return {int(r): c for c, r in enumerate(owner) if r >= 0}


def best_matching(overlaps: DataFrame) -> DataFrame:
    """(gt, pred, n): the one-to-one matching of most overlap; pairs without overlap are left out. The table has a
    row per pair of identities that meet. Identities that no chain of meetings connects cannot compete, so each
    connected component of the meetings is a dense problem of its own."""
    ship_package(overlaps.sparkSession)
    met = overlaps.where("n > 0").select(F.col("gt").cast("long").alias("gt"), F.col("pred").cast("long").alias("pred"), F.col("n").cast("long").alias("n"))
    groups = connected_components(met.select((F.col("gt") * 2).alias("src"), (F.col("pred") * 2 + 1).alias("dst")))

    def run(pdf):
        import numpy as np
        import pandas as pd

        gts, preds = np.unique(pdf["gt"]), np.unique(pdf["pred"])
        table = np.zeros((len(gts), len(preds)))
        table[np.searchsorted(gts, pdf["gt"]), np.searchsorted(preds, pdf["pred"])] = pdf["n"]
        rows = [(gts[r], preds[c], int(table[r, c])) for r, c in assign(-table).items() if table[r, c] > 0]
        return pd.DataFrame(rows, columns=["gt", "pred", "n"])

    named = met.withColumn("node", F.col("gt") * 2).join(groups, "node").drop("node")
    return named.groupBy("component").applyInPandas(run, "gt long, pred long, n long")


def interval_iou(spans: DataFrame, step: float = 0.1) -> DataFrame:
    """(clip_id, iou) of spans (clip_id, side 'gt' or 'pred', a, b) on a grid of seconds, ends included; a clip
    without spans on either side has no row here and counts as 1; a clip that ends at 0 counts as 0."""
    tops = spans.groupBy("clip_id").agg(F.max("b").alias("top"))
    near = F.sequence(F.greatest(F.floor(F.col("a") / step) - 1, F.lit(0)), F.greatest(F.floor(F.col("b") / step) + 1, F.lit(0)))
    ticks = spans.select("clip_id", "side", "a", "b").distinct().withColumn("i", F.explode(near))
    ticks = ticks.where((F.col("i") * F.lit(step)).between(F.col("a"), F.col("b"))).groupBy("clip_id", "i").agg(F.countDistinct("side").alias("sides"))
    sums = ticks.groupBy("clip_id").agg(F.count_if(F.col("sides") == 2).alias("both"), F.count("*").alias("some"))
    iou = F.when(F.col("top") > 0, F.col("both") / F.col("some"))
    return tops.join(sums, "clip_id", "left").select("clip_id", F.round(F.coalesce(iou, F.lit(0.0)), 6).alias("iou"))
