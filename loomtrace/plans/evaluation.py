"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtrace.operators import evaluate as E
from loomtrace.plans.registry import query
from loomtrace.sources import tables

ITEMS_SQL = "items AS (SELECT vec_id AS item, CAST(label AS BIGINT) AS gt, vec_id % 10 AS pred FROM embeddings), cells AS (SELECT gt, pred, count(*) AS n FROM items GROUP BY ALL)"


@query(f"WITH {ITEMS_SQL} SELECT gt, pred, n FROM cells")
def contingency(spark, sf_dir):
    return E.contingency(tables.eval_items(spark, sf_dir))


@query(f"""WITH {ITEMS_SQL}, j AS (SELECT sum(n * (n - 1) / 2.0) AS j, sum(n) AS t FROM cells), a AS (SELECT sum(n * (n - 1) / 2.0) AS a FROM (SELECT sum(n) AS n FROM cells GROUP BY gt)),
b AS (SELECT sum(n * (n - 1) / 2.0) AS b FROM (SELECT sum(n) AS n FROM cells GROUP BY pred))
SELECT round((j - a * b / (t * (t - 1) / 2.0)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2.0)), 6) AS adjusted_rand FROM j, a, b""")
def adjusted_rand(spark, sf_dir):
    return E.adjusted_rand(tables.eval_items(spark, sf_dir))


@query(f"""WITH {ITEMS_SQL}, g AS (SELECT gt, sum(n)::DOUBLE AS ng FROM cells GROUP BY 1), p AS (SELECT pred, sum(n)::DOUBLE AS np FROM cells GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS t FROM cells),
hg AS (SELECT -sum(ng / t * ln(ng / t)) AS hg FROM g, t), hp AS (SELECT -sum(np / t * ln(np / t)) AS hp FROM p, t), mi AS (SELECT sum(n / t * ln(n * t / (ng * np))) AS mi FROM cells JOIN g USING (gt) JOIN p USING (pred), t)
SELECT round(mi / hg, 6) AS homogeneity, round(mi / hp, 6) AS completeness, round(2 * (mi / hg) * (mi / hp) / (mi / hg + mi / hp), 6) AS v_measure FROM mi, hg, hp""")
def v_measure(spark, sf_dir):
    return E.v_measure(tables.eval_items(spark, sf_dir))


@query(f"WITH {ITEMS_SQL} SELECT round(sum(best)::DOUBLE / sum(n), 6) AS purity FROM (SELECT pred, max(n) AS best, sum(n) AS n FROM cells GROUP BY 1)")
def purity(spark, sf_dir):
    return E.purity(tables.eval_items(spark, sf_dir))


F1_SQL = f"""{ITEMS_SQL}, labels AS (SELECT gt AS label FROM cells UNION SELECT pred FROM cells),
counts AS (SELECT label, sum(CASE WHEN gt = label AND pred = label THEN n ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN gt <> label AND pred = label THEN n ELSE 0 END) AS fp,
  sum(CASE WHEN gt = label AND pred <> label THEN n ELSE 0 END) AS fn FROM labels, cells GROUP BY 1),
scores AS (SELECT label, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM counts)"""


@query(f"WITH {F1_SQL} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM scores")
def per_id_prf(spark, sf_dir):
    return E.label_scores(tables.eval_items(spark, sf_dir)).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {F1_SQL}, acc AS (SELECT avg(CASE WHEN gt = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM items) SELECT round(avg(f1), 6) AS macro_f1, round(max(accuracy), 6) AS accuracy FROM scores, acc")
def macro_f1(spark, sf_dir):
    items = tables.eval_items(spark, sf_dir)
    scores = E.label_scores(items).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    return scores.crossJoin(items.agg(F.round(F.avg((F.col("gt") == F.col("pred")).cast("double")), 6).alias("accuracy")))


@query()
def identity_assignment(spark, sf_dir):
    return E.best_matching(E.contingency(tables.eval_items(spark, sf_dir)))


LABELS_SQL = """sides AS (SELECT coalesce(g.vec_id, p.vec_id) AS item, coalesce(g.label, -1) AS gt, coalesce(p.vec_id % 10, -1) AS pred
  FROM (SELECT vec_id, label FROM embeddings WHERE vec_id % 6 <> 0) g FULL OUTER JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0) p ON g.vec_id = p.vec_id)"""


@query(f"WITH {LABELS_SQL} SELECT item, CAST(gt AS BIGINT) AS gt, CAST(pred AS BIGINT) AS pred FROM sides")
def item_labels(spark, sf_dir):
    """Labels over the union of items; -1 where a side lacks the item."""
    items = tables.eval_items(spark, sf_dir)
    gt, pred = items.where("item % 6 <> 0").select("item", "gt"), items.where("item % 7 <> 0").select("item", "pred")
    return gt.join(pred, "item", "full_outer").select("item", F.coalesce("gt", F.lit(-1)).alias("gt"), F.coalesce("pred", F.lit(-1)).alias("pred"))


SPANS_SQL = """spans AS (SELECT 'clip' || (event_id % 30) AS clip_id, CASE WHEN event_id % 2 = 0 THEN 'gt' ELSE 'pred' END AS side, (event_id % 50) / 10.0::DOUBLE AS a,
  (event_id % 50 + event_id % 7) / 10.0::DOUBLE AS b FROM events)"""


@query(f"""WITH {SPANS_SQL}, tops AS (SELECT clip_id, max(b) AS top FROM spans GROUP BY 1), ticks AS (SELECT clip_id, top, unnest(range(0, CAST(ceil(top / 0.1::DOUBLE) AS BIGINT) + 1)) * 0.1::DOUBLE AS t FROM tops),
marks AS (SELECT clip_id, top, t, EXISTS (SELECT 1 FROM spans s WHERE s.clip_id = ticks.clip_id AND side = 'gt' AND t BETWEEN a AND b) AS g,
  EXISTS (SELECT 1 FROM spans s WHERE s.clip_id = ticks.clip_id AND side = 'pred' AND t BETWEEN a AND b) AS p FROM ticks)
SELECT clip_id, round(CASE WHEN max(top) > 0 AND count(*) FILTER (g OR p) > 0 THEN count(*) FILTER (g AND p)::DOUBLE / count(*) FILTER (g OR p) ELSE 0 END, 6) AS iou FROM marks GROUP BY 1""")
def interval_iou(spark, sf_dir):
    e = F.col("event_id")
    spans = tables.read_table(spark, sf_dir, "events").select(
        F.concat(F.lit("clip"), e % 30).alias("clip_id"), F.when(e % 2 == 0, "gt").otherwise("pred").alias("side"), ((e % 50) / 10.0).alias("a"), ((e % 50 + e % 7) / 10.0).alias("b")
    )
    return E.interval_iou(spans)


SCENE_SQL = """clips AS (SELECT vec_id AS clip, CASE WHEN vec_id % 3 = 0 THEN 'crime' ELSE 'normal' END AS gt, CASE WHEN vec_id % 11 = 0 THEN 'missing' WHEN vec_id % 4 = 0 THEN 'crime' ELSE 'normal' END AS pred,
  CASE WHEN vec_id % 5 = 0 THEN NULL ELSE list_distinct([vec_id % 7, vec_id % 4]) END AS gt_people, list_distinct([vec_id % 7, vec_id % 5]) AS people FROM embeddings)"""


@query(f"""WITH {SCENE_SQL}, labels AS (SELECT gt AS label FROM clips UNION SELECT pred FROM clips), f AS (SELECT label, 2.0::DOUBLE * count(*) FILTER (gt = label AND pred = label) / (2 * count(*) FILTER (gt = label AND pred = label)
  + count(*) FILTER (gt <> label AND pred = label) + count(*) FILTER (gt = label AND pred <> label)) AS f1 FROM labels, clips GROUP BY 1),
r AS (SELECT avg(CASE WHEN gt = pred THEN 1.0 ELSE 0.0 END) AS accuracy, avg(CASE WHEN gt_people IS NULL THEN 1.0 ELSE len(list_intersect(gt_people, people))::DOUBLE / len(gt_people) END) AS person_recall FROM clips)
SELECT round(max(accuracy), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(max(person_recall), 6) AS person_recall FROM f, r""")
def scene_metrics(spark, sf_dir):
    k = F.col("vec_id")
    clips = tables.read_table(spark, sf_dir, "embeddings").select(
        F.when(k % 3 == 0, "crime").otherwise("normal").alias("gt"),
        F.when(k % 11 == 0, "missing").when(k % 4 == 0, "crime").otherwise("normal").alias("pred"),
        F.when(k % 5 != 0, F.array_distinct(F.array(k % 7, k % 4))).alias("gt_people"),
        F.array_distinct(F.array(k % 7, k % 5)).alias("people"),
    )
    recall = F.when(F.col("gt_people").isNull(), 1.0).otherwise(F.size(F.array_intersect("gt_people", "people")) / F.size("gt_people"))
    row = clips.agg(F.round(F.avg((F.col("gt") == F.col("pred")).cast("double")), 6).alias("accuracy"), F.round(F.avg(recall), 6).alias("person_recall"))
    return row.crossJoin(E.label_scores(clips).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))).select("accuracy", "macro_f1", "person_recall")


@query(f"WITH {ITEMS_SQL}, r AS (SELECT gt, pred, n, row_number() OVER (PARTITION BY gt ORDER BY n DESC, pred) AS k FROM cells) SELECT gt, pred, n FROM r WHERE k = 1")
def dominant_prediction(spark, sf_dir):
    best = F.row_number().over(Window.partitionBy("gt").orderBy(F.desc("n"), "pred"))
    return E.contingency(tables.eval_items(spark, sf_dir)).withColumn("k", best).where("k = 1").select("gt", "pred", "n")
