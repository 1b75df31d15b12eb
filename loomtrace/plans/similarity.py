"""Queries over pairs of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import similarity as S
from loomtrace.plans.registry import query
from loomtrace.sources import tables

EPS = 0.75

DOT_SQL = """vecs AS MATERIALIZED (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
sims AS MATERIALIZED (SELECT a.id AS i, b.id AS j, least(greatest(1 - list_inner_product(a.v, b.v), 0), 2) AS d FROM vecs a JOIN vecs b ON a.id < b.id)"""


def vecs(spark, sf_dir):
    return tables.embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), "v")


def near(spark, sf_dir, eps=EPS):
    return S.radius_join(vecs(spark, sf_dir), eps)


@query(f"WITH {DOT_SQL} SELECT i, j, round(d, 4) AS d FROM sims WHERE d <= {EPS}")
def pairwise_cosine(spark, sf_dir):
    return near(spark, sf_dir).select("i", "j", F.round("d", 4).alias("d"))


@query(f"WITH {DOT_SQL}, both_ AS (SELECT i, d FROM sims WHERE d <= {EPS} UNION ALL SELECT j, d FROM sims WHERE d <= {EPS}) SELECT i AS id, count(*) AS n_neighbours, round(min(d), 4) AS nearest FROM both_ GROUP BY 1")
def radius_neighbors(spark, sf_dir):
    rows = near(spark, sf_dir)
    both = rows.select(F.col("i").alias("id"), "d").unionByName(rows.select(F.col("j").alias("id"), "d"))
    return both.groupBy("id").agg(F.count("*").alias("n_neighbours"), F.round(F.min("d"), 4).alias("nearest"))


def _groups(spark, sf_dir):
    return tables.embeddings(spark, sf_dir).select((F.col("vec_id") % 50).alias("grp"), F.col("vec_id").alias("id"), "v")


GROUP_SQL = f"""{DOT_SQL}, flat AS (SELECT id % 50 AS grp, k, avg(v[k]) AS x FROM vecs, (SELECT unnest(range(1, 65)) AS k) GROUP BY ALL),
means AS (SELECT grp, list(x ORDER BY k) AS m FROM flat GROUP BY grp)"""


@query(f"WITH {DOT_SQL} SELECT least(i % 50, j % 50) AS i, greatest(i % 50, j % 50) AS j, round(min(d), 4) AS d FROM sims WHERE i % 50 <> j % 50 GROUP BY 1, 2")
def linkage_min(spark, sf_dir):
    return S.linkage(_groups(spark, sf_dir), "min", tables.DIMS).select("i", "j", F.round("d", 4).alias("d"))


@query(f"WITH {DOT_SQL} SELECT least(i % 50, j % 50) AS i, greatest(i % 50, j % 50) AS j, round(avg(d), 4) AS d FROM sims WHERE i % 50 <> j % 50 GROUP BY 1, 2")
def linkage_mean(spark, sf_dir):
    return S.linkage(_groups(spark, sf_dir), "mean", tables.DIMS).select("i", "j", F.round("d", 4).alias("d"))


@query(f"""WITH {GROUP_SQL} SELECT a.grp AS i, b.grp AS j, round(1 - list_inner_product(a.m, b.m) / sqrt(list_inner_product(a.m, a.m) * list_inner_product(b.m, b.m)), 4) AS d
FROM means a JOIN means b ON a.grp < b.grp""")
def linkage_representative(spark, sf_dir):
    return S.linkage(_groups(spark, sf_dir), "representative", tables.DIMS).select("i", "j", F.round("d", 4).alias("d"))


SIDE_SQL = """side AS (SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE (vec_id % 7) / 7.0::DOUBLE END AS ratio,
  CASE WHEN vec_id % 3 = 0 THEN NULL ELSE (vec_id % 11) / 10.0::DOUBLE END AS speed, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE vec_id * 10 END AS sec FROM embeddings)"""


def _sides(spark, sf_dir):
    k = F.col("vec_id")
    return tables.read_table(spark, sf_dir, "embeddings").select(
        k.alias("id"), F.when(k % 5 != 0, (k % 7) / 7.0).alias("ratio"), F.when(k % 3 != 0, (k % 11) / 10.0).alias("speed"), F.when(k % 4 != 0, k * 10).alias("sec")
    )


@query(f"""WITH {DOT_SQL}, {SIDE_SQL}, p AS (SELECT i, j, CASE WHEN coalesce(abs(a.sec - b.sec) > 3000, false) THEN NULL
  ELSE d + coalesce(0.05 * abs(a.ratio - b.ratio), 0) + coalesce(0.05 * abs(a.speed - b.speed), 0) END AS d
  FROM sims JOIN side a ON a.id = i JOIN side b ON b.id = j WHERE d <= {EPS}) SELECT i, j, round(d, 4) AS d FROM p WHERE d IS NOT NULL""")
def penalised_distance(spark, sf_dir):
    side = _sides(spark, sf_dir)
    left, right = (side.select(*[F.col(c).alias(f"{c}_{k}") for c in ("id", "ratio", "speed", "sec")]) for k in ("i", "j"))
    rows = near(spark, sf_dir).join(left, F.col("i") == F.col("id_i")).join(right, F.col("j") == F.col("id_j"))
    return rows.select("i", "j", F.round(S.penalised(rows, 0.05, 0.05, 3000), 4).alias("d")).where("d is not null")


@query(f"""WITH {DOT_SQL} SELECT i, j, round(d, 4) AS d, row_number() OVER (ORDER BY round(d, 6), i, j) AS rank FROM sims
JOIN vecs a ON a.id = i JOIN vecs b ON b.id = j WHERE a.label <> b.label AND d <= 0.7 ORDER BY round(d, 6), i, j LIMIT 20""")
def top20_pairs(spark, sf_dir):
    """The report of the twenty closest pairs across clips."""
    label = tables.embeddings(spark, sf_dir).select("vec_id", "label")
    rows = near(spark, sf_dir, 0.7).join(label.select(F.col("vec_id").alias("i"), F.col("label").alias("li")), "i").join(label.select(F.col("vec_id").alias("j"), F.col("label").alias("lj")), "j")
    top = rows.where("li <> lj").withColumn("key", F.round("d", 6)).orderBy("key", "i", "j").limit(20)
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy("key", "i", "j")).cast("long")).select("i", "j", F.round("d", 4).alias("d"), "rank")


@query(f"""WITH {DOT_SQL}, open AS (SELECT i, j, d FROM sims JOIN vecs a ON a.id = i JOIN vecs b ON b.id = j WHERE d <= {EPS} AND NOT (a.label = b.label AND abs((i * 7) % 200 - (j * 7) % 200) <= 20))
SELECT i, j, round(d, 4) AS d FROM open""")
def candidate_pairs(spark, sf_dir):
    """Pairs within the radius whose tracklets are not in view together."""
    label = tables.embeddings(spark, sf_dir).select("vec_id", "label")
    rows = near(spark, sf_dir).join(label.select(F.col("vec_id").alias("i"), F.col("label").alias("li")), "i").join(label.select(F.col("vec_id").alias("j"), F.col("label").alias("lj")), "j")
    together = (F.col("li") == F.col("lj")) & (F.abs((F.col("i") * 7) % 200 - (F.col("j") * 7) % 200) <= 20)
    return rows.where(~together).select("i", "j", F.round("d", 4).alias("d"))


@query(f"""WITH {DOT_SQL}, t AS (SELECT d, a.label = b.label AS same FROM sims JOIN vecs a ON a.id = i JOIN vecs b ON b.id = j)
SELECT same, count(*) AS n, round(min(d), 4) AS d_min, round(quantile_cont(d, 0.1), 4) AS p10, round(quantile_cont(d, 0.25), 4) AS p25, round(quantile_cont(d, 0.5), 4) AS p50,
  round(quantile_cont(d, 0.75), 4) AS p75, round(quantile_cont(d, 0.9), 4) AS p90, round(max(d), 4) AS d_max, count(*) FILTER (d <= 0.7) AS within_070, count(*) FILTER (d <= 0.8) AS within_080, count(*) FILTER (d <= 0.9) AS within_090
FROM t GROUP BY 1""")
def distance_distribution(spark, sf_dir):
    """Counts and exact quantiles of all pairs, by whether the labels are the same; no pair leaves a task."""
    tagged = tables.embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), "v", F.col("label").cast("long").alias("tag"))
    names = ("p10", "p25", "p50", "p75", "p90")
    rows = [
        (bool(g["alike"]), g["n"], g["low"], *g["quantiles"], g["high"], *g["within"])
        for g in S.pair_summary(tagged, (0.1, 0.25, 0.5, 0.75, 0.9), (0.7, 0.8, 0.9))
    ]
    schema = "same boolean, n long, d_min double, " + ", ".join(f"{x} double" for x in names) + ", d_max double, within_070 long, within_080 long, within_090 long"
    return spark.createDataFrame(rows, schema).select("same", "n", *[F.round(c, 4).alias(c) for c in ("d_min", *names, "d_max")], "within_070", "within_080", "within_090")


@query(f"""WITH {DOT_SQL}, both_ AS (SELECT d FROM sims WHERE d > 0 UNION ALL SELECT d FROM sims WHERE d > 0)
SELECT round(greatest(quantile_cont(d, 0.05), 0.18), 4) AS epsilon, round(quantile_cont(d, 0.15), 4) AS gate FROM both_""")
def adaptive_thresholds(spark, sf_dir):
    """Percentiles over both triangles of the distance matrix."""
    epsilon, gate = S.adaptive_limits(vecs(spark, sf_dir))
    return spark.createDataFrame([(epsilon, gate)], "epsilon double, gate double").select(*[F.round(c, 4).alias(c) for c in ("epsilon", "gate")])


@query(f"""WITH {DOT_SQL} SELECT count(*) AS n_pairs, count(*) FILTER (NOT isfinite(d)) AS n_not_finite, count(*) FILTER (d < 0) AS n_negative, count(*) FILTER (d > 2) AS n_large FROM sims""")
def distance_matrix_checks(spark, sf_dir):
    """Distances that cannot be: counted within the tasks that work them out."""
    found = S.pair_summary(vecs(spark, sf_dir).withColumn("tag", F.lit(0).cast("long")), within=(-1e-300, S.ALL))
    n, broken = sum(g["n"] for g in found), sum(g["broken"] for g in found)
    negative, held = sum(g["within"][0] for g in found), sum(g["within"][1] for g in found)
    return spark.createDataFrame([(n, broken, negative, n - broken - held)], "n_pairs long, n_not_finite long, n_negative long, n_large long")


K1, K2, WEIGHT = 10, 4, 0.3
KNN_SQL = """vecs AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
sims AS MATERIALIZED (SELECT a.id AS i, b.id AS j, CASE WHEN a.id = b.id THEN 1 ELSE list_inner_product(a.v, b.v) END AS s FROM vecs a, vecs b),
orig AS MATERIALIZED (SELECT i, j, greatest(2 - 2 * s, 0) / max(greatest(2 - 2 * s, 0)) OVER (PARTITION BY i) AS o, s FROM sims),
ranked AS MATERIALIZED (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY CASE WHEN i = j THEN 0 ELSE 1 END, s DESC, j) - 1 AS rank FROM sims)"""
RECIPROCAL_SQL = f"""{KNN_SQL}, full_ AS MATERIALIZED (SELECT a.i, a.j FROM ranked a JOIN ranked b ON a.i = b.j AND a.j = b.i WHERE a.rank <= {K1} AND b.rank <= {K1}),
half_ AS MATERIALIZED (SELECT a.i, a.j FROM ranked a JOIN ranked b ON a.i = b.j AND a.j = b.i WHERE a.rank <= round_even({K1} / 2, 0) AND b.rank <= round_even({K1} / 2, 0))"""


@query(f"WITH {KNN_SQL} SELECT i, rank, j FROM ranked WHERE rank <= {K1}")
def rerank_knn(spark, sf_dir):
    return S.nearest(vecs(spark, sf_dir), K1).select("i", F.col("rank").cast("long").alias("rank"), "j")


@query(f"WITH {RECIPROCAL_SQL} SELECT i, j FROM full_")
def rerank_reciprocal(spark, sf_dir):
    return S.reciprocal(S.nearest(vecs(spark, sf_dir), K1), K1)


@query(f"""WITH {RECIPROCAL_SQL}, lent AS MATERIALIZED (SELECT f.i, f.j AS q, h.j, o.j IS NOT NULL AS own FROM full_ f JOIN half_ h ON h.i = f.j LEFT JOIN full_ o ON o.i = f.i AND o.j = h.j),
judged AS MATERIALIZED (SELECT i, j, count(*) FILTER (own) OVER (PARTITION BY i, q) > 2.0::DOUBLE / 3 * count(*) OVER (PARTITION BY i, q) AS takes FROM lent),
sets AS MATERIALIZED (SELECT i, j FROM full_ UNION SELECT i, j FROM judged WHERE takes),
soft AS MATERIALIZED (SELECT i, j, exp(-o) / sum(exp(-o)) OVER (PARTITION BY i) AS x FROM sets JOIN orig USING (i, j)),
mixed AS MATERIALIZED (SELECT r.i, s.j, sum(s.x) / {K2} AS x FROM ranked r JOIN soft s ON s.i = r.j WHERE r.rank < {K2} GROUP BY 1, 2),
meet AS (SELECT a.i, b.i AS j, sum(least(a.x, b.x)) AS m FROM mixed a JOIN mixed b ON a.j = b.j AND a.i < b.i GROUP BY 1, 2)
SELECT i, j, round(greatest((1 - {WEIGHT}) * (1 - m / (2 - m)) + {WEIGHT} * (p.o + q.o) / 2, 0), 4) AS d FROM meet JOIN orig p USING (i, j) JOIN orig q ON q.i = meet.j AND q.j = meet.i""")
def rerank_jaccard(spark, sf_dir):
    return S.rerank(vecs(spark, sf_dir), K1, K2, WEIGHT).select("i", "j", F.round("d", 4).alias("d"))
