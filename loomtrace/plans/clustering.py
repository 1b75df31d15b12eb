"""Queries over clusters, persons and the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtrace.functions import scalars, vectors
from loomtrace.operators import cluster as C
from loomtrace.operators import frames
from loomtrace.operators import similarity as S
from loomtrace.operators import tracklets as T
from loomtrace.operators.graph import connected_components
from loomtrace.operators.order import numbered
from loomtrace.plans.detections import histograms
from loomtrace.plans.registry import query
from loomtrace.plans.similarity import DOT_SQL, near, vecs
from loomtrace.plans.tracklets import ISLANDS_SQL, MIN_FRAMES
from loomtrace.runtime import materialise
from loomtrace.sources import tables
from loomtrace.sources.tables import DET_SQL

EPS = 0.66


@query(f"""WITH RECURSIVE {DOT_SQL}, edges AS (SELECT i, j FROM sims WHERE d <= {EPS} UNION SELECT j, i FROM sims WHERE d <= {EPS}),
reach(node, other) AS (SELECT i, i FROM edges UNION SELECT r.node, e.j FROM reach r JOIN edges e ON e.i = r.other)
SELECT node, min(other) AS component FROM reach GROUP BY node""")
def connected_component_labels(spark, sf_dir):
    return connected_components(near(spark, sf_dir, EPS).select(F.col("i").alias("src"), F.col("j").alias("dst")))


def _nodes(spark, sf_dir):
    k = F.col("vec_id")
    return tables.read_table(spark, sf_dir, "embeddings").select(
        k.alias("id"), F.col("label").cast("string").alias("clip"), F.array(F.struct(((k * 7) % 200).alias("s"), ((k * 7) % 200 + 20).alias("e"))).alias("ranges")
    )


@query()
def greedy_cluster(spark, sf_dir):
    return C.greedy_clusters(_nodes(spark, sf_dir), near(spark, sf_dir, EPS), EPS)


@query()
def singleton_merge(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    labels = materialise(C.greedy_clusters(nodes, near(spark, sf_dir, EPS), EPS), "greedy-labels")
    marked = vecs(spark, sf_dir).join(labels.select("id", (F.col("label") == C.NOISE).alias("open")), "id")
    return C.merge_singletons(nodes, labels, S.radius_join(marked, 0.7), 0.7)


@query("""WITH labels AS (SELECT vec_id AS id, CASE WHEN vec_id % 4 = 0 THEN -1 ELSE label END AS label FROM embeddings), k AS (SELECT count(DISTINCT label) AS n FROM labels WHERE label >= 0)
SELECT id, CAST(dense_rank() OVER (ORDER BY label) AS INTEGER) AS global_id FROM labels WHERE label >= 0
UNION ALL SELECT id, CAST(n + row_number() OVER (ORDER BY id) AS INTEGER) FROM labels, k WHERE label < 0""")
def assign_person_ids(spark, sf_dir):
    k = F.col("vec_id")
    return C.person_ids(tables.read_table(spark, sf_dir, "embeddings").select(k.alias("id"), F.when(k % 4 == 0, -1).otherwise(F.col("label")).alias("label")))


@query()
def kmedoids_prototypes(spark, sf_dir):
    """Up to three medoids of each tracklet's twenty best detections, smoothed in quality order."""
    best = T.keyframes(tables.detections(spark, sf_dir, vectors=True), F.lit(True), 20)
    rows = best.withColumn("v", vectors.normalise(F.col("v")))
    out = C.prototypes(rows, 3, 51)
    return out.select("clip_id", "track_id", "n_prototypes", F.round(F.aggregate("prototypes", F.lit(0.0), lambda s, p: s + vectors.checksum(p)), 5).alias("digest"))


@query()
def hdbscan_clusters(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    out = C.density_clusters(S.forest(vecs(spark, sf_dir)), nodes, 0.6)
    return out.select("id", "label", F.round("probability", 5).alias("probability"))


@query()
def noise_reassign(spark, sf_dir):
    items = vecs(spark, sf_dir)
    labels = materialise(C.density_clusters(S.forest(items), _nodes(spark, sf_dir), 0.6), "density-labels")
    colours = histograms(spark, sf_dir).select(F.col("vec_id").alias("id"), "hist")
    return C.reassign_near(items, S.cosine, labels, colours, 0.74).select("id", "label", F.round("probability", 5).alias("probability"))


@query()
def pca_2d(spark, sf_dir):
    """Two principal components; each axis points to where its largest loading is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = tables.embeddings(spark, sf_dir).select("vec_id", array_to_vector("v").alias("x"))
    model = PCA(k=2, inputCol="x", outputCol="p").fit(rows)
    loadings = model.pc.toArray()  # dims x 2
    sign = [1.0 if loadings[abs(loadings[:, k]).argmax(), k] > 0 else -1.0 for k in (0, 1)]
    p = vector_to_array("p")
    return model.transform(rows).select("vec_id", *[F.round(p[k] * sign[k], 5).alias(f"c{k}") for k in (0, 1)])


# --- catalogue: persons are the tracks of one number over all clips ---------------------------------

APPEAR_SQL = f"""{ISLANDS_SQL}, app AS (SELECT clip_id, track_id, track_id % 40 AS global_id, CAST(sum(n) AS BIGINT) AS num_frames, min(s) AS first_s,
  string_agg(s || '-' || e, ',' ORDER BY s, e) AS ranges, (track_id % 10) / 10.0::DOUBLE + 0.05 AS probability FROM ranges GROUP BY clip_id, track_id HAVING sum(n) >= {MIN_FRAMES})"""


def appearances(spark, sf_dir):
    ranges = T.frame_ranges(tables.detections(spark, sf_dir))
    first = ranges.groupBy("clip_id", "track_id").agg(F.min("s").alias("first_s"))
    rows = T.ranges_text(ranges).where(F.col("num_frames") >= MIN_FRAMES).join(first, ["clip_id", "track_id"])
    return rows.withColumn("global_id", F.col("track_id") % 40).withColumn("probability", (F.col("track_id") % 10) / 10.0 + 0.05)


@query(f"""WITH {APPEAR_SQL} SELECT global_id, count(*) AS n_appearances, string_agg(clip_id || ':' || track_id || ':' || ranges, ';' ORDER BY clip_id, first_s, track_id) AS appearances FROM app GROUP BY 1""")
def catalogue(spark, sf_dir):
    entry = F.struct("clip_id", "first_s", "track_id", F.concat_ws(":", "clip_id", F.col("track_id").cast("string"), "ranges").alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["text"]), ";")
    return appearances(spark, sf_dir).groupBy("global_id").agg(F.count("*").alias("n_appearances"), text.alias("appearances"))


@query(f"""WITH {APPEAR_SQL}, p AS (SELECT global_id, count(DISTINCT clip_id) AS clips, count(*) AS apps, sum(num_frames) AS frames FROM app GROUP BY 1)
SELECT count(*) AS persons, CAST(sum(apps) AS BIGINT) AS tracklets, count(*) FILTER (clips > 1) AS cross_clip, count(*) FILTER (clips = 1) AS single_clip, round(avg(apps), 4) AS mean_appearances, CAST(sum(frames) AS BIGINT) AS frames FROM p""")
def catalogue_stats(spark, sf_dir):
    p = appearances(spark, sf_dir).groupBy("global_id").agg(F.countDistinct("clip_id").alias("clips"), F.count("*").alias("apps"), F.sum("num_frames").alias("frames"))
    return p.agg(
        F.count("*").alias("persons"),
        F.sum("apps").alias("tracklets"),
        F.count_if(F.col("clips") > 1).alias("cross_clip"),
        F.count_if(F.col("clips") == 1).alias("single_clip"),
        F.round(F.avg("apps"), 4).alias("mean_appearances"),
        F.sum("frames").alias("frames"),
    )


@query(f"""WITH {APPEAR_SQL}, p AS (SELECT global_id, count(DISTINCT clip_id) AS clips FROM app GROUP BY 1)
SELECT round(avg(CASE WHEN clips > 1 THEN 1.0 ELSE 0.0 END), 6) AS cross_clip_rate, count(*) < 25 AS few_persons, avg(CASE WHEN clips > 1 THEN 1.0 ELSE 0.0 END) > 0.4 AS enough_matches FROM p""")
def cross_clip_rate(spark, sf_dir):
    p = appearances(spark, sf_dir).groupBy("global_id").agg(F.countDistinct("clip_id").alias("clips"))
    rate = F.avg(F.when(F.col("clips") > 1, 1.0).otherwise(0.0))
    return p.agg(F.round(rate, 6).alias("cross_clip_rate"), (F.count("*") < 25).alias("few_persons"), (rate > 0.4).alias("enough_matches"))


@query(f"""WITH {APPEAR_SQL} SELECT event_id, d.clip_id, d.track_id, app.global_id, app.probability FROM det d LEFT JOIN app ON app.clip_id = d.clip_id AND app.track_id = d.track_id""")
def catalogue_lookup(spark, sf_dir):
    """Each detection's person; missing ones stay null."""
    book = appearances(spark, sf_dir).select("clip_id", "track_id", "global_id", "probability")
    return tables.detections(spark, sf_dir).select("event_id", "clip_id", "track_id").join(book, ["clip_id", "track_id"], "left").select("event_id", "clip_id", "track_id", "global_id", "probability")


@query(f"""WITH {APPEAR_SQL} SELECT global_id FROM app GROUP BY 1 HAVING sum(num_frames) >= 30 AND bool_and(probability >= 0.5)""")
def eligible_clusters(spark, sf_dir):
    p = appearances(spark, sf_dir).groupBy("global_id").agg(F.sum("num_frames").alias("n"), F.bool_and(F.coalesce("probability", F.lit(0.0)) >= 0.5).alias("sure"))
    return p.where("n >= 30 and sure").select("global_id")


TRIPLET_SQL = f"""{ISLANDS_SQL}, tr AS (SELECT clip_id, track_id, track_id % 40 AS gid FROM det GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY clip_id, track_id ORDER BY coalesce(nullif(quality, 0), nullif(confidence, 0), 0) DESC, frame_num, event_id) AS r FROM det),
meets AS (SELECT DISTINCT x.clip_id, x.track_id AS a, y.track_id AS b FROM ranges x JOIN ranges y ON x.clip_id = y.clip_id AND x.track_id <> y.track_id AND x.s <= y.e AND y.s <= x.e),
pos AS (SELECT a.clip_id, a.track_id, min(struct_pack(c := b.clip_id, t := b.track_id)) AS p FROM tr a JOIN tr b ON a.gid = b.gid AND (a.clip_id <> b.clip_id OR a.track_id <> b.track_id) GROUP BY 1, 2),
neg AS (SELECT a.clip_id, a.track_id, min(struct_pack(g := b.gid, t := b.track_id)) AS n FROM tr a JOIN tr b ON a.clip_id = b.clip_id AND a.gid <> b.gid
  LEFT JOIN meets m ON m.clip_id = a.clip_id AND m.a = a.track_id AND m.b = b.track_id WHERE m.a IS NULL GROUP BY 1, 2)"""


def _first_apart(det, tr):
    """(clip_id, track_id, nt): the first tracklet of the clip, by person and track, that is another person's and never in view together.

    Candidates are tried in order, a growing stretch of them a round; only tracklets that found none go on, so no
    list of meeting pairs is made."""
    spans = T.frame_ranges(det).groupBy("clip_id", "track_id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    placed = materialise(numbered(tr, ["clip_id", "gid", "track_id"], "r").join(spans.hint("merge"), ["clip_id", "track_id"]), "placed")
    clips = placed.groupBy("clip_id").agg(F.min("r").alias("at"), F.max("r").alias("last"))
    pending = placed.join(F.broadcast(clips) if clips.count() <= 100_000 else clips, "clip_id").select("clip_id", "track_id", "gid", "spans", "at", "last")
    tried = placed.select(F.col("r").alias("c"), F.col("gid").alias("other"), F.col("track_id").alias("nt"), F.col("spans").alias("theirs"))
    meet = F.exists("spans", lambda x: F.exists("theirs", lambda y: scalars.overlaps(x["s"], x["e"], y["s"], y["e"])))
    found, width = None, 8
    while True:
        probes = pending.withColumn("c", F.explode(F.sequence("at", F.least(F.col("at") + width - 1, F.col("last")))))
        apart = probes.join(tried.hint("merge"), "c").where((F.col("gid") != F.col("other")) & ~meet)
        apart = materialise(apart.groupBy("clip_id", "track_id").agg(F.min_by("nt", "c").alias("nt")), "apart")
        found = apart if found is None else found.unionByName(apart)
        pending = pending.join(apart.select("clip_id", "track_id").hint("merge"), ["clip_id", "track_id"], "left_anti").withColumn("at", F.col("at") + width).where(F.col("at") <= F.col("last"))
        pending = materialise(pending, "pending")
        if pending.isEmpty():
            return found
        width *= 4


FALLBACK_SQL = f"""{TRIPLET_SQL}, far AS (SELECT clip_id, track_id, arg_min(event_id, [frame_num, event_id]) AS first_event, arg_max(event_id, [frame_num, event_id]) AS last_event FROM det GROUP BY ALL HAVING count(*) >= 2),
other AS (SELECT a.gid, min(struct_pack(g := b.gid, c := b.clip_id, t := b.track_id)) AS o FROM (SELECT DISTINCT gid FROM tr) a JOIN tr b ON a.gid <> b.gid GROUP BY 1)"""


@query(f"""WITH {FALLBACK_SQL} SELECT CASE WHEN p.event_id IS NULL THEN far.first_event ELSE a.event_id END AS anchor, coalesce(p.event_id, far.last_event) AS positive, n.event_id AS negative
FROM tr JOIN best a ON a.clip_id = tr.clip_id AND a.track_id = tr.track_id AND a.r = 1 LEFT JOIN pos ON pos.clip_id = tr.clip_id AND pos.track_id = tr.track_id
LEFT JOIN best p ON p.clip_id = pos.p.c AND p.track_id = pos.p.t AND p.r = 1 LEFT JOIN far ON far.clip_id = tr.clip_id AND far.track_id = tr.track_id
LEFT JOIN neg ON neg.clip_id = tr.clip_id AND neg.track_id = tr.track_id JOIN other ON other.gid = tr.gid
JOIN best n ON n.clip_id = CASE WHEN neg.n IS NULL THEN other.o.c ELSE tr.clip_id END AND n.track_id = coalesce(neg.n.t, other.o.t) AND n.r = 1
WHERE coalesce(p.event_id, far.last_event) IS NOT NULL""")
def triplet_mining(spark, sf_dir):
    """Anchor, positive and negative of every tracklet.

    The positive is the person's first other tracklet; where there is none, the tracklet's last detection, with its
    first as the anchor. The negative is the first other person of the clip never in view together; where there is
    none, the first tracklet of another person anywhere. Tables of all tracklets are small as files and large in
    memory, so their joins ask for a merge: none is to be broadcast."""
    columns = ("event_id", "clip_id", "track_id", "frame_num", "quality", "confidence")
    det = materialise(tables.detections(spark, sf_dir).select(*columns), "triplet-detections")
    rank = F.struct(F.coalesce(F.nullif("quality", F.lit(0.0)), F.nullif("confidence", F.lit(0.0)), F.lit(0.0)), -F.col("frame_num"), -F.col("event_id"))
    best = materialise(det.groupBy("clip_id", "track_id").agg(F.max_by("event_id", rank).alias("event_id")), "best-detections")
    tr = best.select("clip_id", "track_id", (F.col("track_id") % 40).alias("gid"))
    # The first two tracklets of a person are enough to name another one for each: no pairs are formed.
    own = F.struct("clip_id", "track_id")
    first = tr.groupBy("gid").agg(F.min(own).alias("one"))
    second = tr.join(first, "gid").where(own != F.col("one")).groupBy("gid").agg(F.min(own).alias("two"))
    pos = tr.join(first, "gid").join(second, "gid").withColumn("p", F.when(F.col("one") == own, F.col("two")).otherwise(F.col("one")))
    neg = _first_apart(det, tr)
    # The first tracklet of all, or of the second person for the first one: two rows.
    placed_all = F.struct("gid", "clip_id", "track_id")
    lead = tr.agg(F.min(placed_all).alias("lead"))
    rest = tr.crossJoin(F.broadcast(lead)).where(F.col("gid") != F.col("lead.gid")).agg(F.min(placed_all).alias("rest"))  # one row each
    ends = frames.ends_by_frame(det)
    rows = tr.join(pos.select("clip_id", "track_id", F.col("p.clip_id").alias("pc"), F.col("p.track_id").alias("pt")).hint("merge"), ["clip_id", "track_id"], "left")
    rows = rows.join(neg.select("clip_id", "track_id", "nt").hint("merge"), ["clip_id", "track_id"], "left").crossJoin(F.broadcast(lead)).crossJoin(F.broadcast(rest))
    other = F.when(F.col("gid") == F.col("lead.gid"), F.col("rest")).otherwise(F.col("lead"))
    rows = rows.withColumn("nc", F.when(F.col("nt").isNull(), other["clip_id"]).otherwise(F.col("clip_id"))).withColumn("nt", F.coalesce("nt", other["track_id"])).drop("lead", "rest")
    rows = rows.join(best.withColumnRenamed("event_id", "top").hint("merge"), ["clip_id", "track_id"]).join(ends.hint("merge"), ["clip_id", "track_id"], "left")
    rows = rows.join(best.select(F.col("clip_id").alias("pc"), F.col("track_id").alias("pt"), F.col("event_id").alias("twin")).hint("merge"), ["pc", "pt"], "left")
    rows = rows.join(best.select(F.col("clip_id").alias("nc"), F.col("track_id").alias("nt"), F.col("event_id").alias("negative")).hint("merge"), ["nc", "nt"])
    alone = F.col("twin").isNull()
    rows = rows.select(F.when(alone, F.col("first_event")).otherwise(F.col("top")).alias("anchor"), F.coalesce("twin", "last_event").alias("positive"), "negative")
    return rows.where("positive is not null")


@query(f"""WITH {APPEAR_SQL} SELECT global_id, clip_id, string_agg(ranges, ',' ORDER BY track_id) AS frame_ranges FROM app GROUP BY 1, 2""")
def seed_ground_truth(spark, sf_dir):
    """A ground-truth draft from the catalogue: one row per person and clip."""
    parts = F.array_sort(F.collect_list(F.struct("track_id", "ranges")))
    return appearances(spark, sf_dir).groupBy("global_id", "clip_id").agg(F.array_join(F.transform(parts, lambda x: x["ranges"]), ",").alias("frame_ranges"))


@query(f"WITH {DET_SQL}, t AS (SELECT clip_id AS stage, sum(value) AS sec FROM (SELECT event_type AS clip_id, value FROM events) GROUP BY 1) SELECT stage, round(sec, 4) AS sec, round(100 * sec / sum(sec) OVER (), 4) AS percent FROM t")
def timing_report(spark, sf_dir):
    rows = tables.read_table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.sum("value").alias("sec"))
    whole = Window.partitionBy(F.lit(1))
    return rows.select("stage", F.round("sec", 4).alias("sec"), F.round(100 * F.col("sec") / F.sum("sec").over(whole), 4).alias("percent"))
