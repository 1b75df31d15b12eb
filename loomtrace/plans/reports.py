"""Whole runs from detections to persons, tables for viewers, acceptance checks and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions import scalars
from loomtrace.operators import evaluate as E
from loomtrace.operators import models, persons
from loomtrace.operators import tracklets as T
from loomtrace.plans.clustering import APPEAR_SQL, appearances
from loomtrace.plans.registry import query
from loomtrace.plans.scenes import PRESENCE_SQL, model_events
from loomtrace.plans.tracklets import ISLANDS_SQL
from loomtrace.sources import tables
from loomtrace.sources.tables import DET_SQL


@query()
def person_catalogue_graph(spark, sf_dir):
    """Persons by constrained greedy clustering, from detections to numbered identities."""
    return persons.graph_persons(tables.detections(spark, sf_dir, vectors=True), tables.DIMS, epsilon=0.2)


@query()
def person_catalogue_density(spark, sf_dir):
    """Persons by density clustering of prototypes, from detections to numbered identities."""
    return persons.density_persons(tables.detections(spark, sf_dir, vectors=True), tables.DIMS, epsilon=0.2, gate=0.25)


@query()
def person_catalogue_adaptive(spark, sf_dir):
    """The whole density run: smoothing in quality order, re-ranked prototypes, limits from the distances."""
    return persons.density_persons(tables.detections(spark, sf_dir, vectors=True), tables.DIMS, rerank=True, keep=F.col("h") >= 100)


@query()
def person_catalogue_penalised(spark, sf_dir):
    """The graph run over all pairs of members, with penalties for place and speed."""
    return persons.graph_persons(tables.detections(spark, sf_dir, vectors=True), tables.DIMS, epsilon=0.3, linkage="mean", temporal=0.05, motion=0.0005)


@query()
def box_tracker(spark, sf_dir):
    return models.track_boxes(tables.detections(spark, sf_dir))


@query(f"""WITH {ISLANDS_SQL}, asked AS (SELECT event_id, clip_id, track_id, frame_num + event_id % 3 AS frame FROM det)
SELECT event_id, bool_or(frame BETWEEN s AND e) AS inside FROM asked JOIN ranges USING (clip_id, track_id) GROUP BY 1""")
def frame_in_ranges(spark, sf_dir):
    """Whether a frame lies in any closed range of its tracklet."""
    det = tables.detections(spark, sf_dir)
    spans = T.frame_ranges(det).groupBy("clip_id", "track_id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    asked = det.select("event_id", "clip_id", "track_id", (F.col("frame_num") + F.col("event_id") % 3).alias("frame"))
    return asked.join(spans, ["clip_id", "track_id"]).select("event_id", F.exists("spans", lambda r: F.col("frame").between(r["s"], r["e"])).alias("inside"))


@query(f"""WITH {APPEAR_SQL}, boxes AS (SELECT event_id, clip_id, track_id, frame_num, least(greatest(CAST(floor(x1 / 1.7::DOUBLE) AS BIGINT), 0), 639) AS left_px, least(greatest(CAST(floor(y1 / 1.7::DOUBLE) AS BIGINT), 0), 359) AS top_px,
  least(greatest(CAST(ceil(x2 / 1.7::DOUBLE) AS BIGINT), 0), 640) AS right_px, least(greatest(CAST(ceil(y2 / 1.7::DOUBLE) AS BIGINT), 0), 360) AS bottom_px FROM det WHERE (frame_num - 1) % 5 = 0)
SELECT event_id, b.clip_id, frame_num, left_px, top_px, right_px, bottom_px, coalesce(global_id, b.track_id) AS colour_id,
  't' || b.track_id || CASE WHEN global_id IS NULL THEN '' ELSE ' g' || global_id || printf(' p=%.2f', probability) END AS label
FROM boxes b LEFT JOIN app ON app.clip_id = b.clip_id AND app.track_id = b.track_id WHERE right_px > left_px AND bottom_px > top_px""")
def viz_boxes(spark, sf_dir):
    """Boxes of every fifth frame in whole pixels of a 640 x 360 view, with labels and the number that sets the colour."""

    def px(c, way, top):
        return F.least(F.greatest(way(F.col(c) / F.lit(1.7)).cast("long"), F.lit(0)), F.lit(top)).cast("long")

    det = tables.detections(spark, sf_dir).where((F.col("frame_num") - 1) % 5 == 0)
    rows = det.select(
        "event_id", "clip_id", "track_id", "frame_num",
        px("x1", F.floor, 639).alias("left_px"), px("y1", F.floor, 359).alias("top_px"), px("x2", F.ceil, 640).alias("right_px"), px("y2", F.ceil, 360).alias("bottom_px"),
    ).where("right_px > left_px and bottom_px > top_px")
    book = appearances(spark, sf_dir).select("clip_id", "track_id", "global_id", "probability")
    label = scalars.identity_label(F.col("track_id"), F.col("global_id"), F.col("probability"))
    return rows.join(book, ["clip_id", "track_id"], "left").select(
        "event_id", "clip_id", "frame_num", "left_px", "top_px", "right_px", "bottom_px", F.coalesce("global_id", "track_id").alias("colour_id"), label.alias("label")
    )


@query(f"""WITH {PRESENCE_SQL} SELECT shot AS clip_id, 'clip: ' || shot || chr(10) || 'label: crime' || chr(10) || 'segments:' || chr(10) ||
  string_agg(printf('- %.2fs-%.2fs people=', a, b) || CASE WHEN p1 = p2 THEN CAST(p1 AS VARCHAR) ELSE least(p1, p2) || ', ' || greatest(p1, p2) END, chr(10) ORDER BY scene_id) AS body FROM model GROUP BY 1""")
def viz_scene_text(spark, sf_dir):
    """A clip's scene as the text panel of a viewer."""
    people = F.array_join(F.array_sort(F.array_distinct(F.array("p1", "p2"))), ", ")
    line = F.format_string("- %.2fs-%.2fs people=%s", "a", "b", people)
    lines = F.array_sort(F.collect_list(F.struct("scene_id", line.alias("t"))))
    rows = model_events(spark, sf_dir).groupBy(F.col("shot").alias("clip_id")).agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("t"))
    return rows.select("clip_id", F.concat(F.lit("clip: "), "clip_id", F.lit("\nlabel: crime\nsegments:\n"), "t").alias("body"))


@query(f"""WITH {APPEAR_SQL}, p AS (SELECT global_id, count(DISTINCT clip_id) AS clips, bool_and(ranges <> '') AS spans FROM app GROUP BY 1),
t AS (SELECT count(*) AS n, count(*) FILTER (clips > 1) AS crossing, coalesce(bool_and(spans), false) AS spans FROM p)
SELECT 'persons are more than 0 and under 25' AS check_name, n > 0 AND n < 25 AS passed FROM t UNION ALL SELECT 'some person is in several clips', crossing > 0 FROM t
UNION ALL SELECT 'over 40 percent are in several clips', n > 0 AND 100.0 * crossing / n > 40 FROM t UNION ALL SELECT 'every appearance has frame ranges', spans FROM t""")
def verify_catalogue(spark, sf_dir):
    """Acceptance checks of a catalogue, one row a check."""
    p = appearances(spark, sf_dir).groupBy("global_id").agg(F.countDistinct("clip_id").alias("clips"), F.bool_and(F.col("ranges") != "").alias("spans"))
    n, crossing = F.count("*"), F.count_if(F.col("clips") > 1)
    checks = {
        "persons are more than 0 and under 25": (n > 0) & (n < 25),
        "some person is in several clips": crossing > 0,
        "over 40 percent are in several clips": F.coalesce((n > 0) & (F.try_divide(100.0 * crossing, n) > 40), F.lit(False)),
        "every appearance has frame ranges": F.coalesce(F.bool_and("spans"), F.lit(False)),
    }
    return p.agg(F.array(*[F.struct(F.lit(k).alias("check_name"), v.alias("passed")) for k, v in checks.items()]).alias("c")).select(F.inline("c"))


@query(f"""WITH {PRESENCE_SQL}, clips AS (SELECT DISTINCT event_type AS clip_id FROM events), lab AS (SELECT c.clip_id, CASE WHEN count(scene_id) > 0 THEN 'crime' ELSE 'normal' END AS label FROM clips c LEFT JOIN model m USING (clip_id) GROUP BY 1)
SELECT 'four clips are labelled' AS check_name, count(*) = 4 AS passed FROM lab UNION ALL SELECT 'labels are normal or crime', bool_and(label IN ('normal', 'crime')) FROM lab UNION ALL SELECT 'some clip shows a crime', bool_or(label = 'crime') FROM lab""")
def verify_scene_labels(spark, sf_dir):
    """Acceptance checks of the scene labels, one row a check."""
    clips = tables.read_table(spark, sf_dir, "events").select(F.col("event_type").alias("clip_id")).distinct()
    marked = model_events(spark, sf_dir).select("clip_id").distinct().withColumn("label", F.lit("crime"))
    lab = clips.join(marked, "clip_id", "left").withColumn("label", F.coalesce("label", F.lit("normal")))
    checks = {
        "four clips are labelled": F.count("*") == 4,
        "labels are normal or crime": F.bool_and(F.col("label").isin("normal", "crime")),
        "some clip shows a crime": F.bool_or(F.col("label") == "crime"),
    }
    return lab.agg(F.array(*[F.struct(F.lit(k).alias("check_name"), v.alias("passed")) for k, v in checks.items()]).alias("c")).select(F.inline("c"))


RUNS = (5, 10, 20)


@query(" UNION ALL ".join(f"""SELECT '| every {m} | ' || count(DISTINCT pred) || ' | ' || printf('%.4f', sum(top)::DOUBLE / sum(n)) || ' |' AS line FROM (
  SELECT pred, max(c) AS top, sum(c) AS n FROM (SELECT vec_id % {m} AS pred, label, count(*) AS c FROM embeddings GROUP BY ALL) GROUP BY 1)""" for m in RUNS))
def ablation_report(spark, sf_dir):
    """One Markdown line for each run: its clusters and their purity."""
    out = None
    for m in RUNS:  # a run is a setting, not data
        counts = E.contingency(tables.eval_items(spark, sf_dir).withColumn("pred", F.col("item") % m))
        per = counts.groupBy("pred").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
        line = per.agg(F.format_string(f"| every {m} | %d | %.4f |", F.count("*"), F.sum("top") / F.sum("n")).alias("line"))
        out = line if out is None else out.unionByName(line)
    return out


@query(f"""WITH {APPEAR_SQL}, f AS (SELECT clip_id, frame_num, count(*) AS n, count(global_id) AS named, list_sort(list(DISTINCT global_id) FILTER (global_id IS NOT NULL)) AS p
  FROM det LEFT JOIN app USING (clip_id, track_id) GROUP BY ALL)
SELECT clip_id, frame_num, n AS n_detections, n - named AS n_unnamed, coalesce(array_to_string(p, ','), '') AS persons FROM f""")
def review_manifest(spark, sf_dir):
    """What a reviewer sees of each frame: its detections, those without a person, and the persons."""
    book = appearances(spark, sf_dir).select("clip_id", "track_id", "global_id")
    rows = tables.detections(spark, sf_dir).select("clip_id", "track_id", "frame_num").join(book, ["clip_id", "track_id"], "left").groupBy("clip_id", "frame_num")
    return rows.agg(
        F.count("*").alias("n_detections"),
        F.count_if(F.col("global_id").isNull()).alias("n_unnamed"),
        F.array_join(F.array_sort(F.collect_set("global_id")), ",").alias("persons"),
    )
