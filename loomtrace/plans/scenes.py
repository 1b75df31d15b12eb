"""Queries over presence intervals, events and scenes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtrace.functions import scalars
from loomtrace.operators.scenes import event_sentence, justify
from loomtrace.operators import tracklets as T
from loomtrace.plans.registry import query
from loomtrace.plans.tracklets import ISLANDS_SQL
from loomtrace.sources import tables

PRESENCE_SQL = f"""{ISLANDS_SQL}, presence AS (SELECT clip_id, track_id % 40 AS gid, s, e, greatest(s - 1, 0) / 30.0::DOUBLE AS t0, greatest(e - 1, 0) / 30.0::DOUBLE AS t1 FROM ranges),
model AS (SELECT event_id AS scene_id, event_type AS clip_id, (event_id % 100) / 30.0::DOUBLE AS a, (event_id % 100 + event_id % 7) / 30.0::DOUBLE AS b, event_id % 40 AS p1, (event_id * 3) % 40 AS p2,
  event_type || '_' || (event_id // 50) AS shot, CASE event_id % 3 WHEN 0 THEN 'fighting' WHEN 1 THEN 'theft' ELSE 'robbery' END AS kind FROM events)"""


def presence(spark, sf_dir):
    fps = F.lit(tables.FPS)
    rows = T.frame_ranges(tables.detections(spark, sf_dir))
    return rows.select("clip_id", (F.col("track_id") % 40).alias("gid"), "s", "e", scalars.frame_to_seconds(F.col("s"), fps).alias("t0"), scalars.frame_to_seconds(F.col("e"), fps).alias("t1"))


def model_events(spark, sf_dir):
    """Event proposals as a model would give them, one a row of the events table; a shot has a bounded number."""
    e = F.col("event_id")
    return tables.read_table(spark, sf_dir, "events").select(
        e.alias("scene_id"),
        F.col("event_type").alias("clip_id"),
        ((e % 100) / 30.0).alias("a"),
        ((e % 100 + e % 7) / 30.0).alias("b"),
        (e % 40).alias("p1"),
        ((e * 3) % 40).alias("p2"),
        F.concat_ws("_", "event_type", F.floor(e / 50).cast("string")).alias("shot"),
        F.when(e % 3 == 0, "fighting").when(e % 3 == 1, "theft").otherwise("robbery").alias("kind"),
    )


def merged_presence(spark, sf_dir):
    """Presence of each person in a clip with overlapping intervals joined: a few rows a person."""
    order = Window.partitionBy("clip_id", "gid").orderBy("s", "e")
    rows = presence(spark, sf_dir).withColumn("reach", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("s") <= F.col("reach"), 0).otherwise(1)).over(order))
    return rows.groupBy("clip_id", "gid", "run").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("run")


def overlapping(spark, sf_dir):
    """(scene, gid) of everyone in view during an event; the join is bucketed by second within a clip. Proposals of the
    same interval share their answer."""
    seen = merged_presence(spark, sf_dir).withColumn("second", F.explode(F.sequence(F.floor("t0"), F.floor("t1"))))
    events = model_events(spark, sf_dir).select("scene_id", "clip_id", "a", "b")
    asked = events.select("clip_id", "a", "b").distinct().withColumn("second", F.explode(F.sequence(F.floor("a"), F.floor("b"))))
    both = asked.join(seen, ["clip_id", "second"]).where(scalars.overlaps(F.col("a"), F.col("b"), F.col("t0"), F.col("t1")))
    return events.join(both.select("clip_id", "a", "b", "gid").distinct(), ["clip_id", "a", "b"]).select("scene_id", "gid")


@query(f"WITH {PRESENCE_SQL} SELECT clip_id, gid, round(t0, 4) AS t0, round(t1, 4) AS t1 FROM presence")
def presence_intervals(spark, sf_dir):
    return presence(spark, sf_dir).select("clip_id", "gid", F.round("t0", 4).alias("t0"), F.round("t1", 4).alias("t1"))


RESOLVED_SQL = f"""{PRESENCE_SQL}, hit AS (SELECT DISTINCT scene_id, gid FROM model m JOIN presence p ON m.clip_id = p.clip_id AND a <= t1 AND t0 <= b),
grouped AS (SELECT m.scene_id, p1, p2, list(DISTINCT gid) FILTER (gid IS NOT NULL) AS seen FROM model m LEFT JOIN hit USING (scene_id) GROUP BY ALL),
picked AS (SELECT scene_id, seen, list_filter(list_distinct([p1, p2]), lambda x: list_contains(coalesce(seen, []), x)) AS agreed FROM grouped)"""


@query(f"""WITH {RESOLVED_SQL}
SELECT scene_id, coalesce(array_to_string(list_sort(CASE WHEN len(agreed) > 0 THEN agreed ELSE seen END), ','), '') AS persons FROM picked""")
def event_person_resolve(spark, sf_dir):
    """Proposed persons who are in view; all who are in view where none of the proposed is."""
    return resolved(spark, sf_dir).select("scene_id", F.array_join("persons", ",").alias("persons"))


def resolved(spark, sf_dir):
    """The proposals with ``persons``, ascending."""
    seen = overlapping(spark, sf_dir).groupBy("scene_id").agg(F.sort_array(F.collect_set("gid")).alias("seen"))
    rows = model_events(spark, sf_dir).join(seen, "scene_id", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<bigint>")))
    agreed = F.sort_array(F.array_intersect(F.array_distinct(F.array("p1", "p2")), F.col("seen")))
    return rows.withColumn("persons", F.when(F.size(agreed) > 0, agreed).otherwise(F.col("seen")))


SEGMENT_SQL = "segments AS (SELECT event_id AS seg, event_type AS clip_id, event_id % 100 + 1 AS s, event_id % 100 + 1 + event_id % 9 AS e FROM events)"


def _segments(spark, sf_dir):
    e = F.col("event_id")
    return tables.read_table(spark, sf_dir, "events").select(e.alias("seg"), F.col("event_type").alias("clip_id"), (e % 100 + 1).alias("s"), (e % 100 + 1 + e % 9).alias("e"))


@query(f"""WITH {ISLANDS_SQL}, {SEGMENT_SQL} SELECT seg, count(*) AS n_detections, count(DISTINCT track_id) AS n_people FROM segments g JOIN det d ON d.clip_id = g.clip_id AND d.frame_num BETWEEN g.s AND g.e GROUP BY 1""")
def segment_people_range_join(spark, sf_dir):
    segments = _segments(spark, sf_dir)
    spans = segments.select("clip_id", "s", "e").distinct()  # segments of one span share their answer
    frames = spans.withColumn("frame_num", F.explode(F.sequence("s", "e")))  # segments are short: an equi-join by frame
    seen = tables.detections(spark, sf_dir).groupBy("clip_id", "frame_num", "track_id").agg(F.count("*").alias("n"))
    rows = frames.join(seen, ["clip_id", "frame_num"]).groupBy("clip_id", "s", "e").agg(F.sum("n").alias("n_detections"), F.countDistinct("track_id").alias("n_people"))
    return segments.join(rows, ["clip_id", "s", "e"]).select("seg", "n_detections", "n_people")


@query(f"""WITH {ISLANDS_SQL}, {SEGMENT_SQL} SELECT event_id, count(seg) AS n_segments FROM det d LEFT JOIN segments g ON d.clip_id = g.clip_id AND d.timestamp_sec BETWEEN (g.s - 1) / 30.0::DOUBLE AND (g.e - 1) / 30.0::DOUBLE GROUP BY 1""")
def point_in_segment(spark, sf_dir):
    """Segments that hold each detection's time; both are on the frame grid, so the time's frame is the key."""
    frames = _segments(spark, sf_dir).withColumn("frame_num", F.explode(F.sequence("s", "e"))).groupBy("clip_id", "frame_num").agg(F.count("*").alias("n"))
    rows = tables.detections(spark, sf_dir).join(frames, ["clip_id", "frame_num"], "left")
    return rows.select("event_id", F.coalesce("n", F.lit(0)).alias("n_segments"))


@query(f"""WITH {ISLANDS_SQL} SELECT clip_id, (frame_num - 1) // 16 AS segment, count(*) AS n_detections, min(frame_num) AS s, max(frame_num) AS e, 16 - count(DISTINCT frame_num) AS n_padded FROM det GROUP BY ALL""")
def count_window_segments(spark, sf_dir):
    """Sixteen-frame segments; the last frame is repeated to fill one."""
    rows = tables.detections(spark, sf_dir).groupBy("clip_id", F.floor((F.col("frame_num") - 1) / 16).alias("segment"))
    return rows.agg(F.count("*").alias("n_detections"), F.min("frame_num").alias("s"), F.max("frame_num").alias("e"), (16 - F.countDistinct("frame_num")).alias("n_padded"))


@query(f"""WITH {RESOLVED_SQL}, said AS (SELECT scene_id, shot, kind, a, b, list_sort(CASE WHEN len(agreed) > 0 THEN agreed ELSE coalesce(seen, []) END) AS ids FROM model JOIN picked USING (scene_id))
SELECT shot AS clip_id, 'crime' AS label, string_agg(printf('%s at %.1fs-%.1fs', kind, a, b) || CASE WHEN len(ids) > 0 THEN ' involving person ' || array_to_string(ids, ', ') ELSE '' END, '; ' ORDER BY scene_id) AS justification FROM said GROUP BY 1
UNION ALL SELECT c || '_quiet', 'normal', 'No criminal activity detected in the clip.' FROM (SELECT DISTINCT event_type AS c FROM events)""")
def scene_justification(spark, sf_dir):
    """A clip's label follows from its events, whatever the model said; the reasons are put in words."""
    rows = resolved(spark, sf_dir).select(F.col("shot").alias("clip_id"), "scene_id", event_sentence(F.col("kind"), F.col("a"), F.col("b"), F.col("persons")).alias("t"))
    clips = tables.read_table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("_quiet")).alias("clip_id")).distinct()
    return justify(clips.unionByName(rows.select("clip_id").distinct()), rows)
