"""Queries over documents, frame sets, model answers and configuration rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions import scalars, vectors
from loomtrace.operators import frames, scenes
from loomtrace.operators import tracklets as T
from loomtrace.plans import evaluation, registry
from loomtrace.plans.registry import query
from loomtrace.plans.tracklets import ISLANDS_SQL
from loomtrace.sources import documents, tables
from loomtrace.sources.tables import DET_SQL

# --- scenes ------------------------------------------------------------------------------------------

#: Made labels, as a video model would name its classes; one is known as a crime without a keyword.
LABELS = ("Punching Person (boxing)", "walking the dog", "headbutting", "SLAPPING", "playing chess", "kicking soccer ball", "reading", "Shoplifting")
KNOWN = ("shoplifting",)
_LABEL_LIST = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
_WORDS = "[" + ", ".join(f"'{x}'" for x in scenes.CRIME_KEYWORDS) + "]"
_IS_CRIME = f"(len(list_filter({_WORDS}, lambda k: contains(lower(window_label), k))) > 0 OR lower(window_label) = 'shoplifting')"
WINDOW_SQL = f"""windows AS (SELECT event_id, event_type || '_' || (event_id // 50) AS clip_id, {_LABEL_LIST}[event_id % 8 + 1] AS window_label, value / (value + 100) AS score,
  (event_id % 100) / 30.0::DOUBLE AS a, (event_id % 100 + 16) / 30.0::DOUBLE AS b, event_id % 100 + 1 AS s, event_id % 100 + 17 AS e,
  CASE event_id % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN [CAST(event_id % 40 AS VARCHAR)] WHEN 2 THEN ['local_' || (event_id % 7)] ELSE [CAST(event_id % 40 AS VARCHAR), 'local_' || (event_id % 7)] END AS people FROM events)"""


def scored_windows(spark, sf_dir):
    e = F.col("event_id")
    person, local = (e % 40).cast("string"), F.concat(F.lit("local_"), (e % 7).cast("string"))
    people = F.when(e % 4 == 0, F.array().cast("array<string>")).when(e % 4 == 1, F.array(person)).when(e % 4 == 2, F.array(local)).otherwise(F.array(person, local))
    return tables.read_table(spark, sf_dir, "events").select(
        "event_id",
        F.concat_ws("_", "event_type", F.floor(e / 50).cast("string")).alias("clip_id"),
        F.element_at(F.array(*[F.lit(x) for x in LABELS]), (e % 8 + 1).cast("int")).alias("window_label"),
        (F.col("value") / (F.col("value") + 100)).alias("score"),
        ((e % 100) / 30.0).alias("a"),
        ((e % 100 + 16) / 30.0).alias("b"),
        (e % 100 + 1).alias("s"),
        (e % 100 + 17).alias("e"),
        people.alias("people"),
    )


@query(f"WITH {WINDOW_SQL} SELECT event_id, window_label, {_IS_CRIME} AS crime FROM windows")
def crime_label_match(spark, sf_dir):
    return scored_windows(spark, sf_dir).select("event_id", "window_label", scenes.says_crime(F.col("window_label"), KNOWN).alias("crime"))


@query(f"""WITH {WINDOW_SQL}, b AS (SELECT clip_id, max(score) FILTER ({_IS_CRIME.replace(" OR lower(window_label) = 'shoplifting'", "")}) AS best FROM windows GROUP BY 1)
SELECT clip_id, CASE WHEN best IS NULL THEN 'normal' ELSE 'crime' END AS label, round(coalesce(best, 0), 6) AS confidence FROM b""")
def crime_confidence(spark, sf_dir):
    """The best score of a clip's crime windows; other windows do not count."""
    return scenes.crime_confidence(scored_windows(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {WINDOW_SQL}, crimes AS (SELECT * FROM windows WHERE {_IS_CRIME}), clips AS (SELECT DISTINCT clip_id FROM windows),
said AS (SELECT clip_id, string_agg(printf('%s detected at %.1fs-%.1fs (frames %d-%d) involving ', window_label, a, b, s, e)
  || CASE WHEN len(people) > 0 THEN array_to_string(list_transform(people, lambda p: 'person ' || p), ', ') ELSE 'people' END, '; ' ORDER BY event_id) AS t FROM crimes GROUP BY 1)
SELECT clip_id, CASE WHEN t IS NULL THEN 'normal' ELSE 'crime' END AS label, coalesce(t, 'No criminal activity detected in the video clip.') AS justification FROM clips LEFT JOIN said USING (clip_id)""")
def segment_justification(spark, sf_dir):
    """The older justification: each crime segment with its frames and people."""
    rows = scored_windows(spark, sf_dir)
    said = scenes.segment_sentence(*[F.col(c) for c in ("window_label", "a", "b", "s", "e", "people")])
    crimes = rows.where(scenes.says_crime(F.col("window_label"), KNOWN)).select("clip_id", F.col("event_id").alias("scene_id"), said.alias("t"))
    return scenes.justify(rows.select("clip_id").distinct(), crimes, scenes.NOTHING_SEEN_IN_VIDEO)


ANSWERS = (
    '{"label":"crime","confidence":0.5,"events":[{"type":"theft","t_start_sec":1.5,"t_end_sec":2.5,"global_person_ids":[1,2]},{"t_start_sec":3}]}',
    '{"label":" normal "}',
    '{"label":"odd"}',
    '{"label":"crime","confidence":1.5}',
    '{"label":"crime","events":[{"t_start_sec":1},3]}',
    '{"label":"crime","events":[{"t_start_sec":0},{"t_start_sec":-1}]}',
    '{"label":"crime","events":[{"t_start_sec":3,"t_end_sec":1}]}',
    "[1,2]",
)
_ANSWER_LIST = "[" + ", ".join(f"'{x}'" for x in ANSWERS) + "]"


@query(f"""WITH raw AS (SELECT event_id AS id, CAST({_ANSWER_LIST}[event_id % 8 + 1] AS JSON) AS d FROM events),
parts AS (SELECT id, json_type(d) = 'OBJECT' AS whole, trim(coalesce(d ->> '$.label', '')) AS label, coalesce(CAST(d ->> '$.confidence' AS DOUBLE), 0) AS confidence, json_extract(d, '$.events[*]') AS ev FROM raw),
times AS (SELECT *, list_transform(ev, lambda x: coalesce(CAST(x ->> '$.t_start_sec' AS DOUBLE), 0)) AS t0,
  list_transform(ev, lambda x: coalesce(CAST(x ->> '$.t_end_sec' AS DOUBLE), CAST(x ->> '$.t_start_sec' AS DOUBLE), 0)) AS t1 FROM parts),
judged AS (SELECT *, CASE WHEN NOT whole THEN 'payload must be an object' WHEN label NOT IN ('normal', 'crime') THEN 'label must be normal or crime'
  WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence must be within 0 and 1' WHEN len(list_filter(ev, lambda x: json_type(x) <> 'OBJECT')) > 0 THEN 'events must be objects'
  WHEN list_min(t0) < 0 OR list_min(t1) < 0 THEN 'times must not be negative' WHEN len(list_filter(list_zip(t0, t1), lambda z: z[2] < z[1])) > 0 THEN 'start must not pass end' END AS error FROM times)
SELECT id, CASE WHEN error IS NULL THEN label END AS label, CASE WHEN error IS NULL THEN confidence END AS confidence, CASE WHEN error IS NULL THEN len(ev) END AS n_events,
  CASE WHEN error IS NULL THEN list_sum(t1) END AS ends, error FROM judged""")
def scene_answers(spark, sf_dir):
    """Model answers parsed and checked; the first broken rule is told."""
    e = F.col("event_id")
    rows = tables.read_table(spark, sf_dir, "events").select(e.alias("id"), F.element_at(F.array(*[F.lit(x) for x in ANSWERS]), (e % 8 + 1).cast("int")).alias("doc"))
    ends = F.when(F.size("events") > 0, F.aggregate("events", F.lit(0.0), lambda s, x: s + x["t_end_sec"]))
    return scenes.parse_answers(rows).select("id", "label", "confidence", F.when(F.col("events").isNotNull(), F.size("events").cast("long")).alias("n_events"), ends.alias("ends"), "error")


@query(f"""WITH {WINDOW_SQL}, b AS (SELECT clip_id, max(score) FILTER ({_IS_CRIME.replace(" OR lower(window_label) = 'shoplifting'", "")}) AS best FROM windows GROUP BY 1)
SELECT clip_id, '{{"clip_id":"' || clip_id || '","label":"' || CASE WHEN best IS NULL THEN 'normal' ELSE 'crime' END || '","percent":' || CAST(floor(100 * coalesce(best, 0)) AS BIGINT) || '}}' AS doc FROM b""")
def scene_documents(spark, sf_dir):
    """One JSON document a clip."""
    rows = scenes.crime_confidence(scored_windows(spark, sf_dir)).withColumn("percent", F.floor(100 * F.col("confidence")))
    return rows.select("clip_id", F.to_json(F.struct("clip_id", "label", "percent")).alias("doc"))


# --- catalogue and frame sets ------------------------------------------------------------------------


def _appearance_rows(spark, sf_dir):
    ranges = T.frame_ranges(tables.detections(spark, sf_dir)).withColumn("pair", F.array("s", "e"))
    rows = ranges.groupBy("clip_id", "track_id").agg(F.array_sort(F.collect_list("pair")).alias("ranges"))
    return rows.withColumn("global_id", F.col("track_id") % 40).withColumn("probability", ((F.col("track_id") % 4) / 4.0 + 0.25))


@query(f"""WITH {ISLANDS_SQL}, per AS (SELECT track_id % 40 AS global_id, clip_id, track_id, list([s, e] ORDER BY s, e) AS r, (track_id % 4) / 4.0::DOUBLE + 0.25 AS p FROM ranges GROUP BY clip_id, track_id)
SELECT global_id, '{{"global_id":' || global_id || ',"appearances":[' || string_agg('{{"clip_id":"' || clip_id || '","local_track_id":' || track_id || ',"frame_ranges":' || replace(CAST(r AS VARCHAR), ' ', '')
  || ',"cluster_probability":' || p || '}}', ',' ORDER BY clip_id, track_id) || ']}}' AS doc FROM per GROUP BY 1""")
def catalogue_documents(spark, sf_dir):
    """One JSON document a person."""
    rows = documents.catalogue_documents(_appearance_rows(spark, sf_dir))
    return rows.select("global_id", F.to_json(F.struct("global_id", "appearances")).alias("doc"))


SETS_SQL = f"""{ISLANDS_SQL}, g AS (SELECT DISTINCT track_id % 40 AS person, clip_id, unnest(range(s, e + 1)) AS frame_num FROM ranges),
p AS (SELECT DISTINCT track_id % 37 AS person, clip_id, unnest(range(s, e + 1)) AS frame_num FROM ranges)"""


def _sets(spark, sf_dir, modulus):
    return frames.frame_sets(T.frame_ranges(tables.detections(spark, sf_dir)).withColumn("person", F.col("track_id") % modulus))


@query(f"WITH {SETS_SQL} SELECT person, clip_id, frame_num FROM g")
def person_frame_sets(spark, sf_dir):
    return _sets(spark, sf_dir, 40)


@query(f"""WITH {SETS_SQL}, c AS (SELECT g.person AS gt, p.person AS pred, count(*) AS common FROM g JOIN p USING (clip_id, frame_num) GROUP BY 1, 2),
a AS (SELECT person AS gt, count(*) AS n FROM g GROUP BY 1), b AS (SELECT person AS pred, count(*) AS n FROM p GROUP BY 1)
SELECT gt, pred, common, a.n + b.n - common AS either FROM c JOIN a USING (gt) JOIN b USING (pred)""")
def frame_set_overlap(spark, sf_dir):
    return frames.frame_set_overlap(_sets(spark, sf_dir, 40), _sets(spark, sf_dir, 37))


@query(f"""WITH {SETS_SQL}, a AS (SELECT clip_id, frame_num, max(person) AS gt FROM g GROUP BY ALL), b AS (SELECT clip_id, frame_num, max(person) AS pred FROM p WHERE person < 30 GROUP BY ALL)
SELECT clip_id, frame_num, coalesce(gt, -1) AS gt, coalesce(pred, -1) AS pred FROM a FULL JOIN b USING (clip_id, frame_num)""")
def frame_labels(spark, sf_dir):
    """Labels of frames; the last person who claims one has it."""
    return frames.frame_labels(_sets(spark, sf_dir, 40), _sets(spark, sf_dir, 37).where("person < 30"))


@query(f"WITH {DET_SQL} SELECT clip_id, track_id, arg_min(event_id, [frame_num, event_id]) AS first_event, arg_max(event_id, [frame_num, event_id]) AS last_event FROM det GROUP BY ALL HAVING count(*) >= 2")
def farthest_pair(spark, sf_dir):
    return frames.ends_by_frame(tables.detections(spark, sf_dir))


@query(f"""WITH {DET_SQL} SELECT clip_id || '.mp4' AS video_path, clip_id, frame_num, count(*) AS n, string_agg(track_id || ':' || event_id, ',' ORDER BY track_id, event_id) AS tracks FROM det GROUP BY ALL""")
def frame_groups(spark, sf_dir):
    """Detections of each frame of each file, for a second look at the frame."""
    rows = tables.detections(spark, sf_dir).withColumn("video_path", F.concat("clip_id", F.lit(".mp4")))
    tracks = F.transform(F.array_sort(F.collect_list(F.struct("track_id", "event_id"))), lambda x: F.concat_ws(":", x["track_id"].cast("string"), x["event_id"].cast("string")))
    return rows.groupBy("video_path", "clip_id", "frame_num").agg(F.count("*").alias("n"), F.array_join(tracks, ",").alias("tracks"))


@query(f"""WITH {DET_SQL}, v AS (SELECT clip_id, track_id, i AS k, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM det JOIN embeddings USING (vec_id), (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
l AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY clip_id, track_id)) AS y FROM v) SELECT clip_id, track_id, round(sum(y * k), 5) AS digest FROM l GROUP BY ALL""")
def tracklet_mean_vectors(spark, sf_dir):
    rows = frames.mean_vectors(tables.detections(spark, sf_dir, vectors=True), tables.DIMS)
    return rows.select("clip_id", "track_id", F.round(vectors.checksum(F.col("v")), 5).alias("digest"))


@query(f"""WITH {DET_SQL}, f AS (SELECT clip_id, frame_num, count(*) AS n, row_number() OVER (PARTITION BY clip_id ORDER BY frame_num) - 1 AS r FROM det GROUP BY clip_id, frame_num)
SELECT clip_id, r // 8 AS batch, count(*) AS n_frames, CAST(sum(n) AS BIGINT) AS n_detections FROM f GROUP BY ALL""")
def frame_batches(spark, sf_dir):
    return frames.frame_batches(tables.detections(spark, sf_dir))


@query("SELECT * FROM ({}) JOIN ({}) USING (clip_id, track_id, num_frames) JOIN ({}) USING (clip_id, track_id) JOIN ({}) USING (clip_id, track_id)".format(
    *(registry.ORACLE_SQL[n] for n in ("tracklet_build", "tracklet_frame_ranges", "motion_profile", "temporal_center"))))
def tracklet_info(spark, sf_dir):
    """All that is known of a tracklet, one row each."""
    det = tables.detections(spark, sf_dir)
    mean = det.groupBy("clip_id", "track_id").agg(F.avg("frame_num").alias("mean_frame"))
    rows = T.build(det).join(T.ranges_text(T.frame_ranges(det)).drop("num_frames"), ["clip_id", "track_id"]).join(T.motion(det), ["clip_id", "track_id"]).join(mean, ["clip_id", "track_id"])
    ratio = F.col("mean_frame") / F.col("clip_last_frame")
    rounded = {"motion_speed": F.col("motion_speed"), "relative_sec": F.col("median_sec"), "center_ratio": ratio, "quality_mean": F.col("quality_mean")}
    return rows.select("clip_id", "track_id", "num_frames", "first_frame", "last_frame", "n_ranges", "ranges", "n_steps", *[F.round(c, 6).alias(n) for n, c in rounded.items()])


# --- boxes, frames and files -------------------------------------------------------------------------


@query(f"""WITH {DET_SQL} SELECT clip_id, clip_id || '.mp4' AS video_path, frame_num, track_id, vec_id, round(CASE WHEN event_id % 4 = 0 THEN confidence ELSE confidence / 2 END, 9) AS confidence,
  round(x1 / 1280.0::DOUBLE + w / 1280.0::DOUBLE / 2, 9) AS center_x, round(y1 / 720.0::DOUBLE + h / 720.0::DOUBLE / 2, 9) AS center_y FROM det WHERE event_id % 6 <> 0""")
def flatten_frames(spark, sf_dir):
    """Frames with nested detections to one row per detection with an embedding."""
    det = tables.detections(spark, sf_dir)
    e = F.col("event_id")
    box = F.array(F.col("x1") / float(tables.WIDTH), F.col("y1") / float(tables.HEIGHT), F.col("w") / float(tables.WIDTH), F.col("h") / float(tables.HEIGHT))
    nested = F.struct(
        "track_id", F.when(e % 6 != 0, F.array(F.col("vec_id"))).alias("embeddings"), F.when(e % 4 != 0, F.col("confidence") / 2).alias("det_confidence"), "confidence", box.alias("bounding_box")
    )
    held = det.groupBy("clip_id", F.concat("clip_id", F.lit(".mp4")).alias("video_path"), "frame_num").agg(F.collect_list(nested).alias("detections"))
    rows = tables.flatten_frames(held)
    return rows.select("clip_id", "video_path", "frame_num", "track_id", F.col("embeddings")[0].alias("vec_id"), *[F.round(c, 9).alias(c) for c in ("confidence", "center_x", "center_y")])


FPS_SQL = "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 25 ELSE 29.97 END"


def _fps(e):
    return F.when(e % 4 == 1, 0.0).when(e % 4 == 2, 25.0).when(e % 4 == 3, 29.97)


@query(f"""WITH {DET_SQL}, f AS (SELECT event_id, frame_num, CAST(CASE WHEN {FPS_SQL} > 1e-6 THEN {FPS_SQL} ELSE 30 END AS DOUBLE) AS fps FROM det)
SELECT event_id, fps, round(greatest(frame_num - 1, 0) / fps, 6) AS sec, round(frame_num / fps, 6) AS sec_unshifted FROM f""")
def frame_times(spark, sf_dir):
    """The frame rate in effect and both conventions of a frame's time."""
    fps = scalars.effective_fps(_fps(F.col("event_id")))
    rows = tables.detections(spark, sf_dir).select("event_id", "frame_num", fps.alias("fps"))
    return rows.select("event_id", "fps", F.round(scalars.frame_to_seconds(F.col("frame_num"), F.col("fps")), 6).alias("sec"), F.round(scalars.frame_to_seconds_unshifted(F.col("frame_num"), F.col("fps")), 6).alias("sec_unshifted"))


@query(f"""WITH {DET_SQL}, m AS (SELECT clip_id, max(frame_num) AS frame_count, max({FPS_SQL}) AS fps FROM det GROUP BY 1)
SELECT clip_id, frame_count, CAST(CASE WHEN fps > 1e-6 THEN fps ELSE 30 END AS DOUBLE) AS fps, round(frame_count / CAST(CASE WHEN fps > 1e-6 THEN fps ELSE 30 END AS DOUBLE), 6) AS duration FROM m""")
def video_meta(spark, sf_dir):
    """One row a clip: frames, frame rate in effect, seconds."""
    rows = tables.detections(spark, sf_dir).groupBy("clip_id").agg(F.max("frame_num").alias("frame_count"), F.max(_fps(F.col("event_id"))).alias("fps"))
    rows = rows.withColumn("fps", scalars.effective_fps(F.col("fps")))
    return rows.withColumn("duration", F.round(F.col("frame_count") / F.col("fps"), 6))


@query(f"""WITH {DET_SQL}, raw AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN [CAST(x1 AS VARCHAR), CAST(y1 AS VARCHAR), 'n/a', CAST(y2 AS VARCHAR)] WHEN 2 THEN [CAST(x1 AS VARCHAR), CAST(y1 AS VARCHAR)]
  ELSE [CAST(x1 AS VARCHAR), CAST(y1 AS VARCHAR), x2 || '.5', CAST(y2 AS VARCHAR)] END AS v FROM det), t AS (SELECT event_id, v, list_transform(v, lambda x: TRY_CAST(x AS DOUBLE)) AS d FROM raw)
SELECT event_id, len(v) = 4 AND len(list_filter(d, lambda x: x IS NULL)) = 0 AND v IS NOT NULL AS whole, CASE WHEN len(v) = 4 AND len(list_filter(d, lambda x: x IS NULL)) = 0 THEN list_sum(d) END AS total FROM t""")
def normalize_box(spark, sf_dir):
    """A box of four numbers, or none."""
    e, text = F.col("event_id"), lambda c: F.col(c).cast("string")
    raw = (
        F.when(e % 5 == 0, None).when(e % 5 == 1, F.array(text("x1"), text("y1"), F.lit("n/a"), text("y2"))).when(e % 5 == 2, F.array(text("x1"), text("y1")))
        .otherwise(F.array(text("x1"), text("y1"), F.concat(text("x2"), F.lit(".5")), text("y2")))
    )
    rows = tables.detections(spark, sf_dir).select("event_id", raw.alias("raw"))
    box = frames.box_or_null(F.col("raw"))
    whole = F.when(F.col("raw").isNull(), F.when(e % 5 == 0, F.lit(None).cast("boolean"))).otherwise(box.isNotNull())
    return rows.select("event_id", F.coalesce(whole, F.lit(False)).alias("whole"), F.aggregate(box, F.lit(0.0), lambda s, x: s + x).alias("total"))


@query(f"""WITH {DET_SQL} SELECT event_id, round(x1 / 1280.0::DOUBLE, 9) AS rel_x, round(y1 / 720.0::DOUBLE, 9) AS rel_y, round(w / 1280.0::DOUBLE, 9) AS rel_w, round(h / 720.0::DOUBLE, 9) AS rel_h,
  (x1 + x2) / 2.0::DOUBLE AS center_x, (y1 + y2) / 2.0::DOUBLE AS center_y FROM det""")
def box_relative(spark, sf_dir):
    w, h = float(tables.WIDTH), float(tables.HEIGHT)
    parts = {"rel_x": F.col("x1") / w, "rel_y": F.col("y1") / h, "rel_w": F.col("w") / w, "rel_h": F.col("h") / h}
    return tables.detections(spark, sf_dir).select(
        "event_id", *[F.round(c, 9).alias(n) for n, c in parts.items()], ((F.col("x1") + F.col("x2")) / 2.0).alias("center_x"), ((F.col("y1") + F.col("y2")) / 2.0).alias("center_y")
    )


POSED_SQL = f"""{DET_SQL}, posed AS (SELECT event_id, clip_id, frame_num, CASE WHEN event_id % 9 > 0 THEN x1 - 60 END AS x1, CASE WHEN event_id % 9 > 0 THEN y1 END AS y1,
  CASE WHEN event_id % 9 > 0 THEN x2 - 60 END AS x2, CASE WHEN event_id % 9 > 0 THEN y2 END AS y2, list_transform(range(1, 18), lambda k: (event_id * k % 10) / 10.0::DOUBLE) AS visibility FROM det)"""


def _posed(spark, sf_dir):
    e = F.col("event_id")
    boxed = [F.when(e % 9 > 0, c).alias(n) for n, c in (("x1", F.col("x1") - 60), ("y1", F.col("y1")), ("x2", F.col("x2") - 60), ("y2", F.col("y2")))]
    visibility = F.transform(F.sequence(F.lit(1), F.lit(17)), lambda k: (e * k % 10) / 10.0)
    return tables.detections(spark, sf_dir).select("event_id", "clip_id", "frame_num", *boxed, visibility.alias("visibility"))


@query(f"WITH {POSED_SQL} SELECT event_id, len(list_filter(visibility, lambda v: v > 0.5)) AS n_visible FROM posed")
def visible_keypoints(spark, sf_dir):
    return _posed(spark, sf_dir).select("event_id", frames.visible_keypoints(F.col("visibility")).cast("long").alias("n_visible"))


@query(f"""WITH {POSED_SQL}, held AS (SELECT *, least(greatest(x1, 0), 1279) AS cx1, least(greatest(y1, 0), 719) AS cy1, least(greatest(x2, 0), 1279) AS cx2, least(greatest(y2, 0), 719) AS cy2 FROM posed),
pairs AS (SELECT a.event_id, greatest(least(a.cx2, b.x2) - greatest(a.cx1, b.x1), 0) * greatest(least(a.cy2, b.y2) - greatest(a.cy1, b.y1), 0) AS common,
  greatest(a.cx2 - a.cx1, 0) * greatest(a.cy2 - a.cy1, 0) AS own, (b.x2 - b.x1) * (b.y2 - b.y1) AS other
  FROM held a JOIN posed b ON a.clip_id = b.clip_id AND a.frame_num = b.frame_num AND a.event_id <> b.event_id AND NOT (a.x1 = b.x1 AND a.y1 = b.y1 AND a.x2 = b.x2 AND a.y2 = b.y2) WHERE b.x1 IS NOT NULL),
worst AS (SELECT event_id, max(common / greatest(own + other - common, 1e-12)::DOUBLE) AS worst FROM pairs GROUP BY 1)
SELECT event_id, CASE WHEN x1 IS NULL THEN true ELSE cx2 > cx1 AND cy2 > cy1 AND coalesce((cy2 - cy1)::DOUBLE / nullif(cx2 - cx1, 0) BETWEEN 1.3 AND 4.0, false) AND (cx2 - cx1) * (cy2 - cy1) >= 0.0015 * 1280 * 720
  AND coalesce(worst, 0) < 0.55 AND len(list_filter(visibility, lambda v: v > 0.5)) >= 7 END AS keep FROM held LEFT JOIN worst USING (event_id)""")
def crop_filter_posed(spark, sf_dir):
    """The whole crop rule: boxes held to the frame, detections without a box pass, seven visible keypoints."""
    return frames.keep_crops(_posed(spark, sf_dir), tables.WIDTH, tables.HEIGHT, 7)


@query("""SELECT event_id, 'models/' || n AS requested, CASE WHEN regexp_full_match(n, 'yolo26[nslmx]\\.pt') THEN 'yolo11' || n[7] || '.pt' END AS fallback
FROM (SELECT event_id, ['yolo26n.pt', 'yolo26x.pt', 'yolo11n.pt', 'yolo26q.pt', 'yolo26m.pt.bak', 'own.pt'][event_id % 6 + 1] AS n FROM events)""")
def fallback_weights(spark, sf_dir):
    """Weights to fall back to where a detector's newer ones are missing."""
    names = [F.lit(f"models/{x}") for x in ("yolo26n.pt", "yolo26x.pt", "yolo11n.pt", "yolo26q.pt", "yolo26m.pt.bak", "own.pt")]
    rows = tables.read_table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*names), (F.col("event_id") % 6 + 1).cast("int")).alias("requested"))
    return rows.withColumn("fallback", scalars.fallback_weights(F.col("requested")))


@query("""WITH files AS (SELECT 'd' || (user_id % 50) AS dir, event_id * 7 % 1000 AS mtime, CASE WHEN event_id % 5 = 0 AND user_id % 2 = 0 THEN 'k' || event_id || '_all_detections.json'
  WHEN event_id % 3 = 0 THEN 'k' || event_id || '_all_detections_v' || (event_id % 4) || '.json' ELSE 'k' || event_id || '.txt' END AS name FROM events),
kinds AS (SELECT *, CASE WHEN name LIKE '%\\_all\\_detections.json' ESCAPE '\\' THEN 1 WHEN name LIKE '%\\_all\\_detections\\_%.json' ESCAPE '\\' THEN 0 END AS kind FROM files)
SELECT dir, name FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY kind DESC, mtime DESC, name DESC) AS r FROM kinds WHERE kind IS NOT NULL) WHERE r = 1""")
def detection_cache_choice(spark, sf_dir):
    """Which of a folder's detection caches is read."""
    e = F.col("event_id")
    stem = F.concat(F.lit("k"), e.cast("string"))
    name = (
        F.when((e % 5 == 0) & (F.col("user_id") % 2 == 0), F.concat(stem, F.lit("_all_detections.json")))
        .when(e % 3 == 0, F.concat(stem, F.lit("_all_detections_v"), (e % 4).cast("string"), F.lit(".json")))
        .otherwise(F.concat(stem, F.lit(".txt")))
    )
    files = tables.read_table(spark, sf_dir, "events").select(F.concat(F.lit("d"), (F.col("user_id") % 50).cast("string")).alias("dir"), name.alias("name"), (e * 7 % 1000).alias("mtime"))
    return documents.choose_cache(files)


# --- evaluation report -------------------------------------------------------------------------------


@query("""SELECT a.adjusted_rand, v.v_measure, p.purity, s.accuracy AS scene_accuracy, s.macro_f1, s.person_recall,
  '{{"person_reid":{{"v_measure":' || printf('%.4f', v.v_measure) || ',"adjusted_rand_index":' || printf('%.4f', a.adjusted_rand) || ',"purity":' || printf('%.4f', p.purity)
  || '}},"scene":{{"accuracy":' || printf('%.4f', s.accuracy) || ',"macro_f1":' || printf('%.4f', s.macro_f1) || '}}}}' AS doc FROM ({}) a, ({}) v, ({}) p, ({}) s""".format(
    *(registry.ORACLE_SQL[n] for n in ("adjusted_rand", "v_measure", "purity", "scene_metrics"))))
def eval_report(spark, sf_dir):
    """All metrics in one row, and as a JSON document."""
    parts = [evaluation.adjusted_rand(spark, sf_dir), evaluation.v_measure(spark, sf_dir).select("v_measure"), evaluation.purity(spark, sf_dir)]
    parts.append(evaluation.scene_metrics(spark, sf_dir).withColumnRenamed("accuracy", "scene_accuracy"))
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(part)  # one row each
    doc = F.format_string(
        '{"person_reid":{"v_measure":%.4f,"adjusted_rand_index":%.4f,"purity":%.4f},"scene":{"accuracy":%.4f,"macro_f1":%.4f}}', "v_measure", "adjusted_rand", "purity", "scene_accuracy", "macro_f1"
    )
    return row.withColumn("doc", doc)
