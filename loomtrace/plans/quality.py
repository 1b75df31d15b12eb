"""Data-quality, review and streaming queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtrace.operators import rules as R
from loomtrace.plans.clustering import APPEAR_SQL, appearances
from loomtrace.plans.registry import query
from loomtrace.sources import tables
from loomtrace.sources.tables import DET_SQL
from loomtrace.streaming import sessions

SAMPLES = 40


def _documents(spark, sf_dir, expression: str):
    return tables.read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr(expression).alias("doc"))


def _payload(parts: list[str]) -> str:
    return "concat(" + ", ".join(parts) + ")"


def _sql(doc: str, checks: list[tuple[str, str, str]], helpers: str) -> str:
    unions = " UNION ALL ".join(f"SELECT id, '{path}' AS path, '{message}' AS message FROM h WHERE {bad}" for path, message, bad in checks)
    return f"WITH docs AS (SELECT event_id AS id, CAST({doc} AS JSON) AS doc FROM events), h AS (SELECT id, doc, {helpers} FROM docs) {unions}"


def _is_int(path: str) -> str:
    return f"coalesce(json_type(doc, '{path}') IN ('BIGINT', 'UBIGINT'), false)"


def _is_number(path: str) -> str:
    return f"coalesce(json_type(doc, '{path}') IN ('BIGINT', 'UBIGINT', 'DOUBLE'), false)"


def _is_text(path: str) -> str:
    return f"coalesce(json_type(doc, '{path}') = 'VARCHAR', false)"


def _int(path: str) -> str:
    return f"CASE WHEN {_is_int(path)} THEN CAST(json_extract_string(doc, '{path}') AS BIGINT) END"


def _number(path: str) -> str:
    return f"CASE WHEN {_is_number(path)} THEN CAST(json_extract_string(doc, '{path}') AS DOUBLE) END"


def _text(path: str) -> str:
    return f"CASE WHEN {_is_text(path)} THEN json_extract_string(doc, '{path}') END"


DETECTION = _payload([
    """'{"clip_id": '""", """CASE event_id % 9 WHEN 0 THEN '""' WHEN 1 THEN '7' ELSE '"c1"' END""",
    """', "frame_num": '""", """CASE event_id % 7 WHEN 0 THEN 'true' WHEN 1 THEN '0' WHEN 2 THEN '1.5' ELSE CAST(event_id + 1 AS VARCHAR(20)) END""",
    """', "track_id": '""", """CASE event_id % 8 WHEN 0 THEN 'null' WHEN 1 THEN '"x"' ELSE CAST(user_id AS VARCHAR(20)) END""", "'}'",
])


@query(_sql(DETECTION, [
    ("clip_id", "must be a non-empty string", "clip IS NULL OR length(clip) = 0"), ("frame_num", "must be an integer", "frame IS NULL"),
    ("frame_num", "must be at least 1", "frame < 1"), ("track_id", "must be an integer", "track IS NULL"),
], f"{_text('$.clip_id')} AS clip, {_int('$.frame_num')} AS frame, {_int('$.track_id')} AS track"))
def validate_detections(spark, sf_dir):
    return R.violations(_documents(spark, sf_dir, DETECTION), R.detection_rules())


APPEARANCE = _payload([
    """'{"clip_id": '""", """CASE event_id % 11 WHEN 0 THEN 'false' ELSE '"c1"' END""", """', "local_track_id": '""", """CASE event_id % 6 WHEN 0 THEN 'true' ELSE CAST(user_id AS VARCHAR(20)) END""",
    """', "frame_ranges": [['""", "CAST(event_id % 50 AS VARCHAR(20))", "', '", "CASE event_id % 13 WHEN 0 THEN 'null' ELSE CAST(event_id % 45 + 3 AS VARCHAR(20)) END",
    """']], "cluster_probability": '""", "CASE event_id % 5 WHEN 0 THEN '2.0' WHEN 1 THEN '-1' WHEN 2 THEN 'null' ELSE '0.75' END", "'}'",
])


@query(_sql(APPEARANCE, [
    ("clip_id", "must be a string", "clip IS NULL"), ("local_track_id", "must be an integer", "track IS NULL"), ("frame_ranges", "must hold integers", "s IS NULL OR e IS NULL"),
    ("frame_ranges", "start must not pass end", "s > e"), ("cluster_probability", "must be within 0 and 1", "p < 0 OR p > 1"),
], f"{_text('$.clip_id')} AS clip, {_int('$.local_track_id')} AS track, {_int('$.frame_ranges[0][0]')} AS s, {_int('$.frame_ranges[0][1]')} AS e, {_number('$.cluster_probability')} AS p"))
def validate_catalogue(spark, sf_dir):
    return R.violations(_documents(spark, sf_dir, APPEARANCE), R.appearance_rules())


SCENE = _payload([
    """'{"label": '""", """CASE event_id % 4 WHEN 0 THEN '"normal"' WHEN 1 THEN '"other"' ELSE '"crime"' END""", """', "crime_segments": ['""",
    """CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('{"timestamp_start": ', CAST(event_id % 10 AS VARCHAR(20)), ', "timestamp_end": ', CAST(event_id % 7 AS VARCHAR(20)), ', "involved_people_global": [',
    CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN '"local_7"' WHEN 2 THEN '' ELSE '3' END, ']}') END""", "']}'",
])


@query(_sql(SCENE, [
    ("label", "must be normal or crime", "label IS NULL OR label NOT IN ('normal', 'crime')"), ("crime_segments", "a normal clip has none", "label = 'normal' AND first IS NOT NULL"),
    ("crime_segments", "a crime clip has one or more", "label = 'crime' AND first IS NULL"), ("crime_segments", "start must not pass end", "s > e"),
    ("involved_people_global", "must hold integers", "person IS NOT NULL AND person NOT IN ('BIGINT', 'UBIGINT')"),
], f"""{_text('$.label')} AS label, json_type(doc, '$.crime_segments[0]') AS first, {_number('$.crime_segments[0].timestamp_start')} AS s,
  {_number('$.crime_segments[0].timestamp_end')} AS e, json_type(doc, '$.crime_segments[0].involved_people_global[0]') AS person"""))  # fmt: skip
def validate_scene(spark, sf_dir):
    return R.violations(_documents(spark, sf_dir, SCENE), R.scene_rules())


#: Documents of several ranges, segments and persons, whose faults are in later ones too.
RANGES = _payload([
    """'{"clip_id": "c1", "local_track_id": 1, "cluster_probability": 0.5, "frame_ranges": [[1, 2], ['""", "CAST(event_id % 50 AS VARCHAR(20))", "', '", "CAST(event_id % 45 + 3 AS VARCHAR(20))", "'], '",
    """CASE event_id % 5 WHEN 0 THEN '[9, 3]' WHEN 1 THEN '[1, 2, 3]' WHEN 2 THEN '["a", true]' WHEN 3 THEN '7' ELSE '[4, 4], [5, 1]' END""", "']}'",
])
SEGMENTS = _payload([
    """'{"label": "crime", "crime_segments": [{"timestamp_start": 0, "timestamp_end": 1, "involved_people_global": [3, '""", "CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN '4' ELSE '\"local_7\"' END",
    """']}, {"timestamp_start": '""", "CAST(event_id % 10 AS VARCHAR(20))", """', "timestamp_end": '""", "CAST(event_id % 7 AS VARCHAR(20))", """', "involved_people_global": ['""",
    "CASE event_id % 3 WHEN 0 THEN '1.5' WHEN 1 THEN '' ELSE '5, 6, null' END", "']}]}'",
])
_INT = "json_type({0}) IN ('BIGINT', 'UBIGINT')"


@query(f"""WITH docs AS (SELECT event_id AS id, CAST({RANGES} AS JSON) AS doc FROM events), x AS (SELECT id, unnest(json_extract(doc, '$.frame_ranges[*]')) AS r, unnest(range(len(json_extract(doc, '$.frame_ranges[*]')))) AS k FROM docs),
t AS (SELECT id, CASE WHEN k = 0 THEN 'frame_ranges' ELSE 'frame_ranges[' || k || ']' END AS path, json_type(r) = 'ARRAY' AND json_array_length(r) = 2 AS pair,
  coalesce({_INT.format("r -> '$[0]'")} AND {_INT.format("r -> '$[1]'")}, false) AS whole, TRY_CAST(r ->> '$[0]' AS BIGINT) AS s, TRY_CAST(r ->> '$[1]' AS BIGINT) AS e FROM x)
SELECT id, path, 'must be a pair of start and end' AS message FROM t WHERE NOT pair UNION ALL SELECT id, path, 'must hold integers' FROM t WHERE pair AND NOT whole
UNION ALL SELECT id, path, 'start must not pass end' FROM t WHERE pair AND whole AND s > e""")
def validate_catalogue_ranges(spark, sf_dir):
    """Every range of an appearance is judged."""
    return R.violations(_documents(spark, sf_dir, RANGES), R.appearance_rules())


@query(f"""WITH docs AS (SELECT event_id AS id, CAST({SEGMENTS} AS JSON) AS doc FROM events), x AS (SELECT id, unnest(json_extract(doc, '$.crime_segments[*]')) AS g, unnest(range(len(json_extract(doc, '$.crime_segments[*]')))) AS k FROM docs),
p AS (SELECT id, k, unnest(json_extract(g, '$.involved_people_global[*]')) AS person, unnest(range(len(json_extract(g, '$.involved_people_global[*]')))) AS j FROM x)
SELECT id, CASE WHEN k = 0 THEN 'crime_segments' ELSE 'crime_segments[' || k || ']' END AS path, 'start must not pass end' AS message FROM x WHERE CAST(g ->> '$.timestamp_start' AS DOUBLE) > CAST(g ->> '$.timestamp_end' AS DOUBLE)
UNION ALL SELECT id, CASE WHEN k = 0 AND j = 0 THEN 'involved_people_global' ELSE 'involved_people_global[' || k || '][' || j || ']' END, 'must hold integers' FROM p WHERE NOT {_INT.format("person")}""")
def validate_scene_segments(spark, sf_dir):
    """Every segment and person of a scene is judged."""
    return R.violations(_documents(spark, sf_dir, SEGMENTS), R.scene_rules())


REPORT = _payload([
    """'{"person_reid": {"v_measure": '""", "CASE event_id % 4 WHEN 0 THEN '1.5' WHEN 1 THEN 'true' ELSE '0.5' END", """', "adjusted_rand_index": '""", "CASE event_id % 5 WHEN 0 THEN '-2' ELSE '-0.5' END",
    """', "purity": 1}, "scene": {"accuracy": '""", """CASE event_id % 6 WHEN 0 THEN '"1"' ELSE '0.25' END""", """'}}'""",
])
_METRICS = {"person_reid.v_measure": (0, 1), "person_reid.adjusted_rand_index": (-1, 1), "person_reid.purity": (0, 1), "scene.accuracy": (0, 1), "scene.macro_f1": (0, 1)}


@query(_sql(REPORT, [x for k, (path, (low, high)) in enumerate(_METRICS.items()) for x in ((path, "must be a number", f"m{k} IS NULL"), (path, f"must be within {low} and {high}", f"m{k} < {low} OR m{k} > {high}"))],
            ", ".join(f"{_number('$.' + path)} AS m{k}" for k, path in enumerate(_METRICS))))
def validate_eval(spark, sf_dir):
    return R.violations(_documents(spark, sf_dir, REPORT), R.report_rules())


@query(f"""WITH {DET_SQL}, frames AS (SELECT DISTINCT clip_id, frame_num FROM det), sizes AS (SELECT clip_id, count(*) AS n FROM frames GROUP BY 1),
slots AS (SELECT clip_id, n, unnest(range(1, least(n, {SAMPLES}) + 1)) AS slot FROM sizes),
ranked AS (SELECT clip_id, n, row_number() OVER (ORDER BY slot, CASE WHEN slot > 1 THEN -n ELSE 0 END, clip_id) AS r FROM slots),
alloc AS (SELECT clip_id, n, count(*) AS k FROM ranked WHERE r <= {SAMPLES} GROUP BY ALL),
picks AS (SELECT clip_id, n, k, unnest(range(0, k)) AS i FROM alloc),
places AS (SELECT clip_id, i, CASE WHEN k = 1 THEN n // 2 ELSE CAST(round_even(i * (n - 1)::DOUBLE / (k - 1), 0) AS BIGINT) END AS place FROM picks),
numbered AS (SELECT clip_id, frame_num, row_number() OVER (PARTITION BY clip_id ORDER BY frame_num) - 1 AS place FROM frames)
SELECT clip_id, frame_num, row_number() OVER (ORDER BY i, clip_id) AS position FROM places JOIN numbered USING (clip_id, place)""")
def review_frame_sample(spark, sf_dir):
    """Forty frames for review: every clip gets one, the rest go round the larger clips, evenly spaced, interleaved."""
    frames = tables.detections(spark, sf_dir).select("clip_id", "frame_num").distinct()
    sizes = frames.groupBy("clip_id").agg(F.count("*").alias("n"))
    slots = sizes.withColumn("slot", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(SAMPLES)))))
    # Only the first SAMPLES slots in this order count: a top-k.
    chosen = slots.orderBy("slot", F.when(F.col("slot") > 1, -F.col("n")).otherwise(0), "clip_id").limit(SAMPLES)
    alloc = chosen.groupBy("clip_id", "n").agg(F.count("*").alias("k"))
    picks = alloc.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    even = F.bround(F.col("i") * (F.col("n") - 1) / (F.col("k") - 1), 0).cast("long")
    places = picks.select("clip_id", "i", F.when(F.col("k") == 1, F.floor(F.col("n") / 2)).otherwise(even).alias("place"))
    numbered = frames.withColumn("place", (F.row_number().over(Window.partitionBy("clip_id").orderBy("frame_num")) - 1).cast("long"))
    found = numbered.join(places, ["clip_id", "place"])
    return found.select("clip_id", "frame_num", F.row_number().over(Window.orderBy("i", "clip_id")).cast("long").alias("position"))


@query(f"""WITH {APPEAR_SQL} SELECT d.clip_id, d.track_id, 'no person for this track' AS warning, count(*) AS n FROM det d LEFT JOIN app USING (clip_id, track_id) WHERE app.global_id IS NULL GROUP BY ALL
UNION ALL SELECT clip_id, track_id, 'frame beyond the clip', count(*) FROM det WHERE frame_num > 110 GROUP BY ALL""")
def review_warnings(spark, sf_dir):
    det = tables.detections(spark, sf_dir)
    unknown = det.join(appearances(spark, sf_dir).select("clip_id", "track_id"), ["clip_id", "track_id"], "left_anti").withColumn("warning", F.lit("no person for this track"))
    beyond = det.where("frame_num > 110").withColumn("warning", F.lit("frame beyond the clip"))
    return unknown.select("clip_id", "track_id", "warning").unionByName(beyond.select("clip_id", "track_id", "warning")).groupBy("clip_id", "track_id", "warning").agg(F.count("*").alias("n"))


@query(f"""WITH {DET_SQL}, gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS opens FROM (SELECT event_type AS clip_id, user_id AS track_id, ts, event_id FROM events)
  WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY clip_id, track_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM gaps),
done AS (SELECT clip_id, track_id, min(ts) AS first_ts, max(ts) + INTERVAL 6 HOURS AS closes, count(*) AS n FROM numbered GROUP BY clip_id, track_id, session)
SELECT clip_id, track_id, epoch_us(first_ts) AS first_us, n FROM done WHERE closes <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def streaming_tracklet_sessions(spark, sf_dir):
    """Sessions of a track that a stream over the events has closed behind its watermark."""
    return sessions.closed_sessions(spark, f"{sf_dir}/events.parquet")
