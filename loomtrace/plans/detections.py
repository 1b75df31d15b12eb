"""Queries over single detections and boxes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtrace.functions import scalars, vectors
from loomtrace.plans.registry import query
from loomtrace.sources import tables
from loomtrace.sources.tables import DET_SQL


@query(f"WITH {DET_SQL} SELECT event_id, clip_id, track_id, frame_num, confidence, quality, vec_id, x1, y1, x2, y2, timestamp_sec FROM det")
def scan_detections(spark, sf_dir):
    return tables.detections(spark, sf_dir).select("event_id", "clip_id", "track_id", "frame_num", "confidence", "quality", "vec_id", "x1", "y1", "x2", "y2", "timestamp_sec")


@query(f"WITH {DET_SQL} SELECT event_id, clip_id, confidence FROM det WHERE event_id % 3 = 0 AND confidence >= 0.05")
def person_class_filter(spark, sf_dir):
    return tables.detections(spark, sf_dir).where((F.col("event_id") % 3 == 0) & (F.col("confidence") >= 0.05)).select("event_id", "clip_id", "confidence")


@query("""SELECT event_id, TRY_CAST(raw AS DOUBLE) AS number FROM (
  SELECT event_id, CASE event_id % 5 WHEN 0 THEN '1.5' WHEN 1 THEN 'abc' WHEN 2 THEN CAST(event_id AS VARCHAR) WHEN 3 THEN NULL ELSE '-2e3' END AS raw FROM events)""")
def safe_float_cast(spark, sf_dir):
    e = F.col("event_id")
    raw = F.when(e % 5 == 0, "1.5").when(e % 5 == 1, "abc").when(e % 5 == 2, e.cast("string")).when(e % 5 == 3, None).otherwise("-2e3")
    return tables.read_table(spark, sf_dir, "events").select("event_id", scalars.safe_float(raw).alias("number"))


@query(f"""WITH {DET_SQL} SELECT event_id, coalesce(quality, confidence, 0) AS ranked,
  coalesce(nullif(quality, 0), nullif(confidence, 0), 0) AS truthy, least(greatest(coalesce(quality, confidence, 1), 0), 1) AS weighted FROM det""")
def quality_rules(spark, sf_dir):
    q, c = F.col("quality"), F.col("confidence")
    return tables.detections(spark, sf_dir).select(
        "event_id", scalars.quality_or_zero(q, c).alias("ranked"), scalars.quality_if_truthy(q, c).alias("truthy"), scalars.quality_or_one(q, c).alias("weighted")
    )


@query(f"""WITH {DET_SQL}, boxes AS (SELECT event_id, least(greatest(x1 - 100, 0), 1279) AS cx1, least(greatest(y1 - 100, 0), 719) AS cy1,
  least(greatest(x2 - 100, 0), 1279) AS cx2, least(greatest(y2 - 100, 0), 719) AS cy2 FROM det)
SELECT *, cx2 > cx1 AND cy2 > cy1 AS valid FROM boxes""")
def box_clip_valid(spark, sf_dir):
    def held(c, top):
        return F.least(F.greatest(F.col(c) - 100, F.lit(0)), F.lit(top - 1))

    rows = tables.detections(spark, sf_dir).select("event_id", held("x1", 1280).alias("cx1"), held("y1", 720).alias("cy1"), held("x2", 1280).alias("cx2"), held("y2", 720).alias("cy2"))
    return rows.withColumn("valid", (F.col("cx2") > F.col("cx1")) & (F.col("cy2") > F.col("cy1")))


SIBLINGS_SQL = f"""{DET_SQL}, sib AS (
  SELECT a.event_id AS a, b.event_id AS b, a.clip_id,
    greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS common,
    a.w * a.h AS area_a, b.w * b.h AS area_b, a.x1 = b.x1 AND a.y1 = b.y1 AND a.x2 = b.x2 AND a.y2 = b.y2 AS same
  FROM det a JOIN det b ON a.clip_id = b.clip_id AND a.frame_num = b.frame_num AND a.event_id <> b.event_id)"""


def _siblings(det):
    """Ordered pairs of detections of one frame. The join is on (clip, frame), so a busy clip is spread over its frames."""
    cols = ("event_id", "x1", "y1", "x2", "y2")
    right = det.select("clip_id", "frame_num", *[F.col(c).alias(f"o_{c}") for c in cols])
    return det.select("clip_id", "frame_num", *cols).join(right, ["clip_id", "frame_num"]).where("event_id <> o_event_id")


def _iou():
    return scalars.iou({c: F.col(c) for c in ("x1", "y1", "x2", "y2")}, {c: F.col(f"o_{c}") for c in ("x1", "y1", "x2", "y2")})


@query(f"WITH {SIBLINGS_SQL} SELECT clip_id, count(*) AS n_pairs, count(DISTINCT a) AS n_boxes FROM sib GROUP BY clip_id")
def sibling_boxes(spark, sf_dir):
    return _siblings(tables.detections(spark, sf_dir)).groupBy("clip_id").agg(F.count("*").alias("n_pairs"), F.countDistinct("event_id").alias("n_boxes"))


@query(f"WITH {SIBLINGS_SQL} SELECT a, b, round(common / (area_a + area_b - common)::DOUBLE, 6) AS iou FROM sib WHERE a < b AND common > 0")
def pair_iou(spark, sf_dir):
    rows = _siblings(tables.detections(spark, sf_dir)).where("event_id < o_event_id").withColumn("iou", _iou())
    return rows.where("iou > 0").select(F.col("event_id").alias("a"), F.col("o_event_id").alias("b"), F.round("iou", 6).alias("iou"))


@query(f"""WITH {SIBLINGS_SQL}, worst AS (SELECT a, max(CASE WHEN same THEN 0 ELSE common / (area_a + area_b - common)::DOUBLE END) AS worst FROM sib GROUP BY a)
SELECT event_id, h::DOUBLE / w BETWEEN 1.3 AND 4.0 AND w * h >= 0.0015 * 1280 * 720 AND coalesce(worst, 0) < 0.55 AS keep
FROM det LEFT JOIN worst ON event_id = a""")
def crop_filter(spark, sf_dir):
    """Crops worth embedding: person-shaped, large enough, little hidden. An equal box of a sibling does not count as hiding."""
    det = tables.detections(spark, sf_dir)
    same = (F.col("x1") == F.col("o_x1")) & (F.col("y1") == F.col("o_y1")) & (F.col("x2") == F.col("o_x2")) & (F.col("y2") == F.col("o_y2"))
    worst = _siblings(det).groupBy("event_id").agg(F.max(F.when(same, 0.0).otherwise(_iou())).alias("worst"))
    shape, area = F.col("h") / F.col("w"), F.col("w") * F.col("h")
    keep = shape.between(1.3, 4.0) & (area >= 0.0015 * tables.WIDTH * tables.HEIGHT) & (F.coalesce("worst", F.lit(0.0)) < 0.55)
    return det.join(worst, "event_id", "left").select("event_id", keep.alias("keep"))


@query(f"""WITH {DET_SQL}, s AS (SELECT *, (event_id * 17) % 300 AS sharpness FROM det)
SELECT event_id, round(0.6 * confidence + 0.3 * sharpness / (sharpness + 100.0::DOUBLE) + 0.1 * least(1, sqrt(w * h / (1280.0::DOUBLE * 720))), 6) AS score FROM s""")
def detection_quality_score(spark, sf_dir):
    s = (F.col("event_id") * 17) % 300
    score = 0.6 * F.col("confidence") + 0.3 * s / (s + 100.0) + 0.1 * F.least(F.lit(1.0), F.sqrt(F.col("w") * F.col("h") / float(tables.WIDTH * tables.HEIGHT)))
    return tables.detections(spark, sf_dir).select("event_id", F.round(score, 6).alias("score"))


HIST_SQL = """hists AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE) / list_sum(list_transform(embedding, lambda y: abs(y::DOUBLE)))) AS hist FROM embeddings)"""


def histograms(spark, sf_dir):
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x))
    rows = tables.embeddings(spark, sf_dir).withColumn("total", total)
    return rows.select("vec_id", "label", F.transform("v", lambda x: F.abs(x) / F.col("total")).alias("hist"))


@query(f"""WITH {HIST_SQL}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_zip(a.hist, b.hist) AS z FROM hists a JOIN hists b ON b.vec_id = a.vec_id + 1)
SELECT a, b, round(list_sum(list_transform(z, lambda t: (t[1] - t[2]) * (t[1] - t[2]) / greatest(t[1] + t[2], 1e-12))), 6) AS chi2 FROM p""")
def torso_chi2(spark, sf_dir):
    h = histograms(spark, sf_dir)
    left, right = h.select(F.col("vec_id").alias("a"), F.col("hist").alias("ha")), h.select(F.col("vec_id").alias("b"), F.col("hist").alias("hb"))
    return left.join(right, F.col("b") == F.col("a") + 1).select("a", "b", F.round(vectors.chi_squared(F.col("ha"), F.col("hb")), 6).alias("chi2"))


NAMES_SQL = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'cam1_' || strftime(ts, '%Y%m%d_%H%M%S') WHEN 1 THEN 'cam-' || strftime(ts, '%Y-%m-%d_%H-%M-%S') || '-x'
  WHEN 2 THEN 'c_' || CAST(epoch_us(ts) // 1000 AS VARCHAR) WHEN 3 THEN 'c_' || CAST(epoch_us(ts) // 1000000 AS VARCHAR) || '_b' WHEN 4 THEN 'c' || strftime(ts, '%Y%m%d') || 'T' || strftime(ts, '%H%M%S') ELSE 'clip_' || event_id END AS name FROM events"""


@query(f"""WITH names AS ({NAMES_SQL}), parts AS (SELECT event_id, name,
  regexp_replace(regexp_extract(name, '(20\\d{{6}})[_\\-T]?(\\d{{6}})', 0), '\\D', '', 'g') AS compact,
  regexp_replace(regexp_extract(name, '20\\d{{2}}-\\d{{2}}-\\d{{2}}[_\\-T ]\\d{{2}}-\\d{{2}}-\\d{{2}}', 0), '\\D', '', 'g') AS dashed,
  regexp_extract(name, '(^|\\D)(1\\d{{12}})(\\D|$)', 2) AS ms, regexp_extract(name, '(^|\\D)(1\\d{{9}})(\\D|$)', 2) AS sec FROM names)
SELECT event_id, name, coalesce(epoch(try_strptime(nullif(compact, ''), '%Y%m%d%H%M%S')), epoch(try_strptime(nullif(dashed, ''), '%Y%m%d%H%M%S')),
  TRY_CAST(nullif(ms, '') AS DOUBLE) / 1000, TRY_CAST(nullif(sec, '') AS DOUBLE)) AS start_sec FROM parts""")
def clip_start_time(spark, sf_dir):
    e, ts = F.col("event_id"), F.col("ts")
    ms = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    name = (
        F.when(e % 6 == 0, F.concat(F.lit("cam1_"), F.date_format(ts, "yyyyMMdd_HHmmss")))
        .when(e % 6 == 1, F.concat(F.lit("cam-"), F.date_format(ts, "yyyy-MM-dd_HH-mm-ss"), F.lit("-x")))
        .when(e % 6 == 2, F.concat(F.lit("c_"), ms))
        .when(e % 6 == 3, F.concat(F.lit("c_"), F.expr("unix_micros(cast(ts as timestamp)) div 1000000"), F.lit("_b")))
        .when(e % 6 == 4, F.concat(F.lit("c"), F.date_format(ts, "yyyyMMdd"), F.lit("T"), F.date_format(ts, "HHmmss")))
        .otherwise(F.concat(F.lit("clip_"), e))
    )
    return tables.read_table(spark, sf_dir, "events").select("event_id", name.alias("name")).withColumn("start_sec", scalars.clip_start_time(F.col("name")))


@query(f"""WITH {DET_SQL}, chosen AS (SELECT DISTINCT clip_id, frame_num FROM det WHERE (frame_num - 1) % 5 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame_num) AS r FROM chosen) SELECT clip_id, frame_num FROM ranked WHERE r <= 12""")
def frame_sampling(spark, sf_dir):
    """Every fifth frame of a clip, at most twelve: the report's own limit."""
    frames = tables.detections(spark, sf_dir).where((F.col("frame_num") - 1) % 5 == 0).select("clip_id", "frame_num").distinct()
    rank = F.row_number().over(Window.partitionBy("clip_id").orderBy("frame_num"))
    return frames.withColumn("r", rank).where("r <= 12").select("clip_id", "frame_num")


@query(f"""WITH {DET_SQL} SELECT event_id, 't' || track_id || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' g' || (track_id % 7) END ||
  CASE WHEN quality IS NULL THEN '' ELSE ' p=' || printf('%.2f', quality) END AS label FROM det""")
def identity_labels(spark, sf_dir):
    person = F.when(F.col("event_id") % 3 != 0, F.col("track_id") % 7)
    return tables.detections(spark, sf_dir).select("event_id", scalars.identity_label(F.col("track_id"), person, F.col("quality")).alias("label"))


@query(f"""WITH {DET_SQL}, a AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id % 3 <> 0),
b AS (SELECT vec_id, list_transform(embedding[33:64], lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id % 4 <> 0),
both_ AS (SELECT a.vec_id, list_concat(list_transform(a.v, lambda x: x / sqrt(list_sum(list_transform(a.v, lambda y: y * y)))), list_transform(b.v, lambda x: x / sqrt(list_sum(list_transform(b.v, lambda y: y * y))))) AS v FROM a JOIN b USING (vec_id)),
unit AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM both_)
SELECT vec_id, len(v) AS width, round(list_sum(list_transform(list_zip(v, range(1, 65)), lambda t: t[1] * t[2])), 6) AS digest FROM unit""")
def ensemble_features(spark, sf_dir):
    """Features of two extractors on the detections both kept, each to unit length, side by side, unit again."""
    e = tables.embeddings(spark, sf_dir)
    left = e.where("vec_id % 3 <> 0").select("vec_id", vectors.normalise(F.slice("v", 1, 32)).alias("a"))
    right = e.where("vec_id % 4 <> 0").select("vec_id", vectors.normalise(F.slice("v", 33, 32)).alias("b"))
    rows = left.join(right, "vec_id").withColumn("v", vectors.normalise(F.concat("a", "b")))
    return rows.select("vec_id", F.size("v").cast("long").alias("width"), F.round(vectors.checksum(F.col("v")), 6).alias("digest"))


@query("""WITH old AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), fresh AS (SELECT vec_id, list_reverse(v[33:64]) AS c FROM old WHERE vec_id % 2 = 0),
merged AS (SELECT vec_id, list_concat(v[1:32], coalesce(c, v[33:64])) AS v FROM old LEFT JOIN fresh USING (vec_id)),
unit AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM merged)
SELECT vec_id, round(list_sum(list_transform(list_zip(v, range(1, 65)), lambda t: t[1] * t[2])), 6) AS digest FROM unit""")
def reembed_merge(spark, sf_dir):
    """The second extractor's part replaced where a new feature exists."""
    e = tables.embeddings(spark, sf_dir)
    fresh = e.where("vec_id % 2 = 0").select("vec_id", F.reverse(F.slice("v", 33, 32)).alias("c"))
    v = vectors.normalise(F.concat(F.slice("v", 1, 32), F.coalesce("c", F.slice("v", 33, 32))))
    return e.join(fresh, "vec_id", "left").select("vec_id", F.round(vectors.checksum(v), 6).alias("digest"))
