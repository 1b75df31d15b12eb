"""Sources and sinks: detections as Parquet or JSON, cache files, and views over the driver's tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01 UTC
FRAME_US = 21_600_000_000
FPS = 30.0
WIDTH, HEIGHT = 1280, 720
DIMS = 64
#: So many embeddings (256 bytes each) are broadcast at most.
BROADCAST_VECTORS = 150_000

DETECTION_SCHEMA = (
    "clip_id string, video_path string, frame_num int, track_id int, embeddings array<float>, confidence double, det_confidence double, "
    "quality double, sharpness double, timestamp_sec double, torso_hist array<float>, box_xyxy_abs array<float>, frame_width int, "
    "frame_height int, bounding_box array<double>, center_x double, center_y double, bbox_w double, bbox_h double"
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_detections_json(spark: SparkSession, path: str) -> DataFrame:
    """A detection cache: one JSON list of records."""
    return spark.read.schema(DETECTION_SCHEMA).json(path, multiLine=True)


def flatten_frames(frames: DataFrame) -> DataFrame:
    """(clip_id, video_path, frame_num, detections[]) to one row per detection with an embedding."""
    det = F.col("d")
    rows = frames.select("clip_id", "video_path", "frame_num", F.explode("detections").alias("d")).where(det["embeddings"].isNotNull())
    box = det["bounding_box"]
    return rows.select(
        "clip_id",
        "video_path",
        "frame_num",
        det["track_id"].alias("track_id"),
        det["embeddings"].alias("embeddings"),
        F.coalesce(det["det_confidence"], det["confidence"]).alias("confidence"),
        (box[0] + box[2] / 2).alias("center_x"),
        (box[1] + box[3] / 2).alias("center_y"),
        box[2].alias("bbox_w"),
        box[3].alias("bbox_h"),
    )


def cache_key(name: str, media_type: str, samples: int, backbone: str, variant: str | None = None) -> str:
    """File stem of a detection cache, by content of its settings."""
    settings = {"name": name, "media_type": media_type, "num_samples": samples, "reid_backbone": backbone, "version": "v4"}
    digest = hashlib.md5(json.dumps(settings, sort_keys=True).encode()).hexdigest()
    return f"{digest}_{variant}" if variant else digest


def read_or_compute(spark: SparkSession, path: str, compute, overwrite: bool = False) -> DataFrame:
    """Read-through cache: Parquet at path, computed and committed atomically where it is missing."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)
    if overwrite or not there:
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:10]


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, v (doubles)."""
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def detections(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """Detections laid over the events table; with ``vectors`` each carries its embedding."""
    n = read_table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n_vecs"))
    events = read_table(spark, sf_dir, "events").crossJoin(F.broadcast(n))  # one row
    e = F.col("event_id")
    frame = (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / FRAME_US
    out = events.select(
        "event_id",
        F.col("event_type").alias("clip_id"),
        F.col("user_id").alias("track_id"),
        (F.floor(frame) + 1).alias("frame_num"),
        (F.col("value") / (F.col("value") + 100)).alias("confidence"),
        F.when(e % 10 == 0, None).when(e % 10 == 1, 0.0).otherwise((e * 7) % 100 / 100.0).alias("quality"),
        (e % F.col("n_vecs")).alias("vec_id"),
        ((e * 37) % 1200).alias("x1"),
        ((e * 91) % 600).alias("y1"),
        (40 + (e * 7) % 60).alias("w"),
        (60 + (e * 13) % 200).alias("h"),
    )
    out = out.withColumn("x2", F.col("x1") + F.col("w")).withColumn("y2", F.col("y1") + F.col("h"))
    out = out.withColumn("timestamp_sec", (F.col("frame_num") - 1) / FPS)
    if not vectors:
        return out
    held = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    if held.count() <= BROADCAST_VECTORS:
        # Detections are dealt to their tracklets first and meet their vectors there: no vector is shuffled.
        out, held = out.repartition("clip_id", "track_id"), F.broadcast(held)
    return out.join(held, "vec_id").withColumn("v", F.col("embedding").cast("array<double>")).drop("embedding")


def eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, gt, pred."""
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("label").cast("long").alias("gt"), (F.col("vec_id") % 10).alias("pred"))


#: The detection view in DuckDB's SQL.
DET_SQL = """dims AS (SELECT count(*) AS n_vecs FROM embeddings),
det AS (
  SELECT *, x1 + w AS x2, y1 + h AS y2, (frame_num - 1) / 30.0::DOUBLE AS timestamp_sec FROM (
    SELECT event_id, event_type AS clip_id, user_id AS track_id,
      (epoch_us(ts) - 1704067200000000) // 21600000000 + 1 AS frame_num,
      value / (value + 100) AS confidence,
      CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN 0.0::DOUBLE ELSE ((event_id * 7) % 100)::DOUBLE / 100 END AS quality,
      event_id % n_vecs AS vec_id, (event_id * 37) % 1200 AS x1, (event_id * 91) % 600 AS y1,
      40 + (event_id * 7) % 60 AS w, 60 + (event_id * 13) % 200 AS h
    FROM events, dims))"""
