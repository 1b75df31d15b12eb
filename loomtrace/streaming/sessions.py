"""Structured Streaming: online sessions of tracks, with a watermark for late detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.runtime import scratch_path

GAP = "6 hours"
LATENESS = "1 day"


def track_sessions(events: DataFrame, gap: str = GAP, lateness: str = LATENESS) -> DataFrame:
    """clip_id, track_id, first_us, n of each session; the same definition for a stream and a batch."""
    rows = events.select(F.col("event_type").alias("clip_id"), F.col("user_id").alias("track_id"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", lateness)
    held = rows.groupBy(F.session_window("ts", gap).alias("w"), "clip_id", "track_id").agg(F.count("*").alias("n"))
    return held.select("clip_id", "track_id", F.unix_micros("w.start").alias("first_us"), "n")


def closed_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Run the stream over what is there and return the sessions that have closed; state and output are in the shared folder."""
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    source = spark.readStream.schema(schema)
    if target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(target).isFile():
        # A file source watches a folder: watch the parent for this one name.
        source, path = source.option("pathGlobFilter", target.getName()), target.getParent().toString()
    stream = track_sessions(source.parquet(path))
    out = scratch_path(spark, "sessions")
    started = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
