"""Catalogue, scene and evaluation documents as JSON, review inputs, and which detection cache to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.operators import rules

APPEARANCE = "struct<clip_id:string,local_track_id:long,frame_ranges:array<array<long>>,cluster_probability:double>"
CATALOGUE_SCHEMA = f"global_id long, appearances array<{APPEARANCE}>"
SCENE_SCHEMA = "clip_id string, label string, confidence double, justification string"


def catalogue_documents(appearances: DataFrame) -> DataFrame:
    """(global_id, appearances) from one row an appearance: global_id, clip_id, track_id, ranges array<array>, probability."""
    entry = F.struct("clip_id", F.col("track_id").cast("long").alias("local_track_id"), F.col("ranges").alias("frame_ranges"), F.col("probability").alias("cluster_probability"))
    return appearances.groupBy("global_id").agg(F.array_sort(F.collect_list(entry)).alias("appearances"))


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document a row, committed as a whole."""
    df.write.mode("overwrite").json(path)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row an appearance: global_id, clip_id, local_track_id, frame_ranges, cluster_probability."""
    return spark.read.schema(CATALOGUE_SCHEMA).json(path).select("global_id", F.explode("appearances").alias("a")).select("global_id", "a.*")


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCENE_SCHEMA).json(path)


BASE, VARIANT = "_all_detections.json", "_all_detections_"


def choose_cache(listing: DataFrame) -> DataFrame:
    """(dir, name): of each folder's files (dir, name, mtime) the newest base cache, else the newest variant; the later name on a tie."""
    base = F.col("name").endswith(BASE)
    kind = F.when(base, 1).when(F.contains("name", F.lit(VARIANT)) & F.col("name").endswith(".json"), 0)
    return listing.withColumn("kind", kind).where("kind is not null").groupBy("dir").agg(F.max_by("name", F.struct("kind", "mtime", "name")).alias("name"))


def resolve_cache(spark: SparkSession, folder: str, given: str = "") -> str:
    """Path of the detection cache to read: the given one, or the choice among the files of ``folder``."""
    files = spark.read.format("binaryFile").load(given or f"{folder}/*{BASE[:-5]}*.json").select("path", F.col("modificationTime").alias("mtime"))
    if given:
        return files.first()["path"]
    found = choose_cache(files.select(F.lit("").alias("dir"), F.col("path").alias("name"), "mtime")).first()
    if found is None:
        raise FileNotFoundError(f"no detection cache in {folder}")
    return found["name"]


def review_inputs(spark: SparkSession, detections: str, catalogue: str, scenes: str) -> dict[str, DataFrame]:
    """The three documents of a review, by name; ValueError with the first violations where one breaks its rules.

    Each is a file of one JSON record a line."""
    checks = {"detections": (detections, rules.detection_rules()), "catalogue": (catalogue, rules.appearance_rules()), "scenes": (scenes, rules.scene_rules())}
    found = {}
    for name, (path, rule) in checks.items():
        rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("id"), F.col("value").alias("doc"))
        broken = rules.violations(rows, rule).limit(5).collect()
        if broken:
            raise ValueError(f"{name}: " + "; ".join(f"{r.path} {r.message}" for r in broken))
        found[name] = rows.select(F.try_parse_json("doc").alias("doc"))
    return found
