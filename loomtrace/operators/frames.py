"""Frame sets of persons, batches of frames, boxes as they come and whole crop rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions import scalars, vectors

VISIBLE = 0.5


def frame_sets(ranges: DataFrame) -> DataFrame:
    """(person, clip_id, frame_num), once each, of closed ranges (person, clip_id, s, e)."""
    return ranges.select("person", "clip_id", F.explode(F.sequence("s", "e")).alias("frame_num")).distinct()


def frame_set_overlap(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(gt, pred, common, either) of the frame sets of persons that share a frame."""
    a, b = gt.withColumnRenamed("person", "gt"), pred.withColumnRenamed("person", "pred")
    common = a.join(b, ["clip_id", "frame_num"]).groupBy("gt", "pred").agg(F.count("*").alias("common"))
    sizes = [x.groupBy(name).agg(F.count("*").alias(f"n_{name}")) for x, name in ((a, "gt"), (b, "pred"))]
    return common.join(sizes[0], "gt").join(sizes[1], "pred").select("gt", "pred", "common", (F.col("n_gt") + F.col("n_pred") - F.col("common")).alias("either"))


def frame_labels(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(clip_id, frame_num, gt, pred): a frame that several persons claim goes to the last of them; -1 where a side has none."""
    sides = [x.groupBy("clip_id", "frame_num").agg(F.max("person").alias(name)) for x, name in ((gt, "gt"), (pred, "pred"))]
    both = sides[0].join(sides[1], ["clip_id", "frame_num"], "full_outer")
    return both.select("clip_id", "frame_num", F.coalesce("gt", F.lit(-1)).alias("gt"), F.coalesce("pred", F.lit(-1)).alias("pred"))


def ends_by_frame(det: DataFrame) -> DataFrame:
    """(clip_id, track_id, first_event, last_event) of tracklets with two detections or more: their farthest pair."""
    at = F.struct("frame_num", "event_id")
    rows = det.groupBy("clip_id", "track_id").agg(F.count("*").alias("n"), F.min_by("event_id", at).alias("first_event"), F.max_by("event_id", at).alias("last_event"))
    return rows.where("n >= 2").drop("n")


def frame_batches(det: DataFrame, size: int = 8) -> DataFrame:
    """(clip_id, batch, n_frames, n_detections): a clip's frames in order, ``size`` to a batch, the last may be short."""
    frames = det.groupBy("clip_id", "frame_num").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("clip_id").orderBy("frame_num"))  # one row a frame of a clip
    return frames.withColumn("batch", F.floor((rank - 1) / size)).groupBy("clip_id", "batch").agg(F.count("*").alias("n_frames"), F.sum("n").alias("n_detections"))


def mean_vectors(det: DataFrame, dims: int) -> DataFrame:
    """(clip_id, track_id, v): the mean of a tracklet's vectors as they are, then of length one."""
    rows = det.groupBy("clip_id", "track_id").agg(vectors.elementwise(F.avg, F.col("v"), dims).alias("v"))
    return rows.withColumn("v", vectors.normalise(F.col("v")))


def box_or_null(values: Column) -> Column:
    """Four numbers as doubles, from texts; null unless there are four and all are numbers."""
    numbers = F.transform(values, lambda v: v.try_cast("double"))
    return F.when((F.size(values) == 4) & F.forall(numbers, lambda v: v.isNotNull()), numbers)


def visible_keypoints(visibility: Column) -> Column:
    return F.size(F.filter(visibility, lambda v: v > VISIBLE))


def keep_crops(det: DataFrame, width: int, height: int, least_keypoints: int | None = None) -> DataFrame:
    """(event_id, keep) by the whole crop rule, over det with box (x1, y1, x2, y2; null where there is none) and visibility.

    A detection without a box passes. The box is held to the frame; it must have a width and a height, be 1.3 to 4
    times as high as wide, cover 0.0015 of the frame and share less than 0.55 with any other box of the frame that
    is not the same box (all sides within a tolerance); with ``least_keypoints`` so many must be visible."""
    corners = ("x1", "y1", "x2", "y2")
    boxed = det.where(" and ".join(f"{c} is not null" for c in corners))
    held = boxed.select(
        "event_id", "clip_id", "frame_num", *corners, *[F.least(F.greatest(F.col(c), F.lit(0)), F.lit((width if c[0] == "x" else height) - 1)).alias(f"c_{c}") for c in corners]
    )
    other = boxed.select("clip_id", "frame_num", *[F.col(c).alias(f"o_{c}") for c in ("event_id", *corners)])
    same = F.lit(True)
    for c in corners:
        same = same & (F.abs(F.col(f"o_{c}") - F.col(c)) <= 1e-5 + 1e-5 * F.abs(F.col(c)))
    share = scalars.iou({c: F.col(f"c_{c}") for c in corners}, {c: F.col(f"o_{c}") for c in corners})
    worst = held.join(other, ["clip_id", "frame_num"]).where("event_id <> o_event_id").groupBy("event_id").agg(F.max(F.when(~same, share)).alias("worst"))
    w, h = F.greatest(F.col("c_x2") - F.col("c_x1"), F.lit(0)), F.greatest(F.col("c_y2") - F.col("c_y1"), F.lit(0))
    fits = (w > 0) & (h > 0) & F.coalesce(F.try_divide(h, w).between(1.3, 4.0), F.lit(False)) & (w * h >= 0.0015 * width * height) & (F.coalesce("worst", F.lit(0.0)) < 0.55)
    judged = held.join(worst, "event_id", "left").select("event_id", fits.alias("fits"))
    rows = det.join(judged, "event_id", "left")
    seen = F.lit(True) if least_keypoints is None else visible_keypoints(F.col("visibility")) >= least_keypoints
    return rows.select("event_id", F.when(F.col("fits").isNull(), True).otherwise(F.col("fits") & seen).alias("keep"))
