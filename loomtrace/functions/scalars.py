"""Scalar rules of the track data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_float(c: Column) -> Column:
    """A number or null; text that is no number gives null."""
    return c.try_cast("double")


def quality_or_zero(quality: Column, confidence: Column) -> Column:
    """Null rule for ranking detections: quality, else confidence, else 0."""
    return F.coalesce(quality, confidence, F.lit(0.0))


def quality_if_truthy(quality: Column, confidence: Column) -> Column:
    """Rule for the best crop: a quality of 0 falls through to confidence."""
    return F.coalesce(F.nullif(quality, F.lit(0.0)), F.nullif(confidence, F.lit(0.0)), F.lit(0.0))


def quality_or_one(quality: Column, confidence: Column) -> Column:
    """Rule for weights: missing counts as 1; held to 0..1."""
    return F.least(F.greatest(F.coalesce(quality, confidence, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))


def frame_to_seconds(frame: Column, fps: Column) -> Column:
    """Seconds of a 1-based frame; never negative."""
    return F.greatest(frame - 1, F.lit(0)) / F.greatest(fps, F.lit(1e-6))


def frame_to_seconds_unshifted(frame: Column, fps: Column) -> Column:
    """The older convention, one frame later."""
    return frame / fps


def effective_fps(fps: Column) -> Column:
    return F.when(fps > 1e-6, fps).otherwise(F.lit(30.0))


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Closed intervals share a point."""
    return (start_a <= end_b) & (start_b <= end_a)


def clip_start_time(clip: Column) -> Column:
    """Start of a clip in epoch seconds from its name, or null: a compact or dashed date and time, 13-digit
    epoch milliseconds or 10-digit epoch seconds, tried in this order."""
    compact = F.regexp_extract(clip, r"(20\d{6})[_\-T]?(\d{6})", 0)
    compact = F.regexp_replace(compact, r"\D", "")
    dashed = F.regexp_replace(F.regexp_extract(clip, r"20\d{2}-\d{2}-\d{2}[_\-T ]\d{2}-\d{2}-\d{2}", 0), r"\D", "")
    millis = F.regexp_extract(clip, r"(^|\D)(1\d{12})(\D|$)", 2)
    seconds = F.regexp_extract(clip, r"(^|\D)(1\d{9})(\D|$)", 2)

    def stamp(text: Column) -> Column:
        return F.unix_timestamp(F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit("yyyyMMddHHmmss"))).cast("double")

    return F.coalesce(stamp(compact), stamp(dashed), F.nullif(millis, F.lit("")).try_cast("double") / 1000, F.nullif(seconds, F.lit("")).try_cast("double"))


def identity_label(track: Column, person: Column, probability: Column) -> Column:
    """Text such as ``t7 g1 p=0.97``; missing parts are left out."""
    return F.concat_ws(" ", F.concat(F.lit("t"), track), F.concat(F.lit("g"), person), F.when(probability.isNotNull(), F.format_string("p=%.2f", probability)))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes given as x1, y1, x2, y2."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0))

    def area(box: dict[str, Column]) -> Column:
        return F.greatest(box["x2"] - box["x1"], F.lit(0)) * F.greatest(box["y2"] - box["y1"], F.lit(0))

    return w * h / F.greatest(area(a) + area(b) - w * h, F.lit(1e-12))


def fallback_weights(path: Column) -> Column:
    """The older weights of the same size that stand in for newer ones, by file name; null where none do."""
    size = F.regexp_extract(F.substring_index(path, "/", -1), r"^yolo26([nslmx])\.pt$", 1)
    return F.when(size != "", F.concat(F.lit("yolo11"), size, F.lit(".pt")))
