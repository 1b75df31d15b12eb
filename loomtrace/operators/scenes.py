"""Scenes: labels that say crime, model answers, and what justifies a clip's label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A label that holds one of these words says crime.
CRIME_KEYWORDS = ("fighting", "punch", "kick", "slap", "headbutting", "wrestling", "shooting", "robbery", "stealing", "pickpocketing", "assault", "theft")

#: What is said of a clip without events.
NOTHING_SEEN = "No criminal activity detected in the clip."
NOTHING_SEEN_IN_VIDEO = "No criminal activity detected in the video clip."


def says_crime(label: Column, known: tuple[str, ...] = ()) -> Column:
    """Whether a label, in any case, is one of ``known`` or holds a keyword."""
    low = F.lower(label)
    return F.exists(F.array(*[F.lit(k) for k in CRIME_KEYWORDS]), lambda k: F.contains(low, k)) | (low.isin([k.lower() for k in known]) if known else F.lit(False))


def crime_confidence(windows: DataFrame) -> DataFrame:
    """(clip_id, label, confidence) from scored windows (clip_id, window_label, score): the best score of a crime window, else 0."""
    crime = says_crime(F.col("window_label"))
    rows = windows.groupBy("clip_id").agg(F.max(F.when(crime, F.col("score"))).alias("best"))
    return rows.select("clip_id", F.when(F.col("best").isNotNull(), "crime").otherwise("normal").alias("label"), F.coalesce("best", F.lit(0.0)).alias("confidence"))


def event_sentence(kind: Column, start: Column, end: Column, persons: Column) -> Column:
    people = F.when(F.size(persons) > 0, F.concat(F.lit(" involving person "), F.array_join(persons.cast("array<string>"), ", "))).otherwise("")
    return F.concat(F.format_string("%s at %.1fs-%.1fs", kind, start, end), people)


def segment_sentence(label: Column, start: Column, end: Column, first: Column, last: Column, persons: Column) -> Column:
    """The older form, with frames and with people who are not named."""
    each = F.transform(persons.cast("array<string>"), lambda p: F.concat(F.lit("person "), p))
    people = F.when(F.size(persons) > 0, F.array_join(each, ", ")).otherwise("people")
    return F.concat(F.format_string("%s detected at %.1fs-%.1fs (frames %d-%d) involving ", label, start, end, first, last), people)


def justify(clips: DataFrame, events: DataFrame, nothing: str = NOTHING_SEEN) -> DataFrame:
    """(clip_id, label, justification) of ``clips``: the sentences ``t`` of their events in order of scene_id, or ``nothing``."""
    said = events.groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("scene_id", "t"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda x: x["t"]), "; ")
    some = F.coalesce(F.size("parts") > 0, F.lit(False))
    return clips.join(said, "clip_id", "left").select(
        "clip_id", F.when(some, "crime").otherwise("normal").alias("label"), F.when(some, joined).otherwise(nothing).alias("justification")
    )


PAYLOAD_EVENT = "struct<type:string,t_start_sec:double,t_end_sec:double,global_person_ids:array<int>,evidence:string>"


def parse_answers(answers: DataFrame) -> DataFrame:
    """(id, label, confidence, events, rationale, error) of model answers (id, doc: JSON text).

    Missing parts take their defaults (confidence 0, an event starts at 0 and ends where it starts, type "event",
    empty texts); the first broken rule, in this order, is in ``error`` and leaves the parts null: not an object,
    unknown label, confidence outside 0..1, an event that is no object, negative times, an end before its start."""
    d = F.try_parse_json("doc")
    rows = answers.select("id", d.alias("d"))
    d = F.col("d")

    def of(value: Column, path: str, kind: str) -> Column:
        return F.try_variant_get(value, path, kind)

    def is_object(value: Column) -> Column:
        return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))

    label, confidence = F.trim(F.coalesce(of(d, "$.label", "string"), F.lit(""))), F.coalesce(of(d, "$.confidence", "double"), F.lit(0.0))
    raw = F.coalesce(of(d, "$.events", "array<variant>"), F.array().cast("array<variant>"))

    def event(x: Column) -> Column:
        start = F.coalesce(of(x, "$.t_start_sec", "double"), F.lit(0.0))
        return F.struct(
            F.coalesce(of(x, "$.type", "string"), F.lit("event")).alias("type"),
            start.alias("t_start_sec"),
            F.coalesce(of(x, "$.t_end_sec", "double"), start).alias("t_end_sec"),
            F.coalesce(of(x, "$.global_person_ids", "array<int>"), F.array().cast("array<int>")).alias("global_person_ids"),
            F.coalesce(of(x, "$.evidence", "string"), F.lit("")).alias("evidence"),
        )

    rows = rows.select(
        "id", d, label.alias("label"), confidence.alias("confidence"), raw.alias("raw"), F.transform(raw, event).alias("events"), F.coalesce(of(d, "$.rationale", "string"), F.lit("")).alias("rationale")
    )
    broken = (
        F.when(~is_object(d), "payload must be an object")
        .when(~F.col("label").isin("normal", "crime"), "label must be normal or crime")
        .when(~F.col("confidence").between(0.0, 1.0), "confidence must be within 0 and 1")
        .when(F.exists("raw", lambda x: ~is_object(x)), "events must be objects")
        .when(F.exists("events", lambda x: (x["t_start_sec"] < 0) | (x["t_end_sec"] < 0)), "times must not be negative")
        .when(F.exists("events", lambda x: x["t_end_sec"] < x["t_start_sec"]), "start must not pass end")
    )
    rows = rows.withColumn("error", F.when(d.isNull(), "payload must be an object").otherwise(broken))
    return rows.select("id", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("label", "confidence", "events", "rationale")], "error")
