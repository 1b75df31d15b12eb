"""Data-quality rules over raw JSON documents: one row per violation (id, path, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kind(doc: Column, path: str) -> Column:
    """Type of a JSON value as written, so that true is no integer: INT, FLOAT, BOOL, TEXT, OTHER or null."""
    name = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    return (
        F.when(name == "BIGINT", "INT").when((name == "DOUBLE") | name.startswith("DECIMAL") | (name == "FLOAT"), "FLOAT").when(name == "BOOLEAN", "BOOL").when(name == "STRING", "TEXT").when(name.isNotNull() & (name != "VOID"), "OTHER")
    )


def integer(doc: Column, path: str) -> Column:
    return F.when(kind(doc, path) == "INT", F.try_variant_get(doc, path, "long"))


def number(doc: Column, path: str) -> Column:
    return F.when(kind(doc, path).isin("INT", "FLOAT"), F.try_variant_get(doc, path, "double"))


def text(doc: Column, path: str) -> Column:
    return F.when(kind(doc, path) == "TEXT", F.try_variant_get(doc, path, "string"))


def elements(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "array<variant>")


def broken_rule(path: Column | str, message: str, bad: Column) -> Column:
    path = F.lit(path) if isinstance(path, str) else path
    return F.when(F.coalesce(bad, F.lit(False)), F.struct(path.alias("path"), F.lit(message).alias("message")))


def place(path: str, *at: Column) -> Column:
    """``path`` for the first element, as the documents' oracle has it, and ``path[k]`` for a later one."""
    first = at[0] == 0
    for k in at[1:]:
        first = first & (k == 0)
    return F.when(first, F.lit(path)).otherwise(F.concat(F.lit(path), *[F.concat(F.lit("["), k.cast("string"), F.lit("]")) for k in at]))


def violations(rows: DataFrame, rules: list[tuple[str, str, Column] | Column]) -> DataFrame:
    """rows: id and doc (JSON text). A rule (path, message, bad) adds a row where bad is true, a rule over an
    array's elements is an array of such rows; one pass over the rows."""
    held = rows.withColumn("doc", F.try_parse_json("doc"))
    single = F.array(*[broken_rule(*x) for x in rules if isinstance(x, tuple)])
    broken = F.concat(single, *[F.coalesce(x, F.array().cast("array<struct<path:string,message:string>>")) for x in rules if not isinstance(x, tuple)])
    return held.select("id", F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("v")).select("id", "v.path", "v.message")


def missing(value: Column) -> Column:
    return value.isNull()


def detection_rules() -> list[tuple[str, str, Column]]:
    d = F.col("doc")
    frame, clip = integer(d, "$.frame_num"), text(d, "$.clip_id")
    return [
        ("clip_id", "must be a non-empty string", missing(clip) | (F.length(clip) == 0)),
        ("frame_num", "must be an integer", missing(frame)),
        ("frame_num", "must be at least 1", frame < 1),
        ("track_id", "must be an integer", missing(integer(d, "$.track_id"))),
    ]


def appearance_rules() -> list[tuple[str, str, Column] | Column]:
    d = F.col("doc")
    ranges, p = elements(d, "$.frame_ranges"), number(d, "$.cluster_probability")

    def of_range(x, k):
        s, e, pair = integer(x, "$[0]"), integer(x, "$[1]"), F.coalesce(F.size(elements(x, "$")) == 2, F.lit(False))
        at = place("frame_ranges", k)
        return F.array(
            broken_rule(at, "must be a pair of start and end", ~pair),
            broken_rule(at, "must hold integers", pair & (missing(s) | missing(e))),
            broken_rule(at, "start must not pass end", pair & (s > e)),
        )

    return [
        ("clip_id", "must be a string", missing(text(d, "$.clip_id"))),
        ("local_track_id", "must be an integer", missing(integer(d, "$.local_track_id"))),
        ("frame_ranges", "must hold integers", missing(ranges)),
        F.flatten(F.transform(ranges, of_range)),
        ("cluster_probability", "must be within 0 and 1", (p < 0) | (p > 1)),
    ]


def scene_rules() -> list[tuple[str, str, Column] | Column]:
    d = F.col("doc")
    label, segments = text(d, "$.label"), elements(d, "$.crime_segments")
    some = F.coalesce(F.size(segments) > 0, F.lit(False))

    def of_segment(x, k):
        late = broken_rule(place("crime_segments", k), "start must not pass end", number(x, "$.timestamp_start") > number(x, "$.timestamp_end"))

        def of_person(y, j):
            return broken_rule(place("involved_people_global", k, j), "must hold integers", missing(integer(y, "$")))

        people = F.transform(elements(x, "$.involved_people_global"), of_person)
        return F.concat(F.array(late), F.coalesce(people, F.array().cast("array<struct<path:string,message:string>>")))

    return [
        ("label", "must be normal or crime", missing(label) | ~label.isin("normal", "crime")),
        ("crime_segments", "a normal clip has none", (label == "normal") & some),
        ("crime_segments", "a crime clip has one or more", (label == "crime") & ~some),
        F.flatten(F.transform(segments, of_segment)),
    ]


def report_rules() -> list[tuple[str, str, Column]]:
    d = F.col("doc")
    bounds = {"person_reid.v_measure": (0, 1), "person_reid.adjusted_rand_index": (-1, 1), "person_reid.purity": (0, 1), "scene.accuracy": (0, 1), "scene.macro_f1": (0, 1)}
    rules = []
    for path, (low, high) in bounds.items():
        value = number(d, f"$.{path}")
        rules += [(path, "must be a number", missing(value)), (path, f"must be within {low} and {high}", (value < low) | (value > high))]
    return rules
