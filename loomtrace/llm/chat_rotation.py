"""Multi-party perspective rotation of conversations.

For every participant of a conversation (every role but the system's) the whole dialogue is rendered
with that speaker as ``assistant``; the others become ``user`` turns that carry their name. The output
is one row per (conversation, perspective, turn): the rendered segment, its character range in the
rendered dialogue, and the range within it that training should learn from (the assistant's words
and the end mark). Joining the segments by position gives the dialogue; they are not joined here, so a
conversation with a third of all rows never meets in one row.

Positions are prefix sums in two levels, over stretches of ``STRETCH`` turn numbers and then over the
sums of stretches, so one long conversation is spread over many tasks. A stretch of more than ``hot_rows`` rows,
as of many equal turns, is counted first and cut by rank into parts. The sums need lengths alone: texts move
once, to the other turns of their stretch, and take all their perspectives there.

Defined cases: a null text is empty; a null role is the participant ``unknown``, as is a role of that name; a
null turn comes first; equal turns are ordered by role, then text, and repeated rows are kept apart; a null
conv_id is a conversation of its own; a very long text is one segment; the beginning of a mark in a text or a
name, ``<|im_``, is written ``<\\|im_``, and line ends in a name are spaces, so no turn can forge another; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.operators.order import numbered

STRETCH = 256
HOT_ROWS = 64 * STRETCH
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
MARK, ESCAPED = "<|im_", "<\\|im_"


def _escaped(text: Column) -> Column:
    return F.replace(text, F.lit(MARK), F.lit(ESCAPED))


def _head(speaker: Column, own: Column) -> Column:
    """What stands before a turn's text; ``own`` says whether the perspective is the speaker's."""
    named = F.concat(F.lit("user name="), F.translate(_escaped(speaker), "\r\n", "  "))
    return F.concat(F.lit(OPEN), F.when(speaker == SYSTEM, SYSTEM).when(own, "assistant").otherwise(named), F.lit("\n"))


def _in_parts(turns: DataFrame, stretch_keys: list[str], order: list[Column], stretch: int, hot_rows: int) -> DataFrame:
    """turns with ``part``: 0, and the rank in steps of ``stretch`` where a stretch has more than ``hot_rows`` rows."""
    hot = turns.groupBy(*stretch_keys).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).drop("n")
    if hot.isEmpty():
        return turns.withColumn("part", F.lit(0).cast("long"))
    ranked = numbered(turns.join(hot, stretch_keys, "left_semi"), [*stretch_keys, "late", "speaker", "text"], "part")
    ranked = ranked.withColumn("part", F.floor(F.col("part") / stretch).cast("long"))
    return turns.join(hot, stretch_keys, "left_anti").withColumn("part", F.lit(0).cast("long")).unionByName(ranked)


def rotate_perspectives(conversations: DataFrame, stretch: int = STRETCH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """conv_id, perspective, position, turn, role, name, segment, start, end, train_start, train_end."""
    least = F.lit(-(1 << 62)).cast("long")
    turns = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), least).alias("conv"),
        F.col("conv_id").isNull().alias("nameless"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("late"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"),
        _escaped(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    ).withColumn("stretch", F.when(F.col("turn").isNull(), least).otherwise(F.floor(F.col("turn") / stretch)))
    conv, order = ["conv", "nameless"], [F.asc_nulls_first("turn"), F.asc("speaker"), F.asc("text")]
    turns = _in_parts(turns, [*conv, "stretch"], order, stretch, hot_rows)
    keys = [*conv, "stretch", "part"]
    # Sums of stretches, from lengths alone. A turn's other rendering differs from its own by its head.
    other, own = F.length(_head(F.col("speaker"), F.lit(False))), F.length(_head(F.col("speaker"), F.lit(True)))
    spoken = turns.groupBy(*keys, "speaker").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    totals = spoken.groupBy(*keys).agg(F.sum("n").alias("rows"), F.sum(F.col("chars") + F.col("n") * (other + len(CLOSE))).alias("size"))
    people = spoken.where(F.col("speaker") != SYSTEM).select(*keys, F.col("speaker").alias("perspective"), (F.col("n") * (own - other)).alias("saved"))
    speakers = people.select(*conv, "perspective").distinct()
    sums = totals.join(speakers, conv).join(people, [*keys, "perspective"], "left").withColumn("size", F.col("size") + F.coalesce("saved", F.lit(0)))
    before = Window.partitionBy(*conv, "perspective").orderBy("stretch", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        *keys, "perspective", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before")
    )
    # Texts are dealt by stretch for this join, and stay there for the window over a stretch and perspective.
    own_turn = F.col("speaker") == F.col("perspective")
    rows = (
        turns.join(bases.hint("merge"), keys)
        .withColumn("head", _head(F.col("speaker"), own_turn))
        .withColumn("segment", F.concat("head", "text", F.lit(CLOSE)))
        .withColumn("size", F.length("segment").cast("long"))
    )
    inner = Window.partitionBy(*keys, "perspective").orderBy(*order)
    placed = rows.select(
        "*",
        (F.col("base") + F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
        (F.col("rows_before") + F.row_number().over(inner) - 1).alias("position"),
    )
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own_turn, "assistant").otherwise("user")
    return placed.select(
        F.when(~F.col("nameless"), F.col("conv")).alias("conv_id"),
        "perspective",
        "position",
        "turn",
        role.alias("role"),
        F.when((F.col("speaker") != SYSTEM) & ~own_turn, F.col("speaker")).alias("name"),
        "segment",
        "start",
        (F.col("start") + F.col("size")).alias("end"),
        F.when(own_turn, F.col("start") + F.length("head")).alias("train_start"),
        F.when(own_turn, F.col("start") + F.col("size") - 1).alias("train_end"),
    )


#: The same rows in DuckDB's SQL, for one level of prefix sums.
ORACLE_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id AS conv, speaker AS perspective FROM turns WHERE speaker <> 'system'
), parts AS (
  SELECT conv_id, perspective, turn, speaker, text,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
    CASE WHEN speaker <> 'system' AND speaker <> perspective THEN speaker END AS name
  FROM turns JOIN speakers ON conv_id IS NOT DISTINCT FROM conv
), heads AS (
  SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM parts
), segments AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM heads
), placed AS (
  SELECT *, row_number() OVER w - 1 AS position, sum(length(segment)) OVER w - length(segment) AS begins
  FROM segments
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn ASC NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, role, name, segment,
  CAST(begins AS BIGINT) AS "start", CAST(begins + length(segment) AS BIGINT) AS "end",
  CAST(CASE WHEN role = 'assistant' THEN begins + length(head) END AS BIGINT) AS train_start,
  CAST(CASE WHEN role = 'assistant' THEN begins + length(segment) - 1 END AS BIGINT) AS train_end
FROM placed
"""
