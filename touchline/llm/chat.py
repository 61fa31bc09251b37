"""Chat formatting by rotating the perspective of a dialogue. DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as assistant,
all others as named users, and a loss mask over exactly the participant's own words (with their
end mark). Speakers in `CONTEXT` (system notes) take no perspective and are rendered as they are.

Turns are ordered by turn, then speaker, then text. A long dialogue is cut into segments of
`SEGMENT_TURNS` turn numbers, each a row, so a conversation with a third of all rows is spread over
segments. The query renders every segment whole, whatever its size, as its SQL does. `rotate` can also cut
segments of more than `HEAVY` rows into parts, by turn and then by `PIECE_ROWS` rows of a turn; parts follow the
order of the rows and are told apart by `part`.

Defined results: exact repetitions of a turn (same conversation, turn, speaker and text) are
rendered once; null speakers are "unknown"; null texts are empty; null turns come first, in segment -1;
rows with a null conv_id form one conversation; a conversation of context alone has no perspective
and gives no row; other columns are ignored. Mask offsets count characters of the segment's text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm import common

# The markers of the ChatML layout.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTEXT = ("system",)
SEGMENT_TURNS = 256
HEAVY = 4096
PIECE_ROWS = 2048
#: Characters of a rendered turn besides its name and text.
LAYOUT = len(OPEN) + 1 + len(CLOSE) + 1


def _segments(turns: DataFrame, cut: bool) -> DataFrame:
    """(conv_id, segment, part, said): said is the ordered array of (turn, speaker, text, at).

    at: characters of the segment (or part) before the row, with the names that others than the speaker see.
    """
    segment = F.coalesce(F.floor(F.col("turn") / SEGMENT_TURNS), F.lit(-1)).cast("bigint")
    rows = turns.select("conv_id", "turn", "speaker", "text", "name", segment.alias("segment")).distinct()
    part = F.struct(F.lit(0).cast("bigint").alias("turn"), F.lit(0).cast("bigint").alias("piece"))
    if cut:
        heavy = rows.groupBy("conv_id", "segment").agg(F.count("*").alias("n")).filter(F.col("n") > HEAVY).withColumnsRenamed({"conv_id": "c", "segment": "s"})
        rows = rows.join(heavy, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")), "left")
        rank = F.row_number().over(Window.partitionBy("conv_id", "segment", "turn").orderBy("speaker", "text"))
        piece = F.floor((rank - 1) / PIECE_ROWS).cast("bigint")
        part = F.when(F.col("n").isNull(), part).otherwise(F.struct(F.coalesce("turn", F.lit(-1)).cast("bigint").alias("turn"), piece.alias("piece")))
    size = F.length("name") + F.length("text") + LAYOUT
    before = Window.partitionBy("conv_id", "segment", "part").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("part", part).withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)))
    return rows.groupBy("conv_id", "segment", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "text", "at"))).alias("said"))


def rotate(conversations: DataFrame, context: tuple[str, ...] = CONTEXT, cut: bool = True) -> DataFrame:
    """(conv_id, perspective, segment, part, n_turns, n_trained, text, mask) of every participant.

    mask: array of (from, to), the spans of text to train on. cut: whether heavy segments are cut into parts.
    """
    c = conversations
    turns = c.select(
        c["conv_id"], c["turn"].cast("bigint").alias("turn"), F.coalesce(c["role"], F.lit("unknown")).alias("speaker"), F.coalesce(c["text"], F.lit("")).alias("text")
    )
    other = lambda speaker: F.when(speaker.isin(*context), speaker).otherwise(F.concat(F.lit("user name="), speaker))
    turns = turns.withColumn("name", other(F.col("speaker")))
    who = turns.filter(~F.col("speaker").isin(*context)).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    seen = _segments(turns, cut).join(who, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")

    def render(s):
        name = F.when(s["speaker"] == F.col("perspective"), F.lit("assistant")).otherwise(other(s["speaker"]))
        return F.concat(F.lit(OPEN), name, F.lit("\n"), s["text"], F.lit(CLOSE + "\n"))

    # a row of the speaker's own is so much longer or shorter under "assistant" than under the speaker's name
    change = F.lit(len("assistant")) - F.length(other(F.col("perspective")))

    def span(s, k):
        at = s["at"] + k * change + len(OPEN) + len("assistant") + 1
        return F.struct(at.cast("int").alias("from"), (at + F.length(s["text"]) + len(CLOSE)).cast("int").alias("to"))

    shaped = seen.withColumn("own", F.filter("said", lambda s: s["speaker"] == F.col("perspective")))
    return shaped.select(
        "conv_id",
        "perspective",
        "segment",
        "part",
        F.size("said").alias("n_turns"),
        F.size("own").alias("n_trained"),
        F.array_join(F.transform("said", render), "").alias("text"),
        F.transform("own", span).alias("mask"),
    )


def op1_chat_rotation(spark, sf_dir: str) -> DataFrame:
    made = rotate(common.table(spark, sf_dir, "conversations"), cut=False)
    spans = F.transform("mask", lambda m: F.concat(m["from"].cast("string"), F.lit("-"), m["to"].cast("string")))
    return made.select("conv_id", "perspective", "segment", "n_turns", "n_trained", "text", F.array_join(spans, ",").alias("mask"))


OP1_SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text,
         coalesce(CAST(floor(turn / {SEGMENT_TURNS}) AS BIGINT), -1) AS segment FROM conversations),
w AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker NOT IN ('system')),
x AS (
  SELECT t.*, perspective, speaker = perspective AS own,
         '{OPEN}' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN speaker ELSE 'user name=' || speaker END || chr(10) AS head,
         t.text || '{CLOSE}' AS body FROM t JOIN w ON t.conv_id IS NOT DISTINCT FROM w.conv_id),
y AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, segment ORDER BY turn NULLS FIRST, speaker, text
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x)
SELECT conv_id, perspective, segment, CAST(count(*) AS INTEGER) AS n_turns, CAST(sum(own::INT) AS INTEGER) AS n_trained,
       string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, speaker, text) AS text,
       coalesce(string_agg(CAST(before + length(head) AS BIGINT) || '-' || CAST(before + length(head) + length(body) AS BIGINT), ',' ORDER BY before) FILTER (WHERE own), '') AS mask
FROM y GROUP BY 1, 2, 3
"""
