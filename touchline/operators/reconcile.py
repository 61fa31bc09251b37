"""Comparison of two independent sources of the same metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The verdicts.
ABSENT_LEFT = "MAPPING ERROR (absent from fixtures)"
ABSENT_RIGHT = "MAPPING ERROR (absent from table)"
NO_COLUMN = "MAPPING ERROR (no column {})"


def long_form(df: DataFrame, keys: list[str], metrics: list[str], value: str) -> DataFrame:
    return df.select(*keys, *[F.col(m).cast("bigint").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", value)


def reconcile_with_notes(left: DataFrame, right: DataFrame, keys: list[str], metrics: list[str], notes: DataFrame) -> DataFrame:
    """(keys, metric, left_value, right_value, difference, status, note): `reconcile` with what the right source says of a key.

    notes: keys and note, one row a key. A note stands beside a status and never changes it; a key that right lacks has
    none. A metric that right has no column for is a mapping error of every key that both have.
    """
    there = [m for m in metrics if m in right.columns]
    rows = reconcile(left, right, keys, there)
    for m in metrics:
        if m not in there:
            lost = left.join(right.select(*keys).distinct(), keys).select(*keys, F.lit(m).alias("metric"), F.col(m).cast("bigint").alias("left_value"), F.lit(None).cast("bigint").alias("right_value"), F.lit(NO_COLUMN.format(m)).alias("status"))
            rows = rows.unionByName(lost)
    said = notes.select(*keys, F.col("note").alias("_note"))
    note = F.when(F.col("status") == ABSENT_RIGHT, "").otherwise(F.coalesce("_note", F.lit("")))
    return rows.join(said, keys, "left").select(*keys, "metric", "left_value", "right_value", (F.col("left_value") - F.col("right_value")).alias("difference"), "status", note.alias("note"))


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, left_value, right_value, status) by a full outer join of both long forms.

    A key that one side lacks gives one row with metric "*". A null on either side is UNKNOWN.
    """
    known_left, known_right = left.select(*keys).distinct().withColumn("in_left", F.lit(True)), right.select(*keys).distinct().withColumn("in_right", F.lit(True))
    presence = known_left.join(known_right, keys, "full_outer")
    absent = presence.filter(F.col("in_left").isNull() | F.col("in_right").isNull()).select(
        *keys, F.lit("*").alias("metric"), F.lit(None).cast("bigint").alias("left_value"), F.lit(None).cast("bigint").alias("right_value"), F.when(F.col("in_left").isNull(), ABSENT_LEFT).otherwise(ABSENT_RIGHT).alias("status")
    )
    both = long_form(left, keys, metrics, "left_value").join(long_form(right, keys, metrics, "right_value"), [*keys, "metric"])
    same = F.when(F.col("left_value").isNull() | F.col("right_value").isNull(), "UNKNOWN").when(F.col("left_value") == F.col("right_value"), "MATCH").otherwise("MISMATCH")
    return both.select(*keys, "metric", "left_value", "right_value", same.alias("status")).unionByName(absent)


def internal_consistency(overall: DataFrame, split: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, total, home_value, away_value) where home + away is not the total."""
    homes = split.select(*keys, *[F.col(f"home_{m}").alias(m) for m in metrics])
    aways = split.select(*keys, *[F.col(f"away_{m}").alias(m) for m in metrics])
    joined = long_form(overall, keys, metrics, "total").join(long_form(homes, keys, metrics, "home_value"), [*keys, "metric"]).join(long_form(aways, keys, metrics, "away_value"), [*keys, "metric"])
    return joined.filter(~(F.col("home_value") + F.col("away_value")).eqNullSafe(F.col("total")))
