"""Relational building blocks with explicit order, so that "first wins" means the same in every run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group. Spark trims groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def dedupe_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, n, share) without nulls. Shares come from one total joined as a single row."""
    n = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def missing_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, missing) for columns with nulls, in one aggregation."""
    one = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in cols])
    return one.unpivot([], cols, "column_name", "missing").filter(F.col("missing") > 0)


def any_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols]))


def flag_repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur more than once. The counts are aggregated first, so a hot key costs one row a task."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select(*[F.col(k).alias(f"_{k}") for k in keys])
    return df.join(counts, reduce(lambda a, b: a & b, [df[k].eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_semi")


def is_close(a: Column, b: Column, atol: float = 1e-6, rtol: float = 1e-5) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def missing_keys(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys of left that right lacks."""
    return left.select(*on).distinct().join(right.select(*on).distinct(), on, "left_anti")


def merge_one_to_one(left: DataFrame, right: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Left join of a one-row-a-key right side: repeats of the key go (first in order stays), and so do columns that left has already.

    A key that left has twice breaks the promise: reading the result fails with an error that names it.
    """
    right = dedupe_first(right, [key], order)
    own = once(left, key)
    return own.join(right.select(key, *[c for c in right.columns if c not in left.columns]), key, "left")


def merge_chain(left: DataFrame, rights: list[tuple[DataFrame, list[Column]]], key: str) -> DataFrame:
    """left with the columns of every right side, one to one; of equal names the first stays. rights: (table, order)."""
    out = once(left, key)
    for right, order in rights:
        right = dedupe_first(right, [key], order)
        out = out.join(right.select(key, *[c for c in right.columns if c not in out.columns]), key, "left")
    return out


def once(df: DataFrame, key: str) -> DataFrame:
    """df, of which every row of a repeated key is an error. Keys are counted with map-side combining."""
    counts = df.groupBy(F.col(key).alias("_once")).agg(F.count("*").alias("_n"))
    told = F.concat(F.lit(f"merge keys are not unique in left: {key} = "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    met = df.join(counts, df[key].eqNullSafe(F.col("_once"))).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(told).cast("bigint")).otherwise(F.col("_n")))
    return met.filter(F.col("_n") == 1).drop("_once", "_n")


def numeric_summary(df: DataFrame, col: str) -> DataFrame:
    """count, mean, standard deviation, least and largest of a column."""
    c = F.col(col)
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("least"), F.max(c).alias("largest"))


def pearson(df: DataFrame, a: str, b: str) -> Column:
    """Correlation from sums; null without variance."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    ok = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return F.when(ok, F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def content_fingerprint(df: DataFrame, keys: list[str], row: Column) -> DataFrame:
    """(keys, n_rows, fingerprint): equal for equal bags of rows in any order, without gathering a group.

    Every row is hashed by md5; the two halves are summed, which map-side combining reduces to one row a task.
    """
    h = F.md5(row.cast("binary"))
    half = lambda a: F.conv(F.substring(h, a, 13), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum(half(1)).alias("_a"), F.sum(half(14)).alias("_b")).select(*keys, "n_rows", F.md5(F.concat_ws(":", F.col("_a").cast("string"), F.col("_b").cast("string")).cast("binary")).alias("fingerprint"))
