"""Features from strictly earlier days, and nothing else.

Rows of one day never see each other. So days, not rows, are windowed: facts are summed per key and
day first (with map-side combining), the running sums over days are small, and rows look theirs up by
(key, day). A key with a third of all rows costs one row a day in the window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _days(date: str) -> Column:
    return F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))


def earlier_days(keys: list[str], date: str) -> Window:
    """All days before the row's day."""
    return Window.partitionBy(*keys).orderBy(_days(date)).rangeBetween(Window.unboundedPreceding, -1)


def join_back(rows: DataFrame, facts: DataFrame, keys: list[str], date: str) -> DataFrame:
    own = {k: f"_facts_{k}" for k in [*keys, date]}  # by name: rows and facts may come from one table
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f)) for k, f in own.items()])
    return rows.join(facts.withColumnsRenamed(own), same, "left").drop(*own.values())


def sums_by_day(rows: DataFrame, keys: list[str], date: str, sums: dict[str, Column], empty: int | None = 0) -> DataFrame:
    """(keys, date, sums over strictly earlier days), one row a day (empty: value without history)."""
    daily = rows.groupBy(*keys, date).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    w = earlier_days(keys, date)
    run = [F.sum(n).over(w) for n in sums]
    return daily.select(*keys, date, *[(F.coalesce(r, F.lit(empty)) if empty is not None else r).alias(n) for n, r in zip(sums, run, strict=True)])


def strict_sums(rows: DataFrame, keys: list[str], date: str, sums: dict[str, Column], empty: int | None = 0) -> DataFrame:
    """rows with, for each name in sums, the sum over strictly earlier days."""
    return join_back(rows, sums_by_day(rows, keys, date, sums, empty), keys, date)


def rest_days(rows: DataFrame, keys: list[str], date: str, name: str = "rest_days") -> DataFrame:
    """Days since the key's last earlier day; null without one."""
    facts = rows.select(*keys, date).distinct()
    facts = facts.withColumn(name, F.datediff(F.col(date), F.max(date).over(earlier_days(keys, date))))
    return join_back(rows, facts, keys, date)


def recent_by_day(rows: DataFrame, keys: list[str], date: str, tie: str, values: list[str], n: int = 5) -> DataFrame:
    """(keys, date, recent), one row a day: the values of the key's last n rows on strictly earlier days, oldest first.

    A day hands on its last n rows at most (trimmed before the shuffle), and the last n before a day lie
    in the n days with rows before it, so no array outgrows n * n.
    """
    w = Window.partitionBy(*keys, date).orderBy(F.col(tie).desc())
    tail = rows.select(*keys, date, tie, *values).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    daily = tail.groupBy(*keys, date).agg(F.sort_array(F.collect_list(F.struct(date, tie, *values))).alias("_day"))
    # days without rows of their own do not exist here, so n day rows hold at least n rows
    before = F.flatten(F.collect_list("_day").over(Window.partitionBy(*keys).orderBy(_days(date)).rowsBetween(-n, -1)))
    facts = daily.select(*keys, date, before.alias("_all"))
    return facts.select(*keys, date, F.slice("_all", F.greatest(F.size("_all") - (n - 1), F.lit(1)), F.lit(n)).alias("recent"))


def last_n(rows: DataFrame, keys: list[str], date: str, tie: str, values: list[str], n: int = 5) -> DataFrame:
    """rows with `recent`, see recent_by_day."""
    return join_back(rows, recent_by_day(rows, keys, date, tie, values, n), keys, date)


def total(array: str, field: str) -> Column:
    return F.aggregate(array, F.lit(0).cast("bigint"), lambda a, x: a + x[field].cast("bigint"))


def previous_value(rows: DataFrame, keys: list[str], date: str, tie: str, value: str, name: str) -> DataFrame:
    """The value of the key's last row on a strictly earlier day (largest tie of that day)."""
    daily = rows.groupBy(*keys, date).agg(F.max_by(value, tie).alias(name))
    last = F.last(name).over(Window.partitionBy(*keys).orderBy(_days(date)).rowsBetween(-1, -1))
    return join_back(rows, daily.select(*keys, date, last.alias(name)), keys, date)


def later_pairs(rows: DataFrame, keys: list[str], date: str) -> DataFrame:
    """(keys, pairs): pairs of a row and a row of a later day, counted without forming them."""
    daily = rows.groupBy(*keys, date).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(_days(date)).rangeBetween(1, Window.unboundedFollowing)
    return daily.withColumn("_p", F.col("_n") * F.coalesce(F.sum("_n").over(w), F.lit(0))).groupBy(*keys).agg(F.sum("_p").alias("pairs"), F.sum(F.when(F.col("_p") > 0, F.col("_n")).otherwise(0)).alias("rows_with_later"))
