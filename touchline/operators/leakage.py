"""Tests that features hold nothing from a match's own day or later, and the registry of what may be used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions.parse import points
from touchline.operators import features, history
from touchline.operators.ledger import two_sided

PASS, FAIL, LEAK = "PASS", "FAIL", "LEAK DETECTED"
# Sample size and replacement score of the perturbation test.
SAMPLE, NEW_HOME, NEW_AWAY = 100, 9, 0


def verdict(df: DataFrame, test: str, tested, observed, bad, when_bad: str = FAIL) -> DataFrame:
    """One row (test, tested, observed, verdict) from aggregates over df."""
    one = df.agg(F.coalesce(tested, F.lit(0)).cast("bigint").alias("tested"), F.coalesce(observed, F.lit(0)).cast("bigint").alias("observed"), F.coalesce(bad, F.lit(0)).cast("bigint").alias("_bad"))
    return one.select(F.lit(test).alias("test"), "tested", "observed", F.when(F.col("_bad") > 0, when_bad).otherwise(PASS).alias("verdict"))


def history_sizes(log: DataFrame, keys: list[str], date: str = "d", same_day: bool = False) -> DataFrame:
    """(keys, date, n, before, newest): rows of the day, rows of its history, and the history's last day. same_day: the wrong frame, as a negative control."""
    daily = log.groupBy(*keys, date).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))).rangeBetween(Window.unboundedPreceding, 0 if same_day else -1)
    return daily.select(*keys, date, "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"), F.max(date).over(w).alias("newest"))


def t1_dated(matches: DataFrame) -> DataFrame:
    undated = F.count_if(F.col("d").isNull())
    return verdict(matches, "T1", F.count("*"), undated, undated)


def audited(log: DataFrame, keys: list[str], table: DataFrame | None = None, date: str = "d") -> DataFrame:
    """(keys, date, n, before, mp, pts): what a feature table says was known (mp matches, pts points), beside the day's rows counted anew.

    table: keys, date, mp and pts, of any number of rows a day; by default what the library's own history makes of log.
    Of several rows of a day the one that knows most counts.
    """
    if table is None:
        table = history.sums_by_day(log, keys, date, {"mp": F.lit(1), "_known": F.col("pts")}).withColumnRenamed("_known", "pts")
    facts = table.groupBy(*keys, date).agg(F.max("mp").alias("mp"), F.max("pts").alias("pts"))
    return history.join_back(history_sizes(log, keys, date), facts, keys, date)


def t2_strict(log: DataFrame, keys: list[str], same_day: bool = False, table: DataFrame | None = None) -> DataFrame:
    """History entries in all; the test fails where a feature table knows more matches than were played on earlier days.

    table: see `audited`. same_day: a table that counts the match's own day, as a negative control.
    """
    if same_day:
        table = history_sizes(log, keys, same_day=True).select(*keys, "d", F.col("before").alias("mp"), F.lit(0).alias("pts"))
    h = audited(log, keys, table)
    return verdict(h, "T2", F.sum("n"), F.sum(F.col("n") * F.col("mp")), F.sum(F.when((F.col("mp") > F.col("before")) | (F.col("newest") >= F.col("d")), F.col("n")).otherwise(0)))


def t3_same_day(matches: DataFrame) -> DataFrame:
    """Matches that share their day with another of the season (none of which may be used)."""
    days = matches.groupBy("season", "d").agg(F.count("*").alias("n"))
    return verdict(days, "T3", F.sum("n"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)), F.lit(0))


def t4_cold_starts(log: DataFrame, keys: list[str]) -> DataFrame:
    h = history_sizes(log, keys)
    return verdict(h, "T4", F.sum("n"), F.sum(F.when(F.col("before") == 0, F.col("n")).otherwise(0)), F.lit(0))


def t5_future_pairs(matches: DataFrame) -> DataFrame:
    """Pairs (match, later match of the season) that an unfiltered join would form."""
    return verdict(history.later_pairs(matches, ["season"], "d"), "T5", F.sum("rows_with_later"), F.sum("pairs"), F.lit(0))


def t6_availability(matches: DataFrame) -> DataFrame:
    """Season totals are known on the season's last day: matches on or before it are exposed."""
    days = matches.groupBy("season", "d").agg(F.count("*").alias("n"))
    known = days.groupBy("season").agg(F.max("d").alias("available"))
    exposed = F.sum(F.when(F.col("available") >= F.col("d"), F.col("n")).otherwise(0))
    return verdict(days.join(known, "season"), "T6", F.sum("n"), exposed, exposed, LEAK)


def final_points(log: DataFrame) -> DataFrame:
    """log with the team's points of the whole season beside every match: what no match may know."""
    return history.join_back(log, log.groupBy("season", "t").agg(F.sum("pts").alias("final_pts")), ["season"], "t")


def t7_constant(table: DataFrame, feature: str = "final_pts") -> DataFrame:
    """Team-seasons of several matches in which a feature takes one value only: the mark of a season's total.

    table: season, t and the feature; without the feature it is a log, and its final points are put to the test.
    """
    table = table if feature in table.columns else final_points(table)
    beside = table.groupBy("season", "t").agg(F.count_distinct(feature).alias("kinds"), F.count("*").alias("n"))
    constant = F.count_if((F.col("kinds") == 1) & (F.col("n") > 1))
    return verdict(beside, "T7", F.count("*"), constant, constant, LEAK)


def t8_behaviour(log: DataFrame, keys: list[str], table: DataFrame | None = None) -> DataFrame:
    """A feature table knows nothing on a key's first day, and never more rows than the key has besides the day's own."""
    h = _seasons(log, keys, table)
    broken = F.sum(F.when(((F.col("d") == F.col("_first")) & (F.col("mp") > 0)) | (F.col("mp") + F.col("n") > F.col("_all")), F.col("n")).otherwise(0))
    return verdict(h, "T8", F.sum("n"), broken, broken)


def t8_totals(log: DataFrame, keys: list[str], table: DataFrame | None = None) -> DataFrame:
    """Matches whose known points already equal the key's final total, with matches still to come; for information."""
    final = log.groupBy(*keys).agg(F.sum("pts").alias("_final"))
    h = history.join_back(_seasons(log, keys, table), final, keys[:-1], keys[-1])
    early = F.sum(F.when((F.col("mp") < F.col("_all")) & (F.col("pts") == F.col("_final")) & (F.col("_final") > 0), F.col("n")).otherwise(0))
    return verdict(h, "T8_TOTALS", F.sum("n"), early, F.lit(0))


def _seasons(log: DataFrame, keys: list[str], table: DataFrame | None) -> DataFrame:
    w = Window.partitionBy(*keys)
    return audited(log, keys, table).withColumn("_first", F.min("d").over(w)).withColumn("_all", F.sum("n").over(w))


def stride_sample(matches: DataFrame, n: int = SAMPLE, id_col: str = "row_id") -> DataFrame:
    """Every step-th match in the order of season, day and id; n at most."""
    step = max(1, matches.count() // n)
    return numbered(matches, ["season", "d"], [id_col]).filter((F.col("position") % step == 0) & (F.col("position") < step * n))


def numbered(df: DataFrame, coarse: list[str], fine: list[str], within: list[str] = ()) -> DataFrame:
    """df with its 0-based position in the order of coarse, then fine, nulls last; within: columns that each start anew.

    Rows are ranked within their coarse group only; the windows over more than that run on one row a
    group (a day of a season), however many rows there are.
    """
    groups = [*within, *coarse]
    own = {c: f"_of_{c}" for c in groups}
    sizes = df.groupBy(*groups).agg(F.count("*").alias("_n"))
    before = sizes.select(*[F.col(c).alias(o) for c, o in own.items()], (F.sum("_n").over(Window.partitionBy(*within).orderBy(*[F.col(c).asc_nulls_last() for c in coarse])) - F.col("_n")).alias("_before"))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*fine)))
    return ranked.join(before, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(o)) for c, o in own.items()])).drop(*own.values()).withColumn("position", F.col("_before") + F.col("_rank") - 1).drop("_before", "_rank")


def perturbed(matches: DataFrame, sample: DataFrame, same_day: bool = False) -> DataFrame:
    """(sample_id, side, changed): do a sampled match's own features move when its score does?

    matches: row_id, season, d, h, a, hg, ag. Every sampled match is scored 9-0 in a copy of its own two teams'
    season, and all probe features of both copies, made by the library's own code, are compared. same_day reads
    them a day later, when the match's own day counts as history: a negative control.
    """
    asked = sample.select(F.col("row_id").alias("sample_id"), "season", F.col("d").alias("on"), F.col("h").alias("h0"), F.col("a").alias("a0"))
    near = (matches["h"] == asked["h0"]) | (matches["a"] == asked["h0"]) | (matches["h"] == asked["a0"]) | (matches["a"] == asked["a0"])
    copies = matches.join(F.broadcast(asked), (matches["season"] == asked["season"]) & near).drop(asked["season"])
    own = F.col("row_id") == F.col("sample_id")
    versions = copies.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    versions = versions.withColumn("hg", F.when(own & (F.col("v") == 1), NEW_HOME).otherwise(F.col("hg"))).withColumn("ag", F.when(own & (F.col("v") == 1), NEW_AWAY).otherwise(F.col("ag")))
    log = two_sided(versions, ["sample_id", "v", "row_id", "h0", "a0"]).filter((F.col("t") == F.col("h0")) | (F.col("t") == F.col("a0")))
    asking = log.filter(F.col("row_id") == F.col("sample_id"))
    if same_day:
        asking = asking.withColumn("d", F.date_add("d", 1)).withColumns({c: F.lit(None).cast(log.schema[c].dataType) for c in ("gf", "ga", "pts")})
        log = log.unionByName(asking)
    sides = features.probe(log, asking, ["sample_id", "v"])
    packed = sides.groupBy("sample_id", "t", "venue").agg(*[F.max(F.when(F.col("v") == v, F.struct(*features.PROBE))).alias(f"f{v}") for v in (0, 1)])
    return packed.groupBy("sample_id", F.col("t").alias("side")).agg(F.bool_or(~F.col("f0").eqNullSafe(F.col("f1"))).alias("changed"))


def t9_perturbation(matches: DataFrame, sample: DataFrame, same_day: bool = False) -> DataFrame:
    moved = F.count_if("changed")
    return verdict(perturbed(matches, sample, same_day), "T9", F.count("*"), moved, moved)


# The registry of features. Each group lists names, whether they are known before a match,
# and whether they may be used in training.
REGISTRY = (
    (("Date",), "YES", "YES (as the ordering key)"),
    (("Wk", "Day", "Home", "Away", "Venue"), "YES", "YES"),
    (("Time",), "YES", "CAUTION"),
    (("Score",), "NO", "NO - TARGET SOURCE"),
    (("Attendance", "Match Report", "Notes"), "NO", "NO"),
    (("Referee",), "UNDETERMINED", "NO - PENDING DECISION"),
    (("HomeGoals", "AwayGoals", "Result", "Points_This_Match"), "NO", "NO - TARGET"),
    (tuple(f"{side}_{x}" for x in ("MP_Before", "Pts_Before", "GF_Before", "GA_Before", "Last5_Pts_Before", "Venue_Pts_Before", "Prev_Match_Pts") for side in ("Home", "Away")), "YES", "YES"),
    (("Final_Season_Pts", "Final_League_Position", "Season_GF_Total", "Season_Shooting_Stats", "Season_Goalkeeping_Stats", "Season_PlayingTime_Stats", "Season_Miscellaneous_Stats"), "NO", "NO"),
    (("Any_Future_Match_Statistic", "Any_SameDay_Match_Statistic", "Current_Match_Statistics"), "NO", "NO"),
)


def registry(spark: SparkSession) -> DataFrame:
    rows = [(name, known, allowed) for names, known, allowed in REGISTRY for name in names]
    return spark.createDataFrame(rows, "feature string, available_before_match string, allowed_for_training string")


def registry_summary(spark: SparkSession) -> DataFrame:
    a = F.col("allowed_for_training")
    return registry(spark).agg(F.count("*").alias("entries"), F.count_if(a == "YES").alias("allowed"), F.count_if(a.startswith("NO")).alias("refused"), F.count_if(F.col("available_before_match") == "UNDETERMINED").alias("undetermined"))
