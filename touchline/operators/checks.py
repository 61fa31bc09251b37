"""Validation: row classes, coverage, duplicate content, season checks and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a complete season holds, and process exit codes.
MATCHES, TEAMS, MATCHES_A_TEAM, MATCHES_A_VENUE = 380, 20, 38, 19
EXIT_CODES = {"PASS": 0, "FATAL": 1, "FAIL": 2}


def row_class(keys: list[Column], score: Column, parsed: Column, date: Column) -> Column:
    """blank (all key cells null), no score, bad score, bad date or used; the first that applies."""
    blank = reduce(lambda a, b: a & b, [k.isNull() for k in [*keys, score]])
    return F.when(blank, "blank").when(score.isNull(), "no score").when(parsed.isNull(), "bad score").when(date.isNull(), "bad date").otherwise("used")


def coverage(found: DataFrame, group: str, slot: str, content: str, slots: list[str]) -> DataFrame:
    """(group, slot, n, status) for every group and slot: PASS, MISSING, DUPLICATE (same content) or UNKNOWN (different)."""
    every = found.select(group).distinct().withColumn(slot, F.explode(F.array(*map(F.lit, slots))))
    # contents travel as digests
    counts = found.groupBy(group, slot).agg(F.count("*").alias("n"), F.count_distinct(F.md5(F.col(content).cast("string").cast("binary"))).alias("kinds"))
    status = F.when(F.col("n").isNull(), "MISSING").when(F.col("n") == 1, "PASS").when(F.col("kinds") == 1, "DUPLICATE").otherwise("UNKNOWN")
    return every.join(counts, [group, slot], "left").select(group, slot, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), status.alias("status"))


def pick_by_type(found: DataFrame, group: str, content: str, name: str) -> DataFrame:
    """(group, n, picked, note): the first table by name; several different ones are refused."""
    g = found.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(content).alias("kinds"), F.min(name).alias("first_name"))
    note = F.when(F.col("n") == 1, "").when(F.col("kinds") == 1, "identical copies").otherwise("refused: different tables")
    return g.select(group, "n", F.when(F.col("kinds") == 1, F.col("first_name")).alias("picked"), note.alias("note"))


def duplicate_content(df: DataFrame, content: str, group: str) -> DataFrame:
    """(content, n, n_groups, scope) of contents that occur more than once."""
    g = df.groupBy(content).agg(F.count("*").alias("n"), F.count_distinct(group).alias("n_groups")).filter(F.col("n") > 1)
    return g.withColumn("scope", F.when(F.col("n_groups") > 1, "across").otherwise("within"))


def season_checks(log: DataFrame, matches: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """One row a season: counts, balance, repeats, negatives and the verdict.

    log: two rows a match (season, d, t, opponent, venue, gf, ga); matches: one row.
    """
    want = {"matches": MATCHES, "teams": TEAMS, "each": MATCHES_A_TEAM, "venue": MATCHES_A_VENUE} | (expected or {})
    per_team = log.groupBy("season", "t").agg(F.count("*").alias("n"), F.count_if(F.col("venue") == "home").alias("at_home"), F.count_if(F.col("venue") == "away").alias("away_from_home"))
    fits = (F.col("n") == want["each"]) & (F.col("at_home") == want["venue"]) & (F.col("away_from_home") == want["venue"])
    teams = per_team.groupBy("season").agg(F.count("*").alias("n_teams"), F.count_if(~fits).alias("unbalanced"))
    pairs = matches.groupBy("season", "d", "h", "a").agg(F.count("*").alias("n"), F.min(F.least("hg", "ag")).alias("low"))
    per_season = pairs.groupBy("season").agg(F.sum("n").alias("n_matches"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("d").isNull()).alias("undated"), F.min("low").alias("least_goals"))
    good = (F.col("n_matches") == want["matches"]) & (F.col("n_teams") == want["teams"]) & (F.col("unbalanced") == 0) & (F.col("repeated") == 0) & (F.col("undated") == 0) & (F.col("least_goals") >= 0)
    return per_season.join(teams, "season").withColumn("status", F.when(good, "PASS").otherwise("FAIL"))


def out_of_order(df: DataFrame, group: list[str], position: str, date: str, stretch: int = 1 << 16) -> DataFrame:
    """(group, n, breaks, chronological): how often a row is dated before the row ahead of it. Fewer than two rows are not chronological.

    Neighbours are compared within stretches of `stretch` positions (a whole number), then the borders of the stretches, a
    row each: however many rows a group has, no window holds more than a stretch of them.
    """
    rows = df.withColumn("_part", F.floor(F.col(position) / stretch))
    w = Window.partitionBy(*group, "_part").orderBy(position)
    rows = rows.withColumn("_prev", F.lag(date).over(w))
    per = rows.groupBy(*group, "_part").agg(F.count("*").alias("n"), F.count_if(F.col("_prev") > F.col(date)).alias("breaks"), F.min_by(date, position).alias("_first"), F.max_by(date, position).alias("_last"))
    border = F.lag("_last").over(Window.partitionBy(*group).orderBy("_part"))
    g = per.withColumn("_border", (border > F.col("_first")).cast("bigint")).groupBy(*group).agg(F.sum("n").alias("n"), (F.sum("breaks") + F.coalesce(F.sum("_border"), F.lit(0))).alias("breaks"))
    return g.withColumn("chronological", (F.col("n") > 1) & (F.col("breaks") == 0))


def overall(status: DataFrame, col: str = "status") -> DataFrame:
    """One row: PASS if every status is, the number of rows that are not, and the exit code."""
    ok = F.coalesce(F.every(F.col(col) == "PASS"), F.lit(False))
    one = status.agg(F.when(ok, "PASS").otherwise("FAIL").alias("verdict"), F.count_if(F.col(col) != "PASS").alias("not_passed"))
    return one.withColumn("exit_code", F.when(F.col("verdict") == "PASS", EXIT_CODES["PASS"]).otherwise(EXIT_CODES["FAIL"]))


def integrity(tables: DataFrame, expected_rows: int = TEAMS) -> DataFrame:
    """Status of inspected tables (name, n_rows, n_teams, missing_teams, kind, side, hint_kind, hint_side).

    A name that claims something else than the content is a finding, not a failure.
    """
    finding = lambda cond, text: F.when(cond, text)
    blocking = F.concat_ws(
        " | ",
        finding(F.col("n_rows") != expected_rows, F.concat(F.lit("rows: "), F.col("n_rows").cast("string"))),
        finding(F.col("missing_teams") > 0, F.concat(F.lit("missing names: "), F.col("missing_teams").cast("string"))),
        finding(F.col("n_teams") != expected_rows, F.concat(F.lit("teams: "), F.col("n_teams").cast("string"))),
        finding(F.col("kind") == "UNKNOWN", F.lit("unknown schema")),
        finding((F.col("side") == "UNKNOWN") & (F.col("kind") != "UNKNOWN"), F.lit("unknown perspective")),
    )
    mismatch = ~(F.col("kind").eqNullSafe(F.col("hint_kind")) & F.col("side").eqNullSafe(F.col("hint_side")))
    return tables.withColumn("name_mismatch", mismatch).withColumn("findings", blocking).withColumn("status", F.when(F.col("findings") == "", "PASS").otherwise("FAIL"))
