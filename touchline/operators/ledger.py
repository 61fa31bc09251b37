"""Match ledgers: one row a match, two rows a match (one per side), and league tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.parse import points


def two_sided(matches: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(season, d, t, opponent, venue, gf, ga, pts) for both sides of (season, d, h, a, hg, ag)."""
    side = lambda t, o, v, gf, ga: F.struct(F.col(t).alias("t"), F.col(o).alias("opponent"), F.lit(v).alias("venue"), F.col(gf).alias("gf"), F.col(ga).alias("ga"))
    both = F.explode(F.array(side("h", "a", "home", "hg", "ag"), side("a", "h", "away", "ag", "hg"))).alias("s")
    log = matches.select(*keep, "season", "d", both).select(*keep, "season", "d", "s.*")
    return log.withColumn("pts", points(F.col("gf"), F.col("ga")))


def _records(prefix: str = "", only=None):
    keep = lambda c: c if only is None else F.when(only, c)
    won, drawn, lost = F.col("gf") > F.col("ga"), F.col("gf") == F.col("ga"), F.col("gf") < F.col("ga")
    made = [("mp", F.lit(1)), ("w", won.cast("int")), ("dr", drawn.cast("int")), ("l", lost.cast("int")), ("gf", F.col("gf")), ("ga", F.col("ga")), ("pts", F.col("pts"))]
    return [F.coalesce(F.sum(keep(c)), F.lit(0)).alias(prefix + n) for n, c in made]


def league_table(log: DataFrame) -> DataFrame:
    """Per season and team: played, won, drawn, lost, goals, points and goal difference."""
    return log.groupBy("season", "t").agg(*_records()).withColumn("gd", F.col("gf") - F.col("ga"))


def venue_table(log: DataFrame) -> DataFrame:
    """The same twice over, at home and away, in one pass."""
    out = log.groupBy("season", "t").agg(*_records("home_", F.col("venue") == "home"), *_records("away_", F.col("venue") == "away"))
    return out.withColumn("home_gd", F.col("home_gf") - F.col("home_ga")).withColumn("away_gd", F.col("away_gf") - F.col("away_ga"))
