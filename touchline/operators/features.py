"""Derived features: differences, guarded rates, carry-over ratings, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators import history
from touchline.operators.ledger import two_sided

# The probe features of one side of a match.
PROBE = ("mp", "pts", "gf", "ga", "last5_pts", "venue_mp", "venue_pts", "prev_pts")

# Fixed value: the weight of the league mean in a carry-over rating.
SHRINKAGE = 0.25


def rate(x: Column, games: Column) -> Column:
    """x / games, null without games."""
    return F.when(games > 0, x / games)


def probe(log: DataFrame, rows: DataFrame, within: list[str] = ()) -> DataFrame:
    """(within, row_id, season, t, venue, d, PROBE) of rows, from strictly earlier days of the season in log.

    log: within, row_id, season, d, t, venue, gf, ga, pts; rows: some of its rows. within tells copies of a season apart.
    """
    team = [*within, "season", "t"]
    side_of = [*team, "venue"]
    # all facts of a team are put together by day first; matches look them up once
    sums = history.sums_by_day(log, team, "d", {"mp": F.lit(1), "b_pts": F.col("pts"), "b_gf": F.col("gf"), "b_ga": F.col("ga")})
    recent = history.recent_by_day(log, team, "d", "row_id", ["pts"])
    facts = sums.join(recent, [*team, "d"]).withColumn("last5_pts", history.total("recent", "pts")).withColumn("prev_pts", F.try_element_at("recent", F.lit(-1))["pts"]).drop("recent")
    got = history.join_back(rows.select("row_id", *side_of, "d"), facts, team, "d")
    got = history.join_back(got, history.sums_by_day(log, side_of, "d", {"venue_mp": F.lit(1), "venue_pts": F.col("pts")}), side_of, "d")
    return got.withColumnsRenamed({"b_pts": "pts", "b_gf": "gf", "b_ga": "ga"})


def differences(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    return df.withColumns({name: F.col(a) - F.col(b) for name, (a, b) in pairs.items()})


# The quantities of which a match has a home-minus-away difference: state of the season, last five matches, last five at the
# venue, rates of the season, then across seasons.
COMPARED = (
    "pts", "gf", "ga", "games", "last5_pts", "last5_wins", "last5_gf", "last5_ga", "venue_pts", "venue_wins", "venue_gf", "venue_ga", "ppg", "gf_rate", "ga_rate",
    "x_ppg", "x_gf_rate", "x_ga_rate", "x_last5_ppg", "rest", "carryover",
)


def _recent_sums(log: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    recent = history.recent_by_day(log, keys, "d", "row_id", ["pts", "wins", "gf", "ga"])
    return recent.select(*keys, "d", *[history.total("recent", c).alias(f"{prefix}_{c}") for c in ("pts", "wins", "gf", "ga")], F.size("recent").alias(f"{prefix}_n"))


def match_differences(matches: DataFrame) -> DataFrame:
    """(row_id, x_diff for every x in COMPARED): home minus away, from strictly earlier days; null where a side has no history to rate.

    matches: row_id, season, d, h, a, hg, ag. All facts are rows of a key and day before matches look them up.
    """
    log = two_sided(matches, ["row_id"]).withColumn("wins", (F.col("gf") > F.col("ga")).cast("int"))
    sums = {"s_pts": F.col("pts"), "s_gf": F.col("gf"), "s_ga": F.col("ga"), "games": F.lit(1)}
    team = ["season", "t"]
    own = history.sums_by_day(log, team, "d", sums).join(_recent_sums(log, team, "last5"), [*team, "d"])
    cross = history.sums_by_day(log, ["t"], "d", {f"x_{c}": x for c, x in sums.items()})
    cross = cross.join(_recent_sums(log, ["t"], "x_last5"), ["t", "d"]).withColumn("rest", F.datediff("d", F.max("d").over(history.earlier_days(["t"], "d"))))
    sides = log.select("row_id", *team, "venue", "d")
    sides = history.join_back(history.join_back(sides, own, team, "d"), _recent_sums(log, [*team, "venue"], "venue"), [*team, "venue"], "d")
    sides = history.join_back(sides, cross, ["t"], "d").join(carryover(log).withColumnRenamed("rating", "carryover"), team, "left")
    rated = {"ppg": ("s_pts", "games"), "gf_rate": ("s_gf", "games"), "ga_rate": ("s_ga", "games"), "x_ppg": ("x_s_pts", "x_games"), "x_gf_rate": ("x_s_gf", "x_games"), "x_ga_rate": ("x_s_ga", "x_games"), "x_last5_ppg": ("x_last5_pts", "x_last5_n")}
    plain = {"pts": "s_pts", "gf": "s_gf", "ga": "s_ga"}
    value = lambda c: rate(F.col(rated[c][0]), F.col(rated[c][1])) if c in rated else F.col(plain.get(c, c))
    side = lambda c, venue: F.max(F.when(F.col("venue") == venue, value(c)))
    return sides.groupBy("row_id").agg(*[(side(c, "home") - side(c, "away")).alias(f"{c}_diff") for c in COMPARED])


def team_season_ppg(log: DataFrame) -> DataFrame:
    """(season, t, ppg): mean points a match of each team's season."""
    return log.groupBy("season", "t").agg((F.sum("pts") / F.count("*")).alias("ppg"))


def carryover(log: DataFrame, mode: str = "asof") -> DataFrame:
    """(season, t, rating) to start each season with: last season's points a match, drawn to the league mean.

    Teams without a last season start at the mean. mode "asof" takes the mean of the seasons
    before, "reference" that of all seasons, later ones included.
    """
    ppg = team_season_ppg(log)
    seasons = ppg.select("season").distinct()
    if mode == "reference":
        mean = seasons.join(F.broadcast(ppg.agg(F.avg("ppg").alias("league_mean"))))
    else:
        by = ppg.groupBy("season").agg(F.sum("ppg").alias("s"), F.count("*").alias("n")).toDF("earlier", "s", "n")
        mean = seasons.join(by, F.col("earlier") < F.col("season"), "left").groupBy("season").agg((F.sum("s") / F.sum("n")).alias("league_mean"))
    last = ppg.select((F.col("season") + 1).alias("season"), "t", F.col("ppg").alias("last_ppg"))
    rating = F.coalesce(F.col("last_ppg") * (1 - SHRINKAGE) + F.col("league_mean") * SHRINKAGE, F.col("league_mean"))
    return ppg.select("season", "t").join(last, ["season", "t"], "left").join(mean, "season").select("season", "t", rating.alias("rating"))


def target(matches: DataFrame, outcome: list[str], label: Column) -> DataFrame:
    """matches with Target and without the columns that tell the outcome."""
    return matches.withColumn("target", label).drop(*outcome)
