"""Evaluation: expanding-window folds, the probability contract and proper scores."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Class order, tolerance of a row's sum and the least probability in the log loss.
CLASSES = ("H", "D", "A")
TOLERANCE = 1e-6
EPSILON = 1e-15
P = ("p_h", "p_d", "p_a")


class ProbabilityError(ValueError):
    """Probabilities that break the contract. They are refused, never repaired."""


class Model(Protocol):
    """Adds p_h, p_d, p_a to the rows of a test fold."""

    def predict_proba(self, train: DataFrame, test: DataFrame) -> DataFrame: ...


def folds(matches: DataFrame, season: str = "season") -> DataFrame:
    """(fold, test_season, train_seasons): every season but the first is tested on all before it."""
    seasons = matches.select(F.col(season).alias("test_season")).distinct()
    earlier = seasons.select(F.col("test_season").alias("s"))
    pairs = seasons.join(earlier, F.col("s") < F.col("test_season"))
    out = pairs.groupBy("test_season").agg(F.sort_array(F.collect_list("s")).alias("train_seasons"))
    return out.select(F.size("train_seasons").alias("fold"), "test_season", "train_seasons")


def membership(matches: DataFrame, season: str = "season") -> DataFrame:
    """(fold, test_season, train_rows, test_rows)."""
    sizes = matches.groupBy(F.col(season).alias("s")).agg(F.count("*").alias("n"))
    f = folds(matches, season)
    train = f.withColumn("s", F.explode("train_seasons")).join(sizes, "s").groupBy("fold", "test_season").agg(F.sum("n").alias("train_rows"))
    return train.join(sizes.withColumnsRenamed({"s": "test_season", "n": "test_rows"}), "test_season").select("fold", "test_season", "train_rows", "test_rows")


def fold_checks(matches: DataFrame) -> DataFrame:
    """(fold, test_season, gap_days, ordered, overlap, whole): folds against the rules of time."""
    span = matches.groupBy("season").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count("*").alias("n"))
    f = folds(matches)
    train = f.withColumn("season", F.explode("train_seasons")).join(span, "season").groupBy("fold", "test_season").agg(F.max("last").alias("train_last"), F.count_if(F.col("season") == F.col("test_season")).alias("overlap"))
    out = train.join(span.withColumnRenamed("season", "test_season"), "test_season")
    return out.select("fold", "test_season", F.datediff("first", "train_last").cast("bigint").alias("gap_days"), (F.col("train_last") < F.col("first")).alias("ordered"), "overlap", F.col("n").alias("test_rows"))


def fold_members(matches: DataFrame, id_col: str = "row_id", season: str = "season") -> DataFrame:
    """(fold, part, id): the matches of each fold, part "train" or "test"."""
    f = folds(matches, season)
    of = f.select("fold", F.explode("train_seasons").alias(season), F.lit("train").alias("part")).unionByName(f.select("fold", F.col("test_season").alias(season), F.lit("test").alias("part")))
    return matches.select(id_col, season).join(of, season).select("fold", "part", id_col)


def fold_audit(matches: DataFrame, members: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(fold, train_rows, test_rows, ordered, apart, untouched, whole): any division into folds against the rules of time.

    ordered: all of train is dated before all of test; apart: no match is in both; untouched: no match of a test season is
    in train; whole: the test seasons are complete. A rule that cannot be told (no dates, one part missing) is broken.
    """
    rows = members.join(matches.select(id_col, "season", "d"), id_col)
    test, train = F.col("part") == "test", F.col("part") == "train"
    per_id = rows.groupBy("fold", id_col).agg((F.bool_or(test) & F.bool_or(train)).alias("both"))
    both = per_id.groupBy("fold").agg(F.bool_or("both").alias("_both"))
    totals = matches.groupBy("season").agg(F.count_distinct(id_col).alias("_all"))
    seasons = rows.groupBy("fold", "season").agg(F.count_if(train).alias("train_rows"), F.count_if(test).alias("test_rows"), F.max(F.when(train, F.col("d"))).alias("last"), F.min(F.when(test, F.col("d"))).alias("first"), F.count_distinct(F.when(test, F.col(id_col))).alias("_test"))
    seasons = seasons.join(totals, "season")
    out = seasons.groupBy("fold").agg(
        F.sum("train_rows").alias("train_rows"), F.sum("test_rows").alias("test_rows"), F.coalesce(F.max("last") < F.min("first"), F.lit(False)).alias("ordered"),
        (~F.bool_or((F.col("train_rows") > 0) & (F.col("test_rows") > 0))).alias("untouched"), F.bool_and((F.col("_test") == 0) | (F.col("_test") == F.col("_all"))).alias("whole"),
    )
    return out.join(both, "fold").select("fold", "train_rows", "test_rows", "ordered", (~F.col("_both")).alias("apart"), "untouched", "whole")


def fold_partition(matches: DataFrame, members: DataFrame, id_col: str = "row_id") -> DataFrame:
    """One row (once, more, never, never_later): how often matches are tested, and how many untested ones are not of the first season."""
    tested = members.filter("part = 'test'").groupBy(id_col).agg(F.count("*").alias("n"))
    first = matches.agg(F.min("season").alias("_first"))
    rows = matches.select(id_col, "season").join(tested, id_col, "left").join(F.broadcast(first))
    return rows.agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") > 1).alias("more"), F.count_if(F.col("n").isNull()).alias("never"), F.count_if(F.col("n").isNull() & (F.col("season") > F.col("_first"))).alias("never_later"))


def violation(p: tuple[str, ...] = P) -> Column:
    """The first rule that a row breaks (finite, not negative, not above 1, sums to 1), or null."""
    cols = [F.col(c).cast("double") for c in p]
    any_of = lambda test: reduce(lambda a, b: a | b, [test(c) for c in cols])
    total = reduce(lambda a, b: a + b, cols)
    return (
        F.when(any_of(lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), "not finite")
        .when(any_of(lambda c: c < 0), "negative")
        .when(any_of(lambda c: c > 1), "above one")
        .when(F.abs(total - 1) > TOLERANCE, "sum")
    )


def validate(proba: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """proba itself, or ProbabilityError. Columns are checked first, then the number of rows, then the values."""
    missing = [c for c in P if c not in proba.columns]
    if missing:
        raise ProbabilityError(f"columns missing: {missing}")
    found = proba.agg(F.count("*").alias("n"), F.min(violation()).alias("first")).first()
    if expected_rows is not None and found["n"] != expected_rows:
        raise ProbabilityError(f"{found['n']} rows for {expected_rows} matches")
    if found["first"] is not None:
        raise ProbabilityError(f"rows break a rule: {found['first']}")
    return proba


def predicted() -> Column:
    """The most likely class; the first of equals in the order of CLASSES."""
    p = F.array(*P)
    return F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position(p, F.array_max(p)).cast("int"))


def _one_hot(label: str) -> list[Column]:
    return [F.when(F.col(label) == c, 1.0).otherwise(0.0) for c in CLASSES]


def row_scores(df: DataFrame, label: str = "result") -> DataFrame:
    """df with pred, log_loss, brier and rps of each row."""
    hot = _one_hot(label)
    own = reduce(lambda a, b: a + b, [F.col(p) * h for p, h in zip(P, hot, strict=True)])
    brier = reduce(lambda a, b: a + b, [F.pow(F.col(p) - h, F.lit(2.0)) for p, h in zip(P, hot, strict=True)])
    steps = [F.pow(F.col(P[0]) - hot[0], F.lit(2.0)), F.pow(F.col(P[0]) + F.col(P[1]) - hot[0] - hot[1], F.lit(2.0))]
    return df.withColumns({"pred": predicted(), "log_loss": -F.log(F.least(F.greatest(own, F.lit(EPSILON)), F.lit(1.0))), "brier": brier, "rps": (steps[0] + steps[1]) / 2})


def metrics(df: DataFrame, by: list[str], label: str = "result") -> DataFrame:
    """(by, n, accuracy, balanced_accuracy, macro_f1, log_loss, brier_score, rps) in one aggregation.

    Balanced accuracy averages over the classes that occur; F1 over all three, 0 where undefined.
    """
    hit = F.col("pred") == F.col(label)
    parts = []
    for c in CLASSES:
        parts += [F.count_if(hit & (F.col(label) == c)).alias(f"tp_{c}"), F.count_if(F.col(label) == c).alias(f"true_{c}"), F.count_if(F.col("pred") == c).alias(f"pred_{c}")]
    g = row_scores(df, label).groupBy(*by).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("accuracy"), *[F.avg(m).alias(a) for m, a in (("log_loss", "log_loss"), ("brier", "brier_score"), ("rps", "rps"))], *parts)
    recalls = [F.when(F.col(f"true_{c}") > 0, F.col(f"tp_{c}") / F.col(f"true_{c}")) for c in CLASSES]
    present = reduce(lambda a, b: a + b, [(F.col(f"true_{c}") > 0).cast("int") for c in CLASSES])
    balanced = F.when(present > 0, reduce(lambda a, b: a + b, [F.coalesce(r, F.lit(0.0)) for r in recalls]) / present)
    f1 = reduce(lambda a, b: a + b, [F.when(F.col(f"true_{c}") + F.col(f"pred_{c}") > 0, 2 * F.col(f"tp_{c}") / (F.col(f"true_{c}") + F.col(f"pred_{c}"))).otherwise(0.0) for c in CLASSES]) / 3
    return g.select(*by, "n", "accuracy", balanced.alias("balanced_accuracy"), f1.alias("macro_f1"), "log_loss", "brier_score", "rps")


def share_model(matches: DataFrame, team: str = "h", season: str = "season", label: str = "result") -> DataFrame:
    """Test rows of every fold with smoothed training shares of the home team as probabilities."""
    by = matches.groupBy(team, season).agg(*[F.count_if(F.col(label) == c).alias(f"n_{c}") for c in CLASSES], F.count("*").alias("n"))
    # shares over all earlier seasons: a strict running sum over the (team, season) counts that occur
    w = Window.partitionBy(team).orderBy(season).rangeBetween(Window.unboundedPreceding, -1)
    prior = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    shares = by.select(team, season, *[((prior(f"n_{c}") + 1) / (prior("n") + 3)).alias(p) for c, p in zip(CLASSES, P, strict=True)])
    first = by.agg(F.min(season).alias("_first"))
    return matches.join(shares, [team, season]).join(F.broadcast(first)).filter(F.col(season) > F.col("_first")).drop("_first")
