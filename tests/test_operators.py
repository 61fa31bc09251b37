import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import checks, evaluate, features, frames, history, leakage, ledger, reconcile
from touchline.sources import sinks

DAY = dt.date(2022, 1, 1)


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def matches(spark):
    rnd = random.Random(4)
    data = []
    for i in range(240):
        h, a = rnd.sample(range(6), 2)
        season = rnd.choice([2021, 2022, 2023])
        data.append((i, season, dt.date(season, 1, 1) + dt.timedelta(days=rnd.randrange(60)), h, a, rnd.randrange(4), rnd.randrange(4)))
    return spark.createDataFrame(data, "row_id long, season int, d date, h int, a int, hg int, ag int").cache()


def test_league_table_balances(matches):
    table = ledger.league_table(ledger.two_sided(matches)).toPandas()
    assert table.mp.sum() == 480 and (table.w + table.dr + table.l == table.mp).all() and table.gd.sum() == 0
    assert (table.pts == 3 * table.w + table.dr).all()
    venue = ledger.venue_table(ledger.two_sided(matches)).toPandas().merge(table, on=["season", "t"])
    assert (venue.home_pts + venue.away_pts == venue.pts).all() and (venue.home_gd + venue.away_gd == venue.gd).all()


def test_strict_history_equals_self_join(matches):
    log = ledger.two_sided(matches, ["row_id"])
    got = {(r.row_id, r.t): (r.n, r.p) for r in history.strict_sums(log, ["season", "t"], "d", {"n": F.lit(1), "p": F.col("pts")}).collect()}
    data = log.collect()
    for x in data:
        past = [y for y in data if y.season == x.season and y.t == x.t and y.d < x.d]
        assert got[(x.row_id, x.t)] == (len(past), sum(y.pts for y in past))


def test_last_five_and_previous(matches):
    log = ledger.two_sided(matches, ["row_id"])
    got = {(r.row_id, r.t): r for r in history.previous_value(history.last_n(log, ["season", "t"], "d", "row_id", ["pts"]), ["season", "t"], "d", "row_id", "pts", "prev").collect()}
    rest = {(r.row_id, r.t): r.rest_days for r in history.rest_days(log, ["season", "t"], "d").collect()}
    data = log.collect()
    for x in data:
        past = sorted((y.d, y.row_id, y.pts) for y in data if y.season == x.season and y.t == x.t and y.d < x.d)
        r = got[(x.row_id, x.t)]
        assert [e.pts for e in (r.recent or [])] == [p for _, _, p in past[-5:]]
        assert r.prev == (past[-1][2] if past else None)
        assert rest[(x.row_id, x.t)] == ((x.d - past[-1][0]).days if past else None)


def test_two_rows_of_a_day_do_not_see_each_other(spark):
    log = rows(spark, [(1, DAY, 3), (1, DAY, 1), (1, DAY + dt.timedelta(1), 0)], "t int, d date, pts int")
    got = history.strict_sums(log, ["t"], "d", {"p": F.col("pts")}).orderBy("d", "pts").collect()
    assert [r.p for r in got] == [0, 0, 4]
    assert history.strict_sums(log, ["t"], "d", {"p": F.col("pts")}, empty=None).filter("p is null").count() == 2


def test_leakage_tests_and_their_negative_controls(matches):
    log, keys = ledger.two_sided(matches), ["season", "t"]
    assert leakage.t2_strict(log, keys).first().verdict == "PASS"
    assert leakage.t2_strict(log, keys, same_day=True).first().verdict == "FAIL"
    sample = leakage.stride_sample(matches, 20)
    assert sample.count() == 20
    assert leakage.t9_perturbation(matches, sample).first().observed == 0
    control = leakage.t9_perturbation(matches, sample, same_day=True).first()
    assert control.verdict == "FAIL" and control.observed > 0
    assert leakage.t6_availability(matches).first().verdict == "LEAK DETECTED" == leakage.t7_constant(log).first().verdict
    assert leakage.t8_behaviour(log, keys).first().verdict == "PASS" == leakage.t1_dated(matches).first().verdict
    one = matches.groupBy("season").count().collect()
    assert leakage.t5_future_pairs(matches).first().observed < sum(r["count"] ** 2 for r in one) / 2


@pytest.mark.parametrize("leak", ["sums_by_day", "recent_by_day"])
def test_perturbation_finds_a_leak_in_the_library_itself(matches, monkeypatch, leak):
    """A history that sees its own day, in the sums or in the last matches alone, fails T9."""
    sample = leakage.stride_sample(matches, 5)
    assert leakage.t9_perturbation(matches, sample).first().verdict == "PASS"
    kept = history.recent_by_day

    def sums(rows, keys, date, made, empty=0):
        return rows.groupBy(*keys, date).agg(*[F.sum(c).alias(n) for n, c in made.items()])

    def recent(rows, keys, date, tie, values, n=5):
        own = rows.groupBy(*keys, date).agg(F.collect_list(F.struct(date, tie, *values)).alias("own"))
        return kept(rows, keys, date, tie, values, n).join(own, [*keys, date]).select(*keys, date, F.concat("recent", "own").alias("recent"))

    monkeypatch.setattr(history, leak, {"sums_by_day": sums, "recent_by_day": recent}[leak])
    assert leakage.t9_perturbation(matches, sample).first().verdict == "FAIL"


def test_empty_tables_give_defined_verdicts(matches):
    none = matches.filter("false")
    assert [tuple(r) for r in leakage.t1_dated(none).collect()] == [("T1", 0, 0, "PASS")]
    assert checks.overall(none.select(F.lit("PASS").alias("status"))).first().verdict == "FAIL"


def test_registry(spark):
    assert tuple(leakage.registry_summary(spark).first()) == (40, 19, 19, 1)


def test_reconcile_four_statuses(spark):
    left = rows(spark, [("s", "A", 3, 1), ("s", "B", 4, None), ("s", "C", 5, 2)], "season string, t string, pts int, gf int")
    right = rows(spark, [("s", "A", 3, 2), ("s", "B", 4, 1), ("s", "D", 5, 2)], "season string, t string, pts int, gf int")
    got = {(r.t, r.metric): r.status for r in reconcile.reconcile(left, right, ["season", "t"], ["pts", "gf"]).collect()}
    assert got == {("A", "pts"): "MATCH", ("A", "gf"): "MISMATCH", ("B", "pts"): "MATCH", ("B", "gf"): "UNKNOWN", ("C", "*"): reconcile.ABSENT_RIGHT, ("D", "*"): reconcile.ABSENT_LEFT}


def test_carryover_modes(spark):
    log = rows(spark, [(1, "A", 3), (1, "B", 1), (2, "A", 0), (2, "C", 3)], "season int, t string, pts int")
    asof = {(r.season, r.t): r.rating for r in features.carryover(log).collect()}
    assert asof == {(1, "A"): None, (1, "B"): None, (2, "A"): 3 * 0.75 + 2 * 0.25, (2, "C"): 2.0}
    ref = {(r.season, r.t): r.rating for r in features.carryover(log, "reference").collect()}
    assert ref[(1, "A")] == 7 / 4 and ref[(2, "A")] == 3 * 0.75 + 7 / 4 * 0.25


def test_coverage_and_pick(spark):
    found = rows(spark, [("22", "X", "m1", "a"), ("22", "X", "m1", "b"), ("22", "Y", "m2", "c"), ("23", "X", "m3", "d"), ("23", "X", "m4", "e")], "season string, slot string, md5 string, name string")
    got = {(r.season, r.slot): r.status for r in checks.coverage(found, "season", "slot", "md5", ["X", "Y"]).collect()}
    assert got == {("22", "X"): "DUPLICATE", ("22", "Y"): "PASS", ("23", "X"): "UNKNOWN", ("23", "Y"): "MISSING"}
    picked = {r.season: (r.picked, r.note) for r in checks.pick_by_type(found.filter("slot = 'X'"), "season", "md5", "name").collect()}
    assert picked == {"22": ("a", "identical copies"), "23": (None, "refused: different tables")}


def test_integrity_mismatch_is_not_blocking(spark):
    t = rows(spark, [("a", 20, 20, 0, "Shooting", "Opponent", "Goalkeeping", "Opponent"), ("b", 19, 19, 1, "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN")], "n string, n_rows int, n_teams int, missing_teams int, kind string, side string, hint_kind string, hint_side string")
    got = {r.n: (r.status, r.name_mismatch) for r in checks.integrity(t).collect()}
    assert got == {"a": ("PASS", True), "b": ("FAIL", False)}


def test_chronology(spark):
    df = rows(spark, [("a", 1, DAY), ("a", 2, DAY), ("b", 1, DAY), ("b", 2, DAY - dt.timedelta(1)), ("c", 1, DAY)], "g string, pos int, d date")
    assert {r.g: r.chronological for r in checks.out_of_order(df, ["g"], "pos", "d").collect()} == {"a": True, "b": False, "c": False}


def test_frames(spark):
    df = rows(spark, [(1, "a"), (1, "b"), (2, None), (2, None)], "k int, v string")
    assert {(r.k, r.v) for r in frames.dedupe_first(df, ["k"], [F.col("v").desc_nulls_last()]).collect()} == {(1, "b"), (2, None)}
    assert frames.flag_repeats(df, ["k", "v"]).count() == 2
    assert [tuple(r) for r in frames.missing_report(df, ["k", "v"]).collect()] == [("v", 2)]
    assert frames.any_missing(df, ["v"]).count() == 2
    assert {(r.value, r.n, r.share) for r in frames.value_counts(df, "v").collect()} == {("a", 1, 0.5), ("b", 1, 0.5)}
    one, two = (frames.content_fingerprint(x, [], F.coalesce("v", F.lit(""))).first() for x in (df, df.orderBy(F.col("v").desc())))
    assert one == two
    assert df.filter(frames.is_close(F.lit(1.0), F.lit(1.0000001))).count() == 4


LABELS = list("HDAHDA")


def scored(spark, probs):
    return spark.createDataFrame([(0, c, *map(float, p)) for c, p in zip(LABELS, probs, strict=True)], "g int, result string, p_h double, p_d double, p_a double")


def test_metrics_closed_forms(spark):
    hot = {"H": (1, 0, 0), "D": (0, 1, 0), "A": (0, 0, 1)}
    perfect = evaluate.metrics(scored(spark, [hot[c] for c in LABELS]), ["g"]).first()
    assert (perfect.accuracy, perfect.balanced_accuracy, perfect.macro_f1, perfect.brier_score, perfect.rps) == (1, 1, 1, 0, 0) and perfect.log_loss < 1e-9
    uniform = evaluate.metrics(scored(spark, [(1 / 3,) * 3] * 6), ["g"]).first()
    assert uniform.log_loss == pytest.approx(1.0986122886) and uniform.brier_score == pytest.approx(2 / 3)
    constant = evaluate.metrics(scored(spark, [(0.8, 0.1, 0.1)] * 6), ["g"]).first()
    assert constant.balanced_accuracy == pytest.approx(1 / 3) and constant.macro_f1 == pytest.approx(1 / 6)


@pytest.mark.parametrize(("bad", "n"), [((-0.1, 0.6, 0.5), 6), ((1.4, 0.3, 0.3), 6), ((0.3,) * 3, 6), ((0.4,) * 3, 6), ((float("nan"), 0.5, 0.5), 6), ((1 / 3,) * 3, 7)])
def test_probabilities_are_refused_not_repaired(spark, bad, n):
    with pytest.raises(evaluate.ProbabilityError):
        evaluate.validate(scored(spark, [bad] * 6), n)


def test_probabilities_accepted(spark):
    good = scored(spark, [(1 / 3,) * 3] * 6)
    assert evaluate.validate(good, 6) is good
    with pytest.raises(evaluate.ProbabilityError):
        evaluate.validate(good.drop("p_a"))


def test_folds_expand(matches):
    got = {r.fold: (r.test_season, r.train_seasons) for r in evaluate.folds(matches).collect()}
    assert got == {1: (2022, [2021]), 2: (2023, [2021, 2022])}
    assert all(r.ordered and r.overlap == 0 for r in evaluate.fold_checks(matches).collect())
    assert sum(r.test_rows for r in evaluate.membership(matches).collect()) == matches.filter("season > 2021").count()


def test_share_model_uses_earlier_seasons_only(matches):
    labelled = matches.withColumn("result", F.lit("H"))
    p = evaluate.share_model(labelled).filter("season = 2022").select("h", "p_h").distinct().collect()
    n = {r.h: r["count"] for r in matches.filter("season = 2021").groupBy("h").count().collect()}
    assert all(r.p_h == pytest.approx((n.get(r.h, 0) + 1) / (n.get(r.h, 0) + 3)) for r in p)


def test_sinks(spark, tmp_path):
    df = rows(spark, [(i, f"t{i}") for i in range(20)], "i int, t string")
    sinks.write_csv(df, str(tmp_path / "x"), ["t", "i"])
    assert spark.read.option("header", True).csv(str(tmp_path / "x")).columns == ["t", "i"]
    assert sinks.listing(df.orderBy("i"), 3)[-1] == "... and 17 more" and '"i": 0' in sinks.specification(df.orderBy("i"))
    assert [sinks.exit_code(x) for x in ("PASS", "FAIL", "?")] == [0, 2, 1]
