"""Audits that must find a fault when there is one, and readers that must survive one."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import checks, evaluate, features, frames, history, leakage, ledger, reconcile
from touchline.sources import html


@pytest.fixture(scope="module")
def matches(spark):
    rnd = random.Random(14)
    data = []
    for i in range(240):
        h, a = rnd.sample(range(6), 2)
        season = rnd.choice([2021, 2022, 2023])
        data.append((i, season, dt.date(season, 1, 1) + dt.timedelta(days=rnd.randrange(60)), h, a, rnd.randrange(4), rnd.randrange(4)))
    return spark.createDataFrame(data, "row_id long, season int, d date, h int, a int, hg int, ag int").cache()


def test_a_leaking_feature_table_fails(matches):
    log, keys = ledger.two_sided(matches, ["row_id"]), ["season", "t"]
    sound = features.probe(log, log)
    assert leakage.t2_strict(log, keys, table=sound).first().verdict == leakage.t8_behaviour(log, keys, table=sound).first().verdict == "PASS"
    one_more = sound.withColumn("mp", F.col("mp") + (F.col("row_id") == 7).cast("int"))  # a single row that knows one match too many
    assert leakage.t2_strict(log, keys, table=one_more).first().verdict == "FAIL"
    own_day = log.groupBy("season", "t", "d").agg(F.count("*").alias("mp"), F.sum("pts").alias("pts"))
    assert leakage.t8_behaviour(log, keys, table=own_day).first().verdict == "FAIL"
    whole = leakage.final_points(log).select("season", "t", "d", F.lit(0).alias("mp"), F.col("final_pts").alias("pts"))
    early = leakage.t8_totals(log, keys, table=whole).first()
    assert early.observed > 0.9 * early.tested and leakage.t8_totals(log, keys).first().observed < early.observed / 4
    assert leakage.t7_constant(leakage.final_points(log)).first().verdict == "LEAK DETECTED"
    assert leakage.t7_constant(sound, "pts").first().verdict == "PASS"


@pytest.mark.parametrize("broken", ["earlier_days"])
def test_the_windows_of_the_library_itself_are_audited(matches, monkeypatch, broken):
    """With history's own window letting the match's day in, T2 and T8 fail."""
    from pyspark.sql import Window

    log, keys = ledger.two_sided(matches), ["season", "t"]
    wrong = lambda keys, date: Window.partitionBy(*keys).orderBy(history._days(date)).rangeBetween(Window.unboundedPreceding, 0)
    monkeypatch.setattr(history, broken, wrong)
    assert leakage.t2_strict(log, keys).first().verdict == leakage.t8_behaviour(log, keys).first().verdict == "FAIL"


def test_a_random_split_fails_the_fold_audit(matches):
    sound = evaluate.fold_members(matches)
    assert all(tuple(r)[3:] == (True,) * 4 for r in evaluate.fold_audit(matches, sound).collect())
    assert tuple(evaluate.fold_partition(matches, sound).first())[1::2] == (0, 0)
    again = evaluate.fold_members(matches.repartition(7))
    assert sound.exceptAll(again).isEmpty() and again.exceptAll(sound).isEmpty()
    split = matches.select(F.lit(1).alias("fold"), F.when(F.col("row_id") % 4 == 0, "test").otherwise("train").alias("part"), "row_id")
    r = evaluate.fold_audit(matches, split).first()
    assert (r.ordered, r.apart, r.untouched, r.whole) == (False, True, False, False)
    both = split.unionByName(split.filter("row_id = 4").withColumn("part", F.lit("train")))
    assert evaluate.fold_audit(matches, both).first().apart is False


def test_merges_are_one_to_one(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, x string")
    right = spark.createDataFrame([(1, 5, "z"), (1, 6, "z"), (3, 7, "z")], "k int, y int, x string")
    other = spark.createDataFrame([(2, 8, 9)], "k int, y int, w int")
    assert {tuple(r) for r in frames.merge_one_to_one(left, right, "k", [F.col("y")]).collect()} == {(1, "a", 5), (2, "b", None), (None, "c", None)}
    chain = frames.merge_chain(left, [(right, [F.col("y")]), (other, [F.col("y")])], "k")
    assert chain.columns == ["k", "x", "y", "w"] and {tuple(r) for r in chain.collect()} == {(1, "a", 5, None), (2, "b", None, 9), (None, "c", None, None)}
    for twice in (left.union(left.limit(1)), left.union(left.filter("k is null"))):
        with pytest.raises(Exception, match="merge keys are not unique in left"):
            frames.merge_one_to_one(twice, right, "k", [F.col("y")]).collect()


def test_notes_stand_beside_a_mismatch(spark):
    left = spark.createDataFrame([("A", 10, 3), ("B", 4, 1), ("C", 5, 2)], "t string, pts int, gf int")
    right = spark.createDataFrame([("A", 2), ("B", 4), ("D", 5)], "t string, pts int")
    notes = spark.createDataFrame([("A", "8 points deducted"), ("D", "new")], "t string, note string")
    got = {(r.t, r.metric): (r.difference, r.status, r.note) for r in reconcile.reconcile_with_notes(left, right, ["t"], ["pts", "gf"], notes).collect()}
    lost = reconcile.NO_COLUMN.format("gf")
    assert got == {("A", "pts"): (8, "MISMATCH", "8 points deducted"), ("A", "gf"): (None, lost, "8 points deducted"), ("B", "pts"): (0, "MATCH", ""), ("B", "gf"): (None, lost, ""), ("C", "*"): (None, reconcile.ABSENT_RIGHT, ""), ("D", "*"): (None, reconcile.ABSENT_LEFT, "new")}


def test_broken_files_are_findings(spark, monkeypatch):
    table = "<table><tr><td colspan='²'>a</td><td colspan=2>b</td></tr></table>"
    rows = [(1, table.encode()), (2, None), (3, b"no table"), (4, "<table><tr><td>café</td></tr></table>".encode("cp1252")), (5, b"<table><tr><td>x</td></tr></table>\x81"), (6, b"<table><tr><td>boom</td></tr></table>")]
    df = spark.createDataFrame(rows, "k long, raw binary")
    got = {r.k: (r.encoding, r.flavour, r.error, r.n_tables, r.shapes) for r in html.scan(df, "k", "raw").collect()}
    assert got[1] == ("utf-8", "html.parser", None, 1, "1x3") and got[2] == (None, None, "no content", 0, "")
    assert got[3][2] == "no tables found" and got[4][0] == "cp1252" and got[5][0] == "latin-1"
    cells = html.cells(df, "k", "raw").collect()
    assert {r.k for r in cells} == {1, 4, 5, 6} and [r.value for r in cells if r.k == 4] == ["café"]

    def refuse(text):
        raise RuntimeError("boom") if "boom" in text else ValueError("other")

    monkeypatch.setattr(html, "parse", refuse)
    assert html.read(b"boom") == ([], None, "RuntimeError: boom")


def test_files_by_patterns_and_preference(spark, tmp_path):
    for name in ("A_x.xls", "Abx.xls", "100%.html", "1000.html", "PL a.xls", "b.XLS"):
        (tmp_path / name).write_bytes(b"x")
    names = lambda p: {r.name for r in html.files(spark, str(tmp_path), p).collect()}
    assert names("a_x.xls") == {"A_x.xls"} and names("100%.html") == {"100%.html"} and names(("*.html", "p?*.xls")) == {"100%.html", "1000.html", "PL a.xls"}
    found = spark.createDataFrame([("22", "b.xls"), ("22", "z pl.xls"), ("22", "y PL.xls"), ("23", "b.xls"), ("23", "a.xls")], "season string, name string")
    assert {tuple(r) for r in html.preferred(found, ["season"]).collect()} == {("22", "y PL.xls"), ("23", "a.xls")}


@pytest.mark.parametrize("stretch", [1, 3, 1 << 16])
def test_order_is_checked_across_stretches(spark, stretch):
    rnd = random.Random(5)
    rows = [(i % 3, i, None if i % 17 == 0 else dt.date(2022, 1, 1) + dt.timedelta(days=rnd.randrange(9))) for i in range(120)] + [(9, 1, dt.date(2022, 1, 1))]
    want = {}
    for g in (0, 1, 2, 9):
        own = [d for k, _, d in rows if k == g]
        breaks = sum(a is not None and b is not None and a > b for a, b in zip(own, own[1:], strict=False))
        want[g] = (len(own), breaks, len(own) > 1 and breaks == 0)
    df = spark.createDataFrame(rows, "g int, p long, d date")
    assert {r.g: (r.n, r.breaks, r.chronological) for r in checks.out_of_order(df, ["g"], "p", "d", stretch).collect()} == want


def test_positions_within_groups_put_nulls_last(spark):
    df = spark.createDataFrame([(1, None, 5), (1, 3, 4), (1, 3, 2), (2, 1, 1), (None, 2, 7), (None, 1, 9)], "g int, a int, b int")
    got = {(r.g, r.b): r.position for r in leakage.numbered(df, ["a"], ["b"], ["g"]).collect()}
    assert got == {(1, 2): 0, (1, 4): 1, (1, 5): 2, (2, 1): 0, (None, 9): 0, (None, 7): 1}


def test_final_tables_names_and_scores_within_text(spark, tmp_path):
    from touchline.functions import parse
    from touchline.sources import sinks

    rows = [("22", "b.xls", "Overall", 0, " A ", "3.0", "x"), ("22", "b.xls", "Overall", 1, "A", "4", "7"), ("22", "b.xls", "Overall", 2, None, "9", "9"), ("22", "c.xls", "Overall", 0, "A", "1", "1"), ("22", "a.xls", "Standard", 0, "A", "0", "0"), ("23", "a.xls", "Overall", 0, "B", "-2.7", "inf")]
    df = spark.createDataFrame(rows, "season string, name string, kind string, row_no int, team string, Pts string, GF string")
    got = html.final_tables(df, ["Pts", "GF", "Rk"])
    assert {tuple(r) for r in got.collect()} == {("22", "b.xls", "A", 4, 7, None), ("23", "a.xls", "B", -2, None, None)}
    assert {r.stem for r in html.stems(df).collect()} == {"a", "b", "c"}
    assert html.register({" PL 22 Overall ": got, "PL-22 overall": got}) == {"PL 22 Overall": "pl_22_overall", "PL-22 overall": "pl_22_overall_"}
    assert spark.table("pl_22_overall").count() == 2
    texts = ["won 3 – 1 at home", "2â€“0 (aet)", "4—4", "no score", None, "10-2-1"]
    scores = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", parse.parse_score_within(F.col("t")).alias("s")).orderBy("i").collect()
    assert [None if r.s is None else tuple(r.s) for r in scores] == [(3, 1), (2, 0), (4, 4), None, None, (10, 2)]
    sinks.write_curated(got, str(tmp_path / "curated"))
    back = spark.read.parquet(str(tmp_path / "curated"))
    assert back.count() == 2 and (tmp_path / "curated" / "season=22").is_dir() and set(back.columns) == set(got.columns)
