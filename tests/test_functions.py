import pytest
from pyspark.sql import functions as F

from touchline.functions import classify, headers, parse


def values(spark, texts, expr):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()
    return [tuple(r.y) if r.y is not None and hasattr(r.y, "home") else r.y for r in rows]


SCORES = ["2–0", "2—0", "2-0", "2â€“0", "2 – 0", "2–", "2–0–1", "-1–2", "2.0–1", None, "", "x", "10–11"]


@pytest.mark.parametrize(
    ("variant", "want"),
    [
        (parse.parse_score, [(2, 0), (2, 0), (2, 0), None, (2, 0), None, None, None, (2, 1), None, None, None, (10, 11)]),
        (lambda c: parse.parse_score(c, decimals=False), [(2, 0), (2, 0), (2, 0), None, (2, 0), None, None, None, None, None, None, None, (10, 11)]),
        (lambda c: parse.parse_score(c, decimals=False, negatives=True), [(2, 0), (2, 0), (2, 0), None, (2, 0), None, None, (-1, 2), None, None, None, None, (10, 11)]),
        (parse.parse_score_lenient, [(2, 0), (2, 0), (2, 0), (2, 0), (2, 0), None, (2, 0), (1, 2), (0, 1), None, None, None, (10, 11)]),
        (parse.parse_score_digits, [(2, 0), (2, 0), (2, 0), (2, 0), (2, 0), None, (2, 0), (1, 2), (2, 0), None, None, None, (10, 11)]),
        (parse.parse_score_anchored, [(2, 0), (2, 0), (2, 0), (2, 0), (2, 0), None, None, None, None, None, None, None, (10, 11)]),
        (parse.parse_score_split, [(2, 0), (2, 0), (2, 0), None, (2, 0), None, (2, 0), None, (2, 1), None, None, None, (10, 11)]),
    ],
)
def test_score_variants(spark, variant, want):
    assert values(spark, SCORES, variant) == want


def test_strict_int_never_rounds(spark):
    assert values(spark, ["+73", "73", "73.0", "3,420", "1.5", "", "nan", "none", "abc", None, "-4"], parse.strict_int) == [73, 73, 73, 3420, None, None, None, None, None, None, -4]


def test_names_and_seasons(spark):
    assert values(spark, ["vs Arsenal", " vs  Arsenal", "Arsenal", "vsArsenal", None], parse.team_key) == ["Arsenal", "Arsenal", "Arsenal", "vsArsenal", None]
    assert values(spark, ["2021-2022 PL Season", "2021 - 2022", "none", None], parse.season_of) == ["2021-2022", "2021-2022", None, None]
    assert values(spark, ["  a   b ", "\ta"], parse.squash) == ["a b", "a"]


def test_result_and_points(spark):
    r = spark.createDataFrame([(2, 0), (0, 2), (1, 1), (None, 1)], "a int, b int").select(parse.result_label(F.col("a"), F.col("b")).alias("r"), parse.points(F.col("a"), F.col("b")).alias("p")).collect()
    assert [(x.r, x.p) for x in r] == [("H", 3), ("A", 0), ("D", 1), (None, None)]


def test_headers():
    c = ("Unnamed: 0_level_0", "Squad")
    assert headers.flatten_plain(c) == headers.flatten_named(c) == "Squad"
    assert headers.flatten_named(("Starts", "Starts")) == "Starts_Starts" and headers.flatten_distinct(("Starts", "Starts")) == "Starts"
    assert headers.flatten_named(("Unnamed: 1_level_0", "")) == "Unnamed: 1_level_0_"
    assert headers.clean_name(" # Pl  x_") == "#_Pl_x"
    assert headers.render_path(("Home", "MP")) == "Home | MP"
    assert headers.find_column(["Date ", "Home"], ["date"]) == "Date "
    assert headers.find_team_column([("A", "x"), c]) == c and headers.find_team_column(["x"]) is None
    assert headers.path_index([c, "Rk"]) == {c: 0, ("Rk",): 1}


def test_table_types(spark):
    tables = {
        "Home/Away": [["Rk"], ["Home", "MP"], ["Away", "MP"]],
        "Overall": [["Rk"], ["Attendance"], ["Top Team Scorer"], ["Pts"]],
        "Goalkeeping": [["Performance", "SoTA"], ["Performance", "Saves"], ["Performance", "CS"]],
        "Shooting": [["Standard", "Sh"], ["Standard", "SoT"], ["Standard", "G/Sh"]],
        "Standard": [["Performance", "Gls"], ["Per 90 Minutes", "Gls"]],
        "Playing Time": [["Subs", "Subs"], ["Team Success", "PPM"]],
        "Miscellaneous": [["Performance", "Fls"], ["Performance", "Crs"], ["Performance", "TklW"]],
        "UNKNOWN": [["Squad"]],
    }
    df = spark.createDataFrame(list(tables.items()), "want string, paths array<array<string>>")
    assert all(r.want == r.got for r in df.select("want", classify.table_type(F.col("paths")).alias("got")).collect())


def test_perspective_hint_and_slot(spark):
    df = spark.createDataFrame([("Overall", 0, 20), ("Shooting", 20, 20), ("Shooting", 0, 20), ("Shooting", 3, 20), ("UNKNOWN", 0, 20), ("Shooting", 0, 0)], "k string, p int, n int")
    side = classify.perspective(F.col("k"), F.col("p"), F.col("n"))
    assert [tuple(r) for r in df.select(side, classify.slot(F.col("k"), side)).collect()] == [("League", "Overall"), ("Opponent", "Shooting Opponent"), ("Squad", "Shooting Squad"), ("UNKNOWN", "UNKNOWN"), ("UNKNOWN", "UNKNOWN"), ("UNKNOWN", "UNKNOWN")]
    names = ["2026 Squad Shooting Opponent .xls", "Squad Sthooting.xls", "Overall.xls", "Home Away.xls", "Misc O.xls", "Playing Time S.xls", "x.xls", "Goalkeeping Opponet.xls"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(classify.name_hint(F.col("n")).alias("h")).collect()
    assert [(r.h.kind, r.h.side) for r in got] == [("Shooting", "Opponent"), ("Shooting", "Squad"), ("Overall", "League"), ("Home/Away", "League"), ("Miscellaneous", "Opponent"), ("Playing Time", "Squad"), ("UNKNOWN", "UNKNOWN"), ("Goalkeeping", "Opponent")]
