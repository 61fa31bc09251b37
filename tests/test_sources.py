from pyspark.sql import functions as F

from touchline.functions.classify import table_type
from touchline.sources import html

GROUPED = """<html><body><table><thead><tr><th></th><th></th><th colspan="2">Home</th><th colspan="2">Away</th></tr>
<tr><th>Rk</th><th>Squad</th><th>MP</th><th>Pts</th><th>MP</th><th>Pts</th></tr></thead>
<tbody><tr><th>1</th><td>Manchester City</td><td>19</td><td>47</td><td>19</td><td>46</td></tr>
<tr><td colspan="6"></td></tr><tr><td>2</td><td>Brighton &amp; Hove</td><td>3,420</td><td>+43</td><td></td><td>2–0</td></tr></tbody></table></body></html>"""
FIXTURES = """<table><tr><th>Date</th><th>Score</th></tr><tr><td>2021-08-13</td><td>2–0</td></tr></table><table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr><tr><td>c</td><td>d</td></tr></table>"""


def test_decode_chain():
    assert html.decode("é".encode()) == ("é", "utf-8")
    assert html.decode(b"\x93x") == ("“x", "cp1252")
    assert html.decode(b"\x81")[1] == "latin-1"


def test_grouped_headers_and_blanks(spark):
    df = spark.createDataFrame([("a", GROUPED), ("b", None), ("c", "no table <td>"), ("d", "")], "k string, html string")
    got = html.cells(df, "k", "html").cache()
    assert {r.k for r in got.collect()} == {"a"}
    assert got.filter("row_no = 0 and col_no = 2").first().header == ["Home", "MP"]
    assert got.filter("row_no = 0 and col_no = 0").first().header == ["Unnamed: 0_level_0", "Rk"]
    one = html.inspect(got, "k").withColumn("kind", table_type(F.col("paths"))).first()
    assert (one.n_rows, one.n_cols, one.levels, one.kind, one.empty_cells) == (3, 6, 2, "Home/Away", 7)
    wide = html.wide(got, "k", {("Unnamed: 1_level_0", "Squad"): "squad", ("Away", "Pts"): "pts"}).filter("squad is not null").orderBy("row_no").collect()
    assert [(r.squad, r.pts) for r in wide] == [("Manchester City", "46"), ("Brighton & Hove", "2–0")]


def test_selection_of_tables(spark):
    got = html.cells(spark.createDataFrame([("f", FIXTURES)], "k string, html string"), "k", "html")
    assert html.largest_tables(got, "k").first().table_no == 1
    assert html.tables_with(got, "k", ["date", "score"]).first().table_no == 0
    assert html.tables_with(got, "k", ["nothing"]).first().table_no == 1


def test_files_by_pattern_and_equal_content(spark, tmp_path):
    folder = tmp_path / "2021-2022 PL Season"
    folder.mkdir()
    for name in ("B.XLS", "a.xls", "c.txt"):
        (folder / name).write_text(GROUPED)
    found = html.files(spark, str(tmp_path))
    assert sorted((r.name, r.season) for r in found.collect()) == [("B.XLS", "2021-2022"), ("a.xls", "2021-2022")]
    made = html.inspect(html.cells(found, "path", "content"), "path")
    assert made.select("content_md5", "schema_signature").distinct().count() == 1
