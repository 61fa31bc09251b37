"""The views that registered queries share, as DataFrames and as SQL.

ledger: one row a match from lineitem (no unique key). games: one row a match from orders, with a
unique row_id. teamlog: two rows a match. elog: one row an event, with a unique id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.parse import result_label
from touchline.operators.ledger import two_sided
from touchline.session import Tables


def ledger(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity", "l_linenumber")
    rows = li.join(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.filter("s_nationkey <> c_nationkey").select(
        F.year("o_orderdate").alias("season"),
        F.col("o_orderdate").cast("date").alias("d"),
        F.col("s_nationkey").alias("h"),
        F.col("c_nationkey").alias("a"),
        (F.col("l_quantity").cast("bigint") % 5).cast("int").alias("hg"),
        (F.col("l_linenumber") % 5).alias("ag"),
    )


def teamlog(t: Tables) -> DataFrame:
    return two_sided(ledger(t))


def games(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.col("o_orderkey").alias("row_id"),
        F.year("o_orderdate").alias("season"),
        F.col("o_orderdate").cast("date").alias("d"),
        (F.col("o_custkey") % 20).cast("int").alias("h"),
        (F.expr("o_custkey div 20") % 20).cast("int").alias("a"),
        (F.col("o_orderkey") % 5).cast("int").alias("hg"),
        (F.expr("o_orderkey div 5") % 4).cast("int").alias("ag"),
    )
    return rows.filter("h <> a")


def elog(t: Tables) -> DataFrame:
    e = t.events
    return e.select("event_id", F.col("user_id").alias("t"), F.col("ts").cast("date").alias("d"), F.col("event_type").alias("venue"), F.round(F.col("value") * 100).cast("bigint").alias("pts"), (F.col("event_id") % 5).cast("int").alias("gf"), (F.col("event_id") % 3).cast("int").alias("ga"))


def labelled(matches: DataFrame) -> DataFrame:
    return matches.withColumn("result", result_label(F.col("hg"), F.col("ag")))


LEDGER = """ledger AS (
  SELECT CAST(year(o_orderdate) AS INT) AS season, CAST(o_orderdate AS DATE) AS d, s_nationkey AS h, c_nationkey AS a,
         CAST(CAST(l_quantity AS BIGINT) % 5 AS INT) AS hg, CAST(l_linenumber % 5 AS INT) AS ag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE s_nationkey <> c_nationkey)"""
_PTS = "CASE WHEN {0} > {1} THEN 3 WHEN {0} = {1} THEN 1 ELSE 0 END"


def log_of(name: str, source: str, extra: str = "") -> str:
    return f"""{name} AS (
  SELECT {extra}season, d, h AS t, a AS opponent, 'home' AS venue, hg AS gf, ag AS ga, {_PTS.format("hg", "ag")} AS pts FROM {source}
  UNION ALL SELECT {extra}season, d, a, h, 'away', ag, hg, {_PTS.format("ag", "hg")} FROM {source})"""


TEAMLOG = f"{LEDGER}, {log_of('teamlog', 'ledger')}"
GAMES = """games AS (
  SELECT * FROM (SELECT o_orderkey AS row_id, CAST(year(o_orderdate) AS INT) AS season, CAST(o_orderdate AS DATE) AS d,
         CAST(o_custkey % 20 AS INT) AS h, CAST((o_custkey // 20) % 20 AS INT) AS a, CAST(o_orderkey % 5 AS INT) AS hg, CAST((o_orderkey // 5) % 4 AS INT) AS ag FROM orders)
  WHERE h <> a)"""
GAMELOG = f"{GAMES}, {log_of('gamelog', 'games')}"
ELOG = """elog AS (
  SELECT event_id, user_id AS t, CAST(ts AS DATE) AS d, event_type AS venue, CAST(round(value * 100) AS BIGINT) AS pts,
         CAST(event_id % 5 AS INT) AS gf, CAST(event_id % 3 AS INT) AS ga FROM events)"""
RESULT = "CASE WHEN hg > ag THEN 'H' WHEN hg < ag THEN 'A' ELSE 'D' END"
STRICT = "RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING"
