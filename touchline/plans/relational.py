"""Scans, scalar functions, filters, projections, joins, aggregates, sets and sorts on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import classify, parse
from touchline.operators import checks, features, frames, history, leakage, ledger, reconcile
from touchline.plans import views as v
from touchline.session import Tables
from touchline.sources import html

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- scan and text -----------------------------------------------------------------------------------


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS n_cells FROM pages WHERE html LIKE '%<li>%'")
def scan_html_cells(t: Tables) -> DataFrame:
    """The table reader on list items dressed as one-cell tables (the pages hold no tables)."""
    dressed = t.pages.select("page_id", F.replace(F.replace("html", F.lit("<li>"), F.lit("<table><tr><td>")), F.lit("</li>"), F.lit("</td></tr></table>")).alias("html"))
    return html.cells(dressed, "page_id", "html").groupBy("page_id").agg(F.count("*").alias("n_cells"))


@query("""
WITH r AS (SELECT lang, md5(concat_ws('|', CAST(doc_id AS VARCHAR), coalesce(text, ''))) AS h FROM documents)
SELECT lang, count(*) AS n_rows, md5(CAST(sum(CAST('0x' || substr(h, 1, 13) AS HUGEINT)) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(h, 14, 13) AS HUGEINT)) AS VARCHAR)) AS fingerprint
FROM r GROUP BY lang""")
def content_fingerprint(t: Tables) -> DataFrame:
    row = F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))
    return frames.content_fingerprint(t.documents, ["lang"], row)


@query("""
SELECT md5(text) AS content, count(*) AS n, count(DISTINCT source) AS n_groups, CASE WHEN count(DISTINCT source) > 1 THEN 'across' ELSE 'within' END AS scope
FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_content(t: Tables) -> DataFrame:
    return checks.duplicate_content(t.documents.select("source", F.md5(F.col("text").cast("binary")).alias("content")), "content", "source")


@query("""
SELECT source, count(*) AS n_files, count(DISTINCT md5(text)) AS n_contents, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes, count(*) FILTER (WHERE text IS NULL OR text = '') AS n_empty,
       min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY source""")
def source_inventory(t: Tables) -> DataFrame:
    d = t.documents
    return d.groupBy("source").agg(
        F.count("*").alias("n_files"), F.count_distinct(F.md5(F.col("text").cast("binary"))).alias("n_contents"), F.sum(F.octet_length("text")).alias("n_bytes"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("n_empty"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    )


@query("""
WITH x AS (SELECT page_id, replace(replace(html, '<li>', '<table><tr><td>'), '</li>', '</td></tr></table>') AS html FROM pages)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, CAST(NULL AS VARCHAR) AS encoding, CASE WHEN html LIKE '%<table>%' THEN 'html.parser' END AS flavour,
       CASE WHEN html IS NULL THEN 'no content' WHEN html NOT LIKE '%<table>%' THEN 'no tables found' END AS error, CAST(coalesce(len(regexp_extract_all(html, '<table>')), 0) AS INTEGER) AS n_tables FROM x""")
def scan_status(t: Tables) -> DataFrame:
    """How every page was read, on list items dressed as one-cell tables (the pages hold no tables)."""
    dressed = t.pages.select("page_id", F.replace(F.replace("html", F.lit("<li>"), F.lit("<table><tr><td>")), F.lit("</li>"), F.lit("</td></tr></table>")).alias("html"))
    return html.scan(dressed, "page_id", "html").drop("shapes")


# -- classification ----------------------------------------------------------------------------------


@query("""
SELECT p_partkey, CASE WHEN list_contains(w, 'small') AND list_contains(w, 'ring') THEN 'small ring' WHEN list_contains(w, 'widget') THEN 'widget'
       WHEN list_contains(w, 'red') OR list_contains(w, 'blue') THEN 'coloured' ELSE 'UNKNOWN' END AS kind FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""")
def rule_classifier(t: Tables) -> DataFrame:
    w = F.split("p_name", " ")
    has = lambda *x: F.size(F.array_except(F.array(*map(F.lit, x)), w)) == 0
    return t.part.select("p_partkey", classify.first_rule([(has("small", "ring"), "small ring"), (has("widget"), "widget"), (has("red") | has("blue"), "coloured")]).alias("kind"))


@query("""
WITH n AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS host FROM pages)
SELECT page_id, CASE WHEN contains(host, 'blog') THEN 'blog' WHEN starts_with(host, 'm.') THEN 'mobile' WHEN starts_with(host, 'www.') THEN 'www' ELSE 'UNKNOWN' END AS kind,
       NOT (contains(host, 'blog') AND ends_with(host, '.com')) AS mismatch FROM n""")
def keyword_router(t: Tables) -> DataFrame:
    host = F.lower(F.regexp_extract("url", "^https?://([^/]+)", 1))
    kind = classify.first_rule([(host.contains("blog"), "blog"), (host.startswith("m."), "mobile"), (host.startswith("www."), "www")])
    expected = F.struct(F.lit("blog"), F.lit(True))
    return t.pages.select("page_id", kind.alias("kind"), (~F.struct(kind, host.endswith(".com")).eqNullSafe(expected)).alias("mismatch"))


@query("""
SELECT source, CASE WHEN count(*) FILTER (WHERE lang = 'en') = count(lang) THEN 'all' WHEN count(*) FILTER (WHERE lang = 'en') = 0 THEN 'none' ELSE 'mixed' END AS kind FROM documents GROUP BY source""")
def all_none_mixed(t: Tables) -> DataFrame:
    g = t.documents.groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("hit"), F.count("lang").alias("n"))
    return g.select("source", classify.first_rule([(F.col("hit") == F.col("n"), "all"), (F.col("hit") == 0, "none")], "mixed").alias("kind"))


@query("""
SELECT lang, n, CASE WHEN kinds = 1 THEN f END AS picked, CASE WHEN n = 1 THEN '' WHEN kinds = 1 THEN 'identical copies' ELSE 'refused: different tables' END AS note
FROM (SELECT md5(text) AS lang, count(*) AS n, count(DISTINCT source) AS kinds, min(doc_id) AS f FROM documents GROUP BY 1)""")
def classify_and_pick(t: Tables) -> DataFrame:
    return checks.pick_by_type(t.documents.select(F.md5(F.col("text").cast("binary")).alias("lang"), "source", "doc_id"), "lang", "source", "doc_id")


@query("""
SELECT event_type, 'SIG-' || dense_rank() OVER (ORDER BY f) AS label, n FROM (SELECT event_type, min(event_id) AS f, count(*) AS n FROM events GROUP BY 1)""")
def first_appearance_label(t: Tables) -> DataFrame:
    """Labels in order of first appearance. Only the distinct values, one row each, are ranked."""
    first = t.events.groupBy("event_type").agg(F.min("event_id").alias("f"), F.count("*").alias("n"))
    from pyspark.sql import Window

    return first.select("event_type", F.concat(F.lit("SIG-"), F.dense_rank().over(Window.orderBy("f")).cast("string")).alias("label"), "n")


# -- scalar functions ----------------------------------------------------------------------------------

_SCORE = "CASE season % 4 WHEN 0 THEN hg || '–' || ag WHEN 1 THEN hg || '-' || ag WHEN 2 THEN hg || ' — ' || ag ELSE 'x' || hg END"


@query(f"""
WITH {v.LEDGER}, s AS (SELECT {_SCORE} AS score FROM ledger)
SELECT score, TRY_CAST(nullif(regexp_extract(score, '^\\s*(\\d+)\\s*[–—-]\\s*(\\d+)\\s*$', 1), '') AS INT) AS home, TRY_CAST(nullif(regexp_extract(score, '^\\s*(\\d+)\\s*[–—-]\\s*(\\d+)\\s*$', 2), '') AS INT) AS away, count(*) AS n
FROM s GROUP BY 1, 2, 3""")
def parse_score(t: Tables) -> DataFrame:
    rows = v.ledger(t).select(F.expr(_SCORE).alias("score")).groupBy("score").agg(F.count("*").alias("n"))
    s = parse.parse_score(F.col("score"))
    return rows.select("score", s["home"].alias("home"), s["away"].alias("away"), "n")


@query("""
SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(p_retailprice AS BIGINT) END AS price, CAST(p_size AS BIGINT) AS signed_size, CAST(NULL AS BIGINT) AS text_value FROM part""")
def strict_int(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", parse.strict_int(F.col("p_retailprice")).alias("price"), parse.strict_int(F.concat(F.lit("+"), F.col("p_size").cast("string"))).alias("signed_size"), parse.strict_int(F.col("p_name")).alias("text_value"))


@query("""SELECT event_id, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS kind FROM events""")
def try_numeric(t: Tables) -> DataFrame:
    return t.events.select("event_id", parse.try_number(F.get_json_object("props", "$.k")).alias("k"), parse.try_number(F.col("event_type")).alias("kind"))


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%Y-%m-%d') AS text, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, CAST(NULL AS DATE) AS bad FROM orders""")
def date_functions(t: Tables) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", d.alias("d"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("text"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.datediff(d, F.lit("1995-01-01").cast("date")).cast("bigint").alias("days"), F.try_to_date("o_orderpriority").alias("bad"))


@query("SELECT p_partkey, trim(regexp_replace('  ' || p_name || '   ' || p_brand || ' ', '\\s+', ' ', 'g')) AS name FROM part")
def string_normalise(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", parse.squash(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_brand", F.lit(" "))).alias("name"))


@query("SELECT n_nationkey, n_name AS team FROM nation")
def team_key(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", parse.team_key(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" vs  "), "n_name")).otherwise(F.col("n_name"))).alias("team"))


@query(f"WITH {v.LEDGER} SELECT season, {v.RESULT} AS result, count(*) AS n FROM ledger GROUP BY 1, 2")
def result_label(t: Tables) -> DataFrame:
    return v.labelled(v.ledger(t)).groupBy("season", "result").agg(F.count("*").alias("n"))


@query(f"WITH {v.GAMES} SELECT row_id, season || '|' || strftime(d, '%Y-%m-%d') || '|' || h || '|' || a AS match_id FROM games")
def match_key(t: Tables) -> DataFrame:
    return v.games(t).select("row_id", parse.match_key(F.col("season"), F.col("d"), F.col("h"), F.col("a")).alias("match_id"))


@query("""SELECT p_partkey, substr(md5('[["' || p_brand || '","' || p_type || '"],["' || p_name || '"]]'), 1, 16) AS signature FROM part""")
def md5_signature(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", parse.signature(F.array(F.array("p_brand", "p_type"), F.array("p_name"))).alias("signature"))


@query("""SELECT s_suppkey, CAST(regexp_extract(s_name, '#(\\d+)', 1) AS BIGINT) AS number, '2021-2022' AS season, CAST(NULL AS VARCHAR) AS no_season FROM supplier""")
def regex_extract(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.regexp_extract("s_name", r"#(\d+)", 1).cast("bigint").alias("number"), parse.season_of(F.concat(F.lit("2021 - 2022 "), "s_name")).alias("season"), parse.season_of(F.lit("PL Season")).alias("no_season"))


# -- filters -------------------------------------------------------------------------------------------

_OL = "SELECT o_orderkey, l_partkey, l_quantity, l_shipdate FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey"


def _order_lines(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    return t.orders.select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


@query(f"""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE l_partkey IS NOT NULL OR l_quantity IS NOT NULL OR l_shipdate IS NOT NULL) AS not_blank, count(*) FILTER (WHERE l_partkey IS NOT NULL AND l_quantity IS NOT NULL) AS complete FROM ({_OL})""")
def drop_blank_rows(t: Tables) -> DataFrame:
    rows = _order_lines(t)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    kept = n(rows.na.drop(how="all", subset=["l_partkey", "l_quantity", "l_shipdate"]), "not_blank")
    return n(rows, "n_rows").join(kept).join(n(rows.na.drop(subset=["l_partkey", "l_quantity"]), "complete"))


@query(f"""
SELECT CASE WHEN l_partkey IS NULL AND l_quantity IS NULL AND l_shipdate IS NULL THEN 'blank' WHEN l_quantity IS NULL THEN 'no score' WHEN l_quantity > 40 THEN 'bad score' WHEN l_shipdate IS NULL THEN 'bad date' ELSE 'used' END AS row_class, count(*) AS n
FROM ({_OL}) GROUP BY 1""")
def row_classification(t: Tables) -> DataFrame:
    kind = checks.row_class([F.col("l_partkey"), F.col("l_shipdate")], F.col("l_quantity"), F.when(F.col("l_quantity") <= 40, F.col("l_quantity")), F.col("l_shipdate"))
    return _order_lines(t).groupBy(kind.alias("row_class")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 400000) OR o_orderpriority = '1-URGENT'")
def boolean_filter(t: Tables) -> DataFrame:
    c = F.col
    return t.orders.filter(((c("o_orderstatus") == "F") & (c("o_totalprice") > 400000)) | (c("o_orderpriority") == "1-URGENT")).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_mktsegment IN ('MACHINERY', 'HOUSEHOLD')")
def semi_membership(t: Tables) -> DataFrame:
    wanted = t.orders.filter(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.filter(F.col("c_mktsegment").isin("MACHINERY", "HOUSEHOLD")).join(wanted, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT p_partkey, starts_with(p_name, 'small') AS pre, contains(p_name, 'ri') AS mid, ends_with(p_name, 'ring') AS suf FROM part")
def string_predicates(t: Tables) -> DataFrame:
    n = F.col("p_name")
    return t.part.select("p_partkey", n.startswith("small").alias("pre"), n.contains("ri").alias("mid"), n.endswith("ring").alias("suf"))


@query("""
WITH j AS (SELECT d.doc_id, text, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT * FROM (SELECT 'quality' AS column_name, count(*) - count(quality) AS missing FROM j UNION ALL SELECT 'text', count(*) - count(text) FROM j UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM j) WHERE missing > 0""")
def missing_report(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "text").join(t.labels, "doc_id", "left")
    return frames.missing_report(joined, ["text", "quality", "toxic"])


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE abs(l_discount - 0.05) <= 1e-6 + 1e-5 * abs(0.05)")
def isclose_filter(t: Tables) -> DataFrame:
    return t.lineitem.filter(frames.is_close(F.col("l_discount"), F.lit(0.05))).select("l_orderkey", "l_linenumber", "l_discount")


# -- projections -----------------------------------------------------------------------------------------


@query("SELECT o_orderpriority, o_orderkey, o_custkey FROM orders")
def project_columns(t: Tables) -> DataFrame:
    return t.orders.select("o_orderpriority", "o_orderkey", "o_custkey")


@query("SELECT n_nationkey AS id, n_name AS team, n_regionkey FROM nation")
def rename_columns(t: Tables) -> DataFrame:
    return t.nation.withColumnsRenamed({"n_nationkey": "id", "n_name": "team", "not_there": "x"})


@query(f"WITH {v.GAMES} SELECT row_id, season, d, h, a, {v.RESULT} AS target FROM games")
def make_target(t: Tables) -> DataFrame:
    return features.target(v.games(t), ["hg", "ag"], parse.result_label(F.col("hg"), F.col("ag")))


_SIDES = f"""WITH {v.GAMELOG}, f AS (
  SELECT DISTINCT season, t, d, coalesce(CAST(sum(pts) OVER w AS BIGINT), 0) AS pts, coalesce(CAST(sum(gf) OVER w AS BIGINT), 0) AS gf, count(*) OVER w AS mp
  FROM gamelog WINDOW w AS (PARTITION BY season, t ORDER BY d {v.STRICT}))"""


def _sides(t: Tables) -> DataFrame:
    """games with both sides' sums before the day, as h_... and a_..."""
    games = v.games(t)
    log = ledger.two_sided(games)
    # one row per team and day carries the facts, so they are joined twice without repeating rows
    facts = history.sums_by_day(log, ["season", "t"], "d", {"b_pts": F.col("pts"), "b_gf": F.col("gf"), "b_mp": F.lit(1)})
    for side in ("h", "a"):
        own = facts.select(F.col("season"), F.col("d"), F.col("t").alias(side), *[F.col(c).alias(f"{side}{c[1:]}") for c in ("b_pts", "b_gf", "b_mp")])
        games = games.join(own, ["season", "d", side])
    return games


@query(f"""{_SIDES}
SELECT g.row_id, x.pts - y.pts AS pts_diff, x.gf - y.gf AS gf_diff, x.mp - y.mp AS mp_diff FROM games g
JOIN f x ON x.season = g.season AND x.d = g.d AND x.t = g.h JOIN f y ON y.season = g.season AND y.d = g.d AND y.t = g.a""")
def difference_features(t: Tables) -> DataFrame:
    return features.differences(_sides(t), {f"{c}_diff": (f"h_{c}", f"a_{c}") for c in ("pts", "gf", "mp")}).select("row_id", "pts_diff", "gf_diff", "mp_diff")


@query(f"""{_SIDES}
SELECT g.row_id, round(CASE WHEN x.mp > 0 THEN x.pts / x.mp END, 9) AS h_ppg, round(CASE WHEN y.mp > 0 THEN y.pts / y.mp END, 9) AS a_ppg, round(CASE WHEN x.mp > 0 THEN x.gf / x.mp END, 9) AS h_gpg FROM games g
JOIN f x ON x.season = g.season AND x.d = g.d AND x.t = g.h JOIN f y ON y.season = g.season AND y.d = g.d AND y.t = g.a""")
def rate_features(t: Tables) -> DataFrame:
    r = lambda x, n: F.round(features.rate(F.col(x), F.col(n)), 9)
    return _sides(t).select("row_id", r("h_pts", "h_mp").alias("h_ppg"), r("a_pts", "a_mp").alias("a_ppg"), r("h_gf", "h_mp").alias("h_gpg"))


@query("SELECT count(l_quantity) AS n, round(avg(l_quantity), 9) AS mean, round(stddev_samp(l_quantity), 9) AS std, min(l_quantity) AS least, max(l_quantity) AS largest FROM lineitem")
def describe_numeric(t: Tables) -> DataFrame:
    s = frames.numeric_summary(t.lineitem, "l_quantity")
    return s.select("n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "least", "largest")


@query("SELECT * FROM (SELECT 'head' AS part, o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5) UNION ALL SELECT * FROM (SELECT 'tail', o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 5)")
def head_tail(t: Tables) -> DataFrame:
    """The first and last five rows by key: the limit is what the operator is."""
    cut = lambda name, order: t.orders.orderBy(order).limit(5).select(F.lit(name).alias("part"), "o_orderkey", "o_totalprice")
    return cut("head", F.col("o_orderkey").asc()).unionAll(cut("tail", F.col("o_orderkey").desc()))


_LAST5 = """(SELECT row_id, t, sum(pts) AS pts, sum(won) AS wins, sum(gf) AS gf, sum(ga) AS ga, count(*) AS n FROM (
  SELECT e.row_id, e.t, p.pts, p.gf, p.ga, (p.gf > p.ga)::INT AS won, row_number() OVER (PARTITION BY e.row_id, e.t ORDER BY p.d DESC, p.row_id DESC) AS r FROM gl e JOIN gl p ON {on} AND p.t = e.t AND p.d < e.d) WHERE r <= 5 GROUP BY 1, 2)"""
_EACH = {c: c for c in ("pts", "gf", "ga", "games", "rest", "carryover")} | {f"{p}_{c}": f"{p}_{c}" for p in ("last5", "venue") for c in ("pts", "wins", "gf", "ga")}
_EACH |= {"ppg": "pts / nullif(games, 0)", "gf_rate": "gf / nullif(games, 0)", "ga_rate": "ga / nullif(games, 0)", "x_ppg": "x_pts / nullif(x_games, 0)", "x_gf_rate": "x_gf / nullif(x_games, 0)", "x_ga_rate": "x_ga / nullif(x_games, 0)", "x_last5_ppg": "x_last5_pts / nullif(x_last5_n, 0)"}


@query(f"""
WITH {v.GAMES}, {v.log_of('gl', 'games', 'row_id, ')},
cp AS (SELECT season, t, sum(pts) / count(*) AS ppg FROM gl GROUP BY 1, 2), cm AS (SELECT s.season, avg(cp.ppg) AS mean FROM (SELECT DISTINCT season FROM cp) s LEFT JOIN cp ON cp.season < s.season GROUP BY 1),
cy AS (SELECT cp.season, cp.t, coalesce(q.ppg * 0.75 + cm.mean * 0.25, cm.mean) AS carryover FROM cp JOIN cm ON cm.season = cp.season LEFT JOIN cp q ON q.season = cp.season - 1 AND q.t = cp.t),
st AS (SELECT row_id, season, t, venue, {', '.join(f"coalesce(sum({c}) OVER w, 0) AS {c}, coalesce(sum({c}) OVER x, 0) AS x_{c}" for c in ('pts', 'gf', 'ga'))}, count(*) OVER w AS games, count(*) OVER x AS x_games, date_diff('day', max(d) OVER x, d) AS rest
  FROM gl WINDOW w AS (PARTITION BY season, t ORDER BY d {v.STRICT}), x AS (PARTITION BY t ORDER BY d {v.STRICT})),
sd AS (SELECT st.*, cy.carryover, {', '.join(f"coalesce({a}.{c}, 0) AS {p}_{c}" for a, p in (('l', 'last5'), ('y', 'venue')) for c in ('pts', 'wins', 'gf', 'ga'))}, z.pts AS x_last5_pts, z.n AS x_last5_n FROM st
  LEFT JOIN cy ON cy.season = st.season AND cy.t = st.t LEFT JOIN {_LAST5.format(on="p.season = e.season")} l ON l.row_id = st.row_id AND l.t = st.t
  LEFT JOIN {_LAST5.format(on="p.season = e.season AND p.venue = e.venue")} y ON y.row_id = st.row_id AND y.t = st.t LEFT JOIN {_LAST5.format(on="true")} z ON z.row_id = st.row_id AND z.t = st.t),
vl AS (SELECT row_id, venue, {', '.join(f"{e} AS v_{c}" for c, e in _EACH.items())} FROM sd)
SELECT h.row_id, {', '.join(f"round(CAST(h.v_{c} - a.v_{c} AS DOUBLE), 6) AS {c}_diff" for c in features.COMPARED)} FROM vl h JOIN vl a ON a.row_id = h.row_id WHERE h.venue = 'home' AND a.venue = 'away'""")
def difference_features_all(t: Tables) -> DataFrame:
    got = features.match_differences(v.games(t))
    return got.select("row_id", *[F.round(F.col(f"{c}_diff").cast("double"), 6).alias(f"{c}_diff") for c in features.COMPARED])


# -- joins -----------------------------------------------------------------------------------------------


@query("""
WITH o AS (SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1)
SELECT c_custkey, c_name, c_nationkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def master_merge(t: Tables) -> DataFrame:
    right = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", F.lit("dropped").alias("c_name"))
    return frames.merge_one_to_one(t.customer.select("c_custkey", "c_name", "c_nationkey"), right, "c_custkey", [F.col("o_orderkey").asc()])


@query("SELECT s_suppkey, s_name, n_name AS nation, r_name AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def left_join(t: Tables) -> DataFrame:
    joined = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select("s_suppkey", "s_name", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


_TABLE = "count(*) AS mp, count(*) FILTER (WHERE gf > ga) AS w, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(pts) AS BIGINT) AS pts"


@query(f"""
WITH {v.TEAMLOG}, l AS (SELECT season, t, {_TABLE} FROM teamlog WHERE t <> 3 GROUP BY 1, 2),
r AS (SELECT season, t, mp, w, CASE WHEN t = 5 THEN NULL ELSE gf END AS gf, CASE WHEN t = 7 THEN pts - 8 ELSE pts END AS pts FROM (SELECT season, t, {_TABLE} FROM teamlog WHERE t <> 4 GROUP BY 1, 2)),
lu AS (SELECT season, t, u.metric, u.value FROM l, LATERAL (VALUES ('mp', mp), ('w', w), ('gf', gf), ('pts', pts)) u(metric, value)),
ru AS (SELECT season, t, u.metric, u.value FROM r, LATERAL (VALUES ('mp', mp), ('w', w), ('gf', gf), ('pts', pts)) u(metric, value))
SELECT season, t, metric, lu.value AS left_value, ru.value AS right_value, CASE WHEN lu.value IS NULL OR ru.value IS NULL THEN 'UNKNOWN' WHEN lu.value = ru.value THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM lu JOIN ru USING (season, t, metric)
UNION ALL SELECT season, t, '*', NULL, NULL, 'MAPPING ERROR (absent from table)' FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.season = l.season AND r.t = l.t)
UNION ALL SELECT season, t, '*', NULL, NULL, 'MAPPING ERROR (absent from fixtures)' FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE r.season = l.season AND r.t = l.t)""")
def reconcile_full_outer(t: Tables) -> DataFrame:
    """The rebuilt table against a published one with a deduction, a blank column and a missing team on either side."""
    table = ledger.league_table(v.teamlog(t)).select("season", "t", "mp", "w", "gf", "pts")
    published = table.filter("t <> 4").withColumn("gf", F.when(F.col("t") != 5, F.col("gf"))).withColumn("pts", F.col("pts") - F.when(F.col("t") == 7, 8).otherwise(0))
    return reconcile.reconcile(table.filter("t <> 3"), published, ["season", "t"], ["mp", "w", "gf", "pts"])


_EIGHT = {"mp": "count(*)", "w": "count(*) FILTER (WHERE gf > ga)", "dr": "count(*) FILTER (WHERE gf = ga)", "l": "count(*) FILTER (WHERE gf < ga)", "gf": "sum(gf)", "ga": "sum(ga)", "gd": "sum(gf) - sum(ga)", "pts": "sum(pts)"}


def _side_sql(name: str, venue: str | None) -> str:
    """The eight metrics of a team, of all its matches or of those at a venue (0 if there are none)."""
    rows = "teamlog" if venue is None else f"(SELECT season, t, venue, CASE WHEN venue = '{venue}' THEN gf END AS gf, CASE WHEN venue = '{venue}' THEN ga END AS ga, CASE WHEN venue = '{venue}' THEN pts END AS pts FROM teamlog)"
    own = {m: e.replace("count(*)", "count(gf)") if venue else e for m, e in _EIGHT.items()}
    return f"{name} AS (SELECT season, t, {', '.join(f'coalesce(CAST({e} AS BIGINT), 0) AS {venue + chr(95) if venue else str()}{m}' for m, e in own.items())} FROM {rows} GROUP BY 1, 2)"


_METRICS_24 = [*_EIGHT, *[f"{s}_{m}" for s in ("home", "away") for m in _EIGHT]]


@query(f"""
WITH {v.TEAMLOG}, {_side_sql('o', None)}, {_side_sql('hm', 'home')}, {_side_sql('aw', 'away')}, b AS (SELECT * FROM o JOIN hm USING (season, t) JOIN aw USING (season, t)),
l AS (SELECT * FROM b WHERE t <> 3), r AS (SELECT * REPLACE (CASE WHEN t = 5 THEN NULL ELSE away_gf END AS away_gf, CASE WHEN t = 7 THEN pts - 8 ELSE pts END AS pts) FROM b WHERE t <> 4),
lu AS (SELECT season, t, u.metric, u.left_value FROM l, LATERAL (VALUES {', '.join(f"('{m}', {m})" for m in _METRICS_24)}) u(metric, left_value)), ru AS (SELECT season, t, u.metric, u.right_value FROM r, LATERAL (VALUES {', '.join(f"('{m}', {m})" for m in _METRICS_24)}) u(metric, right_value)),
x AS (SELECT season, t, metric, left_value, CASE WHEN metric = 'home_l' THEN NULL ELSE right_value END AS right_value,
  CASE WHEN metric = 'home_l' THEN 'MAPPING ERROR (no column home_l)' WHEN right_value IS NULL THEN 'UNKNOWN' WHEN left_value = right_value THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM lu JOIN ru USING (season, t, metric)
UNION ALL SELECT season, t, '*', NULL, NULL, 'MAPPING ERROR (absent from table)' FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.season = l.season AND r.t = l.t)
UNION ALL SELECT season, t, '*', NULL, NULL, 'MAPPING ERROR (absent from fixtures)' FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE r.season = l.season AND r.t = l.t))
SELECT season, t, metric, left_value, right_value, left_value - right_value AS difference, status, CASE WHEN t = 7 THEN '8 points deducted' WHEN t = 3 THEN 'new' ELSE '' END AS note FROM x""")
def reconcile_notes(t: Tables) -> DataFrame:
    """All 24 metrics (8 overall, 8 at home, 8 away) against a table with a deduction, blanks, notes, a missing column and missing teams."""
    log = v.teamlog(t)
    table = ledger.league_table(log).join(ledger.venue_table(log), ["season", "t"]).select("season", "t", *_METRICS_24)
    published = table.filter("t <> 4").withColumn("away_gf", F.when(F.col("t") != 5, F.col("away_gf"))).withColumn("pts", F.col("pts") - F.when(F.col("t") == 7, 8).otherwise(0)).drop("home_l")
    notes = published.select("season", "t", F.when(F.col("t") == 7, "8 points deducted").when(F.col("t") == 3, "new").alias("note"))
    return reconcile.reconcile_with_notes(table.filter("t <> 3"), published, ["season", "t"], _METRICS_24, notes)


@query(f"""
WITH {v.TEAMLOG}, o AS (SELECT season, t, CAST(sum(pts) AS BIGINT) - CASE WHEN t = 7 THEN 8 ELSE 0 END AS total, coalesce(CAST(sum(pts) FILTER (WHERE venue = 'home') AS BIGINT), 0) AS home_value, coalesce(CAST(sum(pts) FILTER (WHERE venue = 'away') AS BIGINT), 0) AS away_value FROM teamlog GROUP BY 1, 2)
SELECT season, t, 'pts' AS metric, total, home_value, away_value FROM o WHERE home_value + away_value <> total""")
def internal_consistency(t: Tables) -> DataFrame:
    log = v.teamlog(t)
    published = ledger.league_table(log).withColumn("pts", F.col("pts") - F.when(F.col("t") == 7, 8).otherwise(0))
    return reconcile.internal_consistency(published, ledger.venue_table(log), ["season", "t"], ["mp", "w", "gf", "ga", "pts"])


@query("SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def anti_join_missing(t: Tables) -> DataFrame:
    return frames.missing_keys(t.customer.select(F.col("c_nationkey").alias("nation")), t.supplier.select(F.col("s_nationkey").alias("nation")), ["nation"])


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_join_extra(t: Tables) -> DataFrame:
    return frames.missing_keys(t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k")), ["k"])


@query(f"WITH {v.ELOG} SELECT event_id, count(*) OVER w AS n_before, coalesce(CAST(sum(pts) OVER w AS BIGINT), 0) AS pts_before FROM elog WINDOW w AS (PARTITION BY t ORDER BY d {v.STRICT})")
def strict_before_history(t: Tables) -> DataFrame:
    return history.strict_sums(v.elog(t), ["t"], "d", {"n_before": F.lit(1), "pts_before": F.col("pts")}).select("event_id", "n_before", "pts_before")


@query(f"""
WITH {v.ELOG}, p AS (SELECT t, d, arg_max(pts, event_id) AS pts FROM elog GROUP BY 1, 2), q AS (SELECT t, d, lag(pts) OVER (PARTITION BY t ORDER BY d) AS prev_pts FROM p)
SELECT event_id, prev_pts FROM elog JOIN q USING (t, d)""")
def prev_value_asof(t: Tables) -> DataFrame:
    return history.previous_value(v.elog(t), ["t"], "d", "event_id", "pts", "prev_pts").select("event_id", "prev_pts")


@query(f"""
WITH {v.LEDGER}, x AS (SELECT season, count(*) OVER (PARTITION BY season ORDER BY d RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM ledger)
SELECT season, CAST(sum(n) AS BIGINT) AS pairs, count(*) FILTER (WHERE n > 0) AS rows_with_later FROM x GROUP BY season""")
def future_pairs(t: Tables) -> DataFrame:
    return history.later_pairs(v.ledger(t), ["season"], "d").select("season", "pairs", "rows_with_later")


@query(f"""
WITH {v.LEDGER}, s AS (SELECT season, max(d) AS available FROM ledger GROUP BY 1)
SELECT l.season, s.available, count(*) FILTER (WHERE s.available >= l.d) AS exposed, count(*) AS n FROM ledger l JOIN s ON l.season = s.season GROUP BY 1, 2""")
def availability_leak(t: Tables) -> DataFrame:
    days = v.ledger(t).groupBy("season", "d").agg(F.count("*").alias("n"))
    known = days.groupBy("season").agg(F.max("d").alias("available"))
    return days.join(known, "season").groupBy("season", "available").agg(F.sum(F.when(F.col("available") >= F.col("d"), F.col("n")).otherwise(0)).alias("exposed"), F.sum("n").alias("n"))


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = CAST(regexp_extract(s_name, '(\\d+)$', 1) AS BIGINT) % 25")
def season_key_join(t: Tables) -> DataFrame:
    """An equi-join on a key taken out of a name."""
    key = F.regexp_extract("s_name", r"(\d+)$", 1).cast("bigint") % 25
    return t.supplier.select("s_suppkey", key.cast("int").alias("n_nationkey")).join(t.nation, "n_nationkey").select("s_suppkey", "n_name")


# -- aggregates --------------------------------------------------------------------------------------------

_LT = """count(*) AS {0}mp, count(*) FILTER (WHERE gf > ga) AS {0}w, count(*) FILTER (WHERE gf = ga) AS {0}dr, count(*) FILTER (WHERE gf < ga) AS {0}l, CAST(sum(gf) AS BIGINT) AS {0}gf, CAST(sum(ga) AS BIGINT) AS {0}ga, CAST(sum(pts) AS BIGINT) AS {0}pts, CAST(sum(gf) - sum(ga) AS BIGINT) AS {0}gd"""


@query(f"WITH {v.TEAMLOG} SELECT season, t, {_LT.format('')} FROM teamlog GROUP BY season, t")
def league_table(t: Tables) -> DataFrame:
    return ledger.league_table(v.teamlog(t))


def _venue_sql() -> str:
    parts = []
    for side in ("home", "away"):
        on = f"FILTER (WHERE venue = '{side}')"
        parts += [f"count(*) {on} AS {side}_mp", *[f"count(*) FILTER (WHERE venue = '{side}' AND gf {o} ga) AS {side}_{n}" for n, o in (("w", ">"), ("dr", "="), ("l", "<"))]]
        parts += [f"CAST(coalesce(sum({c}) {on}, 0) AS BIGINT) AS {side}_{c}" for c in ("gf", "ga", "pts")] + [f"CAST(coalesce(sum(gf - ga) {on}, 0) AS BIGINT) AS {side}_gd"]
    return ", ".join(parts)


@query(f"WITH {v.TEAMLOG} SELECT season, t, {_venue_sql()} FROM teamlog GROUP BY season, t")
def league_table_venue(t: Tables) -> DataFrame:
    return ledger.venue_table(v.teamlog(t))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def group_count(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def value_counts(t: Tables) -> DataFrame:
    return frames.value_counts(t.events, "event_type").select("value", "n")


@query("SELECT quality AS value, round(count(*) / (SELECT count(quality) FROM labels), 9) AS share FROM labels WHERE quality IS NOT NULL GROUP BY 1")
def value_proportions(t: Tables) -> DataFrame:
    return frames.value_counts(t.labels, "quality").select("value", F.round("share", 9).alias("share"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1")
def count_distinct(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.col("ts").cast("date")).alias("days"))


@query(f"WITH {v.LEDGER} SELECT season, min(d) AS first_day, max(d) AS last_day, count(*) AS n FROM ledger GROUP BY 1")
def date_range(t: Tables) -> DataFrame:
    return v.ledger(t).groupBy("season").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count("*").alias("n"))


@query(f"WITH {v.TEAMLOG} SELECT round(avg(p), 9) AS league_mean FROM (SELECT season, t, sum(pts) / count(*) AS p FROM teamlog GROUP BY 1, 2)")
def mean_of_means(t: Tables) -> DataFrame:
    return features.team_season_ppg(v.teamlog(t)).agg(F.round(F.avg("ppg"), 9).alias("league_mean"))


@query(f"WITH {v.TEAMLOG} SELECT season, t, round(sum(pts) / count(*), 9) AS ppg FROM teamlog GROUP BY 1, 2")
def team_season_ppg(t: Tables) -> DataFrame:
    return features.team_season_ppg(v.teamlog(t)).select("season", "t", F.round("ppg", 9).alias("ppg"))


@query(f"WITH {v.TEAMLOG} SELECT t, count(*) AS n, count(*) FILTER (WHERE venue = 'home') AS n_home, count(*) FILTER (WHERE venue = 'away') AS n_away FROM teamlog GROUP BY 1")
def home_away_balance(t: Tables) -> DataFrame:
    return v.teamlog(t).groupBy("t").agg(F.count("*").alias("n"), F.count_if(F.col("venue") == "home").alias("n_home"), F.count_if(F.col("venue") == "away").alias("n_away"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def duplicate_rows(t: Tables) -> DataFrame:
    return frames.flag_repeats(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


@query("SELECT p_name, count(*) - 1 AS extra FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(t: Tables) -> DataFrame:
    return t.part.groupBy("p_name").agg((F.count("*") - 1).alias("extra")).filter("extra > 0")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1")
def dedupe_first(t: Tables) -> DataFrame:
    order = [F.col(c).asc() for c in ("l_partkey", "l_suppkey", "l_extendedprice")]
    return frames.dedupe_first(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""
WITH f AS (SELECT source, lang, count(*) AS n, count(DISTINCT text) AS kinds FROM documents GROUP BY 1, 2), s AS (SELECT DISTINCT source FROM documents), l AS (SELECT unnest(['de', 'en', 'es', 'fr', 'it']) AS lang)
SELECT s.source, l.lang, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'MISSING' WHEN n = 1 THEN 'PASS' WHEN kinds = 1 THEN 'DUPLICATE' ELSE 'UNKNOWN' END AS status FROM s CROSS JOIN l LEFT JOIN f ON f.source = s.source AND f.lang = l.lang""")
def coverage_matrix(t: Tables) -> DataFrame:
    return checks.coverage(t.documents.select("source", "lang", "text"), "source", "lang", "text", ["de", "en", "es", "fr", "it"])


@query("SELECT p_brand, count(*) AS n, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY 1")
def groups_by_size(t: Tables) -> DataFrame:
    g = t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("types"))
    return g.orderBy(F.col("n").desc(), "p_brand")


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) AS open, count(*) FILTER (WHERE starts_with(o_orderpriority, '1')) AS urgent FROM orders")
def status_summary(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    return t.orders.agg(F.count_if(s == "F").alias("finished"), F.count_if(s.isin("O", "P")).alias("open"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"))


@query(f"""
WITH {v.GAMES}, c AS (SELECT season, d, count(*) AS n FROM games GROUP BY 1, 2)
SELECT season, count(*) AS days, count(*) FILTER (WHERE n > 1) AS shared_days, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS shared_rows, max(n) AS busiest FROM c GROUP BY 1""")
def same_day_exposure(t: Tables) -> DataFrame:
    days = v.games(t).groupBy("season", "d").agg(F.count("*").alias("n"))
    return days.groupBy("season").agg(F.count("*").alias("days"), F.count_if(F.col("n") > 1).alias("shared_days"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("shared_rows"), F.max("n").alias("busiest"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS quantity_price, round(corr(l_quantity, l_discount), 6) AS quantity_discount, CAST(NULL AS DOUBLE) AS constant FROM lineitem")
def pearson_corr(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", F.lit(1.0).alias("one"))
    r = lambda a, b: F.round(frames.pearson(li, a, b), 6)
    return li.agg(r("l_quantity", "l_extendedprice").alias("quantity_price"), r("l_quantity", "l_discount").alias("quantity_discount"), r("l_quantity", "one").alias("constant"))


_CHECKS = f"""WITH {v.GAMELOG},
p AS (SELECT season, t, count(*) AS n, count(*) FILTER (WHERE venue = 'home') AS nh, count(*) FILTER (WHERE venue = 'away') AS na FROM gamelog GROUP BY 1, 2),
k AS (SELECT season, count(*) AS n_teams, count(*) FILTER (WHERE n <> 38 OR nh <> 19 OR na <> 19) AS unbalanced FROM p GROUP BY 1),
m AS (SELECT season, d, h, a, count(*) AS n, min(least(hg, ag)) AS low FROM games GROUP BY 1, 2, 3, 4),
s AS (SELECT season, CAST(sum(n) AS BIGINT) AS n_matches, count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE d IS NULL) AS undated, min(low) AS least_goals FROM m GROUP BY 1),
c AS (SELECT s.*, n_teams, unbalanced, CASE WHEN n_matches = 380 AND n_teams = 20 AND unbalanced = 0 AND repeated = 0 AND undated = 0 AND least_goals >= 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM s JOIN k ON s.season = k.season)"""


@query(f"{_CHECKS} SELECT * FROM c")
def season_summary(t: Tables) -> DataFrame:
    games = v.games(t)
    return checks.season_checks(ledger.two_sided(games), games)


@query(f"{_CHECKS} SELECT CASE WHEN bool_and(status = 'PASS') THEN 'PASS' ELSE 'FAIL' END AS verdict, count(*) FILTER (WHERE status <> 'PASS') AS not_passed, CAST(CASE WHEN bool_and(status = 'PASS') THEN 0 ELSE 2 END AS INT) AS exit_code FROM c")
def season_status(t: Tables) -> DataFrame:
    return checks.overall(season_summary(t))


# -- sets and sorts ------------------------------------------------------------------------------------------


@query("SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nation")).unionByName(t.supplier.select(F.col("s_nationkey").alias("nation")))


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t: Tables) -> DataFrame:
    return union_all(t).distinct()


@query("SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def except_sets(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("nation")).subtract(t.supplier.filter("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_sets(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nation")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders")
def distinct_sorted(t: Tables) -> DataFrame:
    return t.orders.agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders""")
def sort_multi(t: Tables) -> DataFrame:
    """Positions by several keys, nulls last, within each customer."""
    rows = t.orders.select("o_custkey", "o_orderdate", "o_orderkey")
    return leakage.numbered(rows, ["o_orderdate"], ["o_orderkey"], ["o_custkey"]).select("o_orderkey", F.col("position").cast("bigint").alias("position"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def top_k(t: Tables) -> DataFrame:
    """The five dearest orders: the limit is what the operator is."""
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(5)
