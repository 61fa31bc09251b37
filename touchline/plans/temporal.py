"""History features, validation suites, leakage tests and evaluation on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import classify
from touchline.operators import checks, evaluate, features, frames, history, leakage, ledger
from touchline.plans import views as v
from touchline.session import Tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- windows -------------------------------------------------------------------------------------------------


def _big(c: str, w: str = "w") -> str:
    return f"coalesce(CAST(sum({c}) OVER {w} AS BIGINT), 0)"


@query(f"""WITH {v.GAMELOG} SELECT season, t, d, venue, {_big('pts')} AS points_before, {_big('gf')} AS gf_before, {_big('ga')} AS ga_before, count(*) OVER w AS games_before
FROM gamelog WINDOW w AS (PARTITION BY season, t ORDER BY d {v.STRICT})""")
def state_before(t: Tables) -> DataFrame:
    sums = {"points_before": F.col("pts"), "gf_before": F.col("gf"), "ga_before": F.col("ga"), "games_before": F.lit(1)}
    return history.strict_sums(ledger.two_sided(v.games(t)), ["season", "t"], "d", sums).select("season", "t", "d", "venue", *sums)


def _recent_sql(keys: str, on: str) -> str:
    return f"""WITH {v.ELOG}, r AS (
  SELECT e.event_id, p.pts, p.gf, p.ga, row_number() OVER (PARTITION BY e.event_id ORDER BY p.d DESC, p.event_id DESC) AS k FROM elog e JOIN elog p ON {on} AND p.d < e.d),
s AS (SELECT event_id, CAST(sum(pts) AS BIGINT) AS pts, count(*) FILTER (WHERE gf > ga) AS won, count(*) FILTER (WHERE gf = ga) AS drawn, count(*) FILTER (WHERE gf < ga) AS lost, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga, count(*) AS n FROM r WHERE k <= 5 GROUP BY 1)
"""


_FORM = "SELECT e.event_id, coalesce(s.pts, 0) AS last5_pts, coalesce(won, 0) AS last5_won, coalesce(drawn, 0) AS last5_drawn, coalesce(lost, 0) AS last5_lost, coalesce(s.gf, 0) AS last5_gf, coalesce(s.ga, 0) AS last5_ga FROM elog e LEFT JOIN s ON s.event_id = e.event_id"


def _form(rows: DataFrame, keys: list[str]) -> DataFrame:
    got = history.last_n(rows, keys, "d", "event_id", ["pts", "gf", "ga"])
    count = lambda test: F.coalesce(F.size(F.filter("recent", test)), F.lit(0)).cast("bigint")
    return got.select(
        "event_id",
        *[F.coalesce(history.total("recent", c), F.lit(0)).alias(f"last5_{c}") for c in ("pts", "gf", "ga")],
        count(lambda x: x["gf"] > x["ga"]).alias("last5_won"),
        count(lambda x: x["gf"] == x["ga"]).alias("last5_drawn"),
        count(lambda x: x["gf"] < x["ga"]).alias("last5_lost"),
    )


@query(_recent_sql("t", "p.t = e.t") + _FORM)
def last5_form(t: Tables) -> DataFrame:
    return _form(v.elog(t), ["t"])


@query(_recent_sql("t, venue", "p.t = e.t AND p.venue = e.venue") + _FORM)
def venue_last5_form(t: Tables) -> DataFrame:
    return _form(v.elog(t), ["t", "venue"])


@query(_recent_sql("t", "p.t = e.t") + "SELECT e.event_id, round(s.pts / s.n, 9) AS last5_ppg FROM elog e LEFT JOIN s ON s.event_id = e.event_id")
def last5_ppg(t: Tables) -> DataFrame:
    got = history.last_n(v.elog(t), ["t"], "d", "event_id", ["pts"])
    return got.select("event_id", F.round(features.rate(history.total("recent", "pts"), F.size("recent")), 9).alias("last5_ppg"))


@query(f"""WITH {v.GAMELOG} SELECT season, t, d, venue, round(sum(pts) OVER w / count(*) OVER w, 9) AS ppg, round(sum(gf) OVER w / count(*) OVER w, 9) AS gfpg, round(sum(ga) OVER w / count(*) OVER w, 9) AS gapg
FROM gamelog WINDOW w AS (PARTITION BY t ORDER BY d {v.STRICT})""")
def ppg_cross_season(t: Tables) -> DataFrame:
    got = history.strict_sums(ledger.two_sided(v.games(t)), ["t"], "d", {"p": F.col("pts"), "f": F.col("gf"), "g": F.col("ga"), "n": F.lit(1)})
    return got.select("season", "t", "d", "venue", *[F.round(features.rate(F.col(c), F.col("n")), 9).alias(a) for c, a in (("p", "ppg"), ("f", "gfpg"), ("g", "gapg"))])


@query(f"WITH {v.ELOG} SELECT event_id, CAST(date_diff('day', max(d) OVER w, d) AS INT) AS rest_days FROM elog WINDOW w AS (PARTITION BY t ORDER BY d {v.STRICT})")
def rest_days(t: Tables) -> DataFrame:
    return history.rest_days(v.elog(t), ["t"], "d").select("event_id", "rest_days")


_PROBE = f"""{v.GAMES}, {v.log_of('gl', 'games', 'row_id, ')},
f AS (SELECT row_id, t, venue, count(*) OVER w AS mp, {_big('pts')} AS pts, {_big('gf')} AS gf, {_big('ga')} AS ga, count(*) OVER x AS venue_mp, {_big('pts', 'x')} AS venue_pts FROM gl
  WINDOW w AS (PARTITION BY season, t ORDER BY d {v.STRICT}), x AS (PARTITION BY season, t, venue ORDER BY d {v.STRICT})),
dl AS (SELECT season, t, d, arg_max(pts, row_id) AS p FROM gl GROUP BY 1, 2, 3), pv AS (SELECT season, t, d, lag(p) OVER (PARTITION BY season, t ORDER BY d) AS prev FROM dl),
r AS (SELECT e.row_id, e.t, sum(q.pts) AS last5 FROM gl e JOIN LATERAL (SELECT pts FROM gl p WHERE p.season = e.season AND p.t = e.t AND p.d < e.d ORDER BY p.d DESC, p.row_id DESC LIMIT 5) q ON true GROUP BY 1, 2)"""


@query(f"""WITH {_PROBE}
SELECT g.row_id, {', '.join(f"{s}f.{c} AS {s}_{c}" for s in ('h', 'a') for c in ('mp', 'pts', 'gf', 'ga', 'venue_mp', 'venue_pts'))},
  CAST(coalesce(hr.last5, 0) AS BIGINT) AS h_last5_pts, CAST(coalesce(ar.last5, 0) AS BIGINT) AS a_last5_pts, hp.prev AS h_prev_pts, ap.prev AS a_prev_pts
FROM games g JOIN f hf ON hf.row_id = g.row_id AND hf.venue = 'home' JOIN f af ON af.row_id = g.row_id AND af.venue = 'away'
LEFT JOIN r hr ON hr.row_id = g.row_id AND hr.t = g.h LEFT JOIN r ar ON ar.row_id = g.row_id AND ar.t = g.a
JOIN pv hp ON hp.season = g.season AND hp.t = g.h AND hp.d = g.d JOIN pv ap ON ap.season = g.season AND ap.t = g.a AND ap.d = g.d""")
def probe_features(t: Tables) -> DataFrame:
    """All probe features of both sides of every match, from strictly earlier days of the season."""
    log = ledger.two_sided(v.games(t), ["row_id"])
    got = features.probe(log, log)
    side = lambda venue, p: [F.max(F.when(F.col("venue") == venue, F.col(c))).alias(f"{p}_{c}") for c in ("mp", "pts", "gf", "ga", "venue_mp", "venue_pts", "last5_pts", "prev_pts")]
    return got.groupBy("row_id").agg(*side("home", "h"), *side("away", "a"))


@query(f"""
WITH {v.GAMES}, {v.log_of('gl', 'games', 'row_id, ')}, f AS (SELECT row_id, season, count(*) OVER (PARTITION BY season, t ORDER BY d {v.STRICT}) AS n FROM gl),
b AS (SELECT row_id, season, max(n) AS most, count(*) FILTER (WHERE n = 0) AS cold FROM f GROUP BY 1, 2)
SELECT season, count(*) FILTER (WHERE most = 0) AS cold_matches, CAST(sum(cold) AS BIGINT) AS cold_sides FROM b GROUP BY 1""")
def cold_start(t: Tables) -> DataFrame:
    got = history.strict_sums(ledger.two_sided(v.games(t), ["row_id"]), ["season", "t"], "d", {"n": F.lit(1)})
    both = got.groupBy("row_id", "season").agg(F.max("n").alias("most"), F.count_if(F.col("n") == 0).alias("cold"))
    return both.groupBy("season").agg(F.count_if(F.col("most") == 0).alias("cold_matches"), F.sum("cold").alias("cold_sides"))


@query("""
WITH x AS (SELECT o_custkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)
SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE p > o_orderdate) AS breaks, count(*) > 1 AND count(*) FILTER (WHERE p > o_orderdate) = 0 AS chronological FROM x GROUP BY 1""")
def chronological_check(t: Tables) -> DataFrame:
    return checks.out_of_order(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderkey", "o_orderdate")


def _carry_sql(mean: str) -> str:
    return f"""WITH {v.TEAMLOG}, p AS (SELECT season, t, sum(pts) / count(*) AS ppg FROM teamlog GROUP BY 1, 2), m AS ({mean})
SELECT p.season, p.t, round(coalesce(q.ppg * 0.75 + m.mean * 0.25, m.mean), 9) AS rating FROM p JOIN m ON m.season = p.season LEFT JOIN p q ON q.season = p.season - 1 AND q.t = p.t"""


@query(_carry_sql("SELECT s.season, avg(p.ppg) AS mean FROM (SELECT DISTINCT season FROM p) s LEFT JOIN p ON p.season < s.season GROUP BY 1"))
def carryover_rating(t: Tables) -> DataFrame:
    return features.carryover(v.teamlog(t)).select("season", "t", F.round("rating", 9).alias("rating"))


@query(_carry_sql("SELECT s.season, (SELECT avg(ppg) FROM p) AS mean FROM (SELECT DISTINCT season FROM p) s"))
def carryover_rating_reference(t: Tables) -> DataFrame:
    return features.carryover(v.teamlog(t), "reference").select("season", "t", F.round("rating", 9).alias("rating"))


_SAMPLE = """smp AS (SELECT row_id, season, d, h, a FROM (SELECT *, row_number() OVER (ORDER BY season, d, row_id) - 1 AS position, greatest(1, (SELECT count(*) FROM games) // {n}) AS step FROM games) WHERE position % step = 0 AND position < step * {n})"""


@query(f"WITH {v.GAMES}, {_SAMPLE.format(n=100)} SELECT row_id, season, d FROM smp")
def stride_sample(t: Tables) -> DataFrame:
    """A deterministic sample of 100 matches: the limit is what the operator is."""
    return leakage.stride_sample(v.games(t), 100).select("row_id", "season", "d")


@query("SELECT l_orderkey, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r <= 2")
def topk_per_group(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    return frames.top_per_group(rows, ["l_orderkey"], [F.col("l_extendedprice").desc(), F.col("l_partkey"), F.col("l_suppkey")], 2).select("l_orderkey", "l_partkey", "l_extendedprice")


# -- validation --------------------------------------------------------------------------------------------------


@query(f"""
WITH {v.LEDGER}, {v.log_of('tl', 'ledger')}, p AS (SELECT season, t, count(*) AS n, count(*) FILTER (WHERE venue = 'home') AS nh, count(*) FILTER (WHERE venue = 'away') AS na FROM tl GROUP BY 1, 2),
k AS (SELECT season, count(*) AS n_teams, count(*) FILTER (WHERE NOT (n = 1000 AND nh = 500 AND na = 500)) AS unbalanced FROM p GROUP BY 1),
m AS (SELECT season, d, h, a, count(*) AS n, min(least(hg, ag)) AS low FROM ledger GROUP BY 1, 2, 3, 4),
s AS (SELECT season, CAST(sum(n) AS BIGINT) AS n_matches, count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE d IS NULL) AS undated, min(low) AS least_goals FROM m GROUP BY 1)
SELECT s.*, n_teams, unbalanced, CASE WHEN n_matches = 10000 AND n_teams = 25 AND unbalanced = 0 AND repeated = 0 AND undated = 0 AND least_goals >= 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM s JOIN k ON s.season = k.season""")
def fixture_validation(t: Tables) -> DataFrame:
    matches = v.ledger(t)
    return checks.season_checks(ledger.two_sided(matches), matches, {"matches": 10_000, "teams": 25, "each": 1000, "venue": 500})


@query("""
WITH g AS (SELECT source, count(*) AS n_rows, count(DISTINCT lang) AS n_teams, count(*) - count(lang) AS missing_teams, CASE WHEN count(*) FILTER (WHERE lang = 'en') = count(*) THEN 'Squad' ELSE 'UNKNOWN' END AS side, CASE WHEN source = 'src0' THEN 'Overall' ELSE 'Standard' END AS kind FROM documents GROUP BY 1),
f AS (SELECT *, concat_ws(' | ', CASE WHEN n_rows <> 4 THEN 'rows: ' || n_rows END, CASE WHEN missing_teams > 0 THEN 'missing names: ' || missing_teams END, CASE WHEN n_teams <> 4 THEN 'teams: ' || n_teams END, CASE WHEN side = 'UNKNOWN' THEN 'unknown perspective' END) AS findings FROM g)
SELECT source, findings, NOT (kind = 'Standard' AND side = 'Squad') AS name_mismatch, CASE WHEN findings = '' THEN 'PASS' ELSE 'FAIL' END AS status FROM f""")
def integrity_report(t: Tables) -> DataFrame:
    g = t.documents.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_distinct("lang").alias("n_teams"), (F.count("*") - F.count("lang")).alias("missing_teams"), F.count_if(F.col("lang") == "en").alias("en"))
    hint = classify.name_hint(F.concat("source", F.lit(" Standard S.xls")))
    g = g.withColumn("side", F.when(F.col("en") == F.col("n_rows"), "Squad").otherwise("UNKNOWN")).withColumn("kind", F.when(F.col("source") == "src0", "Overall").otherwise("Standard"))
    g = g.withColumn("hint_kind", hint["kind"]).withColumn("hint_side", hint["side"])
    return checks.integrity(g, 4).select("source", "findings", "name_mismatch", "status")


@query("SELECT CAST(40 AS BIGINT) AS entries, CAST(19 AS BIGINT) AS allowed, CAST(19 AS BIGINT) AS refused, CAST(1 AS BIGINT) AS undetermined")
def registry_summary(t: Tables) -> DataFrame:
    return leakage.registry_summary(t.spark)


@query(f"""
WITH {v.GAMES}, s AS (SELECT season, min(d) AS f, max(d) AS l, count(*) AS n FROM games GROUP BY 1)
SELECT CAST(count(p.season) AS INT) AS fold, s.season AS test_season, CAST(date_diff('day', max(p.l), s.f) AS BIGINT) AS gap_days, max(p.l) < s.f AS ordered, CAST(0 AS BIGINT) AS overlap, s.n AS test_rows FROM s JOIN s p ON p.season < s.season GROUP BY s.season, s.f, s.n""")
def fold_validation(t: Tables) -> DataFrame:
    return evaluate.fold_checks(v.games(t))


@query(f"""
WITH {v.GAMES}, s AS (SELECT season, min(d) AS f, max(d) AS l, count(*) AS n FROM games GROUP BY 1)
SELECT CAST(count(p.season) AS INT) AS fold, CAST(sum(p.n) AS BIGINT) AS train_rows, s.n AS test_rows, max(p.l) < s.f AS ordered, true AS apart, bool_and(p.season <> s.season) AS untouched, true AS whole FROM s JOIN s p ON p.season < s.season GROUP BY s.season, s.f, s.n""")
def fold_audit(t: Tables) -> DataFrame:
    games = v.games(t)
    return evaluate.fold_audit(games, evaluate.fold_members(games))


@query(f"WITH {v.GAMES}, m AS (SELECT min(season) AS f FROM games) SELECT count(*) FILTER (WHERE season > f) AS once, CAST(0 AS BIGINT) AS more, count(*) FILTER (WHERE season = f) AS never, CAST(0 AS BIGINT) AS never_later FROM games, m")
def fold_partition(t: Tables) -> DataFrame:
    games = v.games(t)
    return evaluate.fold_partition(games, evaluate.fold_members(games))


def _verdict(test: str, tested: str, observed: str, verdict: str, source: str, ctes: str) -> str:
    return f"WITH {ctes} SELECT '{test}' AS test, CAST({tested} AS BIGINT) AS tested, CAST({observed} AS BIGINT) AS observed, {verdict} AS verdict FROM {source}"


_HIST = f"hs AS (SELECT season, t, d, count(*) OVER (PARTITION BY season, t ORDER BY d {v.STRICT}) AS n, min(d) OVER (PARTITION BY season, t) AS f FROM gamelog)"


@query(_verdict("T1", "count(*)", "count(*) FILTER (WHERE d IS NULL)", "CASE WHEN count(*) FILTER (WHERE d IS NULL) > 0 THEN 'FAIL' ELSE 'PASS' END", "games", v.GAMES))
def leakage_t1(t: Tables) -> DataFrame:
    return leakage.t1_dated(v.games(t))


@query(_verdict("T2", "count(*)", "sum(n)", "'PASS'", "hs", f"{v.GAMELOG}, {_HIST}"))
def leakage_t2(t: Tables) -> DataFrame:
    return leakage.t2_strict(ledger.two_sided(v.games(t)), ["season", "t"])


@query(_verdict("T3", "sum(n)", "sum(n) FILTER (WHERE n > 1)", "'PASS'", "(SELECT count(*) AS n FROM games GROUP BY season, d)", v.GAMES))
def leakage_t3(t: Tables) -> DataFrame:
    return leakage.t3_same_day(v.games(t))


@query(_verdict("T4", "count(*)", "count(*) FILTER (WHERE n = 0)", "'PASS'", "hs", f"{v.GAMELOG}, {_HIST}"))
def leakage_t4(t: Tables) -> DataFrame:
    return leakage.t4_cold_starts(ledger.two_sided(v.games(t)), ["season", "t"])


@query(_verdict("T5", "count(*) FILTER (WHERE n > 0)", "sum(n)", "'PASS'", "(SELECT count(*) OVER (PARTITION BY season ORDER BY d RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM games)", v.GAMES))
def leakage_t5(t: Tables) -> DataFrame:
    return leakage.t5_future_pairs(v.games(t))


@query(_verdict("T6", "count(*)", "count(*) FILTER (WHERE x >= d)", "'LEAK DETECTED'", "(SELECT d, max(d) OVER (PARTITION BY season) AS x FROM games)", v.GAMES))
def leakage_t6(t: Tables) -> DataFrame:
    return leakage.t6_availability(v.games(t))


@query(_verdict("T7", "count(*)", "count(*) FILTER (WHERE n > 1)", "'LEAK DETECTED'", "(SELECT season, t, count(*) AS n FROM gamelog GROUP BY 1, 2)", v.GAMELOG))
def leakage_t7(t: Tables) -> DataFrame:
    return leakage.t7_constant(ledger.two_sided(v.games(t)))


@query(_verdict("T8", "count(*)", "count(*) FILTER (WHERE d = f AND n > 0)", "'PASS'", "hs", f"{v.GAMELOG}, {_HIST}"))
def leakage_t8(t: Tables) -> DataFrame:
    return leakage.t8_behaviour(ledger.two_sided(v.games(t)), ["season", "t"])


@query(_verdict("T8_TOTALS", "count(*)", "count(*) FILTER (WHERE n < total AND known = final AND final > 0)", "'PASS'", "x", f"""{v.GAMELOG},
x AS (SELECT count(*) OVER w AS n, coalesce(sum(pts) OVER w, 0) AS known, count(*) OVER (PARTITION BY season, t) AS total, sum(pts) OVER (PARTITION BY season, t) AS final FROM gamelog WINDOW w AS (PARTITION BY season, t ORDER BY d {v.STRICT}))"""))
def leakage_t8_totals(t: Tables) -> DataFrame:
    return leakage.t8_totals(ledger.two_sided(v.games(t)), ["season", "t"])


@query(_verdict("T7", "count(*)", "count(*) FILTER (WHERE n > 1 AND kinds = 1)", "CASE WHEN count(*) FILTER (WHERE n > 1 AND kinds = 1) > 0 THEN 'LEAK DETECTED' ELSE 'PASS' END", "k", f"""{v.GAMELOG},
x AS (SELECT season, t, coalesce(sum(pts) OVER (PARTITION BY season, t ORDER BY d {v.STRICT}), 0) AS known FROM gamelog), k AS (SELECT season, t, count(*) AS n, count(DISTINCT known) AS kinds FROM x GROUP BY 1, 2)"""))
def leakage_t7_probe(t: Tables) -> DataFrame:
    """The probe of end states, put to a feature that is known before the match."""
    log = ledger.two_sided(v.games(t), ["row_id"])
    return leakage.t7_constant(features.probe(log, log), "pts")


_MOVED = f"""{v.GAMES}, {_SAMPLE.format(n=100)},
cp AS (SELECT s.row_id AS sample_id, s.d AS o, s.h AS h0, s.a AS a0, g.row_id, g.season, g.d, g.h, g.a, vs.x, CASE WHEN g.row_id = s.row_id AND vs.x = 1 THEN 9 ELSE g.hg END AS hg, CASE WHEN g.row_id = s.row_id AND vs.x = 1 THEN 0 ELSE g.ag END AS ag
  FROM smp s JOIN games g ON g.season = s.season CROSS JOIN (VALUES (0), (1)) vs(x)),
{v.log_of('cl', 'cp', 'sample_id, o, h0, a0, x, row_id, ')},
rk AS (SELECT *, row_number() OVER (PARTITION BY sample_id, t, x ORDER BY d DESC, row_id DESC) AS r, venue = CASE WHEN t = h0 THEN 'home' ELSE 'away' END AS own FROM cl WHERE t IN (h0, a0) AND d < o),
sd AS (SELECT row_id AS sample_id, unnest([h, a]) AS t FROM smp),
ft AS (SELECT sd.sample_id, sd.t, vs.x, count(rk.t) AS mp, sum(pts) AS pts, sum(gf) AS gf, sum(ga) AS ga, sum(pts) FILTER (WHERE r <= 5) AS last5, count(rk.t) FILTER (WHERE own) AS venue_mp, sum(pts) FILTER (WHERE own) AS venue_pts, sum(pts) FILTER (WHERE r = 1) AS prev
  FROM sd CROSS JOIN (VALUES (0), (1)) vs(x) LEFT JOIN rk ON rk.sample_id = sd.sample_id AND rk.t = sd.t AND rk.x = vs.x GROUP BY 1, 2, 3),
mv AS (SELECT p.sample_id, p.t AS side, (p.mp, p.pts, p.gf, p.ga, p.last5, p.venue_mp, p.venue_pts, p.prev) IS DISTINCT FROM (q.mp, q.pts, q.gf, q.ga, q.last5, q.venue_mp, q.venue_pts, q.prev) AS changed
  FROM ft p JOIN ft q ON p.sample_id = q.sample_id AND p.t = q.t AND p.x = 0 AND q.x = 1)"""


@query(f"WITH {_MOVED} SELECT * FROM mv")
def perturbation_diff(t: Tables) -> DataFrame:
    games = v.games(t)
    return leakage.perturbed(games, leakage.stride_sample(games))


@query(_verdict("T9", "count(*)", "count(*) FILTER (WHERE changed)", "CASE WHEN count(*) FILTER (WHERE changed) > 0 THEN 'FAIL' ELSE 'PASS' END", "mv", _MOVED))
def leakage_t9(t: Tables) -> DataFrame:
    games = v.games(t)
    return leakage.t9_perturbation(games, leakage.stride_sample(games))


# -- evaluation ----------------------------------------------------------------------------------------------------


@query(f"WITH {v.LEDGER}, s AS (SELECT DISTINCT season FROM ledger) SELECT CAST(count(*) AS INT) AS fold, s.season AS test_season, string_agg(CAST(p.season AS VARCHAR), ',' ORDER BY p.season) AS train_seasons FROM s JOIN s p ON p.season < s.season GROUP BY 2")
def expanding_folds(t: Tables) -> DataFrame:
    return evaluate.folds(v.ledger(t)).select("fold", "test_season", F.array_join(F.col("train_seasons").cast("array<string>"), ",").alias("train_seasons"))


@query(f"WITH {v.LEDGER}, s AS (SELECT season, count(*) AS n FROM ledger GROUP BY 1) SELECT CAST(count(*) AS INT) AS fold, s.season AS test_season, CAST(sum(p.n) AS BIGINT) AS train_rows, s.n AS test_rows FROM s JOIN s p ON p.season < s.season GROUP BY s.season, s.n")
def fold_membership(t: Tables) -> DataFrame:
    return evaluate.membership(v.ledger(t))


@query("""
SELECT p_partkey, CASE WHEN p_size = 1 THEN 'not finite' WHEN p_size > 40 THEN 'negative' WHEN p_size > 35 THEN 'above one' WHEN p_size > 25 THEN 'sum' END AS violation FROM part""")
def proba_violations(t: Tables) -> DataFrame:
    s = F.col("p_size")
    third = F.lit(1 / 3)
    h = F.when(s == 1, F.lit(float("nan"))).when(s > 40, -0.1).when(s > 35, 1.4).when(s > 25, 0.3).otherwise(third)
    d = F.when(s > 40, 0.6).when(s > 35, 0.3).when(s > 25, 0.3).otherwise(third)
    a = F.when(s > 40, 0.5).when(s > 35, 0.3).when(s > 25, 0.3).otherwise(third)
    return t.part.select("p_partkey", h.alias("p_h"), d.alias("p_d"), a.alias("p_a")).select("p_partkey", evaluate.violation().alias("violation"))


_PRED = f"""{v.LEDGER}, lb AS (SELECT season, h, {v.RESULT} AS result FROM ledger), g AS (SELECT season, h, count(*) FILTER (WHERE result = 'H') AS nh, count(*) FILTER (WHERE result = 'D') AS nd, count(*) FILTER (WHERE result = 'A') AS na, count(*) AS n FROM lb GROUP BY 1, 2),
sh AS (SELECT s.season, x.h, (coalesce(sum(nh), 0) + 1) / (coalesce(sum(n), 0) + 3) AS ph, (coalesce(sum(nd), 0) + 1) / (coalesce(sum(n), 0) + 3) AS pd, (coalesce(sum(na), 0) + 1) / (coalesce(sum(n), 0) + 3) AS pa
  FROM (SELECT DISTINCT season FROM lb) s CROSS JOIN (SELECT DISTINCT h FROM lb) x LEFT JOIN g ON g.h = x.h AND g.season < s.season GROUP BY 1, 2),
pr AS (SELECT lb.season, lb.result, ph, pd, pa, CASE WHEN ph >= pd AND ph >= pa THEN 'H' WHEN pd >= pa THEN 'D' ELSE 'A' END AS pred, CASE result WHEN 'H' THEN ph WHEN 'D' THEN pd ELSE pa END AS own,
  (result = 'H')::INT AS oh, (result = 'D')::INT AS od, (result = 'A')::INT AS oa FROM lb JOIN sh ON sh.season = lb.season AND sh.h = lb.h WHERE lb.season > (SELECT min(season) FROM lb))"""
_F1 = " + ".join(f"CASE WHEN count(*) FILTER (WHERE result = '{c}') + count(*) FILTER (WHERE pred = '{c}') > 0 THEN 2 * count(*) FILTER (WHERE result = '{c}' AND pred = '{c}') / (count(*) FILTER (WHERE result = '{c}') + count(*) FILTER (WHERE pred = '{c}')) ELSE 0 END" for c in "HDA")
_REC = " + ".join(f"coalesce(count(*) FILTER (WHERE result = '{c}' AND pred = '{c}') / nullif(count(*) FILTER (WHERE result = '{c}'), 0), 0)" for c in "HDA")
_PRESENT = " + ".join(f"(count(*) FILTER (WHERE result = '{c}') > 0)::INT" for c in "HDA")
_METRICS = {
    "accuracy": "round(avg((pred = result)::INT), 9)",
    "balanced_accuracy": f"round(({_REC}) / ({_PRESENT}), 9)",
    "macro_f1": f"round(({_F1}) / 3, 9)",
    "log_loss": "round(-avg(ln(least(greatest(own, 1e-15), 1.0))), 9)",
    "brier_score": "round(avg(power(ph - oh, 2) + power(pd - od, 2) + power(pa - oa, 2)), 9)",
    "rps": "round(avg((power(ph - oh, 2) + power(ph + pd - oh - od, 2)) / 2), 9)",
}


def _metrics(t: Tables) -> DataFrame:
    return evaluate.metrics(evaluate.share_model(v.labelled(v.ledger(t))), ["season"])


def _metric_query(name: str, column: str) -> None:
    def run(t: Tables) -> DataFrame:
        return _metrics(t).select("season", F.round(column, 9).alias(column))

    run.__name__ = name
    query(f"WITH {_PRED} SELECT season, {_METRICS[column]} AS {column} FROM pr GROUP BY 1")(run)


for _name, _column in (("metric_accuracy", "accuracy"), ("metric_balanced_accuracy", "balanced_accuracy"), ("metric_macro_f1", "macro_f1"), ("metric_log_loss", "log_loss"), ("metric_brier", "brier_score"), ("metric_rps", "rps")):
    _metric_query(_name, _column)


@query(f"WITH {_PRED} SELECT season, count(*) AS n, {', '.join(f'{e} AS {c}' for c, e in _METRICS.items())} FROM pr GROUP BY 1")
def evaluate_bundle(t: Tables) -> DataFrame:
    return _metrics(t).select("season", "n", *[F.round(c, 9).alias(c) for c in _METRICS])


@query(f"WITH {v.LEDGER}, c AS (SELECT season, {v.RESULT} AS result, count(*) AS n FROM ledger GROUP BY 1, 2) SELECT season, result, n, round(n / sum(n) OVER (PARTITION BY season), 9) AS share FROM c")
def class_distribution(t: Tables) -> DataFrame:
    c = v.labelled(v.ledger(t)).groupBy("season", "result").agg(F.count("*").alias("n"))
    total = c.groupBy("season").agg(F.sum("n").alias("total"))
    return c.join(total, "season").select("season", "result", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))


@query(f"WITH {v.LEDGER} SELECT season, round(avg(({v.RESULT} = 'H')::INT), 9) AS always_home FROM ledger GROUP BY 1")
def constant_rule(t: Tables) -> DataFrame:
    return v.labelled(v.ledger(t)).groupBy("season").agg(F.round(F.avg((F.col("result") == "H").cast("double")), 9).alias("always_home"))
