"""Classification of tables by what they hold: type, perspective, coverage slot, and what a file name claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markers of each table type, in the order in which they are tried, the coverage slots, and the
# keywords of file names with two known misspellings.
TOP_LEVELS = "top"
RENDERED = "rendered"
TYPE_RULES = (
    ("Home/Away", {TOP_LEVELS: ("Home", "Away")}),
    ("Overall", {RENDERED: ("Attendance", "Top Team Scorer", "Pts")}),
    ("Goalkeeping", {RENDERED: ("Performance | SoTA", "Performance | Saves", "Performance | CS")}),
    ("Shooting", {RENDERED: ("Standard | Sh", "Standard | SoT", "Standard | G/Sh")}),
    ("Standard", {TOP_LEVELS: ("Per 90 Minutes",), RENDERED: ("Performance | Gls",)}),
    ("Playing Time", {TOP_LEVELS: ("Subs", "Team Success")}),
    ("Miscellaneous", {RENDERED: ("Performance | Fls", "Performance | Crs", "Performance | TklW")}),
)
LEAGUE_TYPES = ("Overall", "Home/Away")
PAIRED_TYPES = ("Standard", "Shooting", "Goalkeeping", "Playing Time", "Miscellaneous")
NAME_RULES = (
    ("Overall", ("overall",)),
    ("Home/Away", ("home", "away")),
    ("Goalkeeping", ("goalkeep",)),
    ("Shooting", ("shoot",)),
    ("Shooting", ("sthoot",)),
    ("Standard", ("standard",)),
    ("Playing Time", ("playing time",)),
    ("Miscellaneous", ("misc",)),
)
SLOTS = (*LEAGUE_TYPES, *(f"{t} {p}" for t in PAIRED_TYPES for p in ("Squad", "Opponent")))


def first_rule(rules: list[tuple[Column, str]], default: str = "UNKNOWN") -> Column:
    """The label of the first condition that holds."""
    out = None
    for condition, label in rules:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return F.lit(default) if out is None else out.otherwise(default)


def table_type(paths: Column) -> Column:
    """The type of a table from its column paths (array of arrays of level names)."""
    have = {TOP_LEVELS: F.transform(F.filter(paths, lambda p: F.size(p) > 1), lambda p: p[0]), RENDERED: F.transform(paths, lambda p: F.array_join(p, " | "))}
    rules = []
    for name, needs in TYPE_RULES:
        ok = F.lit(True)
        for where, markers in needs.items():
            ok = ok & (F.size(F.array_except(F.array(*map(F.lit, markers)), have[where])) == 0)
        rules.append((ok, name))
    return first_rule(rules)


def perspective(kind: Column, prefixed: Column, present: Column) -> Column:
    """League, Squad, Opponent or UNKNOWN from how many of the present team names carry the opponent prefix."""
    return first_rule([(kind.isin(*LEAGUE_TYPES), "League"), ((kind == "UNKNOWN") | (present == 0), "UNKNOWN"), (prefixed == present, "Opponent"), (prefixed == 0, "Squad")])


def slot(kind: Column, side: Column) -> Column:
    return F.when(kind.isin(*LEAGUE_TYPES) & (side == "League"), kind).when(kind.isin(*PAIRED_TYPES) & side.isin("Squad", "Opponent"), F.concat_ws(" ", kind, side)).otherwise("UNKNOWN")


def name_hint(name: Column) -> Column:
    """struct(kind, side): what a file name claims, by keywords."""
    low = F.lower(name)
    has = lambda words: F.forall(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    kind = first_rule([(has(words), k) for k, words in NAME_RULES])
    stem = F.trim(F.regexp_replace(low, r"\.[^.]*$", ""))
    side = F.when(kind == "UNKNOWN", "UNKNOWN").when(kind.isin(*LEAGUE_TYPES), "League").when(low.contains("oppon") | stem.endswith(" o"), "Opponent").otherwise("Squad")
    return F.struct(kind.alias("kind"), side.alias("side"))
