"""Scalar expressions: scores, integers, names, results, keys. All native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points for a win, a draw and a loss.
WIN, DRAW, LOSS = 3, 1, 0


def _clean_text(x: Column) -> Column:
    return F.trim(x.cast("string"))


def strict_int(x: Column) -> Column:
    """A whole number written as one ("73", "+73", "73.0", "3,420"), else null; never rounded."""
    text = F.regexp_replace(F.regexp_replace(_clean_text(x), ",", ""), r"^\+", "")
    value = F.when(text.rlike(r"^-?[0-9]+(\.[0-9]*)?$"), text).try_cast("double")
    return F.when(value == F.floor(value), value.cast("bigint"))


def tolerant_int(x: Column) -> Column:
    """A number's whole part, or null where the text is no finite number."""
    value = _clean_text(x).try_cast("double")
    return F.when(F.abs(value) < float("inf"), F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("bigint"))


def try_number(x: Column) -> Column:
    """A number, or null where the text is none (NaN too)."""
    value = F.regexp_replace(_clean_text(x), ",", "").try_cast("double")
    return F.when(~F.isnan(value), value)


def _pair(left: Column, right: Column) -> Column:
    return F.when(left.isNotNull() & right.isNotNull(), F.struct(left.cast("int").alias("home"), right.cast("int").alias("away")))


def parse_score(score: Column, decimals: bool = True, negatives: bool = False) -> Column:
    """The canonical parser: struct(home, away) or null.

    The text must be exactly two whole numbers around one separator (en dash, em dash or hyphen).
    decimals: "2.0" counts as 2. negatives: a leading minus is a sign where a dash separates.
    """
    tail = r"(?:\.0*)?" if decimals else ""
    plain = rf"^\s*\+?(\d+){tail}\s*[–—-]\s*\+?(\d+){tail}\s*$"
    signed = rf"^\s*\+?(-?\d+){tail}\s*[–—]\s*\+?(-?\d+){tail}\s*$"
    text = score.cast("string")
    return F.coalesce(_extract(text, plain), _extract(text, signed)) if negatives else _extract(text, plain)


def _extract(text: Column, pattern: str) -> Column:
    found = text.rlike(pattern)
    return _pair(F.when(found, F.regexp_extract(text, pattern, 1)).try_cast("int"), F.when(found, F.regexp_extract(text, pattern, 2)).try_cast("int"))


def parse_score_lenient(score: Column) -> Column:
    """Unanchored: the first digits-separator-digits, hyphen before en dash before em dash before a mangled dash."""
    text = score.cast("string")
    return F.coalesce(*[_extract(text, rf"(\d+)\s*{sep}\s*(\d+)") for sep in ("-", "–", "—")], _extract(text, "(\\d+)\\s*â.{0,3}(\\d+)"))


def parse_score_digits(score: Column) -> Column:
    """Any two runs of digits with something else between them."""
    return _extract(score.cast("string"), r"(\d+)\D+(\d+)")


def parse_score_anchored(score: Column) -> Column:
    """The whole text is a score once dashes (mangled ones too) are made hyphens."""
    text = F.translate(F.replace(score.cast("string"), F.lit("â€“"), F.lit("-")), "–—", "--")
    return _extract(text, r"^\s*(\d+)\s*-\s*(\d+)\s*$")


def parse_score_within(score: Column) -> Column:
    """A score anywhere in the text, once dashes (mangled ones too) are made hyphens."""
    text = F.translate(F.replace(score.cast("string"), F.lit("â€“"), F.lit("-")), "–—", "--")
    return _extract(text, r"(\d+)\s*-\s*(\d+)")


def parse_score_split(score: Column) -> Column:
    """Cut at hyphens (dashes made hyphens); both first parts read as numbers where they are."""
    parts = F.split(F.translate(score.cast("string"), "–—", "--"), "-")
    side = lambda i: F.when(F.floor(try_number(F.get(parts, F.lit(i)))) == try_number(F.get(parts, F.lit(i))), try_number(F.get(parts, F.lit(i)))).cast("int")
    return _pair(side(0), side(1))


def result_label(home: Column, away: Column) -> Column:
    return F.when(home > away, "H").when(home < away, "A").when(home == away, "D")


def points(gf: Column, ga: Column) -> Column:
    return F.when(gf > ga, WIN).when(gf == ga, DRAW).when(gf < ga, LOSS)


def match_key(season: Column, date: Column, home: Column, away: Column) -> Column:
    return F.concat_ws("|", season.cast("string"), F.date_format(date, "yyyy-MM-dd"), home.cast("string"), away.cast("string"))


def squash(text: Column) -> Column:
    """Trimmed, with single spaces."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def team_key(text: Column) -> Column:
    """A team's name without the opponent prefix."""
    return F.regexp_replace(F.trim(text), r"^vs\s+", "")


def season_of(name: Column) -> Column:
    """"2021-2022" from a file name, or null."""
    return F.nullif(F.concat_ws("-", F.nullif(F.regexp_extract(name, r"(\d{4})\s*-\s*(\d{4})", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"(\d{4})\s*-\s*(\d{4})", 2), F.lit(""))), F.lit(""))


def signature(paths: Column) -> Column:
    """16 hexadecimal digits that identify a schema: the ordered column paths as JSON."""
    return F.substring(F.md5(F.to_json(paths).cast("binary")), 1, 16)
