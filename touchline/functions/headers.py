"""Plan-time helpers over header paths: a column is a tuple of level names, flattened only on request."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

Path = tuple[str, ...]
_BLANK = {"", "nan"}


def as_path(column: str | Sequence[str]) -> Path:
    return (str(column),) if isinstance(column, str) else tuple(str(x) for x in column)


def flatten_plain(column) -> str:
    """Levels joined by "_", without those that contain "Unnamed"."""
    return "_".join(x for x in as_path(column) if "Unnamed" not in x)


def _named(column) -> list[str]:
    levels = [x.strip() for x in as_path(column)]
    return [x for x in levels if x.lower() not in _BLANK and not x.startswith("Unnamed:")] or levels


def flatten_named(column) -> str:
    """Trimmed levels joined by "_"; blank and unnamed ones only if there are no others."""
    return "_".join(_named(column))


def flatten_distinct(column) -> str:
    """As flatten_named, each level name once."""
    return "_".join(dict.fromkeys(_named(column)))


def clean_name(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"\s+", "_", name)).strip("_")


def render_path(column) -> str:
    return " | ".join(as_path(column))


def find_column(columns: Iterable, names: Iterable[str]):
    """The first column that is one of names, whatever the case and spacing."""
    norm = lambda s: " ".join(str(s).split()).lower()
    wanted = {norm(n) for n in names}
    return next((c for c in columns if norm(c) in wanted), None)


def find_team_column(columns: Iterable):
    """The column with a level named Squad or Team."""
    return next((c for c in columns if any(x.strip().lower() in ("squad", "team") for x in as_path(c))), None)


def path_index(columns: Iterable) -> dict[Path, int]:
    return {as_path(c): i for i, c in enumerate(columns)}
