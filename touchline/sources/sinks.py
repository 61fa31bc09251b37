"""Report sinks: CSV with a fixed column order, JSON specifications, exit codes, capped listings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from touchline.operators.checks import EXIT_CODES


def write_csv(df: DataFrame, path: str, fields: list[str], one_file: bool = True) -> None:
    """one_file is for reports; large results stay in as many files as they have partitions."""
    out = df.select(*fields)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).csv(path)


def write_curated(df: DataFrame, path: str, by: str = "season") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def specification(rows: DataFrame, most: int = 1000) -> str:
    """A small table (at most `most` rows) as indented JSON."""
    return json.dumps([r.asDict(recursive=True) for r in rows.limit(most).collect()], indent=2, default=str)


def listing(df: DataFrame, most: int = 12) -> list[str]:
    """The first rows as text, and how many more there are."""
    rows = [" | ".join("" if v is None else str(v) for v in r) for r in df.limit(most).collect()]
    more = df.count() - len(rows)
    return rows + ([f"... and {more} more"] if more > 0 else [])


def exit_code(verdict: str) -> int:
    return EXIT_CODES.get(verdict, EXIT_CODES["FATAL"])
