"""All registered queries of the library and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchline.plans import relational, temporal
from touchline.session import Tables


def _over_tables(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(Tables(spark, sf_dir))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _over_tables(f) for part in (relational, temporal) for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return relational.SQL | temporal.SQL
