"""Session factory and the small set of tables the registered queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "touchline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on: UTC, ANSI, adaptive execution."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


class Tables:
    """Tables of one folder as attributes: Tables(spark, path).orders."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")
