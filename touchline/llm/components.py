"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import common


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands its larger (or smaller) neighbours to the smallest node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    met = both.join(least, "a")
    if large:  # a row an edge, so repeats can wait for the small stars
        return met.filter((F.col("b") > F.col("a")) & (F.col("b") != F.col("m"))).select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def nearby(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node within two edges, for every node of an edge (a, b).

    Nodes of one label are connected, and a star has one label; it takes two rounds, however long chains are.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = common.materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "nearest")
    return both.join(least.toDF("b", "m"), "b").groupBy(F.col("a").alias("node")).agg(F.min("m").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of its component, for every node of an edge (a, b).

    Every round is written to shared storage; only two sums come to the driver.
    """
    now = common.materialize(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    last = None
    while True:
        before, now = now, common.materialize(_stars(_stars(now, True), False), "stars")
        common.discard(before)
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
