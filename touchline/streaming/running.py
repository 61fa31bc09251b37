"""Streaming forms: daily sums with a watermark, and features that become available a day later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def daily_totals(stream: DataFrame, key: str, ts: str, value: str, late: str = "1 day") -> DataFrame:
    """(key, day, n, total) by tumbling days; rows later than the watermark are dropped by Spark."""
    g = stream.withWatermark(ts, late).groupBy(key, F.window(ts, "1 day"))
    return g.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("window.start").cast("date").alias("day"), "n", "total")


def running_state(stream: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """(key, day, n_before, total_before, n, total): each day's rows with the sums of strictly earlier days.

    State per key is five numbers: committed sums, and the pending day's sums, which are committed
    when a later day arrives. Days are expected in order per key; earlier ones are answered from the
    committed sums and not added.
    """

    def step(k, pdfs, state):
        import pandas as pd

        n, total, pending, pn, pt = state.get if state.exists else (0, 0, -1, 0, 0)
        data = pd.concat(list(pdfs))
        out = []
        for d, group in data.groupby("_day"):
            d = int(d)
            if d > pending:
                n, total, pending, pn, pt = n + pn, total + pt, d, 0, 0
            own, s = len(group), int(group["_value"].sum())
            out.append((k[0], d, n, total, own, s))
            if d == pending:
                pn, pt = pn + own, pt + s
        state.update((n, total, pending, pn, pt))
        yield pd.DataFrame(out, columns=["key", "day", "n_before", "total_before", "n", "total"])

    rows = stream.select(F.col(key).cast("long").alias("_key"), F.datediff(F.col(day).cast("date"), F.lit("1970-01-01").cast("date")).alias("_day"), F.col(value).cast("long").alias("_value"))
    out = "key long, day int, n_before long, total_before long, n long, total long"
    made = rows.groupBy("_key").applyInPandasWithState(step, out, "n long, total long, pending int, pn long, pt long", "append", GroupStateTimeout.NoTimeout)
    return made.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")))
