import datetime as dt

from touchline.streaming import running


def test_running_state_commits_a_day_later(spark, tmp_path):
    src = tmp_path / "in"
    day = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, day, 3), (1, day + dt.timedelta(hours=5), 1), (1, day + dt.timedelta(days=1), 5), (2, day, 7)], "user_id long, ts timestamp, v long")
    df.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    q = running.running_state(stream, "user_id", "ts", "v").writeStream.format("memory").queryName("state").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.key, str(r.day)): (r.n_before, r.total_before, r.n, r.total) for r in spark.table("state").collect()}
    assert got == {(1, "2024-01-01"): (0, 0, 2, 4), (1, "2024-01-02"): (2, 4, 1, 5), (2, "2024-01-01"): (0, 0, 1, 7)}


def test_daily_totals(spark, tmp_path):
    src = tmp_path / "in"
    day = dt.datetime(2024, 1, 1, 10)
    df = spark.createDataFrame([(1, day, 3), (1, day + dt.timedelta(hours=1), 4), (1, day + dt.timedelta(days=5), 0)], "user_id long, ts timestamp, v long")
    df.coalesce(1).write.parquet(str(src))
    q = running.daily_totals(spark.readStream.schema(df.schema).parquet(str(src)), "user_id", "ts", "v").writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert (1, 2, 7) in {(r.user_id, r.n, r.total) for r in spark.table("daily").collect()}
