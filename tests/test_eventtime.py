"""Streams over files with late rows and repeats: restartable, and equal to the batch."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loomspark.streaming import eventtime

T0 = datetime(2024, 3, 1)
SCHEMA = "id long, kind string, at timestamp"


def add(spark, folder, rows):
    spark.createDataFrame([(i, k, T0 + timedelta(minutes=m)) for i, k, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def counts(df):
    return sorted((r.window_start, r.kind, r.n) for r in df.collect())


def test_windows_of_a_stream_equal_the_batch_over_restarts(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run():
        rows = eventtime.without_repeats(eventtime.file_stream(spark, folder, SCHEMA, max_files=1), ["id"], "at", "2 hours")
        eventtime.catch_up(eventtime.windowed(rows, "at", "10 minutes", ["kind"], {"n": F.count(F.lit(1))}), out, state)
        return counts(eventtime.current(spark, out, ["window_start", "kind"]))

    def batch():
        rows = spark.read.parquet(folder).dropDuplicates(["id"])
        return counts(eventtime.windowed(rows, "at", "10 minutes", ["kind"], {"n": F.count(F.lit(1))}))

    add(spark, folder, [(k, "ab"[k % 2], k) for k in range(60)])
    assert run() == batch()
    add(spark, folder, [(k, "ab"[k % 2], k) for k in range(50, 90)] + [(200, "a", 5)])  # repeats, and a row an hour late
    assert run() == batch() and run() == batch()
    add(spark, folder, [(k, "c", k) for k in range(300, 330)])
    before = batch()
    assert run() == before
    add(spark, folder, [(999, "a", 1)])  # five hours late: the state for it is gone, and so is the row
    assert run() == before != batch()


def test_sessions(spark):
    rows = [(1, "a", 0), (2, "a", 4), (3, "a", 10), (4, "b", 3), (5, "a", 11), (6, "b", 100)]
    df = spark.createDataFrame([(i, k, T0 + timedelta(minutes=m)) for i, k, m in rows], SCHEMA)
    got = sorted((r.kind, (r.session_start - T0).seconds // 60, (r.session_end - T0).seconds // 60, r.events) for r in eventtime.sessions(df, ["kind"], "at", "5 minutes").collect())
    assert got == [("a", 0, 4, 2), ("a", 10, 11, 2), ("b", 3, 3, 1), ("b", 100, 100, 1)]
    assert eventtime.sessions(df.limit(0), ["kind"], "at", "5 minutes").count() == 0
