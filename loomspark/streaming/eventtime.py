"""Event-time state: windows and repeats over streams of files, with late rows, restartable and equal to the batch result.

A watermark bounds the state: what came with an event time further back than `delay` behind the latest seen isn't counted any
more. Each run takes what is new (availableNow) and ends; state and progress are in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_stream(spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str = "*.parquet", max_files: int | None = None) -> DataFrame:
    """Parquet files of a folder as they come; `max_files` of them in a batch at most."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(folder)


def without_repeats(stream: DataFrame, ids: Sequence[str], at: str, delay: str) -> DataFrame:
    """One row of each id; ids are remembered for `delay` of event time, so a repeat that comes later than that counts anew."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(ids))


def windowed(df: DataFrame, at: str, width: str, keys: Sequence[str], aggregates: dict[str, Column], slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Aggregates of each key and window of event time: window_start, window_end, keys, results. The same on a batch and a stream,
    which needs the `delay` that its state waits for late rows."""
    rows = df.withWatermark(at, delay) if delay else df
    window = F.window(F.col(f"`{at}`").cast("timestamp") if not df.isStreaming else F.col(f"`{at}`"), width, slide or width)
    out = rows.groupBy(window.alias("w"), *[F.col(f"`{k}`") for k in keys]).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[F.col(f"`{k}`") for k in keys], *[F.col(f"`{n}`") for n in aggregates])


def catch_up(results: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream of updates over all that is new and appends what changed, with the batch's number, to the table at `path`.

    A batch that is run again after a failure replaces its own rows: they are in a folder of the batch's number.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = results.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last state of each key of a table of updates: what its latest batch said."""
    updates = spark.read.parquet(path)
    row = F.struct(*[F.col(f"`{c}`") for c in updates.columns if c != "batch"])
    return updates.groupBy(*[F.col(f"`{k}`").alias(f"_{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, "batch").alias("row")).select("row.*")


def sessions(df: DataFrame, keys: Sequence[str], at: str, gap: str) -> DataFrame:
    """keys, session_start, session_end, events: rows of a key with less than `gap` between one and the next are one session. A batch;
    session windows merge in partial aggregates, so a key's rows needn't be in one task before they are merged."""
    window = F.session_window(F.col(f"`{at}`").cast("timestamp"), gap)
    out = df.groupBy(window.alias("w"), *[F.col(f"`{k}`") for k in keys]).agg(F.max(F.col(f"`{at}`")).alias("last"), F.count(F.lit(1)).alias("events"))
    return out.select(*[F.col(f"`{k}`") for k in keys], F.col("w.start").alias("session_start"), F.col("last").alias("session_end"), "events")
