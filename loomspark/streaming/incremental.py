"""Incremental loading: rows past a high-water mark, change logs by comparing snapshots, and the same as a stream.

A high-water mark here is the greatest value loaded so far, kept for each source; it isn't an event-time watermark.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..naming import fresh
from ..staging import shared_path

#: The field of a mark, and where the configuration names the column, by mode. Fixed values.
MODES = {"timestamp": ("last_timestamp", "timestamp_field"), "auto_increment_id": ("last_id", "id_field")}


class MarkStore:
    """Marks by source in one JSON file, replaced in a single step."""

    def __init__(self, path: str) -> None:
        self.path = path

    def all(self) -> dict[str, dict]:
        if not os.path.exists(self.path):
            return {}
        with open(self.path) as f:
            return json.load(f)

    def get(self, source: object) -> dict | None:
        return self.all().get(str(source))

    def put(self, source: object, kind: str, value: dict) -> dict:
        marks = self.all()
        marks[str(source)] = {"watermark_type": kind, "watermark_value": value, "last_sync_time": time.time()}
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        with open(f"{self.path}.new", "w") as f:
            json.dump(marks, f)
        os.replace(f"{self.path}.new", self.path)
        return marks[str(source)]

    def clear(self, source: object) -> None:
        marks = self.all()
        marks.pop(str(source), None)
        with open(f"{self.path}.new", "w") as f:
            json.dump(marks, f)
        os.replace(f"{self.path}.new", self.path)


def _column(df: DataFrame, config: dict) -> str | None:
    mode = MODES.get(config.get("mode", ""))
    name = config.get(mode[1]) if mode else None
    return name if name in df.columns else None


#: Ids at a mark's own moment that the mark itself holds; more are kept as a table.
IDS_IN_MARK = 10_000


def _tie(df: DataFrame, config: dict) -> str | None:
    """The column that tells rows of one moment apart, if the mark goes by both."""
    name = config.get("tie_field")
    return name if name in df.columns and config.get("mode") == "timestamp" else None


def _id_text(df: DataFrame, tie: str) -> Column:
    """An id as text; rows without one are alike."""
    return F.coalesce(F.col(f"`{tie}`").cast("string"), F.lit(""))


def _seen(df: DataFrame, at: Column, tie: str, mark: dict, keep: bool) -> DataFrame:
    """`df` with, of the rows where `at` holds, only those whose ids the mark names (`keep`), or only others."""
    if mark.get("ids_path"):
        ids, name = df.sparkSession.read.parquet(mark["ids_path"]), fresh("_seen_id", df)
        ids = ids.select(F.col("id").alias(name))
        here = df.filter(at).join(ids, _id_text(df, tie) == F.col(name), "left_semi" if keep else "left_anti")
        return df.filter(~F.coalesce(at, F.lit(False))).unionByName(here)
    named = _id_text(df, tie).isin(mark.get("ids_at") or [])
    return df.filter(~F.coalesce(at, F.lit(False)) | (named if keep else ~named))


def newer(df: DataFrame, config: dict, mark: dict | None) -> DataFrame:
    """Rows strictly past the mark; all rows if there is no mark, mode or column. The comparison reaches a Parquet scan.

    With a `tie_field` the mark is a moment and the ids loaded at it: rows of that very moment with other ids, which came late,
    are past it too. Rows of it without an id are past it until one such has been loaded.
    """
    name = _column(df, config)
    value = (mark or {}).get(MODES[config["mode"]][0]) if name else None
    if value is None:
        return df
    c, top, tie = F.col(f"`{name}`"), F.lit(value).cast(df.schema[name].dataType.simpleString()), _tie(df, config)
    if tie is None or not ("ids_at" in mark or "ids_path" in mark):
        return df.filter(c > top)
    return _seen(df.filter(c >= top), c == top, tie, mark, keep=False)


def next_mark(rows: DataFrame, config: dict, mark: dict | None) -> dict | None:
    """The mark after `rows`, which are past `mark` already; it never goes back."""
    name = _column(rows, config)
    if name is None:
        return mark
    top = rows.agg(F.max(f"`{name}`")).first()[0]
    if top is None:
        return mark
    text = top.isoformat(sep=" ") if isinstance(top, (datetime, date)) else top
    out, tie = {MODES[config["mode"]][0]: text}, _tie(rows, config)
    return out if tie is None else out | _ids_at(rows, config, name, tie, text, mark or {})


def _ids_at(rows: DataFrame, config: dict, name: str, tie: str, top: object, mark: dict) -> dict:
    """The ids loaded at the moment `top`, the earlier mark's among them if it is of that moment: named in the mark, or where they
    are many as a table in `ids_dir` (the shared folder where that isn't given)."""
    spark = rows.sparkSession
    at = rows.filter(F.col(f"`{name}`") == F.lit(top).cast(rows.schema[name].dataType.simpleString()))
    ids = at.select(_id_text(rows, tie).alias("id"))
    if mark.get("last_timestamp") == top:
        before = spark.read.parquet(mark["ids_path"]) if mark.get("ids_path") else spark.createDataFrame([(i,) for i in mark.get("ids_at") or []], "id string")
        ids = ids.unionByName(before)
    some = [r.id for r in ids.distinct().limit(IDS_IN_MARK + 1).collect()]
    if len(some) <= IDS_IN_MARK:
        return {"ids_at": sorted(some)}
    path = f"{config['ids_dir']}/ids-{uuid.uuid4().hex}" if config.get("ids_dir") else shared_path(spark, "ids")
    ids.distinct().write.parquet(path)
    return {"ids_path": path}


def sync(df: DataFrame, config: dict, store: MarkStore, source: object) -> tuple[DataFrame, Callable[[], dict | None]]:
    """(new rows, commit): the caller commits once the rows are safely written, so that none is lost or delivered twice.

    The next mark is taken first and bounds the rows: what arrives while they are written is left to the next call. With a
    `tie_field` that holds for rows of the mark's own moment too.
    """
    if not config.get("enabled", True):
        return df, lambda: None
    held = store.get(source)
    mark = held["watermark_value"] if held else None
    rows = newer(df, config, mark)
    after, name = next_mark(rows, config, mark), _column(df, config)
    if name is not None:
        c, value, tie = F.col(f"`{name}`"), (after or {}).get(MODES[config["mode"]][0]), _tie(df, config)
        top = F.lit(value).cast(df.schema[name].dataType.simpleString()) if value is not None else None
        past = c <= top if value is not None else F.lit(False)
        rows = rows.filter(past if mark else past | c.isNull())
        if tie is not None and value is not None:
            rows = _seen(rows, c == top, tie, after, keep=True)

    def commit() -> dict | None:
        return store.put(source, config["mode"], after) if after is not None and after != mark else held

    return rows, commit


def snapshot_changes(old: DataFrame, new: DataFrame, keys: list[str], table: str = "") -> DataFrame:
    """The change log between two snapshots: (table_name, operation_type, record_id, record_data, before_data).

    record_id joins the key's parts with '-'; the images are JSON. Rows are compared column by column, null-safely.
    """
    cols = [c for c in new.columns if c in old.columns]
    image = lambda side: F.to_json(F.struct(*[F.col(f"{side}.`{c}`").alias(c) for c in cols]), {"ignoreNullFields": "false"})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`"))
    there = fresh("_there", old, new)
    mark = lambda df, side: df.select(*[F.col(f"`{c}`") for c in cols], F.lit(True).alias(there)).alias(side)
    both = mark(old, "o").join(mark(new, "n"), on, "full")
    differs = F.lit(False)
    for c in cols:
        differs = differs | ~F.col(f"o.`{c}`").eqNullSafe(F.col(f"n.`{c}`"))
    kind = F.when(F.col(f"o.{there}").isNull(), "INSERT").when(F.col(f"n.{there}").isNull(), "DELETE").when(differs, "UPDATE")
    part = lambda k: F.coalesce(F.col(f"n.`{k}`"), F.col(f"o.`{k}`")).cast("string")
    out = both.select(
        F.lit(table).alias("table_name"), kind.alias("operation_type"), F.concat_ws("-", *[part(k) for k in keys]).alias("record_id"),
        F.when(kind == "DELETE", image("o")).otherwise(image("n")).alias("record_data"), F.when(kind == "UPDATE", image("o")).alias("before_data"),
    )
    return out.filter(F.col("operation_type").isNotNull())


def unsynced(log: DataFrame, table: str, since: int = 0) -> DataFrame:
    """Log rows of a table past a committed offset, in order of id."""
    return log.filter((F.col("table_name") == table) & (F.col("id") > since)).orderBy("id")


class ChangeFeed:
    """Tables whose changes are followed, and how far each one's log has been taken over."""

    def __init__(self, store: MarkStore, source: object) -> None:
        self.store, self.source = store, source

    def _key(self, table: str) -> str:
        return f"{self.source}:{table}"

    def enable(self, table: str) -> bool:
        """Starts following a table at the log's beginning; a table that is followed already stays where it is."""
        if self.store.get(self._key(table)) is None:
            self.store.put(self._key(table), "cdc", {"last_log_id": 0})
        return True

    def disable(self, table: str) -> None:
        self.store.clear(self._key(table))

    def enabled(self, table: str) -> bool:
        return self.store.get(self._key(table)) is not None

    def changes(self, log: DataFrame, table: str) -> tuple[DataFrame, Callable[[], int]]:
        """(log rows not taken over yet, commit): commit moves on past these rows, not past later ones."""
        held = self.store.get(self._key(table))
        if held is None:
            raise KeyError(f"changes of {table!r} aren't followed")
        since = held["watermark_value"]["last_log_id"]
        top = log.filter(F.col("table_name") == table).agg(F.max("id")).first()[0] or since
        rows = unsynced(log, table, since).filter(F.col("id") <= top)

        def commit() -> int:
            self.store.put(self._key(table), "cdc", {"last_log_id": max(top, since)})
            return max(top, since)

        return rows, commit


def latest_images(log: DataFrame, schema: str, order: str = "id") -> DataFrame:
    """The last change of each record, deletions left out, as columns: what applying the log to an empty table gives."""
    last = log.groupBy("record_id").agg(F.max_by(F.struct("operation_type", "record_data"), F.col(order)).alias("x"))
    return last.filter(F.col("x.operation_type") != "DELETE").select(F.from_json("x.record_data", schema).alias("r")).select("r.*")


def apply_changes(base: DataFrame, log: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """`base` after the log: changed records replaced, deleted ones gone, new ones added."""
    images, id_ = latest_images(log, base.schema.simpleString(), order), fresh("_record", base)
    record: Column = F.concat_ws("-", *[F.col(f"`{k}`").cast("string") for k in keys])
    touched = log.select(F.col("record_id").alias(id_)).distinct()
    return base.join(touched, record == F.col(id_), "left_anti").unionByName(images.select(*[F.col(f"`{c}`") for c in base.columns]))


def stream_new_files(spark: SparkSession, path: str, schema, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:  # noqa: ANN001
    """Everything in Parquet files that came since the last run, once each: the stream stops when it has caught up."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
