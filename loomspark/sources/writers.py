"""Sinks by type: sqlite, csv, parquet, http_api. write() returns the rows written and the errors met."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sqlite


@dataclass
class Outcome:
    rows: int = 0
    errors: list[str] = field(default_factory=list)
    path: str | None = None


def flat(df: DataFrame) -> DataFrame:
    """Structs, lists and maps as JSON text, for sinks without nesting."""
    nested = {f.name: F.to_json(F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))}
    return df.withColumns(nested) if nested else df


def write_sqlite(df: DataFrame, config: dict) -> Outcome:
    """Into one table through one task and one transaction; the errors of batches that were left out are in the outcome."""
    sqlite.register(df.sparkSession)
    mode = config.get("write_mode", "append")
    if mode not in ("append", "replace"):
        raise ValueError(f"unknown write mode {mode!r}")
    options = {k: str(config[k]) for k in ("db_path", "table_name", "batch_size", "error_strategy") if config.get(k) is not None} | {"run_id": uuid.uuid4().hex}
    flat(df).coalesce(1).write.format("loomspark_sqlite").options(**options).mode("append" if mode == "append" else "overwrite").save()
    return Outcome(*sqlite.outcome(config["db_path"], options["run_id"]))


def write_csv(df: DataFrame, config: dict) -> Outcome:
    """One file under `export_dir`; for tables too large for one task give `single_file: false` and get a folder of parts."""
    folder = config.get("export_dir") or "exports"
    target = os.path.join(folder, os.path.basename(config.get("filename") or time.strftime("export_%Y%m%d_%H%M%S.csv")))
    single = config.get("single_file", True)
    parts = f"{target}.parts" if single else target
    out = flat(df).coalesce(1) if single else flat(df)
    out.write.mode("overwrite").option("sep", config.get("delimiter", ",")).option("encoding", config.get("encoding", "utf-8")).option("header", config.get("include_header", True)).option("emptyValue", "").option("escape", '"').csv(parts)
    if single:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        fs = path(parts).getFileSystem(sc._jsc.hadoopConfiguration())
        part = next(s.getPath() for s in fs.listStatus(path(parts)) if s.getPath().getName().startswith("part-"))
        fs.delete(path(target), True)
        fs.rename(part, path(target))
        fs.delete(path(parts), True)
    return Outcome(path=target)


def write_parquet(df: DataFrame, config: dict) -> Outcome:
    writer = df.write.mode({"append": "append", "replace": "overwrite"}[config.get("write_mode", "replace")])
    if config.get("partition_by"):
        writer = writer.partitionBy(*config["partition_by"])
    writer.parquet(config["path"])
    return Outcome(path=config["path"])


def write_http(df: DataFrame, config: dict) -> Outcome:
    """JSON arrays of `batch_size` rows, posted by the tasks that hold them. skip and retry make up to max_retries further
    attempts and go on; abort fails the task at once."""
    url, headers, size = config["url"], dict(config.get("headers") or {}), int(config.get("batch_size", 100))
    strategy, tries = config.get("error_strategy", "skip"), int(config.get("max_retries", 3)) + 1
    wait = config.get("timeout", 30)

    def post(lines: list[str]) -> str | None:
        error = None
        for _ in range(1 if strategy == "abort" else tries):
            request = urllib.request.Request(url, data=("[" + ",".join(lines) + "]").encode(), headers={"Content-Type": "application/json", **headers}, method="POST")
            try:
                with urllib.request.urlopen(request, timeout=wait):
                    return None
            except (urllib.error.URLError, OSError) as e:
                error = str(e)
        if strategy == "abort":
            raise RuntimeError(f"posting to {url} failed: {error}")
        return error

    def run(batches: Iterator) -> Iterator:
        sent, errors, held = 0, [], []
        for pdf in batches:
            held += pdf["value"].tolist()
            while len(held) >= size:
                some, held = held[:size], held[size:]
                e = post(some)
                sent, errors = sent + (0 if e else len(some)), errors + ([e] if e else [])
        if held:
            e = post(held)
            sent, errors = sent + (0 if e else len(held)), errors + ([e] if e else [])
        yield pd.DataFrame({"rows": [sent], "errors": [json.dumps(errors)]})

    done = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value")).mapInPandas(run, "rows long, errors string").collect()
    return Outcome(sum(r.rows for r in done), [e for r in done for e in json.loads(r.errors)])


WRITERS: dict[str, Callable[[DataFrame, dict], Outcome]] = {"sqlite": write_sqlite, "csv": write_csv, "parquet": write_parquet, "http_api": write_http}


def write(df: DataFrame, kind: str, config: dict) -> Outcome:
    if kind not in WRITERS:
        raise ValueError(f"unknown sink type {kind!r}")
    return WRITERS[kind](df, config)
