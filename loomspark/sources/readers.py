"""Sources by type: csv, parquet, json, sql, sqlite, http_api. read() gives a lazy DataFrame, preview() a few rows and the count."""

from __future__ import annotations

import json
import os
import tempfile
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sqlite_sql
from ..staging import shared_path
from . import http, sqlite

#: What a CSV field may hold for a missing value. Fixed values.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def tidy(df: DataFrame) -> DataFrame:
    """NaN in floating-point columns becomes null, so that both are one missing value."""
    out = {f.name: F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(out) if out else df


def read_csv(spark: SparkSession, config: dict) -> DataFrame:
    """`schema` (DDL) spares the pass that infers types; missing-value tokens become null in text columns."""
    header = config.get("has_header", True)
    reader = spark.read.option("sep", config.get("delimiter", ",")).option("encoding", config.get("encoding", "utf-8")).option("header", header).option("multiLine", config.get("multiline", False)).option("escape", '"')
    schema = config.get("schema")
    if schema:
        df = reader.schema(schema).csv(config["file_path"])
        df = df.select(*[_missing(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])
    else:
        df = reader.csv(config["file_path"])
        if not header:
            df = df.toDF(*[str(i) for i in range(len(df.columns))])
        df = df.select(*[_missing(c) for c in df.columns])
        df = _typed(df)
    return tidy(df)


def _missing(name: str):  # noqa: ANN202
    c = F.col(f"`{name}`")
    return F.when(~c.isin(MISSING), c).alias(name)


def _typed(df: DataFrame) -> DataFrame:
    """Each text column as bigint, double or boolean if all its values are: one pass over the data."""
    tests = {"long": lambda c: c.rlike(r"^\s*[+-]?\d+\s*$") & F.trim(c).try_cast("bigint").isNotNull(), "double": lambda c: c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), "bool": lambda c: c.rlike(r"^(True|False|TRUE|FALSE|true|false)$")}
    if not df.columns:
        return df
    asks = [F.min(F.when(F.col(f"`{c}`").isNotNull(), test(F.col(f"`{c}`")))).alias(f"{k}_{i}") for i, c in enumerate(df.columns) for k, test in tests.items()]
    told = df.agg(*asks).first()
    out = []
    for i, name in enumerate(df.columns):
        c = F.col(f"`{name}`")
        kind = next((k for k in tests if told[f"{k}_{i}"]), None)
        out.append({"long": F.trim(c).cast("bigint"), "double": F.trim(c).cast("double"), "bool": F.lower(c).cast("boolean"), None: c}[kind].alias(name))
    return df.select(*out)


def read_parquet(spark: SparkSession, config: dict) -> DataFrame:
    return tidy(spark.read.parquet(config["file_path"]))


def read_json(spark: SparkSession, config: dict) -> DataFrame:
    reader = spark.read.option("multiLine", config.get("multiline", False))
    return tidy((reader.schema(config["schema"]) if config.get("schema") else reader).json(config["file_path"]))


def read_sql(spark: SparkSession, config: dict) -> DataFrame:
    """A query over the session's tables and views; `views` maps further names to source configurations. `dialect` sqlite brings that
    engine's functions (functions/sqlite_sql.py)."""
    if config.get("dialect") == "sqlite":
        sqlite_sql.register(spark)
    for name, source in (config.get("views") or {}).items():
        read(spark, source["type"], source["config"]).createOrReplaceTempView(name)
    return spark.sql(config["query"])


def read_sqlite(spark: SparkSession, config: dict, schema: T.StructType | None = None) -> DataFrame:
    """`where` and `row_limit` go into the SQL that SQLite sees; a `schema` spares the pass that tells types, and names the columns."""
    if not config.get("query") and not config.get("table_name"):
        raise ValueError("a SQLite source needs a query or a table_name")
    sqlite.register(spark)
    options = {k: str(v) for k, v in config.items() if k in ("db_path", "query", "table_name", "partitions", "where", "row_limit") and v}
    reader = spark.read.format("loomspark_sqlite").options(**options)
    return tidy((reader if schema is None else reader.schema(schema)).load())


def fetch(config: dict, strict: bool = False) -> list:
    """The list at `data_path` of a JSON response. A key that isn't there is passed over, or with `strict` an error."""
    query = urllib.parse.urlencode(config.get("params") or {})
    url = config["url"] + (("&" if "?" in config["url"] else "?") + query if query else "")
    with urllib.request.urlopen(urllib.request.Request(url, headers=config.get("headers") or {}), timeout=config.get("timeout", 30)) as response:
        data = json.load(response)
    if isinstance(data, dict):
        for key in (config.get("data_path") or "data").split("."):
            if isinstance(data, dict) and key in data:
                data = data[key]
            elif strict:
                raise ValueError(f"the response has no {key!r}")
    if not isinstance(data, list):
        raise ValueError("the response's data isn't a list")
    return data


def _landing(spark: SparkSession) -> str:
    """A folder that executors see: the shared one where it is set, else (one machine) a temporary one."""
    return spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()


def read_http(spark: SparkSession, config: dict, strict: bool = False) -> DataFrame:
    """Landed once as JSON lines, so that later uses don't ask again; nested objects become structs. With `paging` the tasks
    fetch the pages and land them; without, one response is the driver's. `schema` (DDL) spares the pass that infers types."""
    if config.get("paging"):
        http.register(spark)
        path = shared_path(spark, "http")
        spark.read.format("loomspark_http").option("config", json.dumps(config)).load().write.text(path)
        reader = spark.read.schema(config["schema"]) if config.get("schema") else spark.read
        return tidy(reader.json(path))
    rows = fetch(config, strict)
    if not rows:
        return spark.createDataFrame([], T.StructType([]))
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    path = f"{_landing(spark)}/http-{uuid.uuid4().hex}"
    lines.write.text(path)
    return tidy(spark.read.json(path))


READERS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {"csv": read_csv, "parquet": read_parquet, "json": read_json, "sql": read_sql, "sqlite": read_sqlite, "http_api": read_http}


def read(spark: SparkSession, kind: str, config: dict) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"unknown source type {kind!r}")
    return READERS[kind](spark, config)


def preview(spark: SparkSession, kind: str, config: dict, limit: int = 10) -> tuple[list[str], list[dict], int]:
    """(columns, first rows, total): the limit goes to the scan, the total is a count of its own."""
    if kind in ("csv", "sqlite"):
        path = config.get("file_path") or config.get("db_path")
        if path and "://" not in path and not os.path.exists(path):
            raise FileNotFoundError(path)
    if kind == "http_api":
        rows = fetch(config, strict=True)
        return (list(dict.fromkeys(k for r in rows for k in r)), rows[:limit], len(rows))
    df = read(spark, kind, config)
    first = read_sqlite(spark, config | {"row_limit": limit}, df.schema) if kind == "sqlite" and limit > 0 else df
    return df.columns, [r.asDict(recursive=True) for r in first.limit(limit).collect()], df.count()


def list_csv_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, path, size) of the CSV files in a folder, by file listing alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("size"))


def store_upload(data: bytes, filename: str, folder: str) -> str:
    """Keeps an uploaded file under its bare name; folders in the name are dropped."""
    name = os.path.basename(filename.replace("\\", "/"))
    if not name or name in (".", ".."):
        raise ValueError(f"not a file name: {filename!r}")
    os.makedirs(folder, exist_ok=True)
    with open(path := os.path.join(folder, name), "wb") as f:
        f.write(data)
    return path


def stream_http(spark: SparkSession, config: dict) -> DataFrame:
    """A stream of a paged endpoint's rows as they are appended; `schema` (DDL) is needed."""
    http.register(spark)
    lines = spark.readStream.format("loomspark_http").option("config", json.dumps(config)).load()
    return lines.select(F.from_json("value", config["schema"]).alias("r")).select("r.*")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
