"""All queries of the library and their SQL twins, by name.

Each query is a callable of (spark, folder of Parquet tables). Its twin is SQL that gives the same rows on the same tables.
Sums and means of floating-point columns are rounded on both sides; the tables have no missing values of their own, so the
queries that need some make them from the data.
"""

from __future__ import annotations

import os
import re
import sqlite3
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expr
from .operators import frames, ordering, quality, quantiles, relational, sketches, temporal
from .plans import lineage, runtime, sql_lineage, templates, workflow
from .sources import readers, writers
from .staging import shared_path
from .streaming import digests, eventtime, incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return readers.read(spark, "parquet", {"file_path": f"{sf}/{name}.parquet"})


def _money(df: DataFrame, **cols: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in cols.items()})


# sources, the flagship, SQL


@query("SELECT c_mktsegment, round(sum(o_totalprice), 2) AS revenue, count(o_orderkey) AS orders, round(avg(o_totalprice), 2) AS avg_price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def flagship_join_agg_sort(spark: SparkSession, sf: str) -> DataFrame:
    """A whole declared pipeline, folded to one plan: two sources, join, aggregate, sort."""
    source = lambda key, name: {"id": key, "type": "source", "data": {"config": {"source_type": "parquet", "source_config": {"file_path": f"{sf}/{name}.parquet"}}}}
    aggs = [{"column": "o_totalprice", "function": "sum", "alias": "revenue"}, {"column": "o_orderkey", "function": "count", "alias": "orders"}, {"column": "o_totalprice", "function": "avg", "alias": "avg_price"}]
    spec = {
        "nodes": [
            source("orders", "orders"), source("customers", "customer"),
            {"id": "joined", "type": "join", "data": {"config": {"join_type": "inner", "left_key": "o_custkey", "right_key": "c_custkey"}}},
            {"id": "summed", "type": "aggregate", "data": {"config": {"group_by": ["c_mktsegment"], "aggregations": aggs}}},
            {"id": "rounded", "type": "map", "data": {"config": {"operations": [{"type": "compute", "new_column": c, "expression": f"{c}.round(2)"} for c in ("revenue", "avg_price")]}}},
            {"id": "sorted", "type": "sort", "data": {"config": {"sort_by": [{"column": "revenue", "ascending": False}]}}},
        ],
        "edges": [{"source": a, "target": b} for a, b in (("orders", "joined"), ("customers", "joined"), ("joined", "summed"), ("summed", "rounded"), ("rounded", "sorted"))],
    }
    return runtime.build(spark, spec)["sorted"]


@query("SELECT * FROM nation")
def scan_parquet(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "nation")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 10")
def preview_limit(spark: SparkSession, sf: str) -> DataFrame:
    return relational.top_k(_t(spark, sf, "nation"), {"sort_by": [{"column": "n_nationkey"}]}, 10).select("n_nationkey", "n_name")


_SQL = {
    "sql_source": "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 1",
    "sql_window": "SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS nth, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before_key, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS quarter FROM orders",
    "sql_setops": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 FROM region EXCEPT SELECT r_regionkey FROM region WHERE r_regionkey = 1",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "sql_recursive_cte": "WITH RECURSIVE t(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 20) SELECT n, total FROM t",
    "sql_exists": "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 150000)",
    "sql_anti": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "sql_in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "sql_scalar_functions": "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, CAST(length(n_name) AS BIGINT) AS len, substr(n_name, 2, 3) AS part, replace(n_name, 'A', '_') AS r, coalesce(nullif(n_regionkey, 0), -1) AS k, CASE WHEN n_regionkey > 2 THEN 'high' ELSE 'low' END AS side, abs(n_regionkey - 3) AS d, greatest(n_regionkey, 2) AS g FROM nation",
    "sql_group_filter": "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS many, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag",
    "sql_theta_join": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "sql_limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40",
}
for _name, _text in _SQL.items():

    def _run(spark: SparkSession, sf: str, text: str = _text) -> DataFrame:
        views = {t: {"type": "parquet", "config": {"file_path": f"{sf}/{t}.parquet"}} for t in ("region", "nation", "customer", "supplier", "orders", "lineitem") if t in text}
        return readers.read(spark, "sql", {"query": text, "views": views})

    QUERIES[_name], ORACLES[_name] = _run, _text


def _scratch(spark: SparkSession) -> str:
    """A folder for files that SQLite opens by path: in the shared folder where that is a mounted one, else (its store has no paths) the
    driver's own."""
    path = re.sub("^file:/*", "/", shared_path(spark, "scratch"))
    if ":" in path:
        return tempfile.mkdtemp(prefix="loomspark-")
    os.makedirs(path, exist_ok=True)
    return path


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sink_sqlite_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    db = os.path.join(_scratch(spark), "x.db")
    writers.write(_t(spark, sf, "nation"), "sqlite", {"db_path": db, "table_name": "nation", "write_mode": "replace"})
    back = readers.read(spark, "sqlite", {"db_path": db, "table_name": "nation"})
    return back.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY n_regionkey")
def source_sqlite_query(spark: SparkSession, sf: str) -> DataFrame:
    db = os.path.join(_scratch(spark), "x.db")
    writers.write(_t(spark, sf, "nation"), "sqlite", {"db_path": db, "table_name": "nation", "write_mode": "replace"})
    back = readers.read(spark, "sqlite", {"db_path": db, "query": "SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY n_regionkey"})
    return back.select(F.col("n_regionkey").cast("int").alias("n_regionkey"), "nations")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def sink_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    done = writers.write(_t(spark, sf, "nation"), "csv", {"export_dir": _scratch(spark), "filename": "nation.csv"})
    return readers.read(spark, "csv", {"file_path": done.path})


# filter


def _gaps(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))


_GAPS = "(SELECT *, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)"


def _filter(condition: str, where: str, name: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return relational.filter_rows(_gaps(_t(spark, sf, "events")), {"condition": condition}).select("event_id", "event_type", "v")

    QUERIES[name], ORACLES[name] = run, f"SELECT event_id, event_type, v FROM {_GAPS} WHERE {where}"


_filter("v > 20 && event_type == 'click' || event_id < 10", "(v > 20 AND event_type = 'click') OR event_id < 10", "filter_and_or")
_filter("v != 5 AND event_type != 'AND OR'", "v IS DISTINCT FROM 5 AND event_type <> 'AND OR'", "filter_ne_null")
_filter("not (v > 20)", "NOT coalesce(v > 20, false)", "filter_not_null_logic")
_filter("event_type in ['click', 'view'] and event_id not in [1, 2, 3]", "event_type IN ('click', 'view') AND event_id NOT IN (1, 2, 3)", "filter_in_list")
_filter("v.notnull()", "v IS NOT NULL", "filter_notnull")
_filter("v.isnull() | ~(v < 50)", "v IS NULL OR NOT coalesce(v < 50, false)", "filter_isnull_invert")
_filter("10 < v <= 40", "10 < v AND v <= 40", "filter_chained_cmp")
_filter("v.between(10, 20) or `event_type`.str.startswith('p')", "v BETWEEN 10 AND 20 OR event_type LIKE 'p%'", "filter_methods")
_filter("", "true", "filter_empty")


# map


def _map(table: str, operations: list[dict], columns: list[str], sql: str, name: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return relational.map_columns(_t(spark, sf, table), {"operations": operations}).select(*columns)

    QUERIES[name], ORACLES[name] = run, sql


def _compute(**cols: str) -> list[dict]:
    return [{"type": "compute", "new_column": c, "expression": e} for c, e in cols.items()]


def _cast(column: str, target: str) -> list[dict]:
    return [{"type": "type_convert", "column": column, "target_type": target}, {"type": "type_convert", "column": "not_there", "target_type": "int"}]


_map("nation", [{"type": "rename", "old_name": "n_name", "new_name": "name"}, {"type": "rename", "old_name": "gone", "new_name": "x"}, {"type": "unknown"}], ["n_nationkey", "name"], "SELECT n_nationkey, n_name AS name FROM nation", "map_rename")
_map("lineitem", _cast("l_extendedprice", "int"), ["l_orderkey", "l_linenumber", "l_extendedprice"], "SELECT l_orderkey, l_linenumber, trunc(l_extendedprice)::BIGINT AS l_extendedprice FROM lineitem", "map_cast_int")
_map("part", _cast("p_size", "float"), ["p_partkey", "p_size"], "SELECT p_partkey, p_size::DOUBLE AS p_size FROM part", "map_cast_float")
_map("orders", _cast("o_orderkey", "string"), ["o_orderkey"], "SELECT o_orderkey::VARCHAR AS o_orderkey FROM orders", "map_cast_string")
_map("part", [*_compute(over="p_size - 25"), *_cast("over", "bool"), *_cast("p_brand", "bool")], ["p_partkey", "over", "p_brand"], "SELECT p_partkey, p_size <> 25 AS over, length(p_brand) > 0 AS p_brand FROM part", "map_cast_bool")
_map("orders", [*_cast("o_orderdate", "string"), *_cast("o_orderdate", "datetime"), *_compute(y="o_orderdate.dt.year", m="o_orderdate.dt.month")], ["o_orderkey", "y", "m"], "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m FROM orders", "map_cast_datetime")
_map(
    "lineitem", _compute(net="(l_extendedprice * (1 - l_discount)).round(2)", m="l_linenumber % 3", neg="(0 - l_linenumber) % 3", fl="(0 - l_linenumber) // 2", p="(l_linenumber ** 2)", none="l_linenumber / (l_linenumber - l_linenumber)"),
    ["l_orderkey", "l_linenumber", "m", "neg", "fl", "p", "none"],
    "SELECT l_orderkey, l_linenumber, (l_linenumber % 3)::BIGINT AS m, ((-l_linenumber) - 3 * floor(-l_linenumber / 3.0))::BIGINT AS neg, floor(-l_linenumber / 2.0)::BIGINT AS fl, power(l_linenumber, 2) AS p, NULL::DOUBLE AS none FROM lineitem", "map_compute_arith",
)
_map("nation", _compute(label="n_name + '-' + n_name.str.lower()", size="n_name.str.len()", part="n_name.str.slice(0, 3)", has="n_name.str.contains('AN|IN')", swapped="n_name.str.replace('A', 'a')"), ["n_nationkey", "label", "size", "part", "has", "swapped"], "SELECT n_nationkey, n_name || '-' || lower(n_name) AS label, length(n_name)::INT AS size, substr(n_name, 1, 3) AS part, regexp_matches(n_name, 'AN|IN') AS has, replace(n_name, 'A', 'a') AS swapped FROM nation", "map_compute_string")
_map("part", _compute(r="sqrt(p_size).round(6)", e="log10(p_size).round(6)", c="p_size.clip(10, 20)", s="floor(p_retailprice)", bad="log(p_size - p_size - 1)"), ["p_partkey", "r", "e", "c", "s", "bad"], "SELECT p_partkey, round(sqrt(p_size), 6) AS r, round(log10(p_size), 6) AS e, least(greatest(p_size, 10), 20) AS c, floor(p_retailprice)::BIGINT AS s, NULL::DOUBLE AS bad FROM part", "map_compute_math")
_map("orders", _compute(d="o_orderdate.dt.day", w="o_orderdate.dt.dayofweek", q="o_orderdate.dt.quarter", h="o_orderdate.dt.hour"), ["o_orderkey", "d", "w", "q", "h"], "SELECT o_orderkey, day(o_orderdate)::INT AS d, (isodow(o_orderdate) - 1)::INT AS w, quarter(o_orderdate)::INT AS q, hour(o_orderdate)::INT AS h FROM orders", "map_compute_date")
_map("events", _compute(flag="not (value > 50)", big="value > 50 and event_id > 100", filled="value.fillna(0).round(3)"), ["event_id", "flag", "big", "filled"], "SELECT event_id, NOT coalesce(value > 50, false) AS flag, coalesce(value > 50, false) AND event_id > 100 AS big, round_even(coalesce(value, 0), 3) AS filled FROM events", "map_compute_bool")


# branch

_ROUTES = [{"name": "big", "condition": "value > 60"}, {"name": "clicks", "condition": "event_type == 'click' or value > 40"}]


def _routed(spark: SparkSession, sf: str, routes: list[dict]) -> DataFrame:
    out = relational.branch(_t(spark, sf, "events"), {"branches": routes})
    return readers.union_all([df.select(F.lit(k).alias("branch"), "event_id") for k, df in out.items()])


_ROUTE = "CASE WHEN value > 60 THEN 'branch_0' WHEN event_type = 'click' OR value > 40 THEN 'branch_1'{} END"


@query(f"SELECT branch, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (SELECT {_ROUTE.format(' ELSE ' + chr(39) + 'branch_2' + chr(39))} AS branch, event_id FROM events) GROUP BY branch")
def branch_first_match(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, sf, [*_ROUTES, {"name": "rest", "condition": ""}]).groupBy("branch").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT event_id FROM events WHERE NOT (value > 60) AND NOT (event_type = 'click' OR value > 40)")
def branch_default(spark: SparkSession, sf: str) -> DataFrame:
    return relational.branch(_t(spark, sf, "events"), {"branches": [*_ROUTES, {"condition": ""}]})["branch_2"].select("event_id")


@query(f"SELECT branch, event_id FROM (SELECT {_ROUTE.format('')} AS branch, event_id FROM events) WHERE branch IS NOT NULL")
def branch_drop_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, sf, _ROUTES)


# join


def _join_query(name: str, left: str, right: str, config: dict, columns: list[str], sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return relational.join(readers.read(spark, "sql", {"query": left, "views": _views(sf, left)}), readers.read(spark, "sql", {"query": right, "views": _views(sf, right)}), config).select(*columns)

    QUERIES[name], ORACLES[name] = run, sql


def _views(sf: str, text: str) -> dict:
    return {t: {"type": "parquet", "config": {"file_path": f"{sf}/{t}.parquet"}} for t in ("region", "nation", "customer", "supplier", "orders", "lineitem", "events", "part") if f" {t}" in text}


_SOME = "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 3 = 0"
_BOTH = ["o_orderkey", "c_custkey", "c_name"]
_ORDERS = "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 5 <> 0"
for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    _join_query(f"join_{_how}", _ORDERS, _SOME, {"join_type": _how, "left_key": "o_custkey", "right_key": "c_custkey"}, _BOTH, f"SELECT o_orderkey, c_custkey, c_name FROM ({_ORDERS}) {_sql} ({_SOME}) ON o_custkey = c_custkey")
_join_query("join_cross", "SELECT r_regionkey FROM region", "SELECT n_nationkey FROM nation", {"join_type": "cross"}, ["r_regionkey", "n_nationkey"], "SELECT r_regionkey, n_nationkey FROM region, nation")
_join_query("join_natural", "SELECT n_nationkey AS k, n_name FROM nation", "SELECT c_nationkey AS k, c_custkey FROM customer", {}, ["k", "n_name", "c_custkey"], "SELECT n_nationkey AS k, n_name, c_custkey FROM nation JOIN customer ON n_nationkey = c_nationkey")
_join_query("join_multikey", "SELECT l_orderkey AS ok, l_linenumber AS ln, l_quantity FROM lineitem", "SELECT l_orderkey AS ok, l_linenumber AS ln, l_tax FROM lineitem WHERE l_linenumber < 3", {"left_key": ["ok", "ln"], "right_key": ["ok", "ln"]}, ["ok", "ln", "l_quantity", "l_tax"], "SELECT a.l_orderkey AS ok, a.l_linenumber AS ln, a.l_quantity, b.l_tax FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE b.l_linenumber < 3")
_NULLED = "SELECT n_nationkey, CASE WHEN n_regionkey > 1 THEN n_regionkey END AS k FROM nation"
_NULLED2 = "SELECT r_name, CASE WHEN r_regionkey > 0 THEN r_regionkey END AS k FROM region"
_join_query("join_nullsafe", _NULLED, _NULLED2, {"left_key": "k", "right_key": "k"}, ["n_nationkey", "k", "r_name"], f"SELECT n_nationkey, a.k, r_name FROM ({_NULLED}) a JOIN ({_NULLED2}) b ON a.k IS NOT DISTINCT FROM b.k")
_join_query("join_suffix", "SELECT o_orderkey AS id, o_custkey, o_totalprice AS amount FROM orders", "SELECT c_custkey AS id, c_acctbal AS amount FROM customer", {"left_key": "o_custkey", "right_key": "id"}, ["id_left", "o_custkey", "amount_left", "id_right", "amount_right"], "SELECT o_orderkey AS id_left, o_custkey, o_totalprice AS amount_left, c_custkey AS id_right, c_acctbal AS amount_right FROM orders JOIN customer ON o_custkey = c_custkey")
_join_query("join_samekey_coalesce", "SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey % 2 = 0", "SELECT s_suppkey AS k, s_name FROM supplier", {"join_type": "outer", "left_key": "k", "right_key": "k"}, ["k", "c_name", "s_name"], "SELECT coalesce(c_custkey, s_suppkey) AS k, c_name, s_name FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) FULL JOIN supplier ON c_custkey = s_suppkey")


# aggregate

_LINES = "(SELECT *, CASE WHEN l_linenumber > 1 THEN l_quantity END AS q, CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS flag FROM lineitem)"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "lineitem")
    return df.withColumns({"q": F.when(F.col("l_linenumber") > 1, F.col("l_quantity")), "flag": F.when(F.col("l_returnflag") != "A", F.col("l_returnflag"))})


def _agg(name: str, specs: list[tuple[str, str]], sql: str, keys: tuple[str, ...] = ("l_linestatus",), digits: int | None = None, order: str | None = None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        aggs = [{"column": c, "function": f, "alias": f"a{i}"} for i, (c, f) in enumerate(specs)]
        out = relational.aggregate(_lines(spark, sf), {"group_by": list(keys), "aggregations": aggs, "order_by": order})
        return _money(out, **{f"a{i}": digits for i in range(len(specs))}) if digits is not None else out

    some = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    QUERIES[name], ORACLES[name] = run, f"SELECT {', '.join(keys)}, {sql} FROM {_LINES} WHERE {some} GROUP BY {', '.join(keys)}"


_agg("agg_sum", [("l_quantity", "sum")], "round(sum(l_quantity), 2) AS a0", digits=2)
_agg("agg_avg", [("q", "avg")], "round(avg(q), 4) AS a0", digits=4)
_agg("agg_count", [("q", "count"), ("q", "size")], "count(q) AS a0, count(*) AS a1")
_agg("agg_minmax", [("l_shipdate", "min"), ("l_shipdate", "max")], "min(l_shipdate) AS a0, max(l_shipdate) AS a1", keys=("l_returnflag", "l_linestatus"))
_agg("agg_multi_same_column", [("l_tax", "min"), ("l_tax", "max"), ("l_tax", "nunique")], "min(l_tax) AS a0, max(l_tax) AS a1, count(DISTINCT l_tax) AS a2")
_agg("agg_null_keys", [("l_orderkey", "count")], "count(l_orderkey) AS a0", keys=("flag",))
_agg("agg_median", [("l_quantity", "median"), ("l_discount", "quantile")], "round(median(l_quantity), 6) AS a0, round(median(l_discount), 6) AS a1", digits=6)
_agg("agg_std", [("q", "std")], "round(stddev_samp(q), 6) AS a0", digits=6)
_agg("agg_var", [("q", "var")], "round(var_samp(q), 6) AS a0", digits=6)
_agg("agg_sem", [("q", "sem")], "round(stddev_samp(q) / sqrt(count(q)), 8) AS a0", digits=8)
_agg("agg_skew", [("q", "skew")], "round(skewness(q), 6) AS a0", digits=6)
_agg("agg_nunique", [("l_suppkey", "nunique"), ("flag", "nunique")], "count(DISTINCT l_suppkey) AS a0, count(DISTINCT flag) AS a1")
_agg("agg_size", [("flag", "size")], "count(*) AS a0", keys=("l_returnflag",))


@query("SELECT l_linestatus, count(l_orderkey) AS l_orderkey_count, max(l_quantity) AS l_quantity_max FROM lineitem GROUP BY l_linestatus")
def agg_default_alias(spark: SparkSession, sf: str) -> DataFrame:
    return relational.aggregate(_t(spark, sf, "lineitem"), {"group_by": ["l_linestatus"], "aggregations": [{"column": "l_orderkey", "function": "count"}, {"column": "l_quantity", "function": "max"}]})


@query("SELECT event_type, coalesce(sum(CASE WHEN event_type <> 'click' THEN event_id END), 0)::BIGINT AS total FROM events GROUP BY event_type")
def agg_sum_allnull(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "events").withColumn("x", F.when(F.col("event_type") != "click", F.col("event_id")))
    return relational.aggregate(df, {"group_by": ["event_type"], "aggregations": [{"column": "x", "function": "sum", "alias": "total"}]})


@query("SELECT o_custkey, bool_or(o_totalprice > 100000) AS some, bool_and(o_totalprice > 100000) AS every, round(product(1 + o_orderkey % 3)) AS p FROM orders GROUP BY o_custkey")
def agg_any_all_prod(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "orders").withColumns({"big": F.col("o_totalprice") > 100000, "f": 1 + F.col("o_orderkey") % 3})
    out = relational.aggregate(df, {"group_by": ["o_custkey"], "aggregations": [{"column": "big", "function": "any", "alias": "some"}, {"column": "big", "function": "all", "alias": "every"}, {"column": "f", "function": "prod", "alias": "p"}]})
    return out.withColumn("p", F.round("p"))


@query(f"SELECT user_id, arg_min(v, event_id) AS first_v, arg_max(v, event_id) AS last_v FROM {_GAPS} GROUP BY user_id")
def agg_first_last(spark: SparkSession, sf: str) -> DataFrame:
    return relational.aggregate(_gaps(_t(spark, sf, "events")), {"group_by": ["user_id"], "order_by": "event_id", "aggregations": [{"column": "v", "function": "first", "alias": "first_v"}, {"column": "v", "function": "last", "alias": "last_v"}]})


# sort, top-k, dedup


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 50")
def sort_multi(spark: SparkSession, sf: str) -> DataFrame:
    """Order is kept as a number: rows of the sorted top, numbered where they come out."""
    top = relational.top_k(_t(spark, sf, "orders"), {"sort_by": [{"column": "o_orderpriority"}, {"column": "o_totalprice", "ascending": False}, {"column": "o_orderkey"}]}, 50)
    rows = top.select("o_orderkey").collect()
    return spark.createDataFrame([(r.o_orderkey, i + 1) for i, r in enumerate(rows)], "o_orderkey long, place long")


@query(f"SELECT event_id, row_number() OVER (ORDER BY v DESC NULLS LAST, event_id) AS place FROM (SELECT * FROM {_GAPS} WHERE event_id < 60) QUALIFY place > 0")
def sort_nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    df = relational.sort_rows(_gaps(_t(spark, sf, "events")).filter("event_id < 60"), {"sort_by": [{"column": "v", "ascending": False}, {"column": "event_id"}]})
    return spark.createDataFrame([(r.event_id, i + 1) for i, r in enumerate(df.select("event_id").collect())], "event_id long, place long")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def topk(spark: SparkSession, sf: str) -> DataFrame:
    return relational.top_k(_t(spark, sf, "customer"), {"sort_by": [{"column": "c_acctbal", "ascending": False}, {"column": "c_custkey"}]}, 25).select("c_custkey", "c_acctbal")


def _dedup(name: str, keep: object, sql: str, columns: list[str]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = _t(spark, sf, "events").withColumn("kind", F.when(F.col("event_type") != "click", F.col("event_type"))).select("event_id", "user_id", "kind")
        return relational.deduplicate(df, {"columns": columns, "keep": keep, "order_by": "event_id"})

    QUERIES[name], ORACLES[name] = run, f"WITH e AS (SELECT event_id, user_id, CASE WHEN event_type <> 'click' THEN event_type END AS kind FROM events) {sql}"


_dedup("dedup_first", "first", "SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, kind ORDER BY event_id) = 1", ["user_id", "kind"])
_dedup("dedup_last", "last", "SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, kind ORDER BY event_id DESC) = 1", ["user_id", "kind"])
_dedup("dedup_none", False, "SELECT * FROM e QUALIFY count(*) OVER (PARTITION BY user_id, kind) = 1", ["user_id", "kind"])


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def dedup_all_columns(spark: SparkSession, sf: str) -> DataFrame:
    return relational.deduplicate(_t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"), {})


# quality

_RULES = [
    quality.Rule("non_null_rate", {"field": "v", "max_null_percent": 10}), quality.Rule("uniqueness", {"fields": ["user_id", "event_type"]}),
    quality.Rule("range_check", {"field": "v", "min_value": 5, "max_value": 60}), quality.Rule("regex_match", {"field": "event_type", "pattern": "(?P<a>cl|pu)"}),
]
_BAD = {0: "v IS NULL", 2: "v IS NULL OR v < 5 OR v > 60", 3: "NOT regexp_matches(event_type, '^(cl|pu)')"}
_RATE = "CASE WHEN count(*) = 0 THEN 100.0 ELSE round((count(*) - failed) / count(*) * 100, 2) END"


def _rule_sql(i: int) -> str:
    failed = "sum(({})::INT)".format(_BAD[i]) if i in _BAD else "sum((n > 1)::INT)"
    if i == 0:
        failed = f"CASE WHEN {failed} / count(*) * 100 > 10 THEN {failed} ELSE 0 END"
    return f"SELECT {i} AS rule, '{_RULES[i].rule_type}' AS rule_type, count(*) AS total, ({failed})::BIGINT AS failed FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM {_GAPS})"


def _quality(name: str, which: list[int]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = quality.report_frame(_gaps(_t(spark, sf, "events")), [_RULES[i] for i in which])
        ids = F.element_at(F.array(*[F.lit(i) for i in which]), F.col("rule") + 1)
        return out.withColumn("rule", ids)

    QUERIES[name] = run
    ORACLES[name] = "SELECT rule, rule_type, total, failed, round((total - failed) / total * 100, 2) AS pass_rate FROM (" + " UNION ALL ".join(_rule_sql(i) for i in which) + ")"


_quality("dq_non_null_rate", [0])
_quality("dq_uniqueness", [1])
_quality("dq_range", [2])
_quality("dq_regex", [3])
_quality("dq_report", [0, 1, 2, 3])
_WHY = {i: quality.reason(r).replace("'", "''") for i, r in enumerate(_RULES)}


@query(f"SELECT event_id, ({_BAD[2]}) OR ({_BAD[3]}) AS is_dirty, concat_ws('; ', CASE WHEN {_BAD[2]} THEN '{_WHY[2]}' END, CASE WHEN {_BAD[3]} THEN '{_WHY[3]}' END) AS violation_reason FROM {_GAPS}")
def dq_mark(spark: SparkSession, sf: str) -> DataFrame:
    df, _ = quality.apply(_gaps(_t(spark, sf, "events")), [_RULES[2], _RULES[3]])
    return df.select("event_id", "is_dirty", "violation_reason")


@query(f"SELECT event_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM {_GAPS} WHERE NOT ({_BAD[2]})) WHERE n = 1")
def dq_quarantine_clean(spark: SparkSession, sf: str) -> DataFrame:
    rules = [quality.Rule(r.rule_type, r.rule_config, "quarantine") for r in (_RULES[2], _RULES[1])]
    return quality.apply(_gaps(_t(spark, sf, "events")), rules)[0].select("event_id")


@query(f"SELECT event_id, 'range_check' AS rule_type, '{_WHY[2]}' AS violation_reason FROM {_GAPS} WHERE {_BAD[2]}")
def dq_quarantine_rejects(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.quarantine_rows(_gaps(_t(spark, sf, "events")).select("event_id", "v"), _RULES[2])
    return out.select(F.get_json_object("record_data", "$.event_id").cast("long").alias("event_id"), "rule_type", "violation_reason")


# incremental, change data


@query("SELECT event_id, ts FROM events WHERE ts > (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)")
def incr_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "events")
    at = df.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).cast("string").alias("t")).first().t
    return incremental.newer(df, {"mode": "timestamp", "timestamp_field": "ts"}, {"last_timestamp": at}).select("event_id", "ts")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 1000")
def incr_id(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.newer(_t(spark, sf, "orders"), {"mode": "auto_increment_id", "id_field": "o_orderkey"}, {"last_id": 1000}).select("o_orderkey")


@query("SELECT greatest(max(o_orderkey), 1000) AS last_id FROM orders WHERE o_orderkey > 1000")
def incr_new_watermark(spark: SparkSession, sf: str) -> DataFrame:
    config, mark = {"mode": "auto_increment_id", "id_field": "o_orderkey"}, {"last_id": 1000}
    after = incremental.next_mark(incremental.newer(_t(spark, sf, "orders"), config, mark), config, mark)
    return spark.createDataFrame([(after["last_id"],)], "last_id long")


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    df = _t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    new = df.filter("c_custkey % 11 <> 0").withColumn("c_nationkey", F.when(F.col("c_custkey") % 7 == 0, F.lit(None)).otherwise(F.col("c_nationkey")))
    return df.filter("c_custkey % 13 <> 0"), new


_OLD = "(SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 13 <> 0)"
_NEW = "(SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 11 <> 0)"


@query(f"SELECT operation_type, record_id FROM (SELECT CASE WHEN o.c_custkey IS NULL THEN 'INSERT' WHEN n.c_custkey IS NULL THEN 'DELETE' WHEN o.c_nationkey IS DISTINCT FROM n.c_nationkey THEN 'UPDATE' END AS operation_type, coalesce(o.c_custkey, n.c_custkey)::VARCHAR AS record_id FROM {_OLD} o FULL JOIN {_NEW} n USING (c_custkey)) WHERE operation_type IS NOT NULL")
def cdc_snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.snapshot_changes(*_snapshots(spark, sf), ["c_custkey"], "customer").select("operation_type", "record_id")


@query(f"SELECT c_custkey, c_name, c_nationkey FROM {_NEW}")
def cdc_apply(spark: SparkSession, sf: str) -> DataFrame:
    """The old snapshot after the log is the new one."""
    old, new = _snapshots(spark, sf)
    log = incremental.snapshot_changes(old, new, ["c_custkey"]).withColumn("id", F.monotonically_increasing_id())
    return incremental.apply_changes(old, log, ["c_custkey"])


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'click'")
def cdc_latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "DELETE").otherwise("UPDATE")
    log = _t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("record_id"), kind.alias("operation_type"), F.to_json(F.struct("user_id", "value")).alias("record_data"))
    return incremental.latest_images(log, "user_id long, value double")


# runs, workflows, lineage: small tables written out here

_METRICS = [("a", "read", 100.0, 50.0, 10, 5), ("a", "join", 300.0, 20.0, 20, 6), ("b", "read", 80.0, 60.0, 12, 5), ("b", "sort", 40.0, 10.0, 5, 4)]
_METRIC_SQL = "(VALUES " + ", ".join("('{}', '{}', {}::DOUBLE, {}::DOUBLE, {}::BIGINT, {}::BIGINT)".format(*m) for m in _METRICS) + ") AS m(execution_id, node_id, duration_ms, throughput, memory_peak_bytes, output_rows)"


def _metrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_METRICS, "execution_id string, node_id string, duration_ms double, throughput double, memory_peak_bytes long, output_rows long")


@query(f"SELECT node_id, b.duration_ms - a.duration_ms AS duration_ms_diff, b.output_rows - a.output_rows AS output_rows_diff FROM (SELECT * FROM {_METRIC_SQL} WHERE execution_id = 'a') a FULL JOIN (SELECT * FROM {_METRIC_SQL} WHERE execution_id = 'b') b USING (node_id)")
def perf_compare(spark: SparkSession, sf: str) -> DataFrame:
    return runtime.compare_runs(_metrics(spark), "a", "b").select("node_id", "duration_ms_diff", "output_rows_diff")


@query(f"SELECT execution_id, node_id, duration_ms, round(duration_ms / sum(duration_ms) OVER w * 100, 2) AS share_pct, round(duration_ms / max(duration_ms) OVER w * 100, 2) AS bar_pct FROM {_METRIC_SQL} WINDOW w AS (PARTITION BY execution_id)")
def perf_share_of_total(spark: SparkSession, sf: str) -> DataFrame:
    return runtime.node_shares(_metrics(spark))


@query(f"SELECT execution_id, sum(duration_ms) AS total_duration, sum(output_rows)::BIGINT AS total_rows, avg(throughput) AS avg_throughput, max(memory_peak_bytes) AS peak_memory FROM {_METRIC_SQL} GROUP BY execution_id")
def perf_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return runtime.rollup(_metrics(spark))


@query("SELECT * FROM (VALUES ('c')) AS t(pipeline_id)")
def dep_all_upstream_complete(spark: SparkSession, sf: str) -> DataFrame:
    runs = spark.createDataFrame([("a", "failed", 1.0), ("a", "completed", 2.0), ("b", "completed", 1.0), ("x", "completed", 1.0), ("x", "failed", 3.0)], "pipeline_id string, status string, created_at double")
    deps = spark.createDataFrame([("c", "a"), ("c", "b"), ("d", "x"), ("d", "a"), ("e", "never")], "pipeline_id string, upstream_id string")
    return workflow.ready_downstream(runs, deps)


def _records(spark: SparkSession) -> DataFrame:
    step = ("rename", "m", "x")
    rows = [("1", "r", "raw", "a", "mid", "x", [step]), ("1", "r", "raw", "b", "mid", "x", [step]), ("2", "r", "mid", "x", "out", "y", []), ("2", "r", "other", "z", "out", "y", [])]
    return spark.createDataFrame(rows, lineage.SCHEMA)


@query("SELECT * FROM (VALUES ('raw.a', 'step:m:rename', 1::BIGINT), ('raw.b', 'step:m:rename', 1::BIGINT), ('step:m:rename', 'mid.x', 2::BIGINT), ('mid.x', 'out.y', 1::BIGINT), ('other.z', 'out.y', 1::BIGINT)) AS t(source, target, value)")
def lineage_sankey(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.sankey(_records(spark))[1]


@query("SELECT * FROM (VALUES ('mid', 'x', 1, false), ('other', 'z', 1, true), ('raw', 'a', 2, true), ('raw', 'b', 2, true)) AS t(source_table, source_column, depth, is_root)")
def lineage_reverse(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.trace_back(_records(spark), "out", "y")


@query("WITH RECURSIVE e(a, b) AS (VALUES ('a', 'b'), ('b', 'c'), ('a', 'd'), ('x', 'c')), r(k) AS (SELECT b FROM e WHERE a = 'a' UNION SELECT e.b FROM r JOIN e ON e.a = r.k) SELECT k FROM r")
def workflow_downstream(spark: SparkSession, sf: str) -> DataFrame:
    spec = {"nodes": [{"key": k, "pipeline_id": k} for k in "abcdx"], "edges": [{"source": a, "target": b} for a, b in ("ab", "bc", "ad", "xc")]}
    found = workflow.Workflow.parse(spec).downstream("a")
    return spark.createDataFrame([(k,) for k in sorted(found)], "k string")


# templates


@query("SELECT * FROM (VALUES ('North', 300.0::DOUBLE, 2::BIGINT, 150.0::DOUBLE), ('South', 50.0::DOUBLE, 1::BIGINT, 50.0::DOUBLE)) AS t(region, total_amount, order_count, avg_amount)")
def template_multi_table_join(spark: SparkSession, sf: str) -> DataFrame:
    db = os.path.join(_scratch(spark), "sales.db")
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE customers (id INTEGER PRIMARY KEY, name TEXT, region TEXT)")
        c.execute("CREATE TABLE orders (id INTEGER PRIMARY KEY, customer_id INTEGER, amount REAL)")
        c.executemany("INSERT INTO customers VALUES (?, ?, ?)", [(1, "a", "North"), (2, "b", "South")])
        c.executemany("INSERT INTO orders VALUES (?, ?, ?)", [(1, 1, 100), (2, 1, 200), (3, 2, 50), (4, 9, 7)])
    return runtime.build(spark, templates.multi_table_join(db))["largest"]


@query("SELECT c_custkey AS id, c_name AS full_name, 'x' || c_custkey % 100 || '@example.com' AS email, (c_custkey % 60)::BIGINT AS age FROM customer WHERE c_custkey % 60 > 0 QUALIFY row_number() OVER (PARTITION BY c_custkey % 100 ORDER BY c_custkey) = 1")
def template_csv_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("x"), F.col("c_custkey") % 100, F.lit("@example.com")).alias("email"), (F.col("c_custkey") % 60).alias("age"))
    spec = templates.csv_cleaning()
    for n in spec["nodes"]:
        if n["id"] == "once":
            n["data"]["config"]["order_by"] = "id"
    return runtime.build(spark, spec, {"read": df})["once"]


@query("SELECT 'branch_' || CASE WHEN n_name LIKE 'A%' THEN 0 ELSE 1 END AS branch, n_nationkey::BIGINT AS user_id, n_regionkey || ' st, ' || n_name AS full_address FROM nation")
def template_api_sync(spark: SparkSession, sf: str) -> DataFrame:
    users = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.struct(F.concat(F.col("n_regionkey").cast("string"), F.lit(" st")).alias("street"), F.col("n_name").alias("city")).alias("address"))
    cities = tuple(r.n_name for r in _t(spark, sf, "nation").filter("n_name LIKE 'A%'").collect())
    out = runtime.build(spark, templates.api_sync(cities=cities), {"users": users})
    return readers.union_all([out[f"by_city.branch_{i}"].select(F.lit(f"branch_{i}").alias("branch"), "user_id", "full_address") for i in (0, 1)])


# analytics over all of it: each through the operators above


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    df = df.withColumn("disc", expr.expression(df, "l_extendedprice * (1 - l_discount)"))
    aggs = [{"column": "l_quantity", "function": "sum", "alias": "sum_qty"}, {"column": "l_extendedprice", "function": "sum", "alias": "sum_base"}, {"column": "disc", "function": "sum", "alias": "sum_disc"}, {"column": "l_quantity", "function": "avg", "alias": "avg_qty"}, {"column": "l_quantity", "function": "size", "alias": "n"}]
    return _money(relational.aggregate(df, {"group_by": ["l_returnflag", "l_linestatus"], "aggregations": aggs}), sum_qty=2, sum_base=2, sum_disc=2, avg_qty=4)


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def revenue_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    df = relational.join(_t(spark, sf, "lineitem"), _t(spark, sf, "orders"), {"left_key": "l_orderkey", "right_key": "o_orderkey"})
    df = relational.join(df, _t(spark, sf, "customer"), {"left_key": "o_custkey", "right_key": "c_custkey"})
    df = relational.join(df, _t(spark, sf, "nation"), {"left_key": "c_nationkey", "right_key": "n_nationkey"})
    df = df.withColumn("net", expr.expression(df, "l_extendedprice * (1 - l_discount)"))
    return _money(relational.aggregate(df, {"group_by": ["n_name"], "aggregations": [{"column": "net", "function": "sum", "alias": "revenue"}]}), revenue=2)


# whole tables: order as data, ranks, joins by order, joins with rows that have no match


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) - 1 AS place FROM orders")
def sort_orders_whole(spark: SparkSession, sf: str) -> DataFrame:
    keys = [F.col("o_orderpriority").asc_nulls_last(), F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last()]
    return ordering.with_place(_t(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), keys).select("o_orderkey", "place")


@query(f"SELECT event_id, row_number() OVER (ORDER BY v DESC NULLS LAST, event_id) - 1 AS place FROM {_GAPS}")
def sort_events_whole(spark: SparkSession, sf: str) -> DataFrame:
    keys = [F.col("v").desc_nulls_last(), F.col("event_id").asc_nulls_last()]
    return ordering.with_place(_gaps(_t(spark, sf, "events")).select("event_id", "v"), keys).select("event_id", "place")


_WANTED = {"low": ("l_extendedprice", 0.1), "middle": ("l_extendedprice", 0.5), "high": ("l_extendedprice", 0.995), "q": ("q", 0.5)}


@query(f"SELECT l_returnflag, {', '.join(f'round(quantile_cont({c}, {q}), 6) AS {a}' for a, (c, q) in _WANTED.items())} FROM {_LINES} GROUP BY l_returnflag")
def agg_quantiles_by_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _money(quantiles.quantiles(_lines(spark, sf), ["l_returnflag"], _WANTED), low=6, middle=6, high=6, q=6)


@query(f"SELECT {', '.join(f'round(quantile_cont({c}, {q}), 6) AS {a}' for a, (c, q) in _WANTED.items())} FROM {_LINES}")
def agg_quantiles_of_all(spark: SparkSession, sf: str) -> DataFrame:
    """One group with all rows: cut into ranges all the same."""
    return _money(quantiles.quantiles(_lines(spark, sf), [], _WANTED), low=6, middle=6, high=6, q=6)


@query("SELECT o_custkey, round(quantile_cont(o_totalprice, 0.5), 6) AS middle FROM orders GROUP BY o_custkey")
def agg_quantiles_many_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _money(quantiles.quantiles(_t(spark, sf, "orders"), ["o_custkey"], {"middle": ("o_totalprice", 0.5)}), middle=6)


_PURCHASES = "(SELECT user_id, ts, max(event_id) AS last_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)"


def _purchases(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_id"))


@query(f"SELECT event_id, last_id FROM events e ASOF LEFT JOIN {_PURCHASES} p ON e.user_id = p.user_id AND e.ts >= p.ts")
def join_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Every event with its user's last purchase up to then."""
    return temporal.as_of(_t(spark, sf, "events").select("event_id", "user_id", "ts"), _purchases(spark, sf), "ts", ["user_id"]).select("event_id", "last_id")


@query(f"SELECT event_id, last_id FROM events e ASOF JOIN {_PURCHASES} p ON e.user_id = p.user_id AND e.ts < p.ts WHERE p.ts - e.ts <= INTERVAL 6 HOUR")
def join_asof_next(spark: SparkSession, sf: str) -> DataFrame:
    """Events that the user's next purchase follows within six hours."""
    return temporal.as_of(_t(spark, sf, "events").select("event_id", "user_id", "ts"), _purchases(spark, sf), "ts", ["user_id"], direction="forward", exact=False, tolerance=6 * 3600, how="inner").select("event_id", "last_id")


@query("SELECT event_id, last_id FROM events e ASOF LEFT JOIN (SELECT ts, max(event_id) AS last_id FROM events WHERE event_type = 'error' GROUP BY ts) p ON e.ts > p.ts")
def join_asof_one_key(spark: SparkSession, sf: str) -> DataFrame:
    """All rows under one key: the last error before each event, whoever's."""
    errors = _t(spark, sf, "events").filter("event_type = 'error'").select("ts", F.col("event_id").alias("last_id"))
    return temporal.as_of(_t(spark, sf, "events").select("event_id", "ts"), errors, "ts", exact=False).select("event_id", "last_id")


@query("SELECT e.event_id, x.event_id AS error_id FROM events e JOIN events x ON e.user_id = x.user_id AND x.event_type = 'error' AND e.ts BETWEEN x.ts AND x.ts + INTERVAL 12 HOUR")
def join_range(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user in the twelve hours after an error."""
    errors = _t(spark, sf, "events").filter("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("since"), (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("until"))
    return temporal.range_join(_t(spark, sf, "events").select("event_id", "user_id", "ts"), errors, "ts", "since", "until", ["user_id"]).select("event_id", "error_id")


@query("SELECT e.event_id, x.event_id AS signup_id FROM events e LEFT JOIN events x ON x.event_type = 'signup' AND e.ts >= x.ts AND e.ts < x.ts + to_seconds(x.event_id % 5 * 60)")
def join_range_one_key(spark: SparkSession, sf: str) -> DataFrame:
    """No key at all, and intervals of several lengths: events in the minutes after a signup, others with none."""
    signups = _t(spark, sf, "events").filter("event_type = 'signup'").select(F.col("event_id").alias("signup_id"), F.col("ts").alias("since"), F.expr("ts + make_interval(0, 0, 0, 0, 0, event_id % 5, 0)").alias("until"))
    return temporal.range_join(_t(spark, sf, "events").select("event_id", "ts"), signups, "ts", "since", "until", closed="left", how="left").select("event_id", "signup_id")


@query("SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY")
def join_range_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with their order's price where they were shipped within thirty days."""
    lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").withColumn("k", F.col("l_orderkey"))
    due = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice", "o_orderdate", (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("due"))
    return temporal.range_join(lines, due, "l_shipdate", "o_orderdate", "due", ["k"], how="left").select("l_orderkey", "l_linenumber", "o_totalprice")


@query("SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate <= b.o_orderdate + INTERVAL 20 DAY AND b.o_orderdate <= a.o_orderdate + INTERVAL 10 DAY")
def join_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a customer's orders whose spans, of ten and twenty days, overlap."""
    span = lambda name, days: _t(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias(name), F.col("o_orderdate").alias("since"), (F.col("o_orderdate") + F.expr(f"INTERVAL {days} DAYS")).alias("until"))
    return temporal.overlap_join(span("a", 10), span("b", 20), ("since", "until"), ("since", "until"), ["o_custkey"]).select("a", "b")


for _how, _sql in (("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN"), ("inner", "JOIN")):
    # Orders by key against customers by number: either side has rows without a match.
    _join_query(f"join_{_how}_whole", "SELECT o_orderkey, o_totalprice FROM orders", "SELECT c_custkey * 11 AS number, c_name FROM customer", {"join_type": _how, "left_key": "o_orderkey", "right_key": "number"}, ["o_orderkey", "number", "c_name", "o_totalprice"], f"SELECT o_orderkey, number, c_name, o_totalprice FROM orders {_sql} (SELECT c_custkey * 11 AS number, c_name FROM customer) ON o_orderkey = number")
_join_query("join_samekey_whole", "SELECT c_custkey AS k, c_name FROM customer", "SELECT s_suppkey * 20 + 7 AS k, s_name FROM supplier", {"join_type": "outer", "left_key": "k", "right_key": "k"}, ["k", "c_name", "s_name"], "SELECT coalesce(c_custkey, s_suppkey * 20 + 7) AS k, c_name, s_name FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 20 + 7")


# sketches, digests

_SKETCHES = [sketches.Sketch("users", "user_id"), sketches.Sketch("moments", "ts_text", "theta"), sketches.Sketch("amounts", "value", "kll")]


@query("SELECT event_type, count(*) AS rows_seen, count(DISTINCT user_id) AS users, count(DISTINCT ts) AS moments, true AS users_near, true AS moments_near, true AS middle_near, true AS high_near FROM events GROUP BY event_type")
def sketch_merged_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of three batches, merged one after the other, against exact figures of all rows: within 5 % and 3 % of the ranks."""
    df = _t(spark, sf, "events").withColumn("ts_text", F.col("ts").cast("string"))
    batch, state = F.month("ts") % 3, None
    for k in range(3):
        new = sketches.states(df.filter(batch == k), ["event_type"], _SKETCHES)
        state = new if state is None else sketches.merged(state, new, ["event_type"], _SKETCHES)
    exact = df.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("ts").alias("moments"))
    said = state.select("event_type", "rows_seen", sketches.distinct_estimate("users").alias("_u"), sketches.distinct_estimate("moments", "theta").alias("_m"), sketches.quantile_estimate("amounts", 0.5).alias("_q"), sketches.quantile_estimate("amounts", 0.95).alias("_h"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.col(b) * 0.05 + 1
    # The true rank of what the sketch says is the quantile.
    ranks = df.join(F.broadcast(said.select("event_type", "_q", "_h")), "event_type").groupBy("event_type").agg(F.avg((F.col("value") <= F.col("_q")).cast("double")).alias("_qr"), F.avg((F.col("value") <= F.col("_h")).cast("double")).alias("_hr"))
    out = said.join(exact, "event_type").join(ranks, "event_type")
    return out.select("event_type", "rows_seen", "users", "moments", near("_u", "users").alias("users_near"), near("_m", "moments").alias("moments_near"), (F.abs(F.col("_qr") - 0.5) < 0.03).alias("middle_near"), (F.abs(F.col("_hr") - 0.95) < 0.03).alias("high_near"))


@query(ORACLES["cdc_snapshot_diff"])
def cdc_digest_diff(spark: SparkSession, sf: str) -> DataFrame:
    """The change log from digest trees: buckets that agree aren't joined."""
    return digests.digest_changes(*_snapshots(spark, sf), ["c_custkey"], "customer")[0].select("operation_type", "record_id")


@query("SELECT 'UPDATE' AS operation_type, o_orderkey::VARCHAR AS record_id FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
def cdc_digest_few(spark: SparkSession, sf: str) -> DataFrame:
    """All orders against themselves with the dearest one changed: one leaf is joined."""
    old = _t(spark, sf, "orders")
    top = old.agg(F.max("o_totalprice")).first()[0]
    new = old.withColumn("o_orderstatus", F.when(F.col("o_totalprice") == top, "changed").otherwise(F.col("o_orderstatus")))
    return digests.digest_changes(old, new, ["o_orderkey"], "orders")[0].select("operation_type", "record_id")


# frames of peer groups, event time


_DAYS = "(SELECT *, floor(value / 10)::BIGINT AS step FROM events)"


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").select("event_id", "event_type", F.floor(F.col("value") / 10).alias("step"), F.col("user_id"))


def _frame(name: str, start: int | None, end: int | None, exclude: str, over: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        asks = {"n": ("count", "user_id"), "total": ("sum", "user_id"), "least": ("min", "user_id"), "most": ("max", "user_id")}
        return frames.groups_frame(_steps(spark, sf), ["event_type"], [("step", True)], start, end, asks, exclude).select("event_id", "n", "total", "least", "most")

    w = f"OVER (PARTITION BY event_type ORDER BY step GROUPS BETWEEN {over})"
    QUERIES[name], ORACLES[name] = run, f"SELECT event_id, count(user_id) {w} AS n, sum(user_id) {w}::BIGINT AS total, min(user_id) {w} AS least, max(user_id) {w} AS most FROM {_DAYS}"


_frame("window_groups", -2, 1, "no others", "2 PRECEDING AND 1 FOLLOWING")
_frame("window_groups_exclude_row", -1, 1, "current row", "1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW")
_frame("window_groups_exclude_group", None, 1, "group", "UNBOUNDED PRECEDING AND 1 FOLLOWING EXCLUDE GROUP")
_frame("window_groups_exclude_ties", 0, 2, "ties", "CURRENT ROW AND 2 FOLLOWING EXCLUDE TIES")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS events, sum(user_id)::BIGINT AS users FROM events GROUP BY ALL")
def stream_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Six-hour windows counted by a stream over the events' files; repeated ids would count once."""
    schema, path = _t(spark, sf, "events").schema, shared_path(spark, "windows")
    # Watermarks go by timestamps with a zone; the moments are taken as UTC and given back without one.
    rows = eventtime.file_stream(spark, sf, schema, "events.parquet").withColumn("at", F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z"))))
    rows = eventtime.without_repeats(rows, ["event_id"], "at", "2 days")
    counted = eventtime.windowed(rows, "at", "6 hours", ["event_type"], {"events": F.count(F.lit(1)), "users": F.sum("user_id")})
    eventtime.catch_up(counted, f"{path}/out", f"{path}/checkpoint")
    out = eventtime.current(spark, f"{path}/out", ["window_start", "event_type"])
    return out.select(F.to_utc_timestamp("window_start", F.current_timezone()).cast("timestamp_ntz").alias("window_start"), "event_type", "events", "users")


@query("SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return eventtime.sessions(_t(spark, sf, "events"), ["user_id"], "ts", "12 hours").withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


# runs, dependencies and lineage from given tables: a day is a run, an event type a node; lineage is of real queries


_RUN_METRICS = "(SELECT strftime(ts, '%Y-%m-%d') AS execution_id, event_type AS node_id, sum(event_id)::DOUBLE AS duration_ms, round(avg(user_id), 6) AS throughput, max(user_id)::BIGINT AS memory_peak_bytes, count(*) AS output_rows FROM events GROUP BY 1, 2)"


def _run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    days = _t(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("execution_id"), F.col("event_type").alias("node_id"))
    return days.agg(F.sum("event_id").cast("double").alias("duration_ms"), F.round(F.avg("user_id"), 6).alias("throughput"), F.max("user_id").alias("memory_peak_bytes"), F.count(F.lit(1)).alias("output_rows"))


@query(f"SELECT execution_id, sum(duration_ms) AS total_duration, sum(output_rows)::BIGINT AS total_rows, round(avg(throughput), 4) AS avg_throughput, max(memory_peak_bytes) AS peak_memory FROM {_RUN_METRICS} GROUP BY execution_id")
def perf_rollup_days(spark: SparkSession, sf: str) -> DataFrame:
    return _money(runtime.rollup(_run_metrics(spark, sf)), avg_throughput=4)


@query(f"SELECT execution_id, node_id, duration_ms, round(duration_ms / nullif(sum(duration_ms) OVER w, 0) * 100, 2) AS share_pct, round(duration_ms / nullif(max(duration_ms) OVER w, 0) * 100, 2) AS bar_pct FROM {_RUN_METRICS} WINDOW w AS (PARTITION BY execution_id)")
def perf_shares_days(spark: SparkSession, sf: str) -> DataFrame:
    return runtime.node_shares(_run_metrics(spark, sf))


@query(f"SELECT node_id, b.duration_ms - a.duration_ms AS duration_ms_diff, b.output_rows - a.output_rows AS output_rows_diff FROM (SELECT * FROM {_RUN_METRICS} WHERE execution_id = '2024-01-02') a FULL JOIN (SELECT * FROM {_RUN_METRICS} WHERE execution_id = '2024-01-03') b USING (node_id)")
def perf_compare_days(spark: SparkSession, sf: str) -> DataFrame:
    return runtime.compare_runs(_run_metrics(spark, sf), "2024-01-02", "2024-01-03").select("node_id", "duration_ms_diff", "output_rows_diff")


@query("SELECT pipeline_id FROM (SELECT user_id::VARCHAR AS pipeline_id, (user_id + d)::VARCHAR AS upstream_id FROM (SELECT DISTINCT user_id FROM events), (VALUES (1), (2)) AS v(d)) JOIN (SELECT user_id::VARCHAR AS upstream_id, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id) u USING (upstream_id) GROUP BY pipeline_id HAVING bool_and(last <> 'error') AND count(*) = 2")
def dep_ready_users(spark: SparkSession, sf: str) -> DataFrame:
    """A user waits for the next two; a run is an event, and an error a failed one."""
    events = _t(spark, sf, "events")
    runs = events.select(F.col("user_id").cast("string").alias("pipeline_id"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.col("event_id").cast("double").alias("created_at"))
    users = events.select("user_id").distinct()
    deps = users.select(F.col("user_id").cast("string").alias("pipeline_id"), F.explode(F.array((F.col("user_id") + 1).cast("string"), (F.col("user_id") + 2).cast("string"))).alias("upstream_id"))
    return workflow.ready_downstream(runs, deps)


def _order_records(spark: SparkSession, sf: str) -> DataFrame:
    """Lineage records of orders: a column of a table for each customer and order, chained over three pipelines."""
    step = F.array(F.struct(F.lit("rename").alias("type"), F.lit("m").alias("node"), F.lit("").alias("detail")))
    orders = _t(spark, sf, "orders")
    of = lambda pipeline, a, b, c, d: orders.select(F.lit(pipeline).alias("pipeline_id"), F.lit("r").alias("execution_id"), F.lit(a).alias("source_table"), b.alias("source_column"), F.lit(c).alias("target_table"), d.alias("target_column"), step.alias("transform_path"))
    text = lambda c: F.col(c).cast("string")
    return of("1", "orders", text("o_orderkey"), "customers", text("o_custkey")).unionByName(of("2", "customers", text("o_custkey"), "states", F.col("o_orderstatus")))


@query("WITH l AS (SELECT 'orders.' || o_orderkey AS a, 'customers.' || o_custkey AS b FROM orders UNION ALL SELECT 'customers.' || o_custkey, 'states.' || o_orderstatus FROM orders) SELECT a AS source, 'step:m:rename' AS target, count(*) AS value FROM l GROUP BY a UNION ALL SELECT 'step:m:rename', b, count(*) FROM l GROUP BY b")
def lineage_sankey_orders(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.sankey(_order_records(spark, sf))[1]


@query("SELECT DISTINCT 'customers' AS source_table, o_custkey::VARCHAR AS source_column, 1 AS depth, false AS is_root FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT DISTINCT 'orders', o_orderkey::VARCHAR, 2, true FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def lineage_reverse_orders(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.trace_back(_order_records(spark, sf), "states", "F")


@query("SELECT * FROM (VALUES ('n_name', 'nation', 'n_name'), ('revenue', 'lineitem', 'l_extendedprice'), ('revenue', 'lineitem', 'l_discount'), ('last', 'orders', 'o_orderdate')) AS t(column_name, source_table, source_column), (SELECT count(*) AS matches FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey))")
def lineage_of_sql(spark: SparkSession, sf: str) -> DataFrame:
    """Where the columns of a query over four tables come from, and how many rows it has without nations that have no customer."""
    text = "WITH o AS (SELECT o_orderkey AS k, o_custkey, o_orderdate FROM orders) SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue, max(o_orderdate) AS last FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = k GROUP BY n_name HAVING count(c_custkey) > 0"
    df = readers.read(spark, "sql", {"query": text, "views": _views(sf, text)})
    rows = [(c, t, x) for c, found in sql_lineage.column_origins(df).items() for t, x in sorted(found)]
    return spark.createDataFrame(rows, "column_name string, source_table string, source_column string").crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("matches"))))


# SQLite's functions in Spark SQL


@query("SELECT event_id, strftime(ts, '%Y/%m/%d %H h') AS hour, last_day(ts)::VARCHAR AS month_end, round(epoch_us(ts) / 86400000000.0 + 2440587.5, 5) AS julian, json_extract_string(props, '$.k') AS k, event_type GLOB 'c*[k]' AS is_click, strftime(ts + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS later FROM events")
def sql_sqlite_functions(spark: SparkSession, sf: str) -> DataFrame:
    text = "SELECT event_id, strftime('%Y/%m/%d %H h', t) AS hour, sqlite_date(t, 'start of month', '+1 month', '-1 day') AS month_end, round(julianday(t), 5) AS julian, json_extract(props, '$.k') AS k, glob('c*[k]', event_type) AS is_click, sqlite_datetime(t, '+1.5 days') AS later FROM (SELECT *, cast(ts AS STRING) AS t FROM events)"
    return readers.read(spark, "sql", {"query": text, "views": _views(sf, text), "dialect": "sqlite"})


@query("SELECT key, count(*) AS n, sum(value::BIGINT)::BIGINT AS total FROM (SELECT unnest(json_keys(props)) AS key, props FROM events), LATERAL (SELECT json_extract_string(props, '$.' || key) AS value) GROUP BY key")
def sql_sqlite_json_each(spark: SparkSession, sf: str) -> DataFrame:
    text = "SELECT e.key, count(*) AS n, sum(cast(e.value AS BIGINT)) AS total FROM events, LATERAL json_each(props) e GROUP BY e.key"
    return readers.read(spark, "sql", {"query": text, "views": _views(sf, text), "dialect": "sqlite"})


@query("SELECT n_name AS region, round(sum(o_totalprice), 2) AS total_sales, count(o_orderkey) AS order_count, round(avg(o_totalprice), 4) AS avg_order_value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def template_multi_table_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The join template over all orders and customers, put into SQLite first."""
    db = os.path.join(_scratch(spark), "sales.db")
    customers = relational.join(_t(spark, sf, "customer"), _t(spark, sf, "nation"), {"left_key": "c_nationkey", "right_key": "n_nationkey"}).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("region"))
    orders = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("amount"))
    for name, df in (("customers", customers), ("orders", orders)):
        writers.write(df, "sqlite", {"db_path": db, "table_name": name, "write_mode": "replace", "batch_size": 5000, "error_strategy": "abort"})
    spec = templates.multi_table_join(db, aliases=("total_sales", "order_count", "avg_order_value"))
    return _money(runtime.build(spark, spec)["largest"], total_sales=2, avg_order_value=4)
