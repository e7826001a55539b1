"""Frames of peer groups against SQL, and column lineage of SQL sources."""

import random

import duckdb
import pytest

from loomspark.operators import frames, relational
from loomspark.plans import lineage, runtime, sql_lineage

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("exclude", frames.EXCLUDE)
@pytest.mark.parametrize(("start", "end"), [(None, 0), (-2, 2), (None, None), (-3, -1), (1, 2), (0, 0), (0, None)])
def test_groups_frames_equal_sql(spark, exclude, start, end):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["a", "a", "a", None]), rnd.choice([None, 1, 2, 2, 3, 5, 8]), rnd.choice([None, *range(-3, 9)])) for i in range(160)]
    df = spark.createDataFrame(rows, "id int, k string, x int, v long")
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id INT, k VARCHAR, x INT, v BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    bound = lambda n, side: f"UNBOUNDED {side}" if n is None else "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"
    over = f"OVER (PARTITION BY k ORDER BY x DESC NULLS LAST GROUPS BETWEEN {bound(start, 'PRECEDING')} AND {bound(end, 'FOLLOWING')} EXCLUDE {exclude.upper()})"
    want = con.execute(f"SELECT id, count(v) {over}, sum(v) {over}, min(v) {over}, max(v) {over}, round(avg(v) {over}, 9) FROM t").fetchall()
    asks = {f: (f, "v") for f in frames.FUNCTIONS}
    got = frames.groups_frame(df, ["k"], [("x", False)], start, end, asks, exclude)
    assert got.columns == ["id", "k", "x", "v", *asks]
    assert sorted((r.id, r["count"], r["sum"], r["min"], r["max"], None if r["avg"] is None else round(r["avg"], 9)) for r in got.collect()) == sorted((a, b, None if c is None else int(c), d, e, f) for a, b, c, d, e, f in want)


def test_wrong_frames_and_none(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    for bad in ({"start": 1, "end": 0}, {"start": 0, "end": 0, "exclude": "x"}):
        with pytest.raises(relational.ConfigError):
            frames.groups_frame(df, [], [("a", True)], aggregates={"n": ("count", "b")}, **bad)
    assert frames.groups_frame(df.limit(0), [], [("a", True)], None, 0, {"n": ("count", "b")}).collect() == []
    assert [tuple(r) for r in frames.groups_frame(df, [], [("a", True)], None, 0, {"b": ("sum", "b")}).collect()] == [(1, 2)]


QUERIES = {
    "SELECT a.o_custkey AS k, upper(b.c_name) || '!' AS n, o_totalprice * 2 + c_acctbal AS m FROM orders a JOIN customer b ON o_custkey = c_custkey WHERE o_orderkey > 1": {"k": {("orders", "o_custkey")}, "n": {("customer", "c_name")}, "m": {("orders", "o_totalprice"), ("customer", "c_acctbal")}},
    "WITH c AS (SELECT c_custkey AS k, c_name AS x FROM customer), d AS (SELECT k, x AS y FROM c) SELECT y, count(k) AS n, max((SELECT max(n_name) FROM nation)) AS z FROM d GROUP BY y": {"y": {("customer", "c_name")}, "n": {("customer", "c_custkey")}, "z": {("nation", "n_name")}},
    "SELECT n_name AS x, 1 AS one FROM nation UNION ALL SELECT c_name, c_nationkey FROM customer": {"x": {("nation", "n_name"), ("customer", "c_name")}, "one": {("customer", "c_nationkey")}},
    "SELECT x.o_orderkey AS a, y.o_orderkey AS b FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey": {"a": {("orders", "o_orderkey")}, "b": {("orders", "o_orderkey")}},
    "SELECT sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS running FROM orders": {"running": {("orders", "o_totalprice"), ("orders", "o_custkey"), ("orders", "o_orderdate")}},
    "SELECT o_custkey, o_orderstatus, sum(o_totalprice) AS t FROM orders GROUP BY ROLLUP (o_custkey, o_orderstatus)": {"o_custkey": {("orders", "o_custkey")}, "o_orderstatus": {("orders", "o_orderstatus")}, "t": {("orders", "o_totalprice")}},
    "SELECT w FROM nation LATERAL VIEW explode(split(n_name, 'A')) t AS w": {"w": {("nation", "n_name")}},
    "SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer": {"n_nationkey": {("nation", "n_nationkey")}},
    "SELECT DISTINCT c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) ORDER BY c_name LIMIT 3": {"c_name": {("customer", "c_name")}},
    "WITH RECURSIVE r(n, p) AS (SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n + 1, p FROM r WHERE n < 30) SELECT p FROM r": {"p": {("nation", "n_name")}},
}


@pytest.mark.parametrize("query", QUERIES)
def test_columns_are_followed_through_sql(spark, query):
    for t in ("orders", "customer", "nation"):
        spark.read.parquet(f"{SF}/{t}.parquet").createOrReplaceTempView(t)
    got = sql_lineage.column_origins(spark.sql(query))
    assert {c: set(o) for c, o in got.items()} == QUERIES[query]


def test_a_function_over_rows_comes_from_any_column(spark):
    spark.read.parquet(f"{SF}/nation.parquet").createOrReplaceTempView("nation")
    df = spark.sql("SELECT n_name, n_nationkey FROM nation").mapInPandas(lambda it: it, "a string, b int")
    assert sql_lineage.column_origins(df)["a"] == {("nation", "n_name"), ("nation", "n_nationkey")}


def test_lineage_of_a_pipeline_with_a_sql_source(spark, tmp_path):
    views = {t: {"type": "parquet", "config": {"file_path": f"{SF}/{t}.parquet"}} for t in ("customer", "nation")}
    source = {"id": "q", "type": "source", "data": {"config": {"source_type": "sql", "source_config": {"query": "SELECT n_name, c_acctbal AS b FROM customer JOIN nation ON c_nationkey = n_nationkey", "views": views}}}}
    group = {"id": "g", "type": "aggregate", "data": {"config": {"group_by": ["n_name"], "aggregations": [{"column": "b", "function": "sum", "alias": "total"}]}}}
    sink = {"id": "o", "type": "output", "data": {"config": {"output_type": "parquet", "output_config": {"path": str(tmp_path / "out")}}}}
    run = runtime.Executor(spark, {"nodes": [source, group, sink], "edges": [{"source": "q", "target": "g"}, {"source": "g", "target": "o"}]}).run()
    assert run.status == runtime.COMPLETED, run.error
    rows = {(r.source_table, r.source_column, r.target_column) for r in run.lineage.records(spark).collect()}
    assert rows == {("nation", "n_name", "n_name"), ("customer", "c_acctbal", "total")}
    assert lineage.trace_back(run.lineage.records(spark), str(tmp_path / "out"), "total").first().source_column == "c_acctbal"
