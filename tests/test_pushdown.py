"""Conditions and columns in the SQL that SQLite sees; results are those of Spark alone."""

import sqlite3

import pytest

from loomspark.plans import pushdown, runtime
from loomspark.sources import readers, sqlite

CONDITIONS = [
    "n > 3", "n >= 3 and x < 2.5", "5 < n <= 9", "s == 'b'", "s != 'b'", "n != 4", "s in ['a', 'c'] or n == 1", "n in [1, 2, None]", "s.isnull()", "s.notnull() and n.between(2, 6)", "not (n > 3)", "x > 1 and not (s == 'a')", "n > 3 or x * 2 > 3",
    "s > 'a'", "s.str.startswith('a') and n < 8", "mixed == '5'", "n < 5", "`odd name` == 2", "s == \"it's\"", "big == 9007199254740993", "x == 1", "n == 2.0", "flag == 'A'", "s in []",
]


@pytest.fixture(scope="module")
def db(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "x.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER, x REAL, s TEXT, mixed, \"odd name\" INT, big BIGINT, flag TEXT COLLATE NOCASE)")
        rows = [(k, k % 11 if k % 7 else None, (k % 5) / 2 if k % 6 else None, ["a", "b", "c", "it's", None][k % 5], [5, "5", "x", None][k % 4], k % 3, 9007199254740992 + k % 3, "aAb"[k % 3]) for k in range(200)]
        c.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?, ?, ?)", rows)
    return path


def spec(db, *nodes):
    first = {"id": "src", "type": "source", "data": {"config": {"source_type": "sqlite", "source_config": {"db_path": db, "table_name": "t"}}}}
    chain = [first, *nodes]
    return {"nodes": chain, "edges": [{"source": a["id"], "target": b["id"]} for a, b in zip(chain, chain[1:], strict=False)]}


def keep(key, condition):
    return {"id": key, "type": "filter", "data": {"config": {"condition": condition}}}


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("condition", CONDITIONS)
def test_rows_are_those_without_pushdown(spark, db, condition):
    graph = spec(db, keep("some", condition))
    pushed = runtime.build(spark, graph)
    assert rows(pushed["some"]) == rows(runtime.build(spark, graph, push=False)["some"])
    assert pushed["src"].count() == 200


def test_sqlite_sees_the_conditions_and_columns(spark, db, monkeypatch):
    seen = []
    own = readers.read_sqlite
    monkeypatch.setattr(readers, "read_sqlite", lambda s, config, schema=None: seen.append((config, schema)) or own(s, config, schema))
    group = {"id": "sums", "type": "aggregate", "data": {"config": {"group_by": ["s"], "aggregations": [{"column": "x", "function": "sum", "alias": "total"}]}}}
    out = runtime.build(spark, spec(db, keep("one", "n > 3"), keep("two", "s == 'a' or s == 'b'"), group))
    config, schema = seen[-1]
    assert config["where"] == "((\"n\" > 3)) AND (((\"s\" = 'a' COLLATE BINARY OR typeof(\"s\") = 'blob')) OR ((\"s\" = 'b' COLLATE BINARY OR typeof(\"s\") = 'blob')))"
    assert schema.names == ["n", "x", "s"]
    parts = sqlite.SqliteReader(config, schema).partitions()
    assert len(parts) == 4 and all(p.sql.startswith('SELECT "n", "x", "s" FROM "t" WHERE rowid BETWEEN ? AND ? AND ') and config["where"] in p.sql for p in parts)
    fetched = sum(1 for p in parts for _ in sqlite.SqliteReader(config, schema).read(p))
    assert fetched == out["two"].count() < 200
    assert rows(out["sums"]) == rows(runtime.build(spark, spec(db, keep("one", "n > 3"), keep("two", "s == 'a' or s == 'b'"), group), push=False)["sums"])


def test_a_second_use_of_a_frame_is_whole(spark, db):
    out = runtime.build(spark, spec(db, keep("some", "n > 3")))["some"]
    n = out.count()
    assert out.filter("x > 1").count() < n and out.count() == n and out.select("id").count() == n


def test_what_sql_cannot_say_is_left_out(spark, db):
    schema = readers.read_sqlite(spark, {"db_path": db, "table_name": "t"}).schema
    text = sqlite.text_columns(db, "t")
    sql = lambda c: pushdown.where_sql(c, schema, text)
    assert text == {"s", "flag"} and schema["mixed"].dataType.simpleString() == "string"
    assert sql("s > 'a'") is None and sql("n > 3 or x * 2 > 3") is None and sql("not (n > 3)") is None and sql("mixed == '5'") is None and sql("n == 2.0") is None
    assert sql("n > 3 and x * 2 > 3") == '((("n" > 3)))'


def test_preview_and_queries(spark, db):
    columns, first, total = readers.preview(spark, "sqlite", {"db_path": db, "table_name": "t"}, 3)
    assert len(first) == 3 and total == 200 and columns[0] == "id"
    part = sqlite.SqliteReader({"db_path": db, "table_name": "t", "row_limit": "3"}, readers.read_sqlite(spark, {"db_path": db, "table_name": "t"}).schema).partitions()
    assert len(part) == 1 and part[0].sql.endswith(" LIMIT 3")
    graph = spec(db, keep("some", "n > 3"))
    graph["nodes"][0]["data"]["config"]["source_config"] = {"db_path": db, "query": "SELECT id, n FROM t;"}
    assert rows(runtime.build(spark, graph)["some"]) == rows(runtime.build(spark, graph, push=False)["some"])
