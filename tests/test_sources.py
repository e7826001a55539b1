import http.server
import json
import math
import sqlite3
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.sources import readers, sqlite, writers


@pytest.fixture()
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        bodies, posted, fail = {}, [], 0

        def do_GET(self):
            data = json.dumps(Handler.bodies[self.path.split("?")[0]]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if Handler.fail > 0:
                Handler.fail -= 1
                self.send_response(500)
            else:
                Handler.posted.append(body)
                self.send_response(200)
            self.end_headers()

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    Handler.url = f"http://127.0.0.1:{s.server_port}"
    yield Handler
    s.shutdown()


def test_csv_types_and_missing(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,name,age,ok\n1,张三,28,true\n2,NA,,false\n3,\"a,b\",3.5,true\n")
    df = readers.read(spark, "csv", {"file_path": str(tmp_path / "x.csv")})
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "age": "double", "ok": "boolean"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "张三", 28.0, True), (2, None, None, False), (3, "a,b", 3.5, True)]
    (tmp_path / "y.csv").write_text("1;a\n2;b\n")
    assert readers.read(spark, "csv", {"file_path": str(tmp_path / "y.csv"), "delimiter": ";", "has_header": False}).columns == ["0", "1"]
    columns, first, total = readers.preview(spark, "csv", {"file_path": str(tmp_path / "x.csv")}, 2)
    assert (columns[0], len(first), total) == ("id", 2, 3)
    with pytest.raises(FileNotFoundError):
        readers.preview(spark, "csv", {"file_path": str(tmp_path / "gone.csv")})


def test_sqlite_both_ways(spark, tmp_path):
    db = str(tmp_path / "x.db")
    df = spark.range(2500).selectExpr("id", "id * 1.5D AS x", "cast(id AS string) AS s", "named_struct('a', id) AS n")
    config = {"db_path": db, "table_name": "t", "write_mode": "replace", "batch_size": 1000}
    assert writers.write(df, "sqlite", config).rows == 2500
    assert writers.write(df.limit(5), "sqlite", config | {"write_mode": "append"}).rows == 5
    back = readers.read(spark, "sqlite", {"db_path": db, "table_name": "t"})
    assert dict(back.dtypes)["x"] == "double" and back.count() == 2505 and back.filter("id > 2490").count() == 9
    assert readers.read(spark, "sqlite", {"db_path": db, "query": "SELECT count(*) AS n FROM t"}).first().n == 2505
    assert sqlite.list_tables(db) == ["t"]
    with pytest.raises(ValueError):
        readers.read(spark, "sqlite", {"db_path": db})


def test_sqlite_error_strategies(spark, tmp_path):
    db = str(tmp_path / "x.db")
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE t (id INTEGER CHECK (id < 10))")
    df = spark.range(12).coalesce(1)
    done = writers.write(df, "sqlite", {"db_path": db, "table_name": "t", "batch_size": 5})
    assert done.rows == 10 and len(done.errors) == 1 and "CHECK" in done.errors[0]
    for strategy in ("abort", "retry"):
        with pytest.raises(Exception, match="CHECK"):
            writers.write(df, "sqlite", {"db_path": db, "table_name": "t", "batch_size": 5, "error_strategy": strategy})
    with sqlite3.connect(db) as c:  # all or nothing, and nothing is left behind
        assert c.execute("SELECT count(*) FROM t").fetchone() == (10,) and sqlite.list_tables(db) == ["t"]


def test_sqlite_rows_of_failed_tasks_do_not_count(tmp_path):
    db, schema = str(tmp_path / "x.db"), T.StructType([T.StructField("id", T.LongType())])
    writer = sqlite.SqliteWriter({"db_path": db, "table_name": "t", "batch_size": "2"}, schema, False)

    def broken():
        yield from [(1,), (2,), (3,)]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    writer.commit([writer.write(iter([(1,), (2,), (3,)]))])
    assert sqlite.outcome(db, writer.run) == (3, []) and sqlite.list_tables(db) == ["t"]


def test_sqlite_batches_are_found_without_a_scan(tmp_path, monkeypatch):
    """Each batch's rows are a range: the steps of a commit are in proportion to its rows."""
    db, schema, steps, own = str(tmp_path / "x.db"), T.StructType([T.StructField("id", T.LongType())]), [], sqlite3.connect
    writer = sqlite.SqliteWriter({"db_path": db, "table_name": "t", "batch_size": "100"}, schema, False)
    written = writer.write((k,) for k in range(20_050))

    def counted(*args, **named):
        out = own(*args, **named)
        out.set_progress_handler(lambda: steps.append(1), 1000)
        return out

    monkeypatch.setattr(sqlite3, "connect", counted)
    writer.commit([written])
    assert len(steps) < 20_050 * 40 / 1000
    with own(db) as c:
        assert c.execute("SELECT count(*), min(id), max(id), count(DISTINCT id) FROM t").fetchone() == (20_050, 0, 20_049, 20_050)


def test_sqlite_takes_and_gives_batches_of_all_types(spark, tmp_path):
    db = str(tmp_path / "x.db")
    rows = [(1, 2.5, "ä", b"\x00\xff", True, 7), (None, None, None, None, None, None), (-(2**63), math.inf, "", b"", False, -1), (5, math.nan, "x'y", b"z", True, 0)]
    df = spark.createDataFrame(rows, "a long, b double, `c c` string, d binary, e boolean, f int")
    for k, some in enumerate((df, df.withColumn("g", F.lit("2024-01-02").cast("date")).withColumn("h", F.lit("1.50").cast("decimal(5,2)")))):
        writers.write(some, "sqlite", {"db_path": db, "table_name": f"t{k}", "batch_size": 2})
        got = readers.read(spark, "sqlite", {"db_path": db, "table_name": f"t{k}"}).collect()
        want = [(a, None if b is None or math.isnan(b) else b, c, d, e if e is None else int(e), f) for a, b, c, d, e, f in rows]
        assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    assert {(r.g, r.h) for r in got} == {("2024-01-02", "1.50")}


def test_sqlite_types_come_of_all_values(spark, tmp_path):
    db = str(tmp_path / "x.db")
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE t (n NUMERIC, i INTEGER, b BLOB, e TEXT)")
        c.executemany("INSERT INTO t VALUES (?, ?, ?, NULL)", [(k, k, b"x") for k in range(1500)] + [(2.5, "word", b"y")])
    got = readers.read(spark, "sqlite", {"db_path": db, "table_name": "t"})
    assert got.dtypes == [("n", "double"), ("i", "string"), ("b", "binary"), ("e", "string")]
    assert got.where("n = 2.5 AND i = 'word'").count() == 1 and got.count() == 1501
    assert readers.read(spark, "sqlite", {"db_path": db, "query": "SELECT n FROM t"}).agg({"n": "sum"}).first()[0] == sum(range(1500)) + 2.5


def test_csv_long_integers_and_missing_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n9223372036854775807,9223372036854775808,NA\n9223372036854775806,1,x\n")
    got = readers.read(spark, "csv", {"file_path": str(tmp_path / "a.csv")})
    assert got.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string")]
    assert sorted(r.a for r in got.collect()) == [9223372036854775806, 9223372036854775807]
    typed = readers.read(spark, "csv", {"file_path": str(tmp_path / "a.csv"), "schema": "a bigint, b double, c string"})
    assert typed.where("c IS NULL").count() == 1 and typed.dtypes[0] == ("a", "bigint")


def test_csv_sink(spark, tmp_path):
    done = writers.write(spark.createDataFrame([(1, "a"), (2, None)], "id int, s string"), "csv", {"export_dir": str(tmp_path), "filename": "o.csv", "delimiter": "|"})
    assert (tmp_path / "o.csv").read_text() == "id|s\n1|a\n2|\n" and done.path.endswith("o.csv")


def test_http(spark, server):
    server.bodies["/a"] = {"data": {"items": [{"id": 1, "address": {"city": "x"}}, {"id": 2, "address": {"city": "y"}}]}}
    server.bodies["/b"] = [{"id": 5}]
    server.bodies["/c"] = {"data": 3}
    df = readers.read(spark, "http_api", {"url": f"{server.url}/a", "data_path": "data.items", "params": {"q": 1}})
    assert sorted(r.city for r in df.select("address.city").collect()) == ["x", "y"]
    assert readers.read(spark, "http_api", {"url": f"{server.url}/b"}).first().id == 5
    with pytest.raises(ValueError):
        readers.read(spark, "http_api", {"url": f"{server.url}/c"})
    with pytest.raises(ValueError):
        readers.preview(spark, "http_api", {"url": f"{server.url}/a", "data_path": "data.gone"})


def test_http_sink(spark, server):
    server.posted.clear()
    server.fail = 2
    out = writers.write(spark.range(250).coalesce(1), "http_api", {"url": server.url, "batch_size": 100})
    assert (out.rows, out.errors) == (250, []) and sorted(map(len, server.posted)) == [50, 100, 100]
    server.fail = 1
    with pytest.raises(Exception, match="failed"):
        writers.write(spark.range(3).coalesce(1), "http_api", {"url": server.url, "error_strategy": "abort"})


def test_upload_keeps_to_its_folder(spark, tmp_path):
    path = readers.store_upload(b"a\n1\n", "../../evil.csv", str(tmp_path))
    assert path == str(tmp_path / "evil.csv")
    assert [r.name for r in readers.list_csv_files(spark, str(tmp_path)).collect()] == ["evil.csv"]
