"""SQLite's functions in Spark SQL give what SQLite gives."""

import sqlite3

import pytest

from loomspark.functions import sqlite_sql

#: The same call in Spark, and in SQLite where it is written otherwise.
CALLS = [
    ("sqlite_date('2024-01-31', '+1 month')", "date('2024-01-31', '+1 month')"), ("sqlite_datetime('2024-03-10 11:12:13', 'start of month', '-1 day')", "datetime('2024-03-10 11:12:13', 'start of month', '-1 day')"),
    ("sqlite_datetime('2024-02-29', '+1 year')", "datetime('2024-02-29', '+1 year')"), ("sqlite_datetime('2024-02-29', '+1.5 days', '-90 minutes')", "datetime('2024-02-29', '+1.5 days', '-90 minutes')"), ("sqlite_time('2460000.25')", "time('2460000.25')"),
    ("sqlite_date('nonsense')", "date('nonsense')"), ("sqlite_date(NULL)", "date(NULL)"), ("sqlite_date('2024-05-05', 'start of year', '+1 day', '-1 second')", "date('2024-05-05', 'start of year', '+1 day', '-1 second')"),
    ("julianday('2024-03-10 06:00:00')", None), ("julianday('1969-12-31 18:00:00')", None), ("unixepoch('2024-03-10 06:00:00')", None), ("unixepoch('1969-12-31 23:59:59')", None),
    ("strftime('%Y/%m/%d %H:%M:%S %j %w %s %% %f', '2024-03-10 06:07:08')", None), ("strftime('%Y', NULL)", None), ("strftime('%w', '2024-03-09', '+1 day')", None),
    ("glob('*a[0-9]?', 'xxa5y')", "'xxa5y' GLOB '*a[0-9]?'"), ("glob('a.c', 'abc')", "'abc' GLOB 'a.c'"), ("glob('[^a]x', 'bx')", "'bx' GLOB '[^a]x'"), ("glob('a(b)$', 'a(b)$')", "'a(b)$' GLOB 'a(b)$'"), ("glob('A', 'a')", "'a' GLOB 'A'"),
    ("""json_extract('{"a":{"b":3}}', '$.a.b')""", None), ("""json_type('{"a":[1]}', '$.a')""", None), ("""json_type('{"a":1.5}', '$.a')""", None), ("""json_type('{"a":null}', '$.a')""", None), ("""json_type('{"a":"x"}', '$.a')""", None), ("""json_type('{"a":1}')""", None), ("""json_type('{"a":1}', '$.b')""", None),
    ("json_valid('{x')", None), ("json_valid('[1]')", None), ("unicode('ü')", None), ("unicode('')", None), ("iif(1 > 2, 'a', 'b')", None),
]


@pytest.mark.parametrize(("call", "own"), CALLS)
def test_calls_equal_sqlite(spark, call, own):
    sqlite_sql.register(spark) if call is CALLS[0][0] else None
    got = spark.sql(f"SELECT {call} AS x").first().x
    want = sqlite3.connect(":memory:").execute(f"SELECT {own or call}").fetchone()[0]
    assert str(int(got) if isinstance(got, bool) else got) == str(want)


def test_rows_of_json(spark):
    sqlite_sql.register(spark)
    assert [tuple(r) for r in spark.sql("""SELECT key, value FROM json_each('{"a":1,"b":"x"}')""").collect()] == [("a", "1"), ("b", "x")]
    assert [tuple(r) for r in spark.sql("SELECT t.id, e.key, e.value FROM (SELECT 1 AS id, '[5,6]' AS j) t, LATERAL json_each(t.j) e").collect()] == [(1, "0", "5"), (1, "1", "6")]
    assert spark.sql("SELECT * FROM json_each('{x')").collect() == []
