"""SQLite's scalar functions for Spark SQL, as SQL functions of the session: Catalyst inlines them, so they stay in generated code.

register() makes them; queries of a `sql` source can use them then. A name that Spark has with another meaning gets the prefix
`sqlite_`. Times are ISO-8601 texts, Julian day numbers as text or 'now'; modifiers are the ones of whole days, hours,
minutes, seconds, months and years, and the starts of day, month and year.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Days from the beginning of Julian day numbers to 1970. Fixed value.
JULIAN_1970 = "2440587.5D"

#: Codes of strftime and Spark's patterns for them. Fixed values.
CODES = {"%d": "dd", "%H": "HH", "%j": "DDD", "%m": "MM", "%M": "mm", "%S": "ss", "%Y": "yyyy", "%f": "ss.SSS"}

# Arguments are bound once by a lambda, since a SQL function's body is put in place of each call.
_MOMENT = f"transform(array(t), s -> CASE WHEN lower(s) = 'now' THEN cast(current_timestamp() AS TIMESTAMP_NTZ) WHEN s RLIKE '^-?[0-9]+([.][0-9]*)?$' THEN timestampadd(MICROSECOND, cast(round((cast(s AS DOUBLE) - {JULIAN_1970}) * 86400000) * 1000 AS BIGINT), TIMESTAMP_NTZ '1970-01-01 00:00:00') ELSE try_cast(s AS TIMESTAMP_NTZ) END)[0]"
_AMOUNT = "cast(split(s.m, ' ')[0] AS DOUBLE)"
#: Micros of each unit. Fixed values.
UNITS = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000}
# A month that is too short rolls over into the next: January 31 and one month is March 2 or 3.
_ROLLED = "cast(timestampadd(DAY, dayofmonth(s.t) - 1, cast(add_months(date_trunc('MONTH', s.t), cast({n} AS INT)) AS TIMESTAMP_NTZ)) + (s.t - cast(date_trunc('DAY', s.t) AS TIMESTAMP_NTZ)) AS TIMESTAMP_NTZ)"
_MODIFIED = "transform(array(struct(t AS t, m AS m)), s -> CASE WHEN s.m IS NULL OR s.t IS NULL THEN s.t " + " ".join(
    [f"WHEN s.m = 'start of {u}' THEN cast(date_trunc('{u}', s.t) AS TIMESTAMP_NTZ)" for u in ("day", "month", "year")]
    + [f"WHEN s.m RLIKE '^[+-]?[0-9.]+ {u}s?$' THEN timestampadd(MICROSECOND, cast({_AMOUNT} * {n} AS BIGINT), s.t)" for u, n in UNITS.items()]
    + [f"WHEN s.m RLIKE '^[+-]?[0-9]+ {u}s?$' THEN {_ROLLED.format(n=f'{_AMOUNT} * {n}')}" for u, n in (("month", 1), ("year", 12))]
) + " END)[0]"
_FULL = "sqlite_modified(sqlite_modified(sqlite_modified(sqlite_moment(t), m1), m2), m3)"
_ARGS = "t STRING, m1 STRING DEFAULT NULL, m2 STRING DEFAULT NULL, m3 STRING DEFAULT NULL"
_MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {})"


def _formatted() -> str:
    out = "replace(s.f, '%%', chr(1))"
    for code, pattern in CODES.items():
        out = f"replace({out}, '{code}', date_format(s.t, '{pattern}'))"
    out = f"replace({out}, '%w', cast(dayofweek(s.t) - 1 AS STRING))"
    out = f"replace({out}, '%s', cast(floor({_MICROS.format('s.t')} / 1000000) AS STRING))"
    out = f"replace({out}, '%J', cast({_MICROS.format('s.t')} / 86400000000D + {JULIAN_1970} AS STRING))"
    return f"transform(array(struct(format AS f, {_FULL} AS t)), s -> replace({out}, chr(1), '%'))[0]"


#: Parameters, type and body of each function, in an order in which each finds those before it.
FUNCTIONS = {
    "sqlite_moment": ("t STRING", "TIMESTAMP_NTZ", _MOMENT),
    "sqlite_modified": ("t TIMESTAMP_NTZ, m STRING", "TIMESTAMP_NTZ", _MODIFIED),
    "sqlite_date": (_ARGS, "STRING", f"date_format({_FULL}, 'yyyy-MM-dd')"),
    "sqlite_time": (_ARGS, "STRING", f"date_format({_FULL}, 'HH:mm:ss')"),
    "sqlite_datetime": (_ARGS, "STRING", f"date_format({_FULL}, 'yyyy-MM-dd HH:mm:ss')"),
    "julianday": (_ARGS, "DOUBLE", f"{_MICROS.format(_FULL)} / 86400000000D + {JULIAN_1970}"),
    "unixepoch": (_ARGS, "BIGINT", f"cast(floor({_MICROS.format(_FULL)} / 1000000) AS BIGINT)"),
    "strftime": ("format STRING, " + _ARGS, "STRING", _formatted()),
    # ? is one character, * any number, [...] one of some; all else is itself.
    "glob": ("pattern STRING, text STRING", "BOOLEAN", r"text RLIKE concat('(?s)^', regexp_replace(replace(replace(regexp_replace(pattern, r'([\\\\.+(){}|$^])', r'\\$1'), '*', '.*'), '?', '.'), r'\[\\\^', '[^'), '$')"),
    "iif": ("test BOOLEAN, a STRING, b STRING", "STRING", "if(test, a, b)"),
    "json_extract": ("j STRING, path STRING", "STRING", "get_json_object(j, path)"),
    "json_valid": ("j STRING", "BOOLEAN", "try_parse_json(j) IS NOT NULL AND j IS NOT NULL"),
    "json_type": ("j STRING, path STRING DEFAULT '$'", "STRING", "transform(array(try_variant_get(try_parse_json(j), path, 'variant')), v -> CASE WHEN schema_of_variant(v) LIKE 'OBJECT%' THEN 'object' WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN 'array' WHEN schema_of_variant(v) = 'STRING' THEN 'text' WHEN schema_of_variant(v) = 'BIGINT' THEN 'integer' WHEN schema_of_variant(v) = 'BOOLEAN' THEN cast(v AS STRING) WHEN schema_of_variant(v) = 'VOID' THEN 'null' WHEN v IS NOT NULL THEN 'real' END)[0]"),
    "unicode": ("s STRING", "INT", "CASE WHEN s <> '' THEN conv(hex(encode(substr(s, 1, 1), 'UTF-32')), 16, 10) END"),
}
#: Functions that give rows.
TABLES = {
    "json_each": ("j STRING, path STRING DEFAULT '$'", "key STRING, value STRING, pos INT", "SELECT coalesce(key, cast(pos AS STRING)), cast(value AS STRING), pos FROM variant_explode(try_variant_get(try_parse_json(j), path, 'variant'))"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions for this session; their names."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    for name, (args, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE({columns}) RETURN {body}")
    return [*FUNCTIONS, *TABLES]
