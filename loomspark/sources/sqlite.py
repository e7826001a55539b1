"""SQLite tables and queries as a Spark data source, in both directions.

Reading splits a table by rowid ranges; a query is one partition. Spark's own filters aren't pushed to SQLite: Spark keeps a Python
reader with its filters for all uses of a DataFrame, so that a second use would miss the rows that the first filtered out.
Instead a pipeline that is folded gives what it knows as options of a frame of its own: `where` (SQL over the table's columns),
`row_limit`, and the columns by the schema it asks for (plans/pushdown.py). Writing goes through one partition, since SQLite has
one writer.
"""

from __future__ import annotations

import itertools
import json
import sqlite3
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: SQLite's affinities by a part of the declared type. Fixed values, in the order of its documentation.
AFFINITIES = [("INT", T.LongType()), ("CHAR", T.StringType()), ("CLOB", T.StringType()), ("TEXT", T.StringType()), ("REAL", T.DoubleType()), ("FLOA", T.DoubleType()), ("DOUB", T.DoubleType())]


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def text_columns(db_path: str, table: str) -> set[str]:
    """Columns that are declared to hold text, in which SQLite keeps numbers as text too."""
    with sqlite3.connect(db_path) as db:
        return {r[1] for r in db.execute(f"PRAGMA table_info({quoted(table)})") if isinstance(_declared(r[2]), T.StringType)}


def list_tables(db_path: str) -> list[str]:
    with sqlite3.connect(db_path) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]


def _declared(kind: str | None) -> T.DataType | None:
    return next((t for part, t in AFFINITIES if part in (kind or "").upper()), None)


def _fitting(declared: T.DataType | None, kinds: set[str]) -> T.DataType:
    """The type of a column by its declaration, where its values' kinds (of SQLite's typeof) allow that, else by the kinds."""
    if declared is not None and kinds <= {T.LongType: {"integer"}, T.DoubleType: {"integer", "real"}}.get(type(declared), {"integer", "real", "text", "blob"}):
        return declared
    if kinds and kinds <= {"integer"}:
        return T.LongType()
    if kinds and kinds <= {"integer", "real"}:
        return T.DoubleType()
    return T.BinaryType() if kinds == {"blob"} else T.StringType()


@dataclass
class Slice(InputPartition):
    sql: str
    params: tuple = ()


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.path, self.table, self.query, self.schema = options["db_path"], options.get("table_name"), options.get("query"), schema
        self.parts, self.where, self.limit = options.get("partitions"), options.get("where"), options.get("row_limit")

    def partitions(self) -> Sequence[InputPartition]:
        cols = ", ".join(quoted(f.name) for f in self.schema.fields) or "NULL"
        some = f"({self.where})" if self.where else "TRUE"
        if self.query:
            return [Slice(f"SELECT {cols} FROM ({self.query.rstrip().rstrip(';')}) WHERE {some}{self._limited()}")]
        name = quoted(self.table)
        with sqlite3.connect(self.path) as db:
            try:
                lo, hi = db.execute(f"SELECT min(rowid), max(rowid) FROM {name}").fetchone()
            except sqlite3.OperationalError:  # a table without rowid
                return [Slice(f"SELECT {cols} FROM {name} WHERE {some}{self._limited()}")]
        if lo is None:
            return []
        if self.limit:
            return [Slice(f"SELECT {cols} FROM {name} WHERE {some}{self._limited()}")]
        step = (hi - lo) // int(self.parts or max(4, (hi - lo) // _SLICE + 1)) + 1
        return [Slice(f"SELECT {cols} FROM {name} WHERE rowid BETWEEN ? AND ? AND {some}", (a, min(hi, a + step - 1))) for a in range(lo, hi + 1, step)]

    def _limited(self) -> str:
        return f" LIMIT {int(self.limit)}" if self.limit else ""

    def read(self, partition: Slice | None) -> Iterator[tuple]:
        if partition is None:  # Spark's one partition of none
            return
        kinds = [f.dataType for f in self.schema.fields]
        with sqlite3.connect(self.path) as db:
            for row in db.execute(partition.sql, partition.params):
                yield tuple(_fit(v, k) for v, k in zip(row, kinds, strict=True))


#: Types whose values are the same in Arrow and in rows, so that whole batches can go.
_PLAIN = {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BinaryType: pa.binary()}
#: Rows of a batch that is read, the least number that a writer commits at once, and rowids of a slice where no number of slices is given.
_FETCH, _COMMIT, _SLICE = 10_000, 50_000, 1_000_000


def _plain(schema: T.StructType, *more: type) -> bool:
    return len(schema) > 0 and all(type(f.dataType) in (*_PLAIN, *more) for f in schema.fields)


class ArrowReader(SqliteReader):
    """Reads the same rows in Arrow batches."""

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        kinds, names = [f.dataType for f in self.schema.fields], [f.name for f in self.schema.fields]
        with sqlite3.connect(self.path) as db:
            rows = db.execute(partition.sql, partition.params)
            while some := rows.fetchmany(_FETCH):
                columns = [pa.array(c if isinstance(k, T.LongType) else [_fit(v, k) for v in c], _PLAIN[type(k)]) for c, k in zip(zip(*some, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def _fit(value: object, kind: T.DataType) -> object:
    if value is None:
        return None
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else str(value)
    return value


@dataclass
class Written(WriterCommitMessage):
    table: str
    rows: int


#: Where a writer leaves its count and errors for the caller, by run.
OUTCOMES = "_loomspark_outcomes"


class SqliteWriter(DataSourceWriter):
    """Appends in batches; with error_strategy skip a failed batch is left out, abort leaves the table as it was, retry tries
    once more and then aborts.

    A task writes to a table of its own; commit() moves the rows of those that succeeded, in one transaction. So a task that is
    run again doubles nothing.
    """

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool) -> None:
        self.path, self.table, self.schema, self.overwrite = options["db_path"], options["table_name"], schema, overwrite
        self.batch, self.strategy = int(options.get("batch_size", 1000)), options.get("error_strategy", "skip")
        self.run = options.get("run_id") or uuid.uuid4().hex
        if self.strategy not in ("skip", "abort", "retry"):
            raise ValueError(f"unknown error strategy {self.strategy!r}")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        return self._filled(tuple(str(v) if v is not None and not isinstance(v, (int, float, str, bytes)) else v for v in row) for row in iterator)

    def _filled(self, rows: Iterator[tuple]) -> WriterCommitMessage:
        names = [f.name for f in self.schema.fields]
        own, n, at_once = f"_stage_{self.run}_{uuid.uuid4().hex}", 0, max(self.batch, _COMMIT)
        sql = f"INSERT INTO {quoted(own)} VALUES ({', '.join('?' * len(names))})"
        db = sqlite3.connect(self.path, timeout=60)
        try:
            with db:
                db.execute(f"CREATE TABLE {quoted(own)} ({', '.join(f'c{k}' for k in range(len(names)))})")
            while some := list(itertools.islice(rows, at_once)):
                with db:
                    db.executemany(sql, some)
                n += len(some)
        finally:
            db.close()
        return Written(own, n)

    def commit(self, messages: list) -> None:
        kinds = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.ShortType: "INTEGER", T.BooleanType: "INTEGER", T.DoubleType: "REAL", T.FloatType: "REAL", T.BinaryType: "BLOB"}
        names, rows, errors = [f.name for f in self.schema.fields], 0, []
        cols = ", ".join(map(quoted, names))
        db = sqlite3.connect(self.path, timeout=60, isolation_level=None)
        try:
            db.execute("BEGIN IMMEDIATE")
            if self.overwrite:
                db.execute(f"DROP TABLE IF EXISTS {quoted(self.table)}")
            db.execute(f"CREATE TABLE IF NOT EXISTS {quoted(self.table)} ({', '.join(f'{quoted(f.name)} {kinds.get(type(f.dataType), 'TEXT')}' for f in self.schema.fields)})")
            for m in filter(None, messages):
                move = f"INSERT INTO {quoted(self.table)} ({cols}) SELECT {', '.join(f'c{k}' for k in range(len(names)))} FROM {quoted(m.table)} WHERE rowid BETWEEN ? AND ? ORDER BY rowid"
                for first in range(1, m.rows + 1, self.batch):  # a batch is a range of rowids, so that it's found without a scan
                    for left in (1, 0) if self.strategy == "retry" else (0,):
                        db.execute("SAVEPOINT batch")
                        try:
                            rows += db.execute(move, (first, first + self.batch - 1)).rowcount
                            db.execute("RELEASE batch")
                            break
                        except sqlite3.Error as e:
                            db.execute("ROLLBACK TO batch")
                            db.execute("RELEASE batch")
                            errors.append(str(e))
                            if self.strategy != "skip" and not left:
                                raise
            db.execute(f"CREATE TABLE IF NOT EXISTS {OUTCOMES} (run TEXT, rows INTEGER, errors TEXT)")
            db.execute(f"INSERT INTO {OUTCOMES} VALUES (?, ?, ?)", (self.run, rows, json.dumps(errors)))
            db.execute("COMMIT")
        except sqlite3.Error:
            db.execute("ROLLBACK")
            raise
        finally:
            db.close()
            self.abort(messages)

    def abort(self, messages: list) -> None:
        """Drops what the tasks of this run left, those that failed included."""
        with sqlite3.connect(self.path, timeout=60) as db:
            for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND substr(name, 1, ?) = ?", (len(self.run) + 7, f"_stage_{self.run}")).fetchall():
                db.execute(f"DROP TABLE {quoted(name)}")


class ArrowWriter(SqliteWriter, DataSourceArrowWriter):
    """Takes the same rows in Arrow batches."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return self._filled(row for batch in iterator for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))


def outcome(db_path: str, run: str) -> tuple[int, list[str]]:
    """Rows and errors of a finished run, which are forgotten then."""
    with sqlite3.connect(db_path, timeout=60) as db:
        rows, errors = db.execute(f"SELECT rows, errors FROM {OUTCOMES} WHERE run = ?", (run,)).fetchone()
        db.execute(f"DELETE FROM {OUTCOMES} WHERE run = ?", (run,))
        if not db.execute(f"SELECT count(*) FROM {OUTCOMES}").fetchone()[0]:
            db.execute(f"DROP TABLE {OUTCOMES}")
    return rows, json.loads(errors)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomspark_sqlite"

    def schema(self) -> T.StructType:
        path, query, table = self.options["db_path"], self.options.get("query"), self.options.get("table_name")
        if not query and not table:
            raise ValueError("a SQLite source needs a query or a table_name")
        with sqlite3.connect(path) as db:
            source = f"({query.rstrip().rstrip(';')})" if query else quoted(table)
            names = [d[0] for d in db.execute(f"SELECT * FROM {source} LIMIT 0").description]
            declared = {} if query else {r[1]: _declared(r[2]) for r in db.execute(f"PRAGMA table_info({quoted(table)})")}
            # The kinds of all values, in one pass: SQLite lets any column hold any of them.
            kinds = ("integer", "real", "text", "blob")
            told = db.execute(f"SELECT {', '.join(f'max(typeof({quoted(n)}) = {k!r})' for n in names for k in kinds)} FROM {source}").fetchone()
        held = [{k for k, t in zip(kinds, told[4 * i : 4 * i + 4], strict=True) if t} for i in range(len(names))]
        return T.StructType([T.StructField(n, _fitting(declared.get(n), h)) for n, h in zip(names, held, strict=True)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return (ArrowReader if _plain(schema) else SqliteReader)(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return (ArrowWriter if _plain(schema, T.IntegerType, T.ShortType, T.BooleanType, T.FloatType) else SqliteWriter)(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)
