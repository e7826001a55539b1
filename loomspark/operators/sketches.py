"""Approximate distinct counts and quantiles whose state is data: kept for each batch, and merged with later ones.

A state table has a row a group, its rows counted, and a binary column for each sketch. Merging two tables joins them by group
and unites the states, so that a new batch costs its own rows alone. Sets can also be intersected and subtracted (theta).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import ConfigError, _need, col

ROWS = "rows_seen"


@dataclass(frozen=True)
class Sketch:
    """kind: hll (distinct values, relative error about 1.04 / sqrt(2^k) at its k of 12: 1.6 %), theta (distinct values of sets,
    about 1.6 % at its k of 12), kll (quantiles, rank error about 1.3 % at its k of 200)."""

    alias: str
    column: str
    kind: str = "hll"
    k: int | None = None

    def state(self) -> Column:
        c = col(self.column)
        if self.kind == "hll":
            return F.hll_sketch_agg(c, self.k or 12)
        if self.kind == "theta":
            return F.theta_sketch_agg(c, self.k or 12)
        if self.kind == "kll":
            return F.kll_sketch_agg_double(c.cast("double"), self.k or 200)
        raise ConfigError(f"unknown sketch {self.kind!r}")

    def united(self, a: Column, b: Column) -> Column:
        both = {"hll": lambda: F.hll_union(a, b), "theta": lambda: F.theta_union(a, b), "kll": lambda: F.kll_sketch_merge_double(a, b)}[self.kind]()
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def states(df: DataFrame, keys: Sequence[str], sketches: Sequence[Sketch]) -> DataFrame:
    """The state table of a batch: partial states combine before the shuffle. Missing values don't count; a missing key is a group."""
    _need(df, [*keys, *[s.column for s in sketches]], "sketch")
    return df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias(ROWS), *[s.state().alias(s.alias) for s in sketches])


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str], sketches: Sequence[Sketch]) -> DataFrame:
    """One state table for both; a group that one lacks is the other's."""
    on = reduce(lambda x, y: x & y, [F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in keys], F.lit(True))
    # Whether a side has the group: its keys may all be null.
    both = old.alias("o").join(new.alias("n"), on, "full")
    there = F.col(f"o.{ROWS}").isNotNull()
    cols = [F.when(there, F.col(f"o.`{k}`")).otherwise(F.col(f"n.`{k}`")).alias(k) for k in keys]
    rows = (F.coalesce(F.col(f"o.{ROWS}"), F.lit(0)) + F.coalesce(F.col(f"n.{ROWS}"), F.lit(0))).alias(ROWS)
    return both.select(*cols, rows, *[s.united(F.col(f"o.`{s.alias}`"), F.col(f"n.`{s.alias}`")).alias(s.alias) for s in sketches])


def distinct_estimate(state: str, kind: str = "hll") -> Column:
    """About how many different values were seen; 0 of none."""
    return F.coalesce((F.hll_sketch_estimate if kind == "hll" else F.theta_sketch_estimate)(col(state)), F.lit(0).cast("long"))


def quantile_estimate(state: str, q: float) -> Column:
    """A value whose rank is about q of all; null of none."""
    filled = F.kll_sketch_get_n_double(col(state)) > 0
    return F.when(filled, F.kll_sketch_get_quantile_double(F.when(filled, col(state)), F.lit(float(q))))


def rank_estimate(state: str, value: Column) -> Column:
    """About which share of the values is up to `value`."""
    filled = F.kll_sketch_get_n_double(col(state)) > 0
    return F.when(filled, F.kll_sketch_get_rank_double(F.when(filled, col(state)), value.cast("double")))


class SketchTable:
    """A state table in a folder of any store, a version for each batch; a batch that comes twice counts once."""

    def __init__(self, path: str, keys: Sequence[str], sketches: Sequence[Sketch]) -> None:
        self.path, self.keys, self.sketches = path.rstrip("/"), list(keys), list(sketches)

    def _versions(self, spark) -> list[tuple[int, str]]:  # noqa: ANN001
        """(number, batch) of the versions that were written whole."""
        p = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(p):
            return []
        out = []
        for f in files.listStatus(p):
            number, _, batch = f.getPath().getName().partition("-")
            if number.isdigit() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
                out.append((int(number), batch))
        return sorted(out)

    def read(self, spark) -> DataFrame | None:  # noqa: ANN001
        found = self._versions(spark)
        return spark.read.parquet(f"{self.path}/{found[-1][0]:08d}-{found[-1][1]}") if found else None

    def add(self, df: DataFrame, batch: str) -> DataFrame:
        """The table after a batch, which is named by letters and digits; earlier versions stay for readers of theirs."""
        if not batch.isalnum():
            raise ConfigError("a batch is named by letters and digits")
        spark = df.sparkSession
        found = self._versions(spark)
        if batch in [b for _, b in found]:
            return self.read(spark)
        new, old = states(df, self.keys, self.sketches), self.read(spark)
        after = new if old is None else merged(old, new, self.keys, self.sketches)
        after.write.mode("overwrite").parquet(f"{self.path}/{found[-1][0] + 1 if found else 0:08d}-{batch}")
        return self.read(spark)
