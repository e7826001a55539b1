"""Exact quantiles of groups of any size, by selecting ranks over ranges instead of holding a group's values together.

Spark's percentile keeps a group's distinct values in one buffer. Here equal values of a group become one row with a count,
which combines before the shuffle; those rows are cut into ranges of (group, value), so that one large group is many tasks'
work. The counts of a group's ranges, as many rows as there are ranges at most, tell in which of them each wanted rank lies,
and only those ranges are summed up value by value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged, unstage
from .relational import ConfigError, _need, col


def _alike(left: str, right: str, n: int) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.k{i}").eqNullSafe(F.col(f"{right}.k{i}")) for i in range(n)], F.lit(True))


def quantiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]], parts: int | None = None) -> DataFrame:
    """One row a group: its keys, and for each name in `wanted` the quantile (0 to 1) of a column, between two values in
    proportion, as a double.

    Missing values and NaN don't count; a group without others has null. A missing key is a group of its own. No keys: one row,
    or none for an empty table. Long integers beyond 2^53 are rounded as doubles.
    """
    _need(df, [*keys, *[c for c, _ in wanted.values()]], "quantiles")
    if any(not 0 <= q <= 1 for _, q in wanted.values()):
        raise ConfigError("a quantile is from 0 to 1")
    names = [f"k{i}" for i in range(len(keys))]
    grouped = [col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    out = df.select(*grouped).distinct() if keys else df.limit(1).select(F.lit(1).alias("one"))
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    for c in columns:
        own = {alias: q for alias, (x, q) in wanted.items() if x == c}
        found = _of_column(df.select(*grouped, col(c).cast("double").alias("x")), names, own, parts)
        out = out.alias("a").join(found.alias("b"), _alike("a", "b", len(names)), "left").select("a.*", *[F.col(f"b.`q {a}`") for a in own])
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], *[F.col(f"`q {a}`").alias(a) for a in wanted])


def _of_column(rows: DataFrame, names: list[str], own: dict[str, float], parts: int | None) -> DataFrame:
    """names and `q <alias>` of each group that has a value."""
    spark = rows.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = rows.where(F.col("x").isNotNull() & ~F.isnan("x")).groupBy(*names, "x").agg(F.count(F.lit(1)).alias("n"))
    cut = staged(counted.repartitionByRange(parts, *names, "x").withColumn("p", F.spark_partition_id()), "ranges")
    # Of each group a row a range, as few as there are tasks.
    per_range = cut.groupBy(*names, "p").agg(F.sum("n").alias("s"))
    by = Window.partitionBy(*names)
    sums = per_range.select(*names, "p", "s", (F.sum("s").over(by.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("before"), F.sum("s").over(by).alias("total"))
    # Places are counted from 0; each quantile lies between two of them.
    places = []
    for alias, q in own.items():
        at = F.lit(float(q)) * (F.col("total") - 1)
        share = at - F.floor(at)
        places += [F.struct(F.lit(alias).alias("a"), F.floor(at).cast("long").alias("r"), (1 - share).alias("w"), F.lit(0).alias("up")), F.struct(F.lit(alias).alias("a"), F.ceil(at).cast("long").alias("r"), share.alias("w"), F.lit(1).alias("up"))]
    here = F.filter(F.array(*places), lambda t: (t["r"] >= F.col("before")) & (t["r"] < F.col("before") + F.col("s")))
    targets = sums.select(*names, "p", "before", here.alias("ts")).where(F.size("ts") > 0)
    met = cut.alias("a").join(targets.alias("b"), _alike("a", "b", len(names)) & (F.col("a.p") == F.col("b.p"))).select("a.*", "b.before", "b.ts")
    running = F.sum("n").over(Window.partitionBy(*names, "p").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    upto = met.withColumn("upto", F.col("before") + running)
    hits = upto.select(*names, "x", "upto", "n", F.explode("ts").alias("t")).where((F.col("t.r") < F.col("upto")) & (F.col("t.r") >= F.col("upto") - F.col("n")))
    of = lambda a, up: F.max(F.when((F.col("t.a") == a) & (F.col("t.up") == up), F.col("x")))
    share = lambda a: F.max(F.when((F.col("t.a") == a) & (F.col("t.up") == 1), F.col("t.w")))
    # The lower value plus a share of the difference: two infinities of one sign have none.
    value = lambda a: F.when(of(a, 0) == of(a, 1), of(a, 0)).otherwise(of(a, 0) + (of(a, 1) - of(a, 0)) * share(a))
    got = hits.groupBy(*names).agg(*[value(a).alias(f"q {a}") for a in own])
    out = staged(got, "quantiles")
    unstage(cut)
    return out
