"""Joins by order instead of equality: the last row before a moment, and points that lie in intervals.

Neither compares all rows of a key with all others, and neither needs a key's rows in one task, so that a key which most rows
have is spread over time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..naming import fresh
from ..staging import staged, unstage
from .relational import ConfigError, _need, col


def _number(df: DataFrame, name: str) -> Column:
    """The column as a number that keeps its order: moments in microseconds. Decimals go by their doubles."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col(name))
    if isinstance(kind, T.TimestampNTZType):
        c = col(name)  # by its fields, so that no time zone comes in
        return F.unix_date(c.cast("date")).cast("long") * F.lit(86_400_000_000) + (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(col(name)).cast("long")
    if isinstance(kind, T.IntegralType):
        return col(name).cast("long")
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return col(name).cast("double")
    raise ConfigError(f"column {name!r} has no order by number")


def _same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x & y, [a.eqNullSafe(b) for a, b in zip(left, right, strict=True)], F.lit(True))


def _named(left: DataFrame, right: DataFrame, drop: Sequence[str]) -> list[Column]:
    """The columns of both: a name that both have gets a suffix on both; the right's `drop` are left out."""
    both = set(left.columns) & {c for c in right.columns if c not in drop}
    return [F.col(f"l.`{c}`").alias(f"{c}_left" if c in both else c) for c in left.columns] + [F.col(f"r.`{c}`").alias(f"{c}_right" if c in both else c) for c in right.columns if c not in drop]


def as_of(left: DataFrame, right: DataFrame, on: str, keys: Sequence[str] = (), right_on: str | None = None, direction: str = "backward", exact: bool = True, tolerance: float | None = None, how: str = "left", buckets: int | None = None) -> DataFrame:
    """Each left row with the right row of its key whose `right_on` is the last up to `on` (forward: the first from it on).

    `exact` False leaves out equal moments. `tolerance` is the greatest distance, in seconds for timestamps, days for dates,
    else in units of the column. `how` left keeps rows without a match. Missing keys match each other; a row without a moment has
    no match; of right rows alike in key and moment the greatest is taken, by its columns in order.

    Distinct moments of a key are scanned in `buckets` spans of time, each a task's share: within a span the last right moment
    runs along, and what a span inherits is read from one row a span and key. Rows meet their moment by equality, which can be split.
    """
    right_on = right_on or on
    _need(left, [on, *keys], "as-of join")
    _need(right, [right_on, *keys], "as-of join")
    if direction not in ("backward", "forward") or how not in ("left", "inner"):
        raise ConfigError("an as-of join goes backward or forward, left or inner")
    sign = 1 if direction == "backward" else -1
    spark, k = left.sparkSession, [f"k{i}" for i in range(len(keys))]
    at_left, at_right = _number(left, on) * sign, _number(right, right_on) * sign
    moments = lambda df, at, is_right: df.select(*[col(c).alias(n) for c, n in zip(keys, k, strict=True)], at.alias("t"), F.lit(is_right).alias("is_right")).where(F.col("t").isNotNull())
    each = moments(left, at_left, False).unionByName(moments(right, at_right, True)).groupBy(*k, "t").agg(F.bool_or("is_right").alias("is_right"))
    each = staged(each, "moments")
    span = each.agg(F.min("t").cast("double").alias("lo"), F.max("t").cast("double").alias("hi")).first()
    buckets = buckets or 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    width = max(((span.hi or 0) - (span.lo or 0)) / buckets, 1e-9)
    each = each.withColumn("b", F.floor((F.col("t").cast("double") - F.lit(span.lo or 0.0)) / F.lit(width)))
    mine = F.when(F.col("is_right"), F.col("t"))
    # What a span of time inherits: the last right moment of the spans before it.
    past = Window.partitionBy(*k).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    heirs = each.groupBy(*k, "b").agg(F.max(mine).alias("top")).select(*k, "b", F.max("top").over(past).alias("top"))
    along = Window.partitionBy(*k, "b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0 if exact else -1)
    seen = each.withColumn("own", F.max(mine).over(along)).alias("x")
    found = seen.join(heirs.alias("y"), _same([F.col(f"x.{c}") for c in k] + [F.col("x.b")], [F.col(f"y.{c}") for c in k] + [F.col("y.b")])).select("x.*", F.coalesce("own", "top").alias("met"))
    if tolerance is not None:
        unit = 1_000_000 if isinstance(left.schema[on].dataType, (T.TimestampType, T.TimestampNTZType)) else 1
        found = found.where(F.col("t") - F.col("met") <= tolerance * unit)
    found = staged(found.where(F.col("met").isNotNull()).select(*[F.col(c).alias(f"m_{c}") for c in k], F.col("t").alias("m_t"), "met"), "matches")
    unstage(each)
    # The matched right row of each moment, one of those alike.
    rest = F.struct(*[col(c) for c in right.columns])
    rows = right.select(*[col(c).alias(n) for c, n in zip(keys, k, strict=True)], at_right.alias("t"), rest.alias("row")).where(F.col("t").isNotNull())
    best = rows.groupBy(*k, "t").agg(F.max("row").alias("row"))
    needed = found.join(best, _same([F.col(f"m_{c}") for c in k] + [F.col("met")], [F.col(c) for c in k] + [F.col("t")])).select(*[f"m_{c}" for c in k], "m_t", "row")
    needed = staged(needed, "needed")
    unstage(found)
    # Helper columns stand beside the left's own, under names of their own.
    mk, mt, row, lt = [fresh(f"_m{i}", left) for i in range(len(k))], fresh("_mt", left), fresh("_row", left), fresh("_t", left)
    needed = needed.select(*[F.col(f"m_{c}").alias(m) for c, m in zip(k, mk, strict=True)], F.col("m_t").alias(mt), F.col("row").alias(row))
    out = left.withColumn(lt, at_left).join(needed, _same([col(c) for c in keys], [F.col(m) for m in mk]) & (F.col(lt) == F.col(mt)), "left" if how == "left" else "inner")
    both = set(left.columns) & (set(right.columns) - set(keys))
    return out.select(*[col(c).alias(f"{c}_left" if c in both else c) for c in left.columns], *[F.col(row).getField(c).alias(f"{c}_right" if c in both else c) for c in right.columns if c not in keys])


#: The size, a power of two, of intervals without a finite length: one cell holds them all.
_ENDLESS = 1024
#: Sizes up to so many powers under the greatest of a class have its cells, so that a point is looked up once for all of them.
_SPREAD = 2


def _spans(df: DataFrame, low: str, high: str, size: str) -> DataFrame:
    """Intervals with two ends in order, and in `size` the power of two next above their length. It is no less than what doubles
    tell apart at the farther end: smaller cells would have numbers beyond a long's, and all be its greatest one."""
    lo, hi = (_number(df, c).cast("double") for c in (low, high))
    far = F.greatest(F.abs(lo), F.abs(hi))
    s = F.when(hi - lo < 2.0**-20, -20).otherwise(F.ceil(F.log2(hi - lo)).cast("int"))
    s = F.when((s < 1023) & (F.pow(F.lit(2.0), s) < hi - lo), s + 1).otherwise(s)  # log2 isn't exact
    s = F.when(far > 0, F.greatest(s, F.ceil(F.log2(far)).cast("int") - 52)).otherwise(s)
    s = F.when((far == float("inf")) | (hi - lo == float("inf")), _ENDLESS).otherwise(s)
    return df.where(lo.isNotNull() & hi.isNotNull() & ~F.isnan(lo) & ~F.isnan(hi) & (lo <= hi)).withColumn(size, s)


def _classes(sizes: DataFrame) -> dict[int, int]:
    """For each size that occurs, a few dozen at most, the one whose cells hold it."""
    out, top = {}, _ENDLESS
    for (s,) in sorted(sizes.distinct().collect(), reverse=True):
        top = s if top == _ENDLESS or top - s > _SPREAD else top
        out[s] = top
    return out


def _cell(v: Column, size: Column) -> Column:
    """None where no interval of that size can be."""
    at = v / F.pow(F.lit(2.0), size)
    return F.when(size == _ENDLESS, F.lit(0).cast("long")).when(F.abs(at) <= 2.0**53, F.floor(at))


def _held(spans: DataFrame, low: str, high: str, size: Column, cell: str) -> DataFrame:
    """Each interval once for each of the cells that it touches, two at most."""
    return spans.withColumn(cell, F.explode(F.array_distinct(F.array(*[_cell(_number(spans, c).cast("double"), size) for c in (low, high)]))))


def range_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, keys: Sequence[str] = (), closed: str = "both", how: str = "inner") -> DataFrame:
    """Rows of `points` with those of `intervals` of equal keys that hold their `point`: low <= point <= high, or less at the
    ends that `closed` (both, left, right, neither) leaves out. `how` left keeps points that lie in none.

    Each interval is held under the power of two next above its length, or one a little greater that others have: of the cells of
    that size it touches two at most. A point is looked up in its one cell of each size in use, which are few. So long intervals
    cost no more than short ones, and the join is by equality of key and cell, with the ends tested on the pairs that meet. With
    one size in use it is one join, left or inner. Missing keys match each other; rows without a point or an end, NaN among
    them, and intervals whose ends are in the wrong order, match nothing. Ends may be infinite.
    """
    _need(points, [point, *keys], "range join")
    _need(intervals, [low, high, *keys], "range join")
    if closed not in ("both", "left", "right", "neither") or how not in ("inner", "left"):
        raise ConfigError("a range join is closed on both, left, right or neither, inner or left")
    x = _number(points, point).cast("double")
    s, c = fresh("_size", points, intervals), fresh("_cell", points, intervals)
    spans = _spans(intervals, low, high, s)
    if closed != "both":
        spans = spans.where(col(low) < col(high))  # others hold nothing
    classes = _classes(spans.select(s))
    tops = sorted(set(classes.values()))
    inside = {"both": (lambda v, a, b: (v >= a) & (v <= b)), "left": (lambda v, a, b: (v >= a) & (v < b)), "right": (lambda v, a, b: (v > a) & (v <= b)), "neither": (lambda v, a, b: (v > a) & (v < b))}[closed]
    on = _same([F.col(f"l.`{k}`") for k in keys], [F.col(f"r.`{k}`") for k in keys]) & (F.col(f"l.{c}") == F.col(f"r.{c}")) & inside(F.col(f"l.`{point}`"), F.col(f"r.`{low}`"), F.col(f"r.`{high}`"))
    named = _named(points, intervals, keys)
    if len(tops) == 1:
        looked = points.withColumn(c, F.when(~F.isnan(x), _cell(x, F.lit(tops[0]))))
        return looked.alias("l").join(_held(spans, low, high, F.lit(tops[0]), c).alias("r"), on, how).select(*named)
    known = F.create_map(*[F.lit(n) for pair in classes.items() for n in pair]) if classes else F.lit(None).cast("map<int,int>")
    held = _held(spans.withColumn(s, known[F.col(s)]), low, high, F.col(s), c)
    looked = points.where(x.isNotNull() & ~F.isnan(x)).withColumn(s, F.explode(F.lit(tops).cast("array<int>"))).withColumn(c, _cell(x, F.col(s)))
    met = looked.alias("l").join(held.alias("r"), on & (F.col(f"l.{s}") == F.col(f"r.{s}")))
    if how == "inner":
        return met.select(*named)
    # Whether a point lies in an interval depends on its key and value alone.
    hit = met.select(*[F.col(f"l.`{k}`").alias(f"h{i}") for i, k in enumerate([*keys, point])]).distinct().alias("h")
    alone = points.alias("l").join(hit, _same([F.col(f"l.`{k}`") for k in [*keys, point]], [F.col(f"h.h{i}") for i in range(len(keys) + 1)]), "left_anti")
    both = set(points.columns) & (set(intervals.columns) - set(keys))
    blank = [F.lit(None).cast(intervals.schema[c].dataType).alias(f"{c}_right" if c in both else c) for c in intervals.columns if c not in keys]
    return met.select(*named).unionByName(alone.select(*[col(c).alias(f"{c}_left" if c in both else c) for c in points.columns], *blank))


def overlap_join(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of intervals of equal keys that share a point, ends included: the later one's beginning lies in the earlier one.

    Where one size of cells does for both sides, a pair meets in the cell of the later beginning, by one join; else each side's
    beginnings are looked up in the other side's intervals.
    """
    (a, b), (x, y) = left_ends, right_ends
    _need(left, [a, b, *keys], "overlap join")
    _need(right, [x, y, *keys], "overlap join")
    s, c, first = (fresh(n, left, right) for n in ("_size", "_cell", "_first"))
    some, others = _spans(left, a, b, s), _spans(right, x, y, s)
    tops = set(_classes(some.select(s).union(others.select(s))).values())
    if len(tops) == 1:
        size = F.lit(tops.pop())
        held = lambda df, lo, hi: _held(df, lo, hi, size, c).withColumn(first, _cell(_number(df, lo).cast("double"), size))
        on = _same([F.col(f"l.`{k}`") for k in keys], [F.col(f"r.`{k}`") for k in keys]) & (F.col(f"l.{c}") == F.col(f"r.{c}")) & (F.col(f"l.{c}") == F.greatest(F.col(f"l.{first}"), F.col(f"r.{first}")))
        met = (F.col(f"l.`{a}`") <= F.col(f"r.`{y}`")) & (F.col(f"r.`{x}`") <= F.col(f"l.`{b}`"))
        return held(some, a, b).alias("l").join(held(others, x, y).alias("r"), on & met).select(*_named(left, right, keys))
    some, others = some.drop(s), others.drop(s)
    right_later = range_join(others, some, x, a, b, keys)
    left_later = range_join(some, others, a, x, y, keys, closed="right")
    both = set(left.columns) & (set(right.columns) - set(keys))
    name = lambda c, of, other: f"{c}_{of}" if c in both else c
    # In the first join the sides are the other way round.
    first = [col(name(c, "right", 0)).alias(name(c, "left", 0)) for c in left.columns] + [col(name(c, "left", 0)).alias(name(c, "right", 0)) for c in right.columns if c not in keys]
    return right_later.select(*first).unionByName(left_later)
