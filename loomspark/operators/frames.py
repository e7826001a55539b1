"""Window frames that count peer groups, and that leave out the current row, its group or its ties.

Spark's frames go by rows or by ranges of values. Here rows alike in key and order are first one row with partial sums, which
combine before the shuffle; a frame of groups is then a frame of rows over those, before and after the current group apart,
so that what is excluded was never added. Each row gets its group's results by an equality join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..naming import fresh
from .relational import ConfigError, _need, col

FUNCTIONS = ("count", "sum", "min", "max", "avg")
EXCLUDE = ("no others", "current row", "group", "ties")


def groups_frame(df: DataFrame, keys: Sequence[str], order_by: Sequence[tuple[str, bool]], start: int | None, end: int | None, aggregates: dict[str, tuple[str, str]], exclude: str = "no others") -> DataFrame:
    """`df` with a column for each of `aggregates` (name: function and column), over GROUPS BETWEEN start AND end EXCLUDE exclude.

    order_by: columns, each up (True) or down, missing values last. start and end count peer groups from the current one, negative
    before it; None is without bound. count, sum, min, max and avg skip missing values; over none count is 0, the others null.
    Missing keys and order values are peers of their like. A partition's peer groups, not its rows, are one task's.
    """
    _need(df, [*keys, *[c for c, _ in order_by], *[c for _, c in aggregates.values()]], "window frame")
    if exclude not in EXCLUDE or not order_by or any(f not in FUNCTIONS for f, _ in aggregates.values()):
        raise ConfigError(f"a frame of groups has an order, {', '.join(FUNCTIONS)}, and excludes one of {', '.join(EXCLUDE)}")
    if start is not None and end is not None and start > end:
        raise ConfigError("a frame ends where it begins or after")
    k, o = [f"k{i}" for i in range(len(keys))], [f"o{i}" for i in range(len(order_by))]
    columns = list(dict.fromkeys(c for _, c in aggregates.values()))
    named = [col(c).alias(n) for c, n in zip(keys, k, strict=True)] + [col(c).alias(n) for (c, _), n in zip(order_by, o, strict=True)]
    values = [col(c).alias(f"v{j}") for j, c in enumerate(columns)]
    partial = [x for j in range(len(columns)) for x in (F.count(f"v{j}").alias(f"n{j}"), F.sum(f"v{j}").alias(f"s{j}"), F.min(f"v{j}").alias(f"lo{j}"), F.max(f"v{j}").alias(f"hi{j}"))]
    own = df.select(*named, *values)
    peers = own.groupBy(*k, *o).agg(*partial)
    if exclude == "current row":  # a group's next to least and next to greatest, and how often it has those
        peers = _joined(peers, _second(own, peers, [*k, *o], len(columns)), [*k, *o])
    by = Window.partitionBy(*k).orderBy(*[F.col(n).asc_nulls_last() if up else F.col(n).desc_nulls_last() for n, (_, up) in zip(o, order_by, strict=True)])
    low, high = Window.unboundedPreceding, Window.unboundedFollowing
    frames = []
    if start is None or start < 0:
        frames.append(by.rowsBetween(low if start is None else start, -1 if end is None else min(end, -1)))
    if end is None or end > 0:
        frames.append(by.rowsBetween(1 if start is None else max(start, 1), high if end is None else end))
    middle = (start is None or start <= 0) and (end is None or end >= 0)
    around = []
    for j in range(len(columns)):
        for n, f in ((f"n{j}", F.sum), (f"s{j}", F.sum), (f"lo{j}", F.min), (f"hi{j}", F.max)):
            around += [f(n).over(w).alias(f"{n}_{i}") for i, w in enumerate(frames)]
    told = peers.select("*", *around)
    names = {c: fresh(f"_{c}", df) for c in told.columns}
    told = told.select(*[F.col(c).alias(n) for c, n in names.items()])
    on = [col(c).eqNullSafe(F.col(names[n])) for c, n in zip([*keys, *[c for c, _ in order_by]], [*k, *o], strict=True)]
    met = df.join(told, reduce(lambda a, b: a & b, on))
    part = lambda j, what: _parts(names, col(columns[j]), j, what, len(frames), middle, exclude)
    out = []
    for name, (function, c) in aggregates.items():
        j = columns.index(c)
        n = _added(part(j, "n"))
        if function == "count":
            out.append(F.coalesce(n, F.lit(0)).cast("long").alias(name))
        elif function == "sum":
            out.append(F.when(n > 0, _added(part(j, "s"))).alias(name))
        elif function == "avg":
            out.append(F.when(n > 0, _added(part(j, "s")) / n).alias(name))
        else:
            some = part(j, "lo" if function == "min" else "hi")
            pick = F.least if function == "min" else F.greatest
            out.append((pick(*some) if len(some) > 1 else some[0] if some else F.lit(None).cast(df.schema[c].dataType)).alias(name))
    return met.select(*[col(c) for c in df.columns if c not in aggregates], *out)


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    right = right.select(*[F.col(c).alias(f"r_{c}" if c in keys else c) for c in right.columns])
    return left.join(right, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in keys]), "left").drop(*[f"r_{c}" for c in keys])


def _second(own: DataFrame, peers: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Of each peer group: the least and greatest value without its extremes, and how many rows have each extreme."""
    ends = peers.select(*[F.col(c).alias(f"e_{c}") for c in keys], *[f"{x}{j}" for j in range(n) for x in ("lo", "hi")])
    met = own.join(ends, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in keys]))
    asks = []
    for j in range(n):
        v, lo, hi = F.col(f"v{j}"), F.col(f"lo{j}"), F.col(f"hi{j}")
        asks += [F.min(F.when(v > lo, v)).alias(f"lo2{j}"), F.max(F.when(v < hi, v)).alias(f"hi2{j}"), F.count(F.when(v == lo, 1)).alias(f"nlo{j}"), F.count(F.when(v == hi, 1)).alias(f"nhi{j}")]
    return met.groupBy(*keys).agg(*asks)


def _added(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in parts], F.lit(0))


def _parts(names: dict[str, str], value: Column, j: int, what: str, frames: int, middle: bool, exclude: str) -> list[Column]:
    """What a frame is made of: the groups before, those after, and of the current group what isn't excluded."""
    at = lambda c: F.col(names[c])
    out = [at(f"{what}{j}_{i}") for i in range(frames)]
    if not middle or exclude == "group":
        return out
    here = at(f"{what}{j}")
    if exclude == "no others":
        return [*out, here]
    if exclude == "ties":
        return [*out, F.when(value.isNotNull(), 1).otherwise(0) if what == "n" else value]
    if what == "n":
        return [*out, here - F.when(value.isNotNull(), 1).otherwise(0)]
    if what == "s":
        return [*out, here - F.coalesce(value, F.lit(0))]
    # Without the current row the extreme stays unless that row alone has it.
    return [*out, F.when((value == here) & (at(f"n{what}{j}") == 1), at(f"{what}2{j}")).otherwise(here)]
