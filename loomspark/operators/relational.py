"""The transforms of a pipeline: each takes DataFrames and a configuration and returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..naming import fresh
from ..staging import shared_path


class ConfigError(ValueError):
    """A node's configuration doesn't make sense for its input."""


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def _need(df: DataFrame, names: Sequence[str], what: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ConfigError(f"{what}: no column {', '.join(missing)}")


def filter_rows(df: DataFrame, config: dict) -> DataFrame:
    """Rows that meet `condition`; an empty one keeps all."""
    source = (config.get("condition") or "").strip()
    if not source:
        return df
    try:
        return df.filter(expr.condition(df, source))
    except expr.ExpressionError as e:
        raise ConfigError(f"Invalid filter condition {source!r}: {e}") from e


def map_columns(df: DataFrame, config: dict) -> DataFrame:
    """`operations` in order: rename, type_convert, compute. Renames and conversions of columns that aren't there do nothing."""
    for op in config.get("operations") or []:
        kind = op.get("type")
        if kind == "rename":
            df = df.withColumnRenamed(op["old_name"], op["new_name"])
        elif kind == "type_convert" and op["column"] in df.columns:
            df = df.withColumn(op["column"], expr.convert(col(op["column"]), expr.kind_of(df, op["column"]), op["target_type"]))
        elif kind == "compute":
            df = df.withColumn(op["new_column"], expr.expression(df, op["expression"]))
    return df


def _adjusted_skew(c: Column) -> Column:
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


#: Aggregates of a column; missing values are skipped by all but `size`.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "avg": F.avg, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max,
    "median": F.median, "std": F.stddev_samp, "var": F.var_samp, "sem": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)),
    "prod": lambda c: F.coalesce(F.product(c), F.lit(1.0)), "nunique": F.count_distinct, "size": lambda c: F.count(F.lit(1)),
    "skew": _adjusted_skew, "any": lambda c: F.coalesce(F.bool_or(c.cast("boolean")), F.lit(False)),
    "all": lambda c: F.coalesce(F.bool_and(c.cast("boolean")), F.lit(True)), "quantile": lambda c: F.percentile(c, 0.5),
}


def _aggregate(df: DataFrame, spec: dict, order: str | None) -> Column:
    name, function = _resolve(df, spec["column"]), spec["function"]
    alias = spec.get("alias") or f"{spec['column']}_{function}"
    c = col(name)
    if function in ("first", "last"):
        by = col(order) if order else F.monotonically_increasing_id()
        some = F.when(c.isNotNull(), by)
        return (F.min_by(c, some) if function == "first" else F.max_by(c, some)).alias(alias)
    if function not in AGGREGATES:
        raise ConfigError(f"unknown aggregate {function!r}")
    if function == "quantile" and spec.get("q") is not None:
        return F.percentile(c, float(spec["q"])).alias(alias)
    return AGGREGATES[function](c).alias(alias)


def _resolve(df: DataFrame, name: str) -> str:
    """The column meant: after a join a name that both sides had stands for the left one's."""
    return name if name in df.columns else f"{name}_left" if f"{name}_left" in df.columns else name


def aggregate(df: DataFrame, config: dict) -> DataFrame:
    """Groups without missing keys, one column for each aggregation; without keys or aggregations the input as it is.

    `large_groups`: median and quantile (with a `q` from 0 to 1, else the middle) are found by ranks over ranges instead of in a
    buffer a group, which is for groups of more distinct values than a task holds.
    """
    keys, specs = config.get("group_by") or [], config.get("aggregations") or []
    if not keys or not specs:
        return df
    found = [_resolve(df, k) for k in keys]
    _need(df, [*found, *[_resolve(df, s["column"]) for s in specs]], "aggregate")
    order = config.get("order_by")
    if config.get("large_groups"):
        return _with_ranks(df, config, found, keys, specs)
    ordered = any(s["function"] in ("first", "last") for s in specs) and not order
    if ordered:  # the rows' order as scanned, fixed before the shuffle
        order = fresh("_ord", df)
        df = df.withColumn(order, F.monotonically_increasing_id())
    rows = df.filter(reduce(lambda a, b: a & b, [col(k).isNotNull() for k in found]))
    out = rows.groupBy(*[col(k).alias(name) for k, name in zip(found, keys, strict=True)])
    return out.agg(*[_aggregate(rows, s, order) for s in specs])


def _with_ranks(df: DataFrame, config: dict, found: list[str], keys: Sequence[str], specs: Sequence[dict]) -> DataFrame:
    from .quantiles import quantiles  # which needs this module

    ranked = [s for s in specs if s["function"] in ("median", "quantile")]
    name = lambda s: s.get("alias") or f"{s['column']}_{s['function']}"
    rows = df.filter(reduce(lambda a, b: a & b, [col(k).isNotNull() for k in found]))
    wanted = {name(s): (_resolve(df, s["column"]), float(s.get("q", 0.5)) if s["function"] == "quantile" else 0.5) for s in ranked}
    out = quantiles(rows, found, wanted)
    out = out.select(*[col(k).alias(n) for k, n in zip(found, keys, strict=True)], *[col(a) for a in wanted])
    others = [s for s in specs if s not in ranked]
    if others:
        rest = aggregate(df, {**config, "aggregations": others, "large_groups": False})
        out = out.alias("q").join(rest.alias("r"), reduce(lambda a, b: a & b, [F.col(f"q.`{k}`") == F.col(f"r.`{k}`") for k in keys])).select("q.*", *[F.col(f"r.`{name(s)}`") for s in others])
    return out.select(*[col(k) for k in keys], *[col(name(s)) for s in specs])


def sort_rows(df: DataFrame, config: dict) -> DataFrame:
    """By several columns, each up or down; missing values come last either way."""
    by = config.get("sort_by") or []
    if not by:
        return df
    found = [(_resolve(df, s["column"]), s.get("ascending", True)) for s in by]
    _need(df, [n for n, _ in found], "sort")
    return df.orderBy(*[col(n).asc_nulls_last() if up else col(n).desc_nulls_last() for n, up in found])


def deduplicate(df: DataFrame, config: dict) -> DataFrame:
    """One row (`keep` first or last) of those alike in `columns`, or with keep=False only rows that have no like.

    Missing values are alike. `order_by` names the column that orders rows; without it they count as scanned.
    """
    columns, keep = config.get("columns") or [], config.get("keep", "first")
    if keep not in ("first", "last", False, "none"):
        raise ConfigError(f"keep is first, last or False, not {keep!r}")
    _need(df, columns, "deduplicate")
    if not columns and keep in ("first", "last"):
        return df.dropDuplicates()
    by = [col(c) for c in columns or df.columns]
    if keep in (False, "none"):
        return _unrepeated(df, columns or df.columns)
    order, given = fresh("_ord", df), config.get("order_by")
    marked = df.withColumn(order, col(given) if given else F.monotonically_increasing_id())
    # A grouped minimum, not a window: it combines before the shuffle, so one value with most rows costs no more.
    pick = F.min_by if keep == "first" else F.max_by
    whole = F.struct(*[col(c) for c in df.columns])
    row = fresh("_row", df)
    best = marked.groupBy(*[c.alias(f"_k{i}") for i, c in enumerate(by)]).agg(pick(whole, col(order)).alias(row))
    return best.select(f"{row}.*")


def _unrepeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key no other row has: the keys are counted, which combines before the shuffle, and those met once are joined
    back null-safely. A key that most rows share is one row by then, and a join can be split where a window couldn't."""
    names = [fresh(f"_k{i}", df) for i in range(len(keys))]
    n = fresh("_n", df)
    once = df.groupBy(*[col(k).alias(a) for k, a in zip(keys, names, strict=True)]).agg(F.count(F.lit(1)).alias(n)).where(col(n) == 1)
    on = reduce(lambda x, y: x & y, [col(k).eqNullSafe(col(a)) for k, a in zip(keys, names, strict=True)])
    return df.join(once, on, "left_semi")


def join(left: DataFrame, right: DataFrame, config: dict) -> DataFrame:
    """inner, left, right, outer or cross. Missing keys match missing keys; a key of the same name on both sides is one
    column in the left's place; any other name on both sides gets a suffix on both."""
    how = config.get("join_type") or "inner"
    if how == "cross":
        return _suffixed(left, right, set(), lambda a, b: a.crossJoin(b))
    listed = lambda x: [] if x is None or x == "" else [x] if isinstance(x, str) else list(x)
    lk, rk = listed(config.get("left_key")), listed(config.get("right_key"))
    if not lk and not rk:
        lk = rk = [c for c in left.columns if c in right.columns]
        if not lk:
            raise ConfigError("join: no key, and no column in common")
    if len(lk) != len(rk):
        raise ConfigError("join: as many left keys as right keys are needed")
    _need(left, lk, "join")
    _need(right, rk, "join")
    how = {"outer": "full", "full": "full"}.get(how, how)
    if how not in ("inner", "left", "right", "full"):
        raise ConfigError(f"unknown join {how!r}")
    same = {a for a, b in zip(lk, rk, strict=True) if a == b}

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        on = reduce(lambda x, y: x & y, [a[f"_l_{x}"].eqNullSafe(b[f"_r_{y}"]) for x, y in zip(lk, rk, strict=True)])
        return a.join(b, on, how)

    return _suffixed(left, right, same, joined, how)


def _suffixed(left: DataFrame, right: DataFrame, same: set[str], how: Callable[[DataFrame, DataFrame], DataFrame], kind: str = "inner") -> DataFrame:
    both = (set(left.columns) & set(right.columns)) - same
    a = left.select(*[col(c).alias(f"_l_{c}") for c in left.columns])
    b = right.select(*[col(c).alias(f"_r_{c}") for c in right.columns])
    key = {"inner": lambda c: col(f"_l_{c}"), "left": lambda c: col(f"_l_{c}"), "right": lambda c: col(f"_r_{c}"), "full": lambda c: F.coalesce(col(f"_l_{c}"), col(f"_r_{c}"))}[kind]
    out = [key(c).alias(c) if c in same else col(f"_l_{c}").alias(f"{c}_left" if c in both else c) for c in left.columns]
    out += [col(f"_r_{c}").alias(f"{c}_right" if c in both else c) for c in right.columns if c not in same]
    return how(a, b).select(*out)


def join_all(frames: Sequence[DataFrame], config: dict) -> DataFrame:
    if len(frames) < 2:
        raise ConfigError("a join needs two inputs")
    return join(frames[0], frames[1], config)


def branch(df: DataFrame, config: dict, stage: bool = False) -> dict[str, DataFrame]:
    """`branch_0`, `branch_1`, ...: each row goes to the first branch whose condition it meets; an empty condition in last
    place takes the rest, and without one the rest is left out.

    Lazy branches each compute the input anew. With `stage` it is computed once: rows are written to the shared folder by branch,
    and each branch reads its part alone.
    """
    branches = config.get("branches") or []
    if not branches:
        return {"branch_0": df}
    route: Column | None = None
    for i, b in enumerate(branches):
        source = (b.get("condition") or "").strip()
        if not source:
            if i < len(branches) - 1:
                raise ConfigError("only the last branch may have no condition")
            route = F.lit(i) if route is None else route.otherwise(i)
            break
        test = expr.two_valued(df, source)
        route = F.when(test, i) if route is None else route.when(test, i)
    way = fresh("_branch", df)
    routed = df.withColumn(way, route)
    if stage:
        path = shared_path(df.sparkSession, "branches")
        routed.where(col(way).isNotNull()).write.partitionBy(way).parquet(path)
        routed = df.sparkSession.read.schema(routed.schema).parquet(path)
        return {f"branch_{i}": routed.filter(col(way) == i).select(*[col(c) for c in df.columns]) for i in range(len(branches))}
    return {f"branch_{i}": routed.filter(col(way) == i).drop(way) for i in range(len(branches))}


def limit(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)


def top_k(df: DataFrame, config: dict, k: int) -> DataFrame:
    """Sort and limit in one: Spark keeps k rows of each task."""
    return sort_rows(df, config).limit(k)


#: Transforms with one input and one output, by node type.
UNARY = {"filter": filter_rows, "map": map_columns, "aggregate": aggregate, "sort": sort_rows, "deduplicate": deduplicate}
