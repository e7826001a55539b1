"""Columns that have the names which operators use on their way keep their values."""

from pyspark.sql import functions as F

from loomspark.naming import fresh
from loomspark.operators import ordering, quality, relational
from loomspark.streaming import incremental

NAMES = ["_ord", "_n", "_row", "_k0", "_copies", "_u0", "_branch", "_there", "_record", "_seen", "_at", "_ORD1"]
ROWS = [(1, "a"), (1, "a"), (2, "b"), (None, "b"), (None, "c"), (3, None)]


def clashing(spark):
    df = spark.createDataFrame(ROWS, "k long, s string").coalesce(1)
    return df.select("k", "s", *[F.concat(F.coalesce("s", F.lit("-")), F.lit(n)).alias(n) for n in NAMES])


def whole(df):
    """Rows, each with the columns that it came with."""
    for r in df.collect():
        assert all(r[n] == (r.s or "-") + n for n in NAMES), r
    return sorted(((r.k, r.s) for r in df.select("k", "s").collect()), key=repr)


def test_fresh(spark):
    df = clashing(spark)
    assert fresh("_ord", df) == "_ord2" and fresh("x", df) == "x" and fresh("K", df) == "K1"


def test_deduplicate(spark):
    df = clashing(spark)
    for keep in ("first", "last"):
        out = relational.deduplicate(df, {"columns": ["k"], "keep": keep})
        assert out.columns == df.columns and len(whole(out)) == 4
    assert whole(relational.deduplicate(df, {"columns": ["k"], "keep": "none"})) == [(2, "b"), (3, None)]
    assert whole(relational.deduplicate(df, {"keep": False})) == [(2, "b"), (3, None), (None, "b"), (None, "c")]
    plan = relational.deduplicate(df, {"columns": ["k"], "keep": "none"})._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_aggregate_first_without_an_order(spark):
    out = relational.aggregate(clashing(spark), {"group_by": ["k"], "aggregations": [{"column": "_ord", "function": "first"}, {"column": "_ord", "function": "last", "alias": "l"}]})
    assert sorted(map(tuple, out.collect())) == [(1, "a_ord", "a_ord"), (2, "b_ord", "b_ord"), (3, "-_ord", "-_ord")]


def test_branch(spark):
    out = relational.branch(clashing(spark), {"branches": [{"condition": "k > 1"}, {"condition": ""}]})
    assert whole(out["branch_0"]) == [(2, "b"), (3, None)] and len(whole(out["branch_1"])) == 4


def test_quality(spark):
    df, rule = clashing(spark), quality.Rule("uniqueness", {"fields": ["k"]})
    marked = quality.mark(df, rule)
    assert marked.columns == [*df.columns, "is_dirty", "violation_reason"] and len(whole(marked)) == 6 and marked.filter("is_dirty").count() == 4
    good, bad = quality.split(df, rule)
    assert whole(good) == [(2, "b"), (3, None)] and len(whole(bad)) == 4
    report = quality.evaluate(df, rule)
    assert report.failed == 4 and set(report.samples[0]) == set(df.columns)


def test_changes_and_order(spark):
    df = clashing(spark).filter("k >= 2")
    log = incremental.snapshot_changes(df.limit(0), df, ["k"]).withColumn("id", F.monotonically_increasing_id())
    assert whole(incremental.apply_changes(df.filter("k = 2"), log, ["k"])) == [(2, "b"), (3, None)]
    placed = ordering.with_place(clashing(spark), [F.col("s").desc_nulls_last()])
    assert len(whole(placed)) == 6 and [r.s for r in placed.orderBy("place").collect()] == ["c", "b", "b", "a", "a", None]


def test_mark_rules_are_counted_in_one_pass(spark):
    """Reports are those of one rule at a time, and one action makes them all where no rule is violated."""
    df = clashing(spark)
    rules = [quality.Rule("non_null_rate", {"field": "k", "max_null_percent": 10}), quality.Rule("uniqueness", {"fields": ["s"]}), quality.Rule("range_check", {"field": "k", "min_value": 2}), quality.Rule("uniqueness", {"fields": ["k", "s"]}, "quarantine"), quality.Rule("regex_match", {"field": "s", "pattern": "[ab]"})]
    out, reports = quality.apply(df, rules)
    alone, left = [], df
    for rule in rules:
        alone.append(quality.evaluate(left, rule))
        left = quality.mark(left, rule, counts=not alone[-1].passed) if rule.failure_strategy == "mark" else quality.split(left, rule)[0]
    key = lambda r: (r.rule_type, r.total, r.failed, sorted(map(repr, r.samples)))
    assert [key(r) for r in reports] == [key(r) for r in alone]
    assert sorted(map(repr, out.collect())) == sorted(map(repr, left.collect()))
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("rules", "")
    quality.apply(df, [quality.Rule("range_check", {"field": "_n"}, "mark") if i else quality.Rule("non_null_rate", {"field": "k", "max_null_percent": 90}) for i in (0,)] + [quality.Rule("non_null_rate", {"field": c, "max_null_percent": 50}) for c in ("s", "_n", "_row")])
    four = len(tracker.getJobIdsForGroup("rules"))
    sc.setJobGroup("rule", "")
    quality.apply(df, [quality.Rule("non_null_rate", {"field": "k", "max_null_percent": 90})])
    assert four == len(tracker.getJobIdsForGroup("rule"))
    sc.setLocalProperty("spark.jobGroup.id", None)
