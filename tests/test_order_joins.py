"""Ranks, joins by order, sketches and digest trees: edge cases, hot keys, plans."""

import bisect
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomspark.operators import ordering, quantiles, relational, sketches, temporal
from loomspark.streaming import digests, incremental


def interpolated(values, q):
    v = sorted(values)
    at = q * (len(v) - 1)
    lo, hi = v[math.floor(at)], v[math.ceil(at)]
    return lo if lo == hi else lo + (hi - lo) * (at - math.floor(at))


def test_places_of_ties_nulls_and_none(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, 1, 2, 2, 2, 2]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "x int, k long").coalesce(1)
    got = sorted(ordering.with_place(df, [F.col("x").desc_nulls_last()], "at", parts=7).collect(), key=lambda r: r["at"])
    assert [r["at"] for r in got] == list(range(500))
    assert [r.k for r in got] == [k for _, k in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))]  # ties as scanned
    assert ordering.with_place(df.limit(0), [F.col("x")]).count() == 0
    again = ordering.with_place(spark.createDataFrame([("b", 9), ("a", 9)], "x string, place int"), [F.col("x")])
    assert sorted(map(tuple, again.select("x", "place").collect())) == [("a", 0), ("b", 1)]


def test_a_hot_value_is_spread_over_ranges(spark):
    df = spark.range(8000).select(F.lit(1).alias("x"), "id")
    placed = ordering.with_place(df, [F.col("x")], parts=8)
    sizes = [r["count"] for r in placed.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 2500


@pytest.mark.parametrize("parts", [1, 5])
def test_quantiles_equal_sorting(spark, parts):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot"] * 6 + ["a", None]), rnd.choice([None, math.nan, rnd.gauss(0, 10), 5.0, 5.0])) for _ in range(3000)] + [("one", 7.0), ("none", None), ("none", math.nan), ("inf", math.inf), ("inf", math.inf), ("inf", 1.0)]
    df = spark.createDataFrame(rows, "`k k` string, x double")
    wanted = {"lo": ("x", 0.0), "a": ("x", 0.25), "m": ("x", 0.5), "h": ("x", 0.999), "hi": ("x", 1.0)}
    got = {r["k k"]: r for r in quantiles.quantiles(df, ["k k"], wanted, parts=parts).collect()}
    assert set(got) == {"hot", "a", None, "one", "none", "inf"}
    for k, r in got.items():
        own = [x for g, x in rows if g == k and x is not None and not math.isnan(x)]
        for alias, (_, q) in wanted.items():
            want = interpolated(own, q) if own else None
            assert r[alias] == want or math.isclose(r[alias], want, rel_tol=1e-12), (k, alias)
    assert quantiles.quantiles(df.limit(0), [], wanted).collect() == [] and quantiles.quantiles(df, [], {"m": ("x", 0.5)}).count() == 1
    with pytest.raises(relational.ConfigError):
        quantiles.quantiles(df, [], {"m": ("x", 1.5)})


def moments(rnd, n, keys):
    start = datetime(2024, 1, 1)
    return [(rnd.choice(keys), None if rnd.random() < 0.03 else start + timedelta(seconds=rnd.randrange(3000)), k) for k in range(n)]


@pytest.mark.parametrize(("direction", "exact", "tolerance"), [("backward", True, None), ("backward", False, 40), ("forward", True, 15), ("forward", False, None)])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_as_of_equals_bisection(spark, direction, exact, tolerance, kind):
    rnd = random.Random(3)
    keys = ["hot"] * 8 + ["a", None]
    left, right = moments(rnd, 400, keys), moments(rnd, 300, keys)
    a = spark.createDataFrame(left, f"u string, ts {kind}, _t long")
    b = spark.createDataFrame(right, f"u string, at {kind}, _t long")
    got = temporal.as_of(a, b, "ts", ["u"], "at", direction, exact, tolerance, buckets=9).collect()
    best = {}
    for u, t, n in right:
        if t is not None:
            best[u, t] = max(best.get((u, t), -1), n)
    want = []
    for u, t, n in left:
        times = sorted(x for k, x in best if k == u)
        if t is None:
            hit = None
        elif direction == "backward":
            i = (bisect.bisect_right if exact else bisect.bisect_left)(times, t)
            hit = times[i - 1] if i else None
        else:
            i = (bisect.bisect_left if exact else bisect.bisect_right)(times, t)
            hit = times[i] if i < len(times) else None
        if hit is not None and tolerance is not None and abs((t - hit).total_seconds()) > tolerance:
            hit = None
        want.append((n, hit, best.get((u, hit))))
    assert sorted((r._t_left, r["at"], r._t_right) for r in got) == sorted(want)
    assert temporal.as_of(a, b.limit(0), "ts", ["u"], "at", how="inner").count() == 0 and temporal.as_of(a.limit(0), b, "ts", ["u"], "at").count() == 0


@pytest.mark.parametrize("closed", ["both", "left", "right", "neither"])
def test_range_join_equals_comparing_all(spark, closed):
    rnd = random.Random(4)
    number = lambda: rnd.choice([None, math.nan, 0.0, 8.0, -8.0, rnd.uniform(-50, 50)])
    points = [(rnd.choice(["k", "k", None]), number(), n) for n in range(150)]
    spans = [(rnd.choice(["k", "k", None]), number(), number(), n) for n in range(120)] + [("k", -math.inf, math.inf, 500), (None, 8.0, math.inf, 501), ("k", 8.0, 8.0, 502), ("k", 1e-9, 2e-9, 503), ("k", 0.0, 16.0, 504)]
    a, b = spark.createDataFrame(points, "k string, x double, n long"), spark.createDataFrame(spans, "k string, lo double, hi double, n long")
    inside = {"both": lambda x, l, h: l <= x <= h, "left": lambda x, l, h: l <= x < h, "right": lambda x, l, h: l < x <= h, "neither": lambda x, l, h: l < x < h}[closed]  # noqa: E741
    good = lambda *v: all(i is not None and not math.isnan(i) for i in v)
    want = [(p, s) for k, x, p in points for j, lo, hi, s in spans if k == j and good(x, lo, hi) and lo <= hi and inside(x, lo, hi)]
    got = temporal.range_join(a, b, "x", "lo", "hi", ["k"], closed)
    assert sorted((r.n_left, r.n_right) for r in got.collect()) == sorted(want)
    left = temporal.range_join(a, b, "x", "lo", "hi", ["k"], closed, how="left")
    alone = {p for _, _, p in points} - {p for p, _ in want}
    assert sorted(((r.n_left, r.n_right) for r in left.collect()), key=repr) == sorted([*want, *((p, None) for p in alone)], key=repr)
    assert left.columns == got.columns == ["k", "x", "n_left", "lo", "hi", "n_right"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert temporal.range_join(a, b.limit(0), "x", "lo", "hi", ["k"], how="left").count() == 150


def test_long_intervals_cost_no_more(spark):
    """An interval is held in two cells at most, whatever its length."""
    spans = spark.createDataFrame([(float(k), float(k) + 2.0**k) for k in range(0, 40, 3)] + [(0.0, 1e15)], "lo double, hi double")
    points = spark.createDataFrame([(float(2**k),) for k in range(45)], "x double")
    got = temporal.range_join(points, spans, "x", "lo", "hi").count()
    assert got == sum(lo <= 2.0**k <= hi for k in range(45) for lo, hi in [(float(j), float(j) + 2.0**j) for j in range(0, 40, 3)] + [(0.0, 1e15)])


def test_overlaps(spark):
    rnd = random.Random(5)
    side = lambda: [(rnd.choice("ab"), (lo := rnd.randrange(60)), lo + rnd.randrange(-1, 12), n) for n in range(60)]
    one, two = side(), side()
    a, b = spark.createDataFrame(one, "k string, lo long, hi long, n long"), spark.createDataFrame(two, "k string, x long, y long, n long")
    want = sorted((p, q) for k, lo, hi, p in one for j, x, y, q in two if k == j and lo <= hi and x <= y and lo <= y and x <= hi)
    assert sorted((r.n_left, r.n_right) for r in temporal.overlap_join(a, b, ("lo", "hi"), ("x", "y"), ["k"]).collect()) == want


def test_sketch_table_takes_a_batch_once(spark, tmp_path):
    kinds = [sketches.Sketch("d", "x"), sketches.Sketch("s", "x", "theta"), sketches.Sketch("q", "x", "kll")]
    held = sketches.SketchTable(str(tmp_path / "t"), ["k"], kinds)
    assert held.read(spark) is None
    for n in range(4):
        batch = spark.range(n * 1000, n * 1000 + 2000).select(F.when(F.col("id") % 3 > 0, "a").alias("k"), F.when(F.lit(n != 3), F.col("id")).alias("x"))
        for _ in range(2):
            held.add(batch, f"b{n}")
    rows = {r.k: r for r in held.read(spark).select("k", sketches.ROWS, sketches.distinct_estimate("d").alias("d"), sketches.distinct_estimate("s", "theta").alias("s"), sketches.quantile_estimate("q", 0.5).alias("m"), sketches.rank_estimate("q", F.lit(1000)).alias("r")).collect()}
    assert set(rows) == {"a", None} and sum(r[sketches.ROWS] for r in rows.values()) == 8000
    seen = {"a": 2667, None: 1333}  # of 0 to 3999, each group's part; 1000 to 2999 came twice
    for k, n in seen.items():
        assert abs(rows[k].d - n) < 0.05 * n and abs(rows[k].s - n) < 0.05 * n and abs(rows[k].m - 2000) < 200 and abs(rows[k].r - 1 / 6) < 0.05
    with pytest.raises(relational.ConfigError):
        held.add(batch, "../x")
    empty = sketches.states(batch.withColumn("x", F.lit(None).cast("long")), ["k"], kinds)
    assert {(r.d, r.m) for r in empty.select(sketches.distinct_estimate("d").alias("d"), sketches.quantile_estimate("q", 0.5).alias("m")).collect()} == {(0, None)}


def changes(df):
    return sorted(map(repr, df.collect()))


def test_digest_changes_equal_snapshot_changes(spark):
    rows = [(k, f"v{k % 7}" if k % 5 else None, None if k % 5 else f"v{k % 7}") for k in range(600)]
    old = spark.createDataFrame(rows, "id long, a string, b string")
    new = spark.createDataFrame([(i, b, a) if i == 55 else (i, "new", b) if i == 77 else (i, a, b) for i, a, b in rows if i != 99] + [(1000, "x", None), (None, "n", None)], "id long, a string, b string")
    want = incremental.snapshot_changes(old, new, ["id"], "t")
    got, found = digests.digest_changes(old, new, ["id"], "t", leaves=300)
    assert changes(got) == changes(want) and len(changes(got)) == 5  # a value that moves to the column beside it is seen
    assert found.count <= 5 and found.compared[0] == 1 and sum(found.compared) < 120
    joined = digests.digest_changes(old, new, ["id"], leaves=300)[0]
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    same, none = digests.digest_changes(old, old.orderBy(F.desc("id")), ["id"])
    assert same.count() == 0 and none.compared == [1, 0, 0, 0] and none.count == 0


def test_digest_trees_are_kept_and_see_repeats(spark):
    old = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, a string")
    kept = digests.tree(old, ["id"], ["a", "id"], leaves=16)
    twice = old.unionByName(old.filter("id = 1").limit(1)).unionByName(old.filter("id = 1").limit(1))
    assert digests.differing(kept, digests.tree(twice, ["id"], ["a", "id"], leaves=16)).count == 1
    got, _ = digests.digest_changes(old, old.filter("id = 2"), ["id"], leaves=16, old_tree=kept)
    assert changes(got) == changes(incremental.snapshot_changes(old, old.filter("id = 2"), ["id"]))
    for a, b in ((old.limit(0), old), (old, old.limit(0)), (old.limit(0), old.limit(0))):
        assert changes(digests.digest_changes(a, b, ["id"], leaves=16)[0]) == changes(incremental.snapshot_changes(a, b, ["id"]))


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_intervals_without_length_are_spread_over_cells(spark):
    """At moments of today, cells finer than doubles tell apart had one number for all."""
    rows = spark.range(3000).select(F.timestamp_micros(F.col("id") * 7_000_000 + 1_700_000_000_000_000).alias("t"))
    spans = temporal._spans(rows.withColumn("u", F.col("t")), "t", "u", "s")
    assert temporal._held(spans, "t", "u", F.col("s"), "c").groupBy("c").count().agg(F.max("count")).first()[0] == 1
    assert temporal.range_join(rows.withColumnRenamed("t", "p"), rows.withColumn("u", F.col("t")), "p", "t", "u").count() == 3000
    assert temporal.range_join(rows.withColumnRenamed("t", "p"), rows.withColumn("u", F.col("t")), "p", "t", "u", closed="left", how="left").where("t IS NULL").count() == 3000


@pytest.mark.parametrize("how", ["inner", "left"])
def test_intervals_of_like_sizes_are_one_join(spark, how):
    rnd = random.Random(8)
    points = [(rnd.choice(["k", "j", None]), rnd.choice([None, math.nan, 1e300, -math.inf, rnd.uniform(-90, 90)]), n) for n in range(200)]
    spans = [(rnd.choice(["k", "j", None]), (lo := rnd.uniform(-90, 80)), lo + rnd.choice([3.0, 5.0, 7.9]), n) for n in range(100)]
    a, b = spark.createDataFrame(points, "k string, x double, n long"), spark.createDataFrame(spans, "k string, lo double, hi double, m long")
    want = [(p, s) for k, x, p in points for j, lo, hi, s in spans if k == j and x is not None and lo <= x <= hi]
    alone = [(p, None) for _, _, p in points if p not in {p for p, _ in want}]
    got = temporal.range_join(a, b, "x", "lo", "hi", ["k"], how=how)
    assert sorted(((r.n, r.m) for r in got.collect()), key=repr) == sorted(want + (alone if how == "left" else []), key=repr)
    assert joins(got) == 1


def test_overlaps_of_like_sizes_are_one_join(spark):
    rnd = random.Random(9)
    side = lambda most: [(rnd.choice(["a", "b", None]), (lo := rnd.uniform(-60, 60)), lo + rnd.uniform(2.1, most), n) for n in range(90)] + [("a", math.nan, 1.0, 900), ("a", 0.0, math.nan, 901), ("b", None, 2.0, 902), ("b", 2.0, 1.0, 903)]
    one, two = side(4.0), side(8.0)
    a, b = spark.createDataFrame(one, "k string, lo double, hi double, n long"), spark.createDataFrame(two, "k string, lo double, y double, n long")
    good = lambda lo, hi: lo is not None and lo <= hi
    want = sorted((p, q) for k, lo, hi, p in one for j, x, y, q in two if k == j and good(lo, hi) and good(x, y) and lo <= y and x <= hi)
    got = temporal.overlap_join(a, b, ("lo", "hi"), ("lo", "y"), ["k"])
    assert sorted((r.n_left, r.n_right) for r in got.collect()) == want and joins(got) == 1
    assert got.columns == ["k", "lo_left", "hi", "n_left", "lo_right", "y", "n_right"]
