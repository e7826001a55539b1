import pytest

from loomspark.operators import quality, relational


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_join_null_keys_and_suffixes(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k int, v string")
    out = relational.join(left, right, {"left_key": "k", "right_key": "k"})
    assert out.columns == ["k", "v_left", "v_right"]
    assert rows(out) == rows(spark.createDataFrame([(1, "a", "x"), (None, "b", "y")], "k int, a string, b string"))
    assert relational.join(left, right, {"join_type": "outer", "left_key": "k", "right_key": "k"}).count() == 4


def test_join_of_a_frame_with_itself(spark):
    df = spark.createDataFrame([(1, 2), (2, 1)], "a int, b int")
    assert rows(relational.join(df, df, {"left_key": "a", "right_key": "b"})) == [(1, 2, 2, 1), (2, 1, 1, 2)]


def test_join_needs_two_inputs(spark):
    with pytest.raises(relational.ConfigError):
        relational.join_all([spark.range(1)], {})


def test_aggregate_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, 1.0)], "g string, x double")
    specs = [{"column": "x", "function": f} for f in ("sum", "count", "avg", "size")]
    assert rows(relational.aggregate(df, {"group_by": ["g"], "aggregations": specs})) == [("a", 0.0, 0, None, 2)]
    assert relational.aggregate(df, {"group_by": [], "aggregations": specs}) is df


def test_dedup(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, None, 3), (4, None, 4), (5, "b", 5)], "id int, a string, o int")
    ids = lambda keep: [r.id for r in relational.deduplicate(df, {"columns": ["a"], "keep": keep, "order_by": "o"}).orderBy("id").collect()]
    assert ids("first") == [1, 3, 5] and ids("last") == [2, 4, 5] and ids(False) == [5]


def test_branches_partition_the_input(spark):
    df = spark.range(100).withColumnRenamed("id", "n")
    out = relational.branch(df, {"branches": [{"condition": "n % 2 == 0"}, {"condition": "n % 3 == 0"}, {"condition": ""}]})
    parts = [{r.n for r in d.collect()} for d in out.values()]
    assert set().union(*parts) == set(range(100)) and sum(map(len, parts)) == 100
    with pytest.raises(relational.ConfigError):
        relational.branch(df, {"branches": [{"condition": ""}, {"condition": "n > 1"}]})


def test_sort_is_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    for up, want in ((True, [1, 2, None]), (False, [2, 1, None])):
        assert [r.x for r in relational.sort_rows(df, {"sort_by": [{"column": "x", "ascending": up}]}).collect()] == want


def test_quality_values(spark):
    df = spark.createDataFrame([(s,) for s in ("10", " 5 ", "abc", "", "1d", None)], "s string")
    assert quality.evaluate(df, quality.Rule("range_check", {"field": "s", "min_value": 0, "max_value": 9})).failed == 5
    df = spark.createDataFrame([(s,) for s in ("ab1", "1ab", None, "nan")], "s string")
    assert quality.evaluate(df, quality.Rule("regex_match", {"field": "s", "pattern": "[a-z]"})).failed == 1
    empty = df.limit(0)
    report = quality.evaluate(empty, quality.Rule("uniqueness", {"fields": ["s"]}))
    assert (report.total, report.pass_rate, report.passed) == (0, 100.0, True)


def test_quality_strategies(spark):
    df = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "id int, x int")
    rule = lambda how: quality.Rule("range_check", {"field": "x", "min_value": 0, "max_value": 10}, how)
    marked, reports = quality.apply(df, [rule("mark"), quality.Rule("non_null_rate", {"field": "x", "max_null_percent": 0})])
    assert [(r.id, r.is_dirty, r.violation_reason.count("; ")) for r in marked.orderBy("id").collect()] == [(1, False, 0), (2, True, 0), (3, True, 1)]
    assert [r.failed for r in reports] == [2, 1]
    taken = []
    clean, _ = quality.apply(df, [rule("quarantine")], lambda r, bad: taken.extend(x.id for x in bad.collect()))
    assert [r.id for r in clean.collect()] == [1] and sorted(taken) == [2, 3]
    with pytest.raises(quality.QualityAbort) as e:
        quality.apply(df, [rule("abort")])
    assert e.value.reports[0].failed == 2
    assert quality.apply(df.filter("x = 5"), [rule("abort")])[0].count() == 1
