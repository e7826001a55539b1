import pytest

from loomspark.functions import expr
from loomspark.operators import relational


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(1, None, "a"), (2, 5.0, "b AND c"), (3, 1.0, None)], "id long, v double, s string")


@pytest.mark.parametrize(
    ("condition", "ids"),
    [
        ("v != 5", [1, 3]), ("not (v > 2)", [1, 3]), ("v > 2", [2]), ("~(v > 2) && id < 3", [1]), ("s == 'b AND c'", [2]), ("s.isnull() || v == 5", [2, 3]),
        ("v in [1, 5]", [2, 3]), ("v not in [1]", [1, 2]), ("s.str.contains('AND')", [2]), ("not s.str.startswith('a')", [2, 3]), ("0 < id < 3 and v.notnull()", [2]),
        ("`id` == 1 | `id` == 3", [1, 3]), ("v == [1, 5] and id == 3", [3]), ("(v > 0) == (id > 1)", [1, 2, 3]), ("v != v", [1]), ("id.isin([1, 2]) and not v.between(4, 6)", [1]),
    ],
)
def test_conditions(nulls, condition, ids):
    assert sorted(r.id for r in relational.filter_rows(nulls, {"condition": condition}).collect()) == ids


@pytest.mark.parametrize("source", ["@x > 1", "v.__class__", "open('x')", "gone > 1", "v >", "lambda: 1", "[v for v in id]", "id", "s + v", "v.apply(print)", "s.str.decode('x')", "import os"])
def test_refused(nulls, source):
    with pytest.raises(ValueError):
        relational.filter_rows(nulls, {"condition": source}).collect()


@pytest.mark.parametrize(
    ("source", "values"),
    [
        ("v / 0", [None, None, None]), ("id // 2", [0, 1, 1]), ("(0 - id) % 3", [2, 1, 0]), ("s + '!'", ["a!", "b AND c!", None]), ("v.fillna(9)", [9, 5, 1]),
        ("v.clip(2, 4)", [None, 4, 2]), ("s.str.upper()", ["A", "B AND C", None]), ("log(v - 6)", [None, None, None]), ("v > 2", [False, True, False]), ("id.astype('str') + s", ["1a", "2b AND c", None]),
        ("abs(0 - id)", [1, 2, 3]), ("-id", [-1, -2, -3]), ("1 if v > 2 else 0", [0, 1, 0]),
    ],
)
def test_values(nulls, source, values):
    got = nulls.withColumn("x", expr.expression(nulls, source)).orderBy("id").collect()
    assert [r.x for r in got] == values


def test_positive_predicates_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    for condition in ("l_quantity > 10 and l_linenumber in [1, 2]", "l_quantity != 10"):
        plan = relational.filter_rows(df, {"condition": condition})._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: [")[1].split("]")[0]
        assert "l_quantity" in pushed


def test_bool_conversion(spark):
    df = spark.createDataFrame([("False", 0), ("", 2), (None, None)], "s string, n int")
    out = relational.map_columns(df, {"operations": [{"type": "type_convert", "column": c, "target_type": "bool"} for c in ("s", "n")]})
    assert [tuple(r) for r in out.collect()] == [(True, False), (False, True), (True, True)]


def test_columns_used():
    assert expr.columns_used("sqrt(a) + `b c` * address.city.str.len()") == ["a", "b c", "address"]
