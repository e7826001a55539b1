"""Every query with a SQL twin gives the twin's rows."""

import math
from pathlib import Path

import duckdb
import pytest

from loomspark import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return db


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ")
    return float(v) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_its_twin(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(plain(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


def test_flagship_is_one_plan_with_pruned_scans(spark):
    plan = catalogue.QUERIES["flagship_join_agg_sort"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "c_name" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
