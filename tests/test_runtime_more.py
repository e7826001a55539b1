"""Branches computed once, checkpoints through Spark's file systems, quantiles of large groups, single records of the service."""

import pytest
from pyspark.sql import functions as F

from loomspark.operators import relational
from loomspark.plans import runtime
from loomspark.plans.service import Service
from loomspark.plans.store import NotFoundError
from loomspark.streaming import incremental

SF = "/root/testdata/sf0.001"


def routed_spec(out):
    node = lambda key, kind, config: {"id": key, "type": kind, "data": {"config": config}}
    routes = {"branches": [{"condition": "value > 60"}, {"condition": "event_type == 'click'"}, {"condition": ""}]}
    nodes = [node("src", "source", {"source_type": "parquet", "source_config": {"file_path": f"{SF}/events.parquet"}}), node("way", "branch", routes)]
    nodes += [node(f"out{i}", "output", {"output_type": "parquet", "output_config": {"path": f"{out}/{i}"}}) for i in range(3)]
    edges = [{"source": "src", "target": "way"}] + [{"source": "way", "target": f"out{i}", "sourceHandle": f"branch_{i}"} for i in range(3)]
    return {"nodes": nodes, "edges": edges}


def test_branches_are_computed_once(spark, tmp_path):
    run = runtime.Executor(spark, routed_spec(tmp_path)).run()
    assert run.status == runtime.COMPLETED, run.error
    events = spark.read.parquet(f"{SF}/events.parquet")
    want = relational.branch(events, {"branches": [{"condition": "value > 60"}, {"condition": "event_type == 'click'"}, {"condition": ""}]})
    for i in range(3):
        got = spark.read.parquet(f"{tmp_path}/{i}")
        assert got.columns == events.columns and sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in want[f"branch_{i}"].collect())
    assert run.states["way"].output_rows == events.count() == run.states["src"].output_rows
    staged = relational.branch(events, {"branches": [{"condition": "value > 60"}, {"condition": "value > 50"}]}, stage=True)
    plan = staged["branch_1"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_branch" in plan and "events.parquet" not in plan
    empty = relational.branch(events.limit(0), {"branches": [{"condition": "value > 60"}, {"condition": ""}]}, stage=True)
    assert [df.count() for df in empty.values()] == [0, 0]


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_resume_reads_checkpoints_by_any_path(spark, tmp_path, scheme):
    folder = f"{scheme}{tmp_path}/checkpoints"
    node = lambda key, kind, config: {"id": key, "type": kind, "data": {"config": config}}
    spec = {"nodes": [node("src", "source", {"source_type": "parquet", "source_config": {"file_path": f"{SF}/nation.parquet"}}), node("f", "filter", {"condition": "n_regionkey > 2"}), node("bad", "filter", {"condition": "nothing > 1"})], "edges": [{"source": "src", "target": "f"}, {"source": "f", "target": "bad"}]}
    first = runtime.Executor(spark, spec, checkpoint_dir=folder).run()
    assert first.status == runtime.FAILED
    spec["nodes"][2] = node("bad", "filter", {"condition": "n_nationkey > 1"})
    again = runtime.Executor(spark, spec, checkpoint_dir=folder)
    assert set(again._saved(first, "f")) == {"f"} and again._saved(first, "bad") == {}
    second = again.run(first)
    assert second.status == runtime.COMPLETED and second.id == first.id and second.states["f"].start == first.states["f"].start


def test_quantiles_of_large_groups(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    specs = [{"column": "l_quantity", "function": "median"}, {"column": "l_tax", "function": "sum", "alias": "t"}, {"column": "l_extendedprice", "function": "quantile", "q": 0.9, "alias": "p"}]
    config = {"group_by": ["l_returnflag"], "aggregations": specs}
    got, want = (relational.aggregate(df, config | more) for more in ({"large_groups": True}, {}))
    assert got.columns == want.columns == ["l_returnflag", "l_quantity_median", "t", "p"]
    rounded = lambda x: sorted((r[0], *(round(v, 6) for v in r[1:])) for r in x.collect())
    assert rounded(got) == rounded(want)
    alone = relational.aggregate(df, {"group_by": ["l_returnflag"], "aggregations": specs[:1], "large_groups": True})
    assert alone.count() == 3


def test_marks_and_changes_of_the_service(spark, tmp_path):
    s = Service(spark, str(tmp_path))
    with pytest.raises(NotFoundError):
        s.watermark("a")
    assert s.create_watermark("a", "timestamp", {"last_timestamp": "2024-01-01 00:00:00"})["watermark_value"] == {"last_timestamp": "2024-01-01 00:00:00"}
    for bad in (("a", "timestamp", {"last_timestamp": "x"}), ("b", "timestamp", {}), ("b", "else", {"last_id": 1})):
        with pytest.raises(ValueError):
            s.create_watermark(*bad)
    assert s.update_watermark("a", {"last_timestamp": "2023-01-01 00:00:00"})["watermark_type"] == "timestamp"
    assert s.watermark("a")["watermark_value"]["last_timestamp"].startswith("2023") and set(s.watermarks()) == {"a"}
    s.delete_watermark("a")
    with pytest.raises(NotFoundError):
        s.delete_watermark("a")

    old, new = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string"), spark.createDataFrame([(1, "z"), (3, "w")], "id long, v string")
    log = incremental.snapshot_changes(old, new, ["id"], "t").select(F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("record_id")).cast("long").alias("id"), "table_name", "operation_type", "record_id", "record_data", "before_data")
    s.store.append("change_logs", log)
    taken = []
    with pytest.raises(KeyError):
        s.take_changes("src", "t", taken.append)
    assert s.enable_changes("src", "t")
    assert s.take_changes("src", "t", lambda df: taken.extend(df.collect())) == 3 and len(taken) == 3
    assert s.take_changes("src", "t", lambda df: taken.extend(df.collect())) == 3 and len(taken) == 3
    s.disable_changes("src", "t")
    with pytest.raises(KeyError):
        s.take_changes("src", "t", taken.append)


def test_single_records_of_the_service(spark, tmp_path):
    s = Service(spark, str(tmp_path / "meta"))
    node = lambda key, kind, config: {"id": key, "type": kind, "data": {"config": config}}
    spec = {"nodes": [node("src", "source", {"source_type": "parquet", "source_config": {"file_path": f"{SF}/nation.parquet"}}), node("o", "output", {"output_type": "parquet", "output_config": {"path": str(tmp_path / "out")}})], "edges": [{"source": "src", "target": "o"}]}
    p = s.save_pipeline("p", spec)
    s.save_rule({"pipeline_id": p["id"], "node_id": "src", "rule_type": "range_check", "rule_config": {"field": "n_nationkey", "max_value": 20}})
    run = s.execute_pipeline(p["id"])
    assert run.status == runtime.COMPLETED, run.error
    listed = s.quality_reports(execution_id=run.id)
    one = s.quality_report(listed[0]["id"])
    assert one["failed_rows"] == 4 and len(one["violation_samples"]) == 4
    assert {r["target_column"] for r in s.lineage_records(pipeline_id=p["id"])} >= {"n_name"} and len(s.lineage_records(limit=2)) == 2
    flow = s.save_workflow("w", {"nodes": [{"key": "a", "pipeline_id": p["id"]}], "edges": []})
    s.execute_workflow(flow["id"])
    found = s.workflow_executions()
    assert s.workflow_execution(found[0]["id"])["workflow_id"] == str(flow["id"])
    for get in (s.quality_report, s.workflow_execution):
        with pytest.raises(NotFoundError):
            get("none")
