import json
import sqlite3
from datetime import datetime

import pytest

from loomspark.operators.quality import Rule
from loomspark.plans import lineage, spec, templates, workflow
from loomspark.plans.runtime import Executor
from loomspark.plans.service import Service
from loomspark.plans.store import NotFoundError, Store
from loomspark.streaming import incremental


def csv_spec(path, target, condition="x > 0"):
    node = lambda key, kind, **c: {"id": key, "type": kind, "data": {"config": c}}
    return {
        "nodes": [node("in", "source", source_type="csv", source_config={"file_path": path}), node("f", "filter", condition=condition), node("out", "output", output_type="parquet", output_config={"path": target})],
        "edges": [{"source": "in", "target": "f"}, {"source": "f", "target": "out"}],
    }


@pytest.fixture()
def table(tmp_path):
    (tmp_path / "in.csv").write_text("id,x\n1,5\n2,-1\n3,\n4,7\n")
    return str(tmp_path / "in.csv")


def test_run_counts_metrics_lineage(spark, tmp_path, table):
    store = Store(spark, str(tmp_path / "meta"))
    run = Executor(spark, csv_spec(table, str(tmp_path / "o")), "7", store).run()
    assert run.status == "completed" and spark.read.parquet(str(tmp_path / "o")).count() == 2
    assert (run.states["in"].output_rows, run.states["f"].output_rows, run.states["f"].input_rows) == (4, 2, 4)
    assert store.records("performance_metrics").count() == 3
    assert {(r.source_column, r.target_column) for r in store.records("lineage_records").collect()} == {("id", "id"), ("x", "x")}


def test_failure_then_resume_reads_checkpoints(spark, tmp_path, table):
    bad = csv_spec(table, str(tmp_path / "o"), "gone > 0")
    where = str(tmp_path / "cp")
    first = Executor(spark, bad, checkpoint_dir=where).run()
    assert first.status == "failed" and first.states["in"].status == "completed" and "gone" in first.error
    (tmp_path / "in.csv").unlink()  # the source can't be read again
    second = Executor(spark, csv_spec(table, str(tmp_path / "o")), checkpoint_dir=where).run(first)
    assert second.status == "completed" and second.id == first.id and spark.read.parquet(str(tmp_path / "o")).count() == 2


def test_rules_gate_the_run(spark, tmp_path, table):
    store, target = Store(spark, str(tmp_path / "meta")), str(tmp_path / "o")
    rule = lambda how: {"in": [Rule("non_null_rate", {"field": "x", "max_null_percent": 0}, how, 1)]}
    assert Executor(spark, csv_spec(table, target), "1", store, rule("abort")).run().status == "failed"
    assert store.records("quality_reports").first().failed_rows == 1
    assert Executor(spark, csv_spec(table, target), "1", store, rule("quarantine")).run().status == "completed"
    assert json.loads(store.records("quarantine_records").first().record_data)["id"] == 3


def test_bad_specs():
    for nodes, edges in (
        ([], []), ([{"id": "a", "type": "what"}], []), ([{"id": "a", "type": "filter"}], []), ([{"id": "a", "type": "source"}, {"id": "a", "type": "source"}], []),
        ([{"id": "a", "type": "filter"}, {"id": "b", "type": "filter"}], [{"source": "a", "target": "b"}, {"source": "b", "target": "a"}]), ([{"id": "a", "type": "source"}], [{"source": "a", "target": "z"}]),
    ):
        with pytest.raises(spec.SpecError):
            spec.Pipeline.parse({"nodes": nodes, "edges": edges})


def test_join_handle_decides_the_right_side():
    nodes = [{"id": "a", "type": "source"}, {"id": "b", "type": "source"}, {"id": "j", "type": "join"}]
    edges = [{"source": "a", "target": "j", "targetHandle": "join_right"}, {"source": "b", "target": "j"}]
    assert [e.source for e in spec.Pipeline.parse({"nodes": nodes, "edges": edges}).inputs("j")] == ["b", "a"]


def test_template_csv_cleaning(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id,name,email,age\n1,a,a@x.y,28\n2,b,a@x.y,30\n3,c,,20\n4,d,d@x.y,-1\n5,e,e@x.y,22\n")
    db = str(tmp_path / "o.db")
    run = Executor(spark, templates.csv_cleaning(str(tmp_path / "c.csv"), db)).run()
    assert run.status == "completed", run.error
    with sqlite3.connect(db) as c:
        assert c.execute("SELECT id, full_name FROM customers ORDER BY id").fetchall() == [(1, "a"), (5, "e")]


def test_template_join_to_csv(spark, tmp_path):
    db = str(tmp_path / "s.db")
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE customers (id INTEGER, region TEXT)")
        c.execute("CREATE TABLE orders (id INTEGER, customer_id INTEGER, amount REAL)")
        c.executemany("INSERT INTO customers VALUES (?, ?)", [(1, "N"), (2, "S")])
        c.executemany("INSERT INTO orders VALUES (?, ?, ?)", [(1, 1, 10), (2, 2, 99), (3, 1, 20)])
    run = Executor(spark, templates.multi_table_join(db, "r.csv", str(tmp_path))).run()
    assert run.status == "completed", run.error
    assert (tmp_path / "r.csv").read_text().splitlines() == ["region,total_amount,order_count,avg_amount", "S,99.0,1,99.0", "N,30.0,2,15.0"]
    paths = {(r[2], r[3], r[5]) for r in run.lineage.rows}
    assert ("orders", "amount", "avg_amount") in paths and ("customers", "region", "region") in paths


def test_workflow_stops_and_skips():
    class Done:
        def __init__(self, ok):
            self.status, self.error = ("completed", None) if ok else ("failed", "no")

    flow = {"nodes": [{"key": k, "pipeline_id": k} for k in "abcd"], "edges": [{"source": "a", "target": "b"}, {"source": "b", "target": "c"}]}
    run = workflow.run_workflow(flow, lambda p: Done(p != "b"))
    assert run.states == {"a": "completed", "d": "completed", "b": "failed", "c": "skipped"} and run.status == "failed"
    assert workflow.run_workflow(flow, lambda p: Done(True)).status == "completed"
    with pytest.raises(spec.SpecError):
        spec.Workflow.parse({"nodes": [{"key": "a"}, {"key": "b"}], "edges": [{"source": "a", "target": "b"}, {"source": "b", "target": "a"}]})


def test_cron():
    t = datetime(2024, 2, 28, 23, 59)
    assert workflow.Cron("0 0 29 2 *").next(t) == datetime(2024, 2, 29)
    assert workflow.Cron("*/15 9-17 * * mon-fri").next(datetime(2024, 3, 1, 17, 50)) == datetime(2024, 3, 4, 9, 0)
    assert workflow.Cron("0 12 1 * 7").matches(datetime(2024, 3, 3, 12, 0))
    for bad in ("* * * *", "60 * * * *", "* * 0 * *", "a * * * *"):
        with pytest.raises(ValueError):
            workflow.Cron(bad)


def test_service(spark, tmp_path, table):
    s = Service(spark, str(tmp_path / "meta"))
    a = s.save_pipeline("a", csv_spec(table, str(tmp_path / "a")))
    b = s.save_pipeline("b", csv_spec(table, str(tmp_path / "b")))
    s.add_dependency(b["id"], a["id"])
    with pytest.raises(spec.SpecError):
        s.add_dependency(a["id"], b["id"])
    s.save_rule({"pipeline_id": a["id"], "node_id": "in", "rule_type": "range_check", "rule_config": {"field": "x", "min_value": 0}})
    run = s.execute_pipeline(a["id"], trigger=True)
    assert run.status == "completed", run.error
    assert [e["pipeline_id"] for e in s.executions()] == ["2", "1"] and len(s.quality_reports(pipeline_id=1)) == 1
    graph = s.lineage_graph(a["id"])
    assert any(n["name"].startswith("step:f") for n in graph["nodes"])
    assert {r["source_column"] for r in s.lineage_reverse(str(tmp_path / "b"), "id")} == {"id"}
    first, second = (e["id"] for e in s.executions())
    assert {r["node_id"] for r in s.compare(first, second)} == {"in", "f", "out"}
    w = s.save_workflow("w", {"nodes": [{"id": "n", "data": {"pipelineId": 1}}], "edges": []}, cron_expression="5 * * * *", is_scheduled=True)
    assert s.execute_workflow(w["id"]).status == "completed" and len(s.workflow_executions()) == 1
    assert s.scheduler.tick(datetime(2024, 1, 1, 0, 6)) == []
    s.delete("pipelines", b["id"])
    with pytest.raises(NotFoundError):
        s.get("pipelines", b["id"])


def test_incremental_delivers_each_row_once(spark, tmp_path):
    store = incremental.MarkStore(str(tmp_path / "m.json"))
    config, seen = {"enabled": True, "mode": "auto_increment_id", "id_field": "id"}, []
    for top in (5, 5, 9, 3, 12):  # the source also shrinks once
        rows, commit = incremental.sync(spark.range(top), config, store, "s")
        seen += [r.id for r in rows.collect()]
        commit()
    assert seen == list(range(12)) and store.get("s")["watermark_value"] == {"last_id": 11}


def test_stream_catches_up(spark, tmp_path):
    got = []
    for part in (range(3), range(3, 5)):
        spark.createDataFrame([(i,) for i in part], "id long").write.mode("append").parquet(str(tmp_path / "in"))
        incremental.stream_new_files(spark, str(tmp_path / "in"), "id long", lambda df, _: got.extend(r.id for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(got) == [0, 1, 2, 3, 4]


def test_snapshot_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, s string")
    new = spark.createDataFrame([(2, "B"), (3, None), (4, "d")], "id int, s string")
    log = incremental.snapshot_changes(old, new, ["id"], "t")
    assert {(r.operation_type, r.record_id) for r in log.collect()} == {("DELETE", "1"), ("UPDATE", "2"), ("INSERT", "4")}


def test_change_feed_gives_each_change_once(spark, tmp_path):
    feed, seen = incremental.ChangeFeed(incremental.MarkStore(str(tmp_path / "m.json")), 1), []
    with pytest.raises(KeyError):
        feed.changes(spark.createDataFrame([], "id long, table_name string"), "t")
    feed.enable("t")
    for top in (3, 3, 7):
        log = spark.range(1, top + 1).selectExpr("id", "if(id % 2 = 0, 't', 'u') AS table_name")
        rows, commit = feed.changes(log, "t")
        seen += [r.id for r in rows.collect()]
        commit()
        feed.enable("t")
    assert seen == [2, 4, 6]
    feed.disable("t")
    assert not feed.enabled("t")


def test_highlight():
    assert lineage.highlight([("a", "b"), ("b", "c"), ("x", "c")], "b") == {"a", "b", "c"}


def test_lineage_goes_all_the_way_back(spark):
    rows = [("p", "e", f"t{k}", "c", f"t{k + 1}", "c", []) for k in range(40)]
    rows += [("p", "e", "a", "x", "d", "x", []), ("p", "e", "a", "x", "e", "x", []), ("p", "e", "d", "x", "f", "x", []), ("p", "e", "e", "x", "f", "x", []), ("p", "e", "f", "x", "a", "x", [])]
    records = spark.createDataFrame(rows, lineage.SCHEMA)
    got = lineage.trace_back(records, "t40", "c").collect()
    assert len(got) == 40 and [(r.source_table, r.depth) for r in got if r.is_root] == [("t0", 40)]
    loop = {(r.source_table, r.depth) for r in lineage.trace_back(records, "f", "x").collect()}
    assert loop == {("d", 1), ("e", 1), ("a", 2)}
    assert lineage.trace_back(records, "none", "c").count() == 0


def test_sync_leaves_later_rows_to_the_next_call(spark, tmp_path):
    path, config = str(tmp_path / "rows"), {"mode": "auto_increment_id", "id_field": "id", "enabled": True}
    store = incremental.MarkStore(str(tmp_path / "marks.json"))
    spark.range(5).write.parquet(path)
    rows, commit = incremental.sync(spark.read.parquet(path), config, store, "s")
    spark.range(5, 8).write.mode("append").parquet(path)  # while the rows are written
    late = incremental.newer(spark.read.parquet(path), config, None).count()
    assert rows.count() == 5 and late == 8 and commit()["watermark_value"] == {"last_id": 4}
    again, _ = incremental.sync(spark.read.parquet(path), config, store, "s")
    assert sorted(r.id for r in again.collect()) == [5, 6, 7]
