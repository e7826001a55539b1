"""The library as a service's functions, without a web framework: entities, runs, reports and graphs in plain Python values."""

from __future__ import annotations

import json
import os
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import Rule
from ..sources import readers, sqlite
from ..streaming.incremental import MODES, ChangeFeed, MarkStore
from . import lineage, runtime, templates, workflow
from .spec import Pipeline, Workflow
from .store import NotFoundError, Store


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Service:
    def __init__(self, spark: SparkSession, folder: str, uploads: str | None = None) -> None:
        self.spark, self.store = spark, Store(spark, folder)
        self.uploads, self.checkpoints = uploads or os.path.join(folder, "uploads"), os.path.join(folder, "checkpoints")
        self.marks = MarkStore(os.path.join(folder, "marks.json"))
        self.scheduler = workflow.Scheduler(self._scheduled)
        for kind in ("pipelines", "workflows"):
            for e in self.store.entities(kind).values():
                self._schedule(kind, e)

    # data

    def preview(self, kind: str, config: dict, limit: int = 10) -> dict:
        columns, first, total = readers.preview(self.spark, kind, config, limit)
        return {"columns": columns, "rows": first, "total": total}

    def upload_csv(self, data: bytes, filename: str) -> str:
        return readers.store_upload(data, filename, self.uploads)

    def list_files(self) -> list[dict]:
        return rows(readers.list_csv_files(self.spark, self.uploads)) if os.path.isdir(self.uploads) else []

    def list_sqlite_tables(self, db_path: str) -> list[str]:
        return sqlite.list_tables(db_path)

    # pipelines and workflows

    def save_pipeline(self, name: str, dag: dict, key: object = None, **more: object) -> dict:
        Pipeline.parse(dag)
        value = {"name": name, "dag_config": dag, **more}
        out = self.store.update("pipelines", key, value) if key is not None else self.store.create("pipelines", value)
        self._schedule("pipelines", out)
        return out

    def save_workflow(self, name: str, dag: dict, key: object = None, **more: object) -> dict:
        Workflow.parse(dag)
        value = {"name": name, "dag_config": dag, **more}
        out = self.store.update("workflows", key, value) if key is not None else self.store.create("workflows", value)
        self._schedule("workflows", out)
        return out

    def get(self, kind: str, key: object) -> dict:
        return self.store.get(kind, key)

    def list(self, kind: str, skip: int = 0, limit: int = 100, **match: object) -> list[dict]:
        found = [e for e in self.store.entities(kind).values() if all(e.get(k) == v for k, v in match.items() if v is not None)]
        return found[skip : skip + limit]

    def delete(self, kind: str, key: object) -> None:
        self.store.delete(kind, key)
        self.scheduler.remove((kind, str(key)))

    def from_template(self, template: str, name: str | None = None, **parameters: object) -> dict:
        return self.save_pipeline(name or template, templates.instantiate(template, **parameters), template_type=template)

    def _schedule(self, kind: str, e: dict) -> None:
        key = (kind, str(e["id"]))
        self.scheduler.remove(key)
        if e.get("is_scheduled") and e.get("cron_expression"):
            self.scheduler.add(key, e["cron_expression"], e.get("is_enabled", True))

    def _scheduled(self, key: tuple[str, str]) -> None:
        (self.execute_pipeline if key[0] == "pipelines" else self.execute_workflow)(key[1])

    def tick(self, now: datetime) -> list[object]:
        return self.scheduler.tick(now)

    # rules

    def save_rule(self, value: dict, key: object = None) -> dict:
        return self.store.update("quality_rules", key, value) if key is not None else self.store.create("quality_rules", {"failure_strategy": "mark", "is_enabled": True, **value})

    def _rules(self, pipeline_id: object) -> dict[str, list[Rule]]:
        out: dict[str, list[Rule]] = {}
        for r in self.store.entities("quality_rules").values():
            if str(r["pipeline_id"]) == str(pipeline_id):
                out.setdefault(r["node_id"], []).append(Rule(r["rule_type"], r["rule_config"], r["failure_strategy"], r["id"], r["is_enabled"]))
        return out

    # runs

    def execute_pipeline(self, key: object, resume: runtime.Run | None = None, trigger: bool = False) -> runtime.Run:
        pipeline = self.store.get("pipelines", key)
        run = runtime.Executor(self.spark, pipeline["dag_config"], str(key), self.store, self._rules(key), self.checkpoints, self.marks).run(resume)
        if trigger and run.status == runtime.COMPLETED:
            self.trigger_downstream(key)
        return run

    def execute_async(self, key: object):  # noqa: ANN201
        self.store.get("pipelines", key)
        return self.scheduler.start(("pipelines", str(key)))

    def execute_workflow(self, key: object) -> workflow.WorkflowRun:
        flow = self.store.get("workflows", key)
        if flow.get("is_enabled") is False:
            raise ValueError(f"workflow {key} is switched off")
        return workflow.run_workflow(flow["dag_config"], self.execute_pipeline, self.store, str(key))

    def add_dependency(self, pipeline_id: object, upstream_id: object) -> dict:
        for k in (pipeline_id, upstream_id):
            self.store.get("pipelines", k)
        edges = [(d["upstream_id"], d["pipeline_id"]) for d in self.store.entities("dependencies").values()] + [(str(upstream_id), str(pipeline_id))]
        Workflow({k: k for e in edges for k in e}, edges).order()  # no cycles
        return self.store.create("dependencies", {"pipeline_id": str(pipeline_id), "upstream_id": str(upstream_id)})

    def remove_dependency(self, pipeline_id: object, upstream_id: object) -> None:
        found = [k for k, d in self.store.entities("dependencies").items() if (d["pipeline_id"], d["upstream_id"]) == (str(pipeline_id), str(upstream_id))]
        if not found:
            raise NotFoundError(f"dependency {upstream_id} -> {pipeline_id}")
        for k in found:
            self.store.delete("dependencies", k)

    def trigger_downstream(self, key: object) -> list[str]:
        """Runs the pipelines that wait for `key` and whose upstreams have all completed."""
        found = [(d["pipeline_id"], d["upstream_id"]) for d in self.store.entities("dependencies").values()]
        waiting = {p for p, u in found if u == str(key)}
        if not waiting:
            return []
        deps = self.spark.createDataFrame(found, "pipeline_id string, upstream_id string")
        ready = {r.pipeline_id for r in workflow.ready_downstream(self.store.records("executions"), deps).collect()} & waiting
        for p in sorted(ready):
            self.execute_pipeline(p, trigger=True)
        return sorted(ready)

    # what runs left

    def executions(self, skip: int = 0, limit: int = 100, pipeline_id: object = None) -> list[dict]:
        return rows(self.store.page("executions", skip, limit, pipeline_id=None if pipeline_id is None else str(pipeline_id)))

    def execution(self, key: str) -> dict:
        found = rows(self.store.records("executions").filter(F.col("id") == key).orderBy(F.col("created_at").desc()).limit(1))
        if not found:
            raise NotFoundError(f"executions: {key}")
        return found[0] | {"node_states": json.loads(found[0]["node_states"])}

    def quality_reports(self, skip: int = 0, limit: int = 100, execution_id: str | None = None, pipeline_id: object = None) -> list[dict]:
        return rows(self.store.page("quality_reports", skip, limit, execution_id=execution_id, pipeline_id=None if pipeline_id is None else str(pipeline_id)))

    def quarantine(self, skip: int = 0, limit: int = 100, execution_id: str | None = None, node_id: str | None = None) -> list[dict]:
        return rows(self.store.page("quarantine_records", skip, limit, execution_id=execution_id, node_id=node_id))

    def performance(self, skip: int = 0, limit: int = 100, execution_id: str | None = None) -> list[dict]:
        return rows(self.store.page("performance_metrics", skip, limit, execution_id=execution_id))

    def compare(self, first: str, second: str) -> list[dict]:
        return rows(runtime.compare_runs(self.store.records("performance_metrics"), first, second))

    def workflow_executions(self, skip: int = 0, limit: int = 100, workflow_id: object = None) -> list[dict]:
        return rows(self.store.page("workflow_executions", skip, limit, workflow_id=None if workflow_id is None else str(workflow_id)))

    def lineage_graph(self, pipeline_id: object) -> dict:
        records = self.store.records("lineage_records").filter(F.col("pipeline_id") == str(pipeline_id))
        nodes, links = lineage.sankey(records)
        return {"nodes": rows(nodes), "links": rows(links)}

    def lineage_reverse(self, table: str, column: str) -> list[dict]:
        return rows(lineage.trace_back(self.store.records("lineage_records"), table, column))

    def watermarks(self) -> dict[str, dict]:
        return self.marks.all()

    def watermark(self, source: object) -> dict:
        found = self.marks.get(source)
        if found is None:
            raise NotFoundError(f"watermarks: {source}")
        return found

    def create_watermark(self, source: object, kind: str, value: dict) -> dict:
        """A mark to begin with: what lies before it counts as loaded."""
        if kind not in MODES or MODES[kind][0] not in value:
            raise ValueError(f"a watermark of kind {kind!r} needs {MODES.get(kind, ('a known kind',))[0]}")
        if self.marks.get(source) is not None:
            raise ValueError(f"there is a watermark of {source} already")
        return self.marks.put(source, kind, value)

    def update_watermark(self, source: object, value: dict) -> dict:
        """Moves a mark, back too, so that rows can be loaded again."""
        kind = self.watermark(source)["watermark_type"]
        if kind in MODES and MODES[kind][0] not in value:
            raise ValueError(f"a watermark of kind {kind!r} needs {MODES[kind][0]}")
        return self.marks.put(source, kind, value)

    def delete_watermark(self, source: object) -> None:
        self.watermark(source)
        self.marks.clear(source)

    # changes that are followed

    def enable_changes(self, source: object, table: str) -> bool:
        return ChangeFeed(self.marks, source).enable(table)

    def disable_changes(self, source: object, table: str) -> None:
        ChangeFeed(self.marks, source).disable(table)

    def take_changes(self, source: object, table: str, sink, log: DataFrame | None = None) -> int:  # noqa: ANN001
        """Hands the changes not taken over yet to `sink` and moves on once it is done; the log's last id that was taken."""
        rows_, commit = ChangeFeed(self.marks, source).changes(self.store.records("change_logs") if log is None else log, table)
        sink(rows_)
        return commit()

    # single records

    def _record(self, kind: str, key: str) -> dict:
        found = rows(self.store.records(kind).filter(F.col("id") == key).orderBy(F.col("created_at").desc()).limit(1))
        if not found:
            raise NotFoundError(f"{kind}: {key}")
        return found[0]

    def quality_report(self, key: str) -> dict:
        found = self._record("quality_reports", key)
        return found | {"violation_samples": json.loads(found["violation_samples"])}

    def workflow_execution(self, key: str) -> dict:
        found = self._record("workflow_executions", key)
        return found | {"node_states": json.loads(found["node_states"])}

    def lineage_records(self, skip: int = 0, limit: int = 100, pipeline_id: object = None, execution_id: str | None = None) -> list[dict]:
        return rows(self.store.page("lineage_records", skip, limit, "target_column", pipeline_id=None if pipeline_id is None else str(pipeline_id), execution_id=execution_id))
