"""Workflows of pipelines, dependencies between pipelines, and schedules."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import COMPLETED, FAILED, PENDING, RUNNING, SKIPPED
from .spec import Workflow
from .store import Store, new_id


@dataclass
class WorkflowRun:
    id: str
    status: str = PENDING
    states: dict[str, str] = field(default_factory=dict)
    runs: dict[str, object] = field(default_factory=dict)
    error: str | None = None


def run_workflow(spec: dict, execute: Callable[[object], object], store: Store | None = None, workflow_id: str = "") -> WorkflowRun:
    """Pipelines in topological order; `execute(pipeline_id)` returns a Run. The first failure stops the workflow: what lies
    downstream is skipped, the rest stays pending. A node without a pipeline fails alone."""
    flow = Workflow.parse(spec)
    out, began = WorkflowRun(new_id(), RUNNING, dict.fromkeys(flow.pipelines, PENDING)), time.time()
    for key in flow.order():
        if out.states[key] == SKIPPED:
            continue
        if flow.pipelines[key] is None:
            out.states[key], out.error = FAILED, f"node {key!r} names no pipeline"
            for k in flow.downstream(key):
                out.states[k] = SKIPPED
            continue
        out.states[key] = RUNNING
        try:
            run = out.runs[key] = execute(flow.pipelines[key])
            status, error = run.status, run.error
        except Exception as e:
            status, error = FAILED, f"{type(e).__name__}: {e}"
        out.states[key] = status
        if status != COMPLETED:
            out.error = f"{key}: {error}"
            for k in flow.downstream(key):
                out.states[k] = SKIPPED
            break
    out.status = COMPLETED if all(s == COMPLETED for s in out.states.values()) else FAILED
    if store:
        store.append("workflow_executions", [(out.id, str(workflow_id), out.status, began, time.time(), json.dumps(out.states), out.error, time.time())])
    return out


def ready_downstream(executions: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(pipeline_id) of pipelines all of whose upstreams' latest executions completed.

    executions: pipeline_id, status, created_at. dependencies: pipeline_id, upstream_id.
    """
    latest = executions.groupBy(F.col("pipeline_id").alias("upstream_id")).agg(F.max_by("status", "created_at").alias("status"))
    seen = dependencies.join(latest, "upstream_id", "left")
    return seen.groupBy("pipeline_id").agg(F.bool_and(F.coalesce(F.col("status") == COMPLETED, F.lit(False))).alias("ready")).filter("ready").select("pipeline_id")


class Cron:
    """A five-field schedule: minute, hour, day of month, month, day of week (0 or 7 is Sunday; names in English)."""

    RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
    MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
    DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")

    def __init__(self, text: str) -> None:
        parts = text.split()
        if len(parts) != 5:
            raise ValueError(f"a schedule has five fields: {text!r}")
        self.fields = [self._field(p.lower(), k) for k, p in enumerate(parts)]
        if 7 in self.fields[4]:
            self.fields[4].add(0)
        self.any_day, self.any_weekday = parts[2] == "*", parts[4] == "*"

    def _number(self, text: str, k: int) -> int:
        names = {3: {n: i + 1 for i, n in enumerate(self.MONTHS)}, 4: {n: i for i, n in enumerate(self.DAYS)}}.get(k, {})
        return names[text] if text in names else int(text)

    def _field(self, text: str, k: int) -> set[int]:
        lo, hi = self.RANGES[k]
        out: set[int] = set()
        for part in text.split(","):
            span, _, step = part.partition("/")
            if span == "*":
                a, b = lo, hi if k != 4 else 6
            elif "-" in span:
                a, b = (self._number(x, k) for x in span.split("-"))
            else:
                a = self._number(span, k)
                b = hi if step else a
            if not (lo <= a <= b <= hi) or (step and int(step) < 1):
                raise ValueError(f"{part!r} is out of range")
            out.update(range(a, b + 1, int(step or 1)))
        return out

    def matches(self, t: datetime) -> bool:
        minute, hour, day, month, weekday = self.fields
        if t.minute not in minute or t.hour not in hour or t.month not in month:
            return False
        of_month, of_week = t.day in day, (t.weekday() + 1) % 7 in weekday
        return of_month and of_week if self.any_day or self.any_weekday else of_month or of_week

    def next(self, after: datetime) -> datetime:
        t = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
        for _ in range(366 * 24 * 60 * 5):
            if self.matches(t):
                return t
            t += timedelta(days=1) - timedelta(hours=t.hour, minutes=t.minute) if t.month not in self.fields[3] else timedelta(minutes=1)
        raise ValueError("the schedule never comes")


class Scheduler:
    """Starts what is due, each in a thread of its own; tick() is called by a timer or by hand."""

    def __init__(self, run: Callable[[object], object]) -> None:
        self.run, self.jobs, self.running = run, {}, {}

    def add(self, key: object, schedule: str, enabled: bool = True) -> None:
        self.jobs[key] = (Cron(schedule), enabled)

    def remove(self, key: object) -> None:
        self.jobs.pop(key, None)

    def tick(self, now: datetime) -> list[object]:
        due = [k for k, (cron, on) in self.jobs.items() if on and cron.matches(now) and not (k in self.running and self.running[k].is_alive())]
        for k in due:
            self.start(k)
        return due

    def start(self, key: object) -> threading.Thread:
        self.running[key] = threading.Thread(target=self.run, args=(key,), daemon=True)
        self.running[key].start()
        return self.running[key]
