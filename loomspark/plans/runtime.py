"""Runs a pipeline: its graph becomes one lazy DataFrame plan, and each sink is one action.

A node only materialises where something needs it: quality gates (which must be known before a sink), outputs with several
consumers (persisted), and nodes that checkpoint. Row counts come from Observations, which ride along with the action.
"""

from __future__ import annotations

import json
import time
import traceback
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import quality, relational
from ..sources import readers, writers
from ..staging import children
from ..streaming import incremental
from . import lineage, pushdown
from .spec import Node, Pipeline
from .store import Store, new_id

PENDING, RUNNING, COMPLETED, FAILED, SKIPPED = "pending", "running", "completed", "failed", "skipped"


@dataclass
class NodeState:
    status: str = PENDING
    input_rows: int | None = None
    output_rows: int | None = None
    start: float | None = None
    end: float | None = None
    memory: int | None = None
    error: str | None = None

    @property
    def duration_ms(self) -> float | None:
        return None if self.start is None or self.end is None else (self.end - self.start) * 1000

    @property
    def throughput(self) -> float | None:
        ms = self.duration_ms
        return None if not ms or self.output_rows is None else round(self.output_rows / (ms / 1000), 2)


@dataclass
class Run:
    id: str
    status: str = PENDING
    states: dict[str, NodeState] = field(default_factory=dict)
    reports: list[tuple[str, quality.Report]] = field(default_factory=list)
    outcomes: dict[str, writers.Outcome] = field(default_factory=dict)
    error: str | None = None
    lineage: lineage.Tracker | None = None

    @property
    def total_rows(self) -> int:
        return sum(s.output_rows or 0 for s in self.states.values() if s.status == COMPLETED)


def build(spark: SparkSession, spec: dict, frames: dict[str, DataFrame] | None = None, push: bool = True) -> dict[str, DataFrame]:
    """The lazy DataFrame of every node (branches under id.branch_i), sinks left out. Nothing runs.

    `frames` stands in for nodes that are given, such as sources in tests. `push`: what follows a SQLite source reads it by SQL that
    has its conditions and columns; the source's own frame stays whole.
    """
    pipeline, out = Pipeline.parse(spec), dict(frames or {})
    for key in pipeline.order():
        node = pipeline.node(key)
        if key in out or node.type == "output":
            continue
        given = pushdown.narrowed(spark, pipeline, node, out, set(frames or {})) if push else None
        out |= _node_frames(spark, pipeline, node, out, given)
    return out


def _input(pipeline: Pipeline, edge, out: dict[str, DataFrame]) -> DataFrame:  # noqa: ANN001
    """What an edge carries: of a branch node the branch that its handle names, or the first."""
    if pipeline.node(edge.source).type == "branch":
        handle = edge.source_handle or "branch_0"
        name = f"{edge.source}.{handle}"
        if name not in out:
            raise relational.ConfigError(f"node {edge.source!r} has no output {handle!r}")
        return out[name]
    return out[edge.source]


def _node_frames(spark: SparkSession, pipeline: Pipeline, node: Node, out: dict[str, DataFrame], given: DataFrame | None = None, stage: bool = False) -> dict[str, DataFrame]:
    inputs = [_input(pipeline, e, out) for e in pipeline.inputs(node.id)] if given is None else [given]
    if node.type == "source":
        c = node.config
        kind = c.get("source_type") or c.get("type")
        return {node.id: readers.read(spark, kind, c.get("source_config") or c.get("config") or c)}
    if node.type == "join":
        return {node.id: relational.join_all(inputs, node.config)}
    if node.type == "branch":
        return {f"{node.id}.{k}": v for k, v in relational.branch(inputs[0], node.config, stage).items()} | {node.id: inputs[0]}
    return {node.id: relational.UNARY[node.type](inputs[0], node.config)}


class Executor:
    """One run of a pipeline, with its rules, metrics, lineage, checkpoints and marks."""

    def __init__(self, spark: SparkSession, spec: dict, pipeline_id: str = "", store: Store | None = None, rules: dict[str, list[quality.Rule]] | None = None, checkpoint_dir: str | None = None, marks: incremental.MarkStore | None = None) -> None:
        self.spark, self.pipeline, self.pipeline_id, self.store = spark, Pipeline.parse(spec), pipeline_id, store
        self.rules, self.checkpoint_dir, self.marks = rules or {}, checkpoint_dir, marks

    def run(self, resume: Run | None = None) -> Run:
        """Fail-fast. With `resume`, nodes that completed before are read from their checkpoints instead of run again."""
        done = {k for k, s in resume.states.items() if s.status == COMPLETED} if resume and self.checkpoint_dir else set()
        run = Run(resume.id if resume and done else new_id(), RUNNING, {n.id: NodeState() for n in self.pipeline.nodes})
        run.lineage = lineage.Tracker(self.pipeline_id, run.id)
        began, out, held, commits = time.time(), {}, [], []
        uses = Counter((e.source, e.source_handle) for e in self.pipeline.edges)
        watches: dict[str, Observation] = {}
        try:
            for key in self.pipeline.order():
                node, state = self.pipeline.node(key), run.states[key]
                state.status, state.start = RUNNING, time.time()
                try:
                    if key in done and self._saved(run, key):
                        state.__dict__.update(resume.states[key].__dict__)
                        out |= {name: self.spark.read.parquet(path) for name, path in self._saved(run, key).items()}
                        if node.type != "output":
                            self._trace(run, node, out)
                        continue
                    if node.type == "output":
                        self._output(run, node, out, watches, held)
                    else:
                        # Each branch that is used is an action of its own: what leads to them runs once, as it is written.
                        several = len([e for e in self.pipeline.edges if e.source == key]) > 1 and not self.checkpoint_dir
                        made = _node_frames(self.spark, self.pipeline, node, out, stage=several)
                        if node.type == "source":
                            made[key] = self._incremental(node, made[key], commits)
                        if node.type != "branch":
                            made[key] = self._gate(run, node, made[key], held)
                        made = self._keep(run, node, made, uses, held, watches)
                        out |= made
                        self._trace(run, node, out)
                    state.status, state.end = COMPLETED, time.time()
                except Exception as e:
                    state.status, state.end, state.error = FAILED, time.time(), f"{type(e).__name__}: {e}"
                    raise
            for commit in commits:
                commit()
            run.status = COMPLETED
        except Exception as e:
            run.status, run.error = FAILED, "".join(traceback.format_exception_only(e)).strip()
        finally:
            self._count(run, watches)
            for df in held:
                df.unpersist()
            self._record(run, began)
        return run

    def _incremental(self, node: Node, df: DataFrame, commits: list) -> DataFrame:
        config = node.config.get("incremental") or (node.config.get("source_config") or {}).get("incremental")
        if not config or not config.get("enabled") or self.marks is None:
            return df
        rows, commit = incremental.sync(df, config, self.marks, node.config.get("data_source_id") or node.id)
        commits.append(commit)
        return rows

    def _gate(self, run: Run, node: Node, df: DataFrame, held: list) -> DataFrame:
        rules = [r for r in self.rules.get(node.id, []) if r.is_enabled]
        if not rules:
            return df
        held.append(df := df.persist())
        keep = (lambda rule, bad: self._quarantine(run, node, rule, bad)) if self.store else None
        try:
            df, reports = quality.apply(df, rules, keep)
        except quality.QualityAbort as e:
            run.reports += [(node.id, r) for r in e.reports]
            raise
        run.reports += [(node.id, r) for r in reports]
        return df

    def _quarantine(self, run: Run, node: Node, rule: quality.Rule, bad: DataFrame) -> None:
        rows = bad.select(F.lit(run.id).alias("execution_id"), F.lit(node.id).alias("node_id"), F.lit(rule.id).cast("long").alias("rule_id"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in bad.columns])).alias("record_data"), F.lit(quality.reason(rule)).alias("violation_reason"), F.lit(time.time()).alias("created_at"))
        self.store.append("quarantine_records", rows)

    def _keep(self, run: Run, node: Node, made: dict[str, DataFrame], uses: Counter, held: list, watches: dict) -> dict[str, DataFrame]:
        out = {}
        for name, df in made.items():
            handle = name.partition(".")[2] or None
            if node.type == "branch" and handle is None:
                out[name] = df
                continue
            if self.checkpoint_dir:
                df.write.mode("overwrite").parquet(path := self._path(run, name))
                out[name] = self.spark.read.parquet(path)
                state = run.states[node.id]
                state.output_rows = (state.output_rows or 0) + out[name].count()
                continue
            run.states[node.id].memory = size_estimate(df)
            watches[name] = Observation(f"rows {name}")
            df = df.observe(watches[name], F.count(F.lit(1)).alias("n"))
            if uses[node.id, handle] + (uses[node.id, None] if handle else 0) > 1:
                held.append(df := df.persist())
            out[name] = df
        return out

    def _output(self, run: Run, node: Node, out: dict[str, DataFrame], watches: dict, held: list) -> None:
        edge = self.pipeline.inputs(node.id)[0]
        df = self._gate(run, node, _input(self.pipeline, edge, out), held)
        c = node.config
        kind = c.get("output_type") or c.get("target_type") or c.get("type")
        watches[node.id] = Observation(f"rows {node.id}")
        df = df.observe(watches[node.id], F.count(F.lit(1)).alias("n"))
        run.outcomes[node.id] = writers.write(df, kind, c.get("output_config") or c.get("target_config") or c.get("config") or c)
        run.lineage.output(node, self.pipeline)

    def _trace(self, run: Run, node: Node, out: dict[str, DataFrame]) -> None:
        if node.type == "source":
            run.lineage.source(node, out[node.id].columns, out[node.id])
        else:
            run.lineage.transform(node, self.pipeline, out[node.id].columns)

    def _path(self, run: Run, name: str) -> str:
        return f"{self.checkpoint_dir}/{run.id}/{name}"

    def _saved(self, run: Run, key: str) -> dict[str, str]:
        """Checkpoints of a node that were completed."""
        folder = f"{self.checkpoint_dir}/{run.id}"
        names = [n for n in children(self.spark, folder) if n == key or n.startswith(f"{key}.")]
        return {n: f"{folder}/{n}" for n in names if "_SUCCESS" in children(self.spark, f"{folder}/{n}")}

    def _count(self, run: Run, watches: dict[str, Observation]) -> None:
        """Rows of each node, from what the actions observed; a node that no action reached has no count."""
        for name, watch in watches.items():
            state, got = run.states[name.partition(".")[0]], _observed(watch)
            if state.status == COMPLETED and got is not None:
                state.output_rows = (state.output_rows or 0) + got if "." in name else got
        for n in self.pipeline.nodes:
            state = run.states[n.id]
            counts = [run.states[e.source].output_rows for e in self.pipeline.inputs(n.id)]
            state.input_rows = sum(c or 0 for c in counts) if counts else state.output_rows
            state.end = state.end or state.start

    def _record(self, run: Run, began: float) -> None:
        if not self.store:
            return
        now = time.time()
        states = json.dumps({k: s.__dict__ for k, s in run.states.items()})
        self.store.append("executions", [(run.id, self.pipeline_id, run.status, began, now, run.total_rows, run.total_rows, run.error, states, now)])
        self.store.append("performance_metrics", [(run.id, k, s.start, s.end, s.duration_ms, s.input_rows, s.output_rows, s.throughput, s.memory, now) for k, s in run.states.items() if s.start])
        self.store.append("quality_reports", [(new_id(), run.id, self.pipeline_id, n, r.rule_id, r.rule_type, r.total, r.passed_rows, r.failed, r.pass_rate, json.dumps(r.samples, default=str), now) for n, r in run.reports])
        if run.status == COMPLETED and run.lineage.rows:
            self.store.append("lineage_records", run.lineage.records(self.spark))


def _observed(watch: Observation, wait: float = 2.0) -> int | None:
    """The count if an action brought it. A plan that lost the node to the optimiser never does, so this doesn't wait for long."""
    if watch._jo is None:
        return None
    until = time.time() + wait
    while not watch._jo.future().isCompleted():
        if time.time() > until:
            return None
        time.sleep(0.02)
    return watch.get.get("n")


def size_estimate(df: DataFrame) -> int:
    """Catalyst's estimate of a DataFrame's bytes, from file sizes and column widths; nothing runs."""
    return min(2**63 - 1, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))


def compare_runs(metrics: DataFrame, first: str, second: str) -> DataFrame:
    """Per node, the second run's figures less the first's; null where a run lacks the node."""
    figures = ["duration_ms", "throughput", "memory_peak_bytes", "output_rows"]
    side = lambda run, tag: metrics.filter(F.col("execution_id") == run).select(F.col("node_id").alias(f"_{tag}"), *[F.col(f).alias(f"{tag}_{f}") for f in figures])
    both = side(first, "exec1").join(side(second, "exec2"), F.col("_exec1") == F.col("_exec2"), "full")
    return both.select(F.coalesce("_exec1", "_exec2").alias("node_id"), *[f"{t}_{f}" for t in ("exec1", "exec2") for f in figures], *[(F.col(f"exec2_{f}") - F.col(f"exec1_{f}")).alias(f"{f}_diff") for f in figures])


def rollup(metrics: DataFrame) -> DataFrame:
    """Per run: total duration and rows, mean throughput, peak memory."""
    return metrics.groupBy("execution_id").agg(F.sum("duration_ms").alias("total_duration"), F.sum("output_rows").alias("total_rows"), F.avg("throughput").alias("avg_throughput"), F.max("memory_peak_bytes").alias("peak_memory"))


def node_shares(metrics: DataFrame) -> DataFrame:
    """Each node's part of its run's duration in percent, and its duration as a part of the longest node's."""
    per = metrics.groupBy("execution_id").agg(F.sum("duration_ms").alias("_sum"), F.max("duration_ms").alias("_max"))
    out = metrics.join(per, "execution_id")
    return out.select("execution_id", "node_id", "duration_ms", F.round(F.col("duration_ms") / F.nullif("_sum", F.lit(0)) * 100, 2).alias("share_pct"), F.round(F.col("duration_ms") / F.nullif("_max", F.lit(0)) * 100, 2).alias("bar_pct"))
