"""Column lineage: which input columns each output column comes from, and through which steps; graphs and traces over it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..staging import staged
from . import sql_lineage
from .spec import Node, Pipeline, reachable

SCHEMA = "pipeline_id string, execution_id string, source_table string, source_column string, target_table string, target_column string, transform_path array<struct<type:string,node:string,detail:string>>"


@dataclass(frozen=True)
class Origin:
    """A column of a source and the steps it took since."""

    table: str
    column: str
    path: tuple[tuple[str, str, str], ...] = ()

    def then(self, kind: str, node: str, detail: str = "") -> Origin:
        return Origin(self.table, self.column, (*self.path, (kind, node, detail)))


Columns = dict[str, frozenset[Origin]]


def table_name(node: Node) -> str:
    """What a source or sink is called in lineage."""
    c = next((node.config[k] for k in ("source_config", "output_config", "target_config", "config") if node.config.get(k)), node.config)
    return str(c.get("table_name") or c.get("file_path") or c.get("filename") or c.get("path") or c.get("url") or node.label)


def _union(*sets: frozenset[Origin]) -> frozenset[Origin]:
    return frozenset().union(*sets)


def _stepped(cols: Columns, kind: str, node: str, detail: str = "") -> Columns:
    return {c: frozenset(o.then(kind, node, detail) for o in os) for c, os in cols.items()}


def through(node: Node, inputs: list[Columns], outputs: list[str]) -> Columns:
    """Origins of a node's output columns from those of its inputs."""
    cols, config = inputs[0] if inputs else {}, node.config
    if node.type == "map":
        for op in config.get("operations") or []:
            kind = op.get("type")
            if kind == "rename" and op["old_name"] in cols:
                cols = {op["new_name"] if c == op["old_name"] else c: frozenset(o.then(kind, node.id, op["new_name"]) for o in os) if c == op["old_name"] else os for c, os in cols.items()}
            elif kind == "type_convert" and op["column"] in cols:
                cols = cols | {op["column"]: frozenset(o.then(kind, node.id, op["target_type"]) for o in cols[op["column"]])}
            elif kind == "compute":
                used = [c for c in expr.columns_used(op["expression"]) if c in cols]
                cols = cols | {op["new_column"]: frozenset(o.then(kind, node.id, op["expression"]) for o in _union(*[cols[c] for c in used]))}
        return {c: cols.get(c, frozenset()) for c in outputs}
    if node.type == "join":
        left, right = inputs[0], inputs[1] if len(inputs) > 1 else {}
        out: Columns = {}
        for c in outputs:
            if c.endswith("_left") and c[:-5] in left and c not in left:
                found = left[c[:-5]]
            elif c.endswith("_right") and c[:-6] in right and c not in right:
                found = right[c[:-6]]
            else:
                found = _union(left.get(c, frozenset()), right.get(c, frozenset()))
            out[c] = found
        return _stepped(out, "join", node.id, config.get("join_type") or "inner")
    if node.type == "aggregate" and config.get("group_by") and config.get("aggregations"):
        at = lambda name: cols.get(name) or cols.get(f"{name}_left") or frozenset()
        out = {k: frozenset(o.then("group_by", node.id, k) for o in at(k)) for k in config["group_by"]}
        for a in config["aggregations"]:
            name = a.get("alias") or f"{a['column']}_{a['function']}"
            out[name] = frozenset(o.then("aggregate", node.id, a["function"]) for o in at(a["column"]))
        return out
    if node.type in ("filter", "sort", "deduplicate", "branch"):
        return _stepped({c: cols.get(c, frozenset()) for c in outputs}, node.type, node.id, str(config.get("condition") or ""))
    return {c: cols.get(c, frozenset()) for c in outputs}


@dataclass
class Tracker:
    """Follows columns through a plan as it is folded; records() says what reached the sinks."""

    pipeline_id: str = ""
    execution_id: str = ""
    at: dict[str, Columns] = field(default_factory=dict)
    rows: list[tuple] = field(default_factory=list)

    def source(self, node: Node, columns: list[str], df: DataFrame | None = None) -> None:
        """`df`: the frame of a source that is a query over Spark's tables, whose columns are followed to theirs."""
        found = sql_lineage.column_origins(df) if df is not None and (node.config.get("source_type") or node.config.get("type")) == "sql" else {}
        of = lambda c: frozenset(Origin(t or table_name(node), x, (("sql", node.id, c),)) for t, x in found[c]) if found.get(c) else frozenset([Origin(table_name(node), c)])
        self.at[node.id] = {c: of(c) for c in columns}

    def transform(self, node: Node, pipeline: Pipeline, columns: list[str]) -> None:
        self.at[node.id] = through(node, [self.at.get(e.source, {}) for e in pipeline.inputs(node.id)], columns)

    def output(self, node: Node, pipeline: Pipeline) -> None:
        cols = self.at.get(pipeline.inputs(node.id)[0].source, {})
        for name, origins in cols.items():
            for o in sorted(origins, key=lambda o: (o.table, o.column, o.path)):
                self.rows.append((self.pipeline_id, self.execution_id, o.table, o.column, table_name(node), name, list(o.path)))

    def records(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SCHEMA)


def sankey(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links). A column is one node whether it is a source or a target, so that chains of pipelines join up; a link's
    value is how many paths use it."""
    a, b = F.concat_ws(".", "source_table", "source_column"), F.concat_ws(".", "target_table", "target_column")
    steps = F.transform("transform_path", lambda s: F.concat_ws(":", F.lit("step"), s["node"], s["type"]))
    chain = records.select(F.concat(F.array(a), steps, F.array(b)).alias("chain"))
    links = chain.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("chain") - 1), lambda i: F.struct(F.get("chain", i - 1).alias("source"), F.get("chain", i).alias("target")))).alias("l")).groupBy("l.source", "l.target").agg(F.count(F.lit(1)).alias("value"))
    nodes = links.select("source").union(links.select("target")).distinct().withColumnRenamed("source", "name")
    return nodes, links


def trace_back(records: DataFrame, table: str, column: str) -> DataFrame:
    """(source_table, source_column, depth, is_root): all columns that a target column comes from, over any number of pipelines
    and steps, each once at its least depth. roots: no origin.

    A search by breadth: each round joins the columns found last with the records; only columns not seen before go on. All of it
    stays in tables, so that neither a level nor the answer has to fit the driver.
    """
    spark, key = records.sparkSession, ["t", "c"]
    edges = staged(records.select(F.col("source_table").alias("t"), F.col("source_column").alias("c"), F.col("target_table").alias("to_t"), F.col("target_column").alias("to_c")).distinct(), "edges")
    last = spark.createDataFrame([(table, column)], "t string, c string")
    seen, depth = last.withColumn("depth", F.lit(0)), 0
    while True:
        depth += 1
        at = last.select(F.col("t").alias("to_t"), F.col("c").alias("to_c"))
        found = edges.join(at, ["to_t", "to_c"]).select(*key).distinct().join(seen.select(*key), key, "left_anti")
        last = staged(found.withColumn("depth", F.lit(depth)), "found")
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    reached = edges.select(F.col("to_t").alias("t"), F.col("to_c").alias("c"), F.lit(False).alias("leaf")).distinct()
    out = seen.where("depth > 0").join(reached, key, "left")
    return out.select(F.col("t").alias("source_table"), F.col("c").alias("source_column"), "depth", F.coalesce("leaf", F.lit(True)).alias("is_root"))


def highlight(links: list[tuple[str, str]], node: str) -> set[str]:
    """All nodes on a way to or from `node`, and itself."""
    return {node} | reachable([node], links) | reachable([node], links, backward=True)
