"""Data-quality rules: each is one predicate that says which rows violate it, used for counting, marking and splitting alike."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..naming import fresh
from .relational import ConfigError, col

SAMPLES = 20
#: Columns that marking adds. Fixed names.
MARKS = {"is_dirty": "boolean", "violation_reason": "string"}
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


class QualityAbort(RuntimeError):
    """A rule with the abort strategy was violated."""


@dataclass
class Rule:
    rule_type: str
    rule_config: dict
    failure_strategy: str = "mark"
    id: int | None = None
    is_enabled: bool = True


@dataclass
class Report:
    """What one rule found. pass_rate is in percent."""

    rule_type: str
    total: int
    failed: int
    samples: list[dict] = field(default_factory=list)
    rule_id: int | None = None

    @property
    def passed_rows(self) -> int:
        return self.total - self.failed

    @property
    def pass_rate(self) -> float:
        return round(self.passed_rows / self.total * 100, 2) if self.total else 100.0

    @property
    def passed(self) -> bool:
        return self.failed == 0


def java_pattern(pattern: str) -> str:
    """A Python pattern for Java's matcher, anchored at the start alone as re.match is, with Unicode classes."""
    out = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", out)
    return f"(?U)^(?:{out})"


def _fields(config: dict) -> list[str]:
    fields = config.get("fields") or config.get("field") or []
    return [fields] if isinstance(fields, str) else list(fields)


def violation(rule: Rule, copies: str = "_copies") -> Column:
    """Whether a row violates the rule: never null. For non_null_rate these are the missing rows; the rate decides whether
    they count. For uniqueness the predicate needs the column `copies`, which prepared() adds."""
    c = rule.rule_config
    if rule.rule_type == "non_null_rate":
        return col(c["field"]).isNull()
    if rule.rule_type == "uniqueness":
        return col(copies) > 1
    if rule.rule_type == "range_check":
        text = col(c["field"]).cast("string")
        x = F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))
        bad = x.isNull()
        if c.get("min_value") is not None:
            bad = bad | (x < float(c["min_value"]))
        if c.get("max_value") is not None:
            bad = bad | (x > float(c["max_value"]))
        return F.coalesce(bad, F.lit(True))
    if rule.rule_type == "regex_match":
        return ~F.coalesce(col(c["field"]).cast("string"), F.lit("nan")).rlike(java_pattern(c["pattern"]))
    raise ConfigError(f"unknown rule type {rule.rule_type!r}")


def prepared(df: DataFrame, rule: Rule, copies: str) -> DataFrame:
    """`df` with what the rule's predicate needs: for uniqueness the number of rows alike in its fields, as `copies`.

    That count is a grouped one, joined back null-safely, so that a value which most rows share is no single task's work.
    """
    if rule.rule_type != "uniqueness":
        return df
    fields = _fields(rule.rule_config)
    names = [fresh(f"_u{i}", df) for i in range(len(fields))]
    counts = df.groupBy(*[col(f).alias(u) for f, u in zip(fields, names, strict=True)]).agg(F.count(F.lit(1)).alias(copies))
    on = F.lit(True)
    for f, u in zip(fields, names, strict=True):
        on = on & col(f).eqNullSafe(col(u))
    return df.join(counts, on).drop(*names)


def evaluate(df: DataFrame, rule: Rule, samples: int = SAMPLES) -> Report:
    """Counts in one pass; violating rows are fetched only if there are any, `samples` of them."""
    return evaluate_all(df, [rule], samples)[0]


def evaluate_all(df: DataFrame, rules: list[Rule], samples: int = SAMPLES) -> list[Report]:
    """A report for each rule, all on the same rows: one pass counts for all of them. If any is violated a second action
    fetches `samples` rows of each that is; each shows the marks of the rules before it."""
    ready, bads = df, []
    for rule in rules:
        copies = fresh("_copies", ready)
        ready = prepared(ready, rule, copies)
        bads.append(violation(rule, copies))
    got = ready.agg(F.count(F.lit(1)).alias("total"), *[F.coalesce(F.sum(b.cast("long")), F.lit(0)).alias(f"f{i}") for i, b in enumerate(bads)]).first()
    reports = [Report(r.rule_type, got.total, _counted(r, got.total, got[f"f{i}"]), rule_id=r.id) for i, r in enumerate(rules)]
    parts = []
    for i, (rule, bad, report) in enumerate(zip(rules, bads, reports, strict=True)):
        if report.failed and samples:
            marks = [F.col(c) if c in ready.columns else F.lit(None).cast(t).alias(c) for c, t in MARKS.items()]
            parts.append(ready.filter(bad).limit(samples).select(F.lit(i).alias("rule"), F.struct(*[col(c) for c in df.columns]).alias("row"), F.struct(*marks).alias("marks")))
        if i + 1 < len(rules):
            ready = _marked(ready, rule, bad if report.failed else F.lit(False))
    if parts:
        for r in reduce(DataFrame.unionByName, parts).collect():
            marks = r.marks.asDict() if r.rule or MARKS.keys() <= set(df.columns) else {}
            reports[r.rule].samples.append(r.row.asDict(recursive=True) | marks)
    return reports


def _counted(rule: Rule, total: int, missing: int) -> int:
    if rule.rule_type == "non_null_rate":
        allowed = float(rule.rule_config.get("max_null_percent", 0))
        return missing if total and missing / total * 100 > allowed else 0
    return missing


def report_frame(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule (rule_type, total, failed, pass_rate), lazily. Rules on single rows share one pass."""
    cols = ["rule", "rule_type", "total", "failed", "pass_rate"]
    rowwise = [(i, r) for i, r in enumerate(rules) if r.rule_type != "uniqueness"]
    out = None
    if rowwise:
        got = df.agg(F.count(F.lit(1)).alias("total"), *[F.coalesce(F.sum(violation(r).cast("long")), F.lit(0)).alias(f"f{i}") for i, r in rowwise])
        out = got.select("total", F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r.rule_type).alias("rule_type"), _lazy_count(r, F.col("total"), F.col(f"f{i}")).alias("failed")) for i, r in rowwise])).alias("x")).select("x.rule", "x.rule_type", "total", "x.failed")
    for i, r in enumerate(rules):
        if r.rule_type == "uniqueness":
            sizes = df.groupBy(*[col(f) for f in _fields(r.rule_config)]).count()
            one = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("failed"))
            one = one.select(F.lit(i).alias("rule"), F.lit(r.rule_type).alias("rule_type"), "total", "failed")
            out = one if out is None else out.unionByName(one)
    rate = F.when(F.col("total") == 0, 100.0).otherwise(F.round((F.col("total") - F.col("failed")) / F.col("total") * 100, 2))
    return out.withColumn("pass_rate", rate).select(*cols)


def _lazy_count(rule: Rule, total: Column, missing: Column) -> Column:
    if rule.rule_type != "non_null_rate":
        return missing
    return F.when((total > 0) & (missing / total * 100 > float(rule.rule_config.get("max_null_percent", 0))), missing).otherwise(F.lit(0).cast("long"))


def reason(rule: Rule) -> str:
    return f"{rule.rule_type}: {rule.rule_config}"


def _marked(df: DataFrame, rule: Rule, bad: Column) -> DataFrame:
    dirty = F.col("is_dirty") if "is_dirty" in df.columns else F.lit(False)
    said = F.col("violation_reason") if "violation_reason" in df.columns else F.lit("")
    more = F.when(said == "", F.lit(reason(rule))).otherwise(F.concat(said, F.lit("; "), F.lit(reason(rule))))
    return df.withColumns({"is_dirty": bad | dirty, "violation_reason": F.when(bad, more).otherwise(said)})


def mark(df: DataFrame, rule: Rule, counts: bool = True) -> DataFrame:
    """Adds is_dirty and violation_reason, or adds to them. `counts` False: the rule holds as a whole, nothing is marked."""
    copies = fresh("_copies", df)
    if not counts:
        return _marked(df, rule, F.lit(False))
    return _marked(prepared(df, rule, copies), rule, violation(rule, copies)).drop(copies)


def split(df: DataFrame, rule: Rule, counts: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that violate)."""
    copies = fresh("_copies", df)
    ready = prepared(df, rule, copies) if counts else df
    bad = violation(rule, copies) if counts else F.lit(False)
    return ready.filter(~bad).drop(copies), ready.filter(bad).drop(copies)


def quarantine_rows(df: DataFrame, rule: Rule) -> DataFrame:
    """Violating rows as (rule_type, record_data JSON, violation_reason)."""
    _, bad = split(df, rule)
    return bad.select(F.lit(rule.rule_type).alias("rule_type"), F.to_json(F.struct(*[col(c) for c in df.columns])).alias("record_data"), F.lit(reason(rule)).alias("violation_reason"))


def apply(df: DataFrame, rules: list[Rule], quarantine=None) -> tuple[DataFrame, list[Report]]:  # noqa: ANN001
    """Enabled rules in order, each on what the one before left. Returns the rows that go on and the reports.

    Mark rules leave all rows, so those in a row, and the rule after them, are counted in one pass.
    `quarantine(rule, rows)` stores the rows a quarantine rule takes out. An abort rule raises QualityAbort, with the
    reports so far in its `reports`, once its own is made.
    """
    reports: list[Report] = []
    for rule in rules:
        if rule.is_enabled and rule.failure_strategy not in ("mark", "quarantine", "abort"):
            raise ConfigError(f"unknown failure strategy {rule.failure_strategy!r}")
    for run in _runs([r for r in rules if r.is_enabled]):
        for rule, report in zip(run, evaluate_all(df, run), strict=True):
            reports.append(report)
            if rule.failure_strategy == "mark":
                df = mark(df, rule, counts=not report.passed)
            elif report.passed:
                continue
            elif rule.failure_strategy == "quarantine":
                df, bad = split(df, rule)
                if quarantine is not None:
                    quarantine(rule, bad)
            else:
                stop = QualityAbort(f"{report.failed} of {report.total} rows violate {reason(rule)}")
                stop.reports = reports
                raise stop
    return df, reports


def _runs(rules: list[Rule]) -> list[list[Rule]]:
    """Rules that see the same rows: any number of mark rules and the one after them. A rule on the marks themselves begins anew."""
    out: list[list[Rule]] = []
    for rule in rules:
        if not out or out[-1][-1].failure_strategy != "mark" or MARKS.keys() & set(_fields(rule.rule_config)):
            out.append([])
        out[-1].append(rule)
    return out
