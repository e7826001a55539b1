"""Metadata of runs: records appended to one Parquet folder for each kind, and small editable entities in JSON files."""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is recorded, by kind. Fixed values.
RECORDS = {
    "executions": "id string, pipeline_id string, status string, start_time double, end_time double, total_rows long, success_rows long, error_log string, node_states string, created_at double",
    "quality_reports": "id string, execution_id string, pipeline_id string, node_id string, rule_id long, rule_type string, total_rows long, passed_rows long, failed_rows long, pass_rate double, violation_samples string, created_at double",
    "quarantine_records": "execution_id string, node_id string, rule_id long, record_data string, violation_reason string, created_at double",
    "performance_metrics": "execution_id string, node_id string, start_time double, end_time double, duration_ms double, input_rows long, output_rows long, throughput double, memory_peak_bytes long, created_at double",
    "lineage_records": "pipeline_id string, execution_id string, source_table string, source_column string, target_table string, target_column string, transform_path array<struct<type:string,node:string,detail:string>>",
    "change_logs": "id long, table_name string, operation_type string, record_id string, record_data string, before_data string",
    "workflow_executions": "id string, workflow_id string, status string, start_time double, end_time double, node_states string, error_log string, created_at double",
}


class NotFoundError(KeyError):
    """No such entity."""


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def append(self, kind: str, rows: list[tuple] | DataFrame) -> None:
        if isinstance(rows, list):
            if not rows:
                return
            rows = self.spark.createDataFrame(rows, RECORDS[kind]).coalesce(1)
        rows.write.mode("append").parquet(f"{self.folder}/{kind}")

    def records(self, kind: str) -> DataFrame:
        path = f"{self.folder}/{kind}"
        try:
            return self.spark.read.schema(RECORDS[kind]).parquet(path)
        except Exception as e:  # Spark's class differs between classic and Connect sessions
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], RECORDS[kind])

    def page(self, kind: str, skip: int = 0, limit: int = 100, order: str = "created_at", **match: object) -> DataFrame:
        """Records with these values, newest first, a page at a time."""
        rows = self.records(kind)
        for name, value in match.items():
            if value is not None:
                rows = rows.filter(F.col(name) == F.lit(value))
        return rows.orderBy(F.col(order).desc()).offset(skip).limit(limit)

    # entities: pipelines, rules, workflows, data sources, dependencies

    def _path(self, kind: str) -> str:
        return os.path.join(self.folder, f"{kind}.json")

    def entities(self, kind: str) -> dict[str, dict]:
        if not os.path.exists(self._path(kind)):
            return {}
        with open(self._path(kind)) as f:
            return json.load(f)

    def _save(self, kind: str, found: dict) -> None:
        os.makedirs(self.folder, exist_ok=True)
        with open(f"{self._path(kind)}.new", "w") as f:
            json.dump(found, f)
        os.replace(f"{self._path(kind)}.new", self._path(kind))

    def get(self, kind: str, key: object) -> dict:
        found = self.entities(kind)
        if str(key) not in found:
            raise NotFoundError(f"{kind}: {key}")
        return found[str(key)]

    def create(self, kind: str, value: dict) -> dict:
        found = self.entities(kind)
        key = str(max([int(k) for k in found if k.isdigit()], default=0) + 1)
        found[key] = value | {"id": int(key), "created_at": time.time(), "updated_at": time.time()}
        self._save(kind, found)
        return found[key]

    def update(self, kind: str, key: object, value: dict) -> dict:
        found = self.entities(kind)
        if str(key) not in found:
            raise NotFoundError(f"{kind}: {key}")
        found[str(key)] |= {k: v for k, v in value.items() if v is not None} | {"updated_at": time.time()}
        self._save(kind, found)
        return found[str(key)]

    def delete(self, kind: str, key: object) -> None:
        found = self.entities(kind)
        if found.pop(str(key), None) is None:
            raise NotFoundError(f"{kind}: {key}")
        self._save(kind, found)


def new_id() -> str:
    return uuid.uuid4().hex
