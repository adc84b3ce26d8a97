"""Runs as an append-only table: one row per status change, the latest counts."""

from __future__ import annotations

import datetime
import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "run_id string, status string, at timestamp, fingerprint string, parameters string, number_of_episodes bigint, "
    "number_of_train_eligible_episodes bigint, number_of_sequences bigint, mapping_version string, warnings array<string>, error string"
)


def parameters_text(parameters: dict) -> str:
    return json.dumps(parameters, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def fingerprint(parameters: dict) -> str:
    """SHA-256 of the parameters as JSON with sorted keys."""
    return hashlib.sha256(parameters_text(parameters).encode("utf-8")).hexdigest()


def new_run_id() -> str:
    return f"{datetime.datetime.now(datetime.timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"


def append_status(spark: SparkSession, path: str, run_id: str, status: str, parameters: dict, counts: dict | None = None,
                  warnings: list[str] | None = None, error: str | None = None) -> None:
    counts = counts or {}
    row = (
        run_id, status, datetime.datetime.now(datetime.timezone.utc), fingerprint(parameters), parameters_text(parameters),
        counts.get("rows_total"), counts.get("rows_train_eligible"), counts.get("n_sequences"), counts.get("mapping_version"),
        warnings or [], error,
    )
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last status of each run."""
    runs = spark.read.schema(SCHEMA).parquet(path)
    last = runs.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in runs.columns if c != "run_id"]), "at").alias("r"))
    return last.select("run_id", "r.*")
