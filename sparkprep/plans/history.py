"""Run manifest: one row per state change, read back as history and status counts."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

STATUSES = ["pending", "processing", "completed", "failed", "cancelled"]
MANIFEST_SCHEMA = (
    "run_id string, status string, created_at timestamp, updated_at timestamp, message string, "
    "counters map<string,string>"
)


def append_manifest(
    spark: SparkSession,
    path: str,
    run_id: str,
    status: str,
    created_at: datetime,
    counters: Mapping[str, Any] | None = None,
    message: str | None = None,
) -> None:
    if status not in STATUSES:
        raise ValueError(f"unknown status '{status}'")
    values = {k: str(v) for k, v in counters.items()} if counters else None
    row = (run_id, status, created_at, datetime.now(timezone.utc), message, values)
    spark.createDataFrame([row], MANIFEST_SCHEMA).write.mode("append").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).parquet(path)


def run_history(manifest: DataFrame) -> DataFrame:
    """The latest state of every run, newest first."""
    rest = [c for c in manifest.columns if c not in ("run_id", "updated_at")]
    latest = manifest.groupBy("run_id").agg(
        F.max("updated_at").alias("updated_at"), *[F.max_by(c, "updated_at").alias(c) for c in rest]
    )
    return latest.select(*manifest.columns).orderBy(F.col("created_at").desc())


def run_status_counts(manifest: DataFrame) -> DataFrame:
    """Runs per status, with all five statuses present, and the total."""
    latest = manifest.groupBy("run_id").agg(F.max_by("status", "updated_at").alias("status"))
    counts = latest.groupBy("status").agg(F.count(F.lit(1)).alias("runs"))
    every = manifest.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    per_status = every.join(counts, "status", "left").select("status", F.coalesce("runs", F.lit(0)).alias("runs"))
    total = latest.agg(F.lit("total").alias("status"), F.count(F.lit(1)).alias("runs"))
    return per_status.unionByName(total)
