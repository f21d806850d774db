"""Retention, refresh and cascading deletes. Every operator returns the new
table; the caller writes it to a new place."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlake.operators.traffic import protocol_distribution

STAGING_DAYS = 14
RUN_DAYS = 30


def _older_than(now: Column, days: int) -> Column:
    return F.col("finished_at") < now - F.expr(f"INTERVAL {days} DAYS")


def expired_staging_runs(runs: DataFrame, now: Column, days: int = STAGING_DAYS) -> DataFrame:
    """run_id of successful runs that finished long ago."""
    return runs.filter((F.col("status") == "success") & _older_than(now, days)).select("run_id")


def expired_runs(runs: DataFrame, now: Column, days: int = RUN_DAYS) -> DataFrame:
    """run_id of runs that finished long ago, with any status."""
    return runs.filter(F.coalesce(_older_than(now, days), F.lit(False))).select("run_id")


def expire_staging(staging: DataFrame, runs: DataFrame, now: Column,
                   days: int = STAGING_DAYS) -> DataFrame:
    """Staged rows without those of successful runs finished long ago."""
    return staging.join(expired_staging_runs(runs, now, days), "run_id", "left_anti")


def expire_runs(runs: DataFrame, staging: DataFrame, now: Column,
                days: int = RUN_DAYS) -> tuple[DataFrame, DataFrame]:
    """(runs, staging) without runs finished long ago and their staged rows."""
    old = F.coalesce(_older_than(now, days), F.lit(False))
    dropped = runs.filter(old).select("run_id")
    return runs.filter(~old), staging.join(dropped, "run_id", "left_anti")


def refresh_protocol_distribution(packets: DataFrame, path: str, refreshed_at: Column) -> DataFrame:
    """Recompute the stored protocol summary and read it back."""
    protocol_distribution(packets, refreshed_at).write.mode("overwrite").parquet(path)
    return packets.sparkSession.read.parquet(path)


class CascadeResult(NamedTuple):
    sessions: DataFrame
    packets: DataFrame
    features: DataFrame
    predictions: DataFrame
    alerts: DataFrame


def cascade_delete_sessions(
    session_ids: DataFrame, sessions: DataFrame, packets: DataFrame,
    features: DataFrame, predictions: DataFrame, alerts: DataFrame,
) -> CascadeResult:
    """Delete sessions with their features, predictions and alerts; their
    packets stay, unlinked."""
    gone = session_ids.select("session_id").distinct()
    keep = lambda df: df.join(gone, "session_id", "left_anti")
    # Packets without a session get keys of their own, so that they spread
    # over all tasks instead of meeting under null.
    key = F.coalesce(F.col("session_id"), -1 - F.col("packet_id"))
    unlinked = packets.withColumn("_key", key).join(
        gone.select(F.col("session_id").alias("_key"), F.lit(True).alias("_gone")),
        "_key", "left",
    ).withColumn(
        "session_id", F.when(F.col("_gone").isNull(), F.col("session_id"))
    ).select(*packets.columns)
    return CascadeResult(
        keep(sessions), unlinked, keep(features), keep(predictions), keep(alerts)
    )
