"""Filtered, paged listings and detail lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlake.functions.columns import seconds_between
from packetlake.schemas import FEATURE_COLS

MAX_LIMIT = 1000
DEFAULT_LIMIT = 100


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """``limit`` rows from ``offset`` in the given order."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    if offset < 0:
        raise ValueError("offset must be 0 or greater")
    return df.orderBy(*order).offset(offset).limit(limit)


def _equal(df: DataFrame, **wanted: object) -> DataFrame:
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def _flow_filters(df: DataFrame, src_ip, dst_ip, protocol) -> DataFrame:
    protocol = protocol.upper() if protocol is not None else None
    return _equal(df, src_ip=src_ip, dst_ip=dst_ip, protocol=protocol)


def list_packets(
    packets: DataFrame, src_ip: str | None = None, dst_ip: str | None = None,
    protocol: str | None = None, limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> DataFrame:
    """Packets, newest first."""
    rows = _flow_filters(packets, src_ip, dst_ip, protocol)
    return page(rows, [F.desc("captured_at"), F.desc("packet_id")], limit, offset)


def list_sessions(
    sessions: DataFrame, src_ip: str | None = None, dst_ip: str | None = None,
    protocol: str | None = None, limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> DataFrame:
    """Sessions, latest start first."""
    rows = _flow_filters(sessions, src_ip, dst_ip, protocol)
    return page(rows, [F.desc("started_at"), F.desc("session_id")], limit, offset)


def list_alerts(
    alerts: DataFrame, status: str | None = None, min_severity: int | None = None,
    limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> DataFrame:
    """Alerts, newest first."""
    rows = _equal(alerts, status=status)
    if min_severity is not None:
        rows = rows.filter(F.col("severity") >= min_severity)
    return page(rows, [F.desc("triggered_at"), F.desc("alert_id")], limit, offset)


def list_predictions(
    predictions: DataFrame, labels: DataFrame, session_id: int | None = None,
    model_version: str | None = None, label: str | None = None,
    limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> DataFrame:
    """Predictions with their label code, newest first."""
    codes = labels.select("label_id", F.col("label_code").alias("predicted_label"))
    rows = predictions.join(
        F.broadcast(codes), F.col("predicted_label_id") == F.col("label_id"), "left"
    ).drop("label_id")
    label = label.upper() if label is not None else None
    rows = _equal(rows, session_id=session_id, model_version=model_version, predicted_label=label)
    return page(rows, [F.desc("created_at"), F.desc("prediction_id")], limit, offset)


def list_ingestion_runs(
    runs: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0
) -> DataFrame:
    """Audit rows, latest first, with their duration in seconds."""
    duration = F.round(seconds_between(F.col("started_at"), F.col("finished_at")), 2)
    return page(
        runs.withColumn("duration_sec", duration),
        [F.desc("started_at"), F.desc("run_id")], limit, offset,
    )


def packet_count(packets: DataFrame) -> DataFrame:
    return packets.agg(F.count("*").alias("count"))


def alert_detail(
    alerts: DataFrame, sessions: DataFrame, predictions: DataFrame, labels: DataFrame,
    alert_ids: DataFrame | None = None,
) -> DataFrame:
    """Alerts with nested session and prediction details, null where absent."""
    if alert_ids is not None:
        alerts = alerts.join(alert_ids.select("alert_id"), "alert_id", "left_semi")
    session_details = sessions.select(
        "session_id",
        F.struct("src_ip", "dst_ip", "src_port", "dst_port", "protocol").alias("session_details"),
    )
    codes = labels.select("label_id", F.col("label_code").alias("predicted_label"))
    prediction_details = predictions.join(
        F.broadcast(codes), F.col("predicted_label_id") == F.col("label_id"), "left"
    ).select(
        "prediction_id",
        F.struct(
            F.col("confidence").cast("double").alias("confidence"),
            "model_version", "predicted_label",
        ).alias("prediction_details"),
    )
    return alerts.join(session_details, "session_id", "left").join(
        prediction_details, "prediction_id", "left"
    )


def alerts_since(alerts: DataFrame, last_alert_id: int = -1) -> DataFrame:
    """Alerts after an id, oldest first."""
    return (
        alerts.filter(F.col("alert_id") > last_alert_id)
        .select("alert_id", "alert_type", "severity", "description")
        .orderBy("alert_id")
    )


def session_features_for(features: DataFrame, session_ids: DataFrame) -> DataFrame:
    """The feature vectors of the given sessions."""
    return features.join(session_ids.select("session_id"), "session_id", "left_semi").select(
        "session_id", *FEATURE_COLS
    )
