"""Live detections in the main tables, and scoring of chosen sessions.

Each micro-batch is one commit of the sessions, one of the predictions and one
of the alerts, whose notes name the batch. A table that has a batch's commit
takes it no second time, so a job that ended between two of them goes on with
the next one after a restart: ids stay dense and rows single. Notes of batches
count downwards from -1, those of ingestion runs upwards.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packetlake.functions.ordered import hashed_row_number
from packetlake.operators import alerts as alert_ops
from packetlake.operators import models as model_ops
from packetlake.operators import sessions as session_ops
from packetlake.operators.labels import label_ids
from packetlake.plans import batch
from packetlake.plans.warehouse import Warehouse
from packetlake.schemas import (
    ALERTS_SCHEMA,
    BENIGN,
    FEATURE_COLS,
    PREDICTIONS_SCHEMA,
    SESSIONS_SCHEMA,
    attack_labels,
)
from packetlake.session import store_stage
from packetlake.streaming.detect import score_closed
from packetlake.streaming.sessions import closed_sessions


class Model(Protocol):
    version: str

    def score(self, features: DataFrame) -> DataFrame:
        """``features`` with predicted_label, confidence, anomaly_score, is_anomaly."""


def note_of(batch_id: int) -> int:
    return -1 - batch_id


def _taken(house: Warehouse, table: str, batch_id: int) -> bool:
    """Batches come in order, so one as new as this one means it is in."""
    return any(run <= note_of(batch_id) for run in house.keyed(table).all_runs() if run < 0)


def record_batch(
    house: Warehouse, closed: DataFrame, model: Model, now: Column, batch_id: int,
    direction: str = "canonical",
) -> None:
    """Sessions, predictions and alerts of the detected sessions of one batch."""
    labels, note = attack_labels(house.spark), [note_of(batch_id)]
    closed = store_stage(closed, "closed")
    scored = store_stage(score_closed(closed, model, direction), "scored")
    found = scored.filter((F.col("predicted_label") != BENIGN) | F.col("is_anomaly"))
    if not _taken(house, "sessions", batch_id):
        new = closed_sessions(closed).join(found.select("flow_hash"), "flow_hash", "left_semi")
        changed = session_ops.upsert_sessions(
            house.matching("sessions", new, SESSIONS_SCHEMA), new, house.keyed("sessions").last_id
        )
        batch.merge_changed(house, "sessions", batch.SESSION_KEY, changed, "session_id", note)
    ids = house.matching("sessions", found, SESSIONS_SCHEMA).select("flow_hash", "session_id")
    named = store_stage(found.join(ids, "flow_hash"), "named")
    if not _taken(house, "predictions", batch_id):
        record = F.to_json(F.struct("anomaly_score", "is_anomaly"))
        upsert(house, label_ids(
            named.withColumn("features", record), labels, "predicted_label"
        ).select(
            "session_id", F.col("label_id").alias("predicted_label_id"),
            F.col("confidence").cast("decimal(6,5)").alias("confidence"),
            F.lit(model.version).alias("model_version"), "features", now.alias("created_at"),
        ), note)
    if not _taken(house, "alerts", batch_id):
        predictions = house.matching(
            "predictions", named.withColumn("model_version", F.lit(model.version)), PREDICTIONS_SCHEMA
        ).select("session_id", "prediction_id")
        due = alert_ops.alerts_from_stream(named.join(predictions, "session_id"), now)
        numbered = (
            hashed_row_number(due, [], F.md5(F.col("prediction_id").cast("string")), "_rank")
            .withColumn("alert_id", (F.col("_rank") + house.keyed("alerts").last_id).cast("bigint"))
            .withColumn("acknowledged_at", F.lit(None).cast("timestamp"))
            .withColumn("metadata", F.lit(None).cast("string"))
            .select(*ALERTS_SCHEMA.fieldNames())
        )
        batch.merge_changed(house, "alerts", batch.ALERT_KEY, numbered, "alert_id", note)


def upsert(house: Warehouse, rows: DataFrame, runs: list[int] | None = None) -> DataFrame:
    """Store predictions under their ids; known pairs of session and version keep theirs."""
    changed = model_ops.number_predictions(
        model_ops.upsert_predictions(house.matching("predictions", rows, PREDICTIONS_SCHEMA), rows),
        house.keyed("predictions").last_id,
    )
    return batch.merge_changed(house, "predictions", batch.PREDICTION_KEY, changed, "prediction_id", runs)


def start_detection(
    closed_stream: DataFrame, model: Model, house: Warehouse, checkpoint: str,
    direction: str = "canonical", **trigger,
) -> StreamingQuery:
    """Run the detection job on a stream of ``online_sessions``."""

    def handle(closed: DataFrame, batch_id: int) -> None:
        record_batch(house, closed, model, F.current_timestamp(), batch_id, direction)

    return (
        closed_stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"})).start()
    )


def score_or_rules(house: Warehouse, model: Model, session_ids: DataFrame, now: Column) -> DataFrame:
    """Predictions of chosen sessions, also of ones that have some: by the model
    where there are features, else by the rules. Stores them, raises the alerts
    that are due and returns the rows."""
    labels = attack_labels(house.spark)
    wanted = session_ids.select(F.col("session_id").cast("bigint").alias("session_id")).distinct()
    sessions = house.read("sessions", SESSIONS_SCHEMA).join(wanted, "session_id", "left_semi")
    features = house.matching("session_features", wanted, batch.FEATURES_SCHEMA)
    by_model = model_ops.prediction_rows(
        model.score(features.select("session_id", *FEATURE_COLS)), labels, model.version, now
    )
    by_rules = label_ids(
        model_ops.rules_score(sessions, features), labels, "predicted_label"
    ).select(
        "session_id", F.col("label_id").alias("predicted_label_id"),
        F.col("confidence").cast("decimal(6,5)").alias("confidence"), "model_version", "features",
        now.alias("created_at"),
    )
    rows = store_stage(by_model.unionByName(by_rules), "chosen-predictions")
    upsert(house, rows)
    batch.raise_alerts(house)
    return house.matching("predictions", rows, PREDICTIONS_SCHEMA)
