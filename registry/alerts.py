"""Alert and retention queries."""

from pyspark.sql import functions as F

from packetlake.operators import alerts as A
from packetlake.operators import retention as R
from packetlake.session import shared_folder
from registry.base import query, with_tables

NOW = "2024-02-01"


def now():
    return F.lit(NOW).cast("timestamp")


@query("alerts_from_predictions", with_tables("predictions attack_labels", """
SELECT session_id, prediction_id, 'ml_prediction' AS alert_type, 4 AS severity, 'open' AS status,
  'high_confidence_non_benign' AS rule_name,
  'Auto-generated from ML prediction confidence threshold' AS description, 1706745600000000 AS triggered_at,
  '{"confidence":' || confidence || ',"model_version":"' || model_version || '"}' AS metadata
FROM predictions JOIN attack_labels ON label_id = predicted_label_id
WHERE label_code <> 'BENIGN' AND confidence >= 0.90000"""))
def _(t):
    return A.alerts_from_predictions(t.predictions, t.labels, now())


@query("alerts_from_stream", with_tables("predictions attack_labels", """
SELECT session_id, prediction_id, label_code AS alert_type, CASE WHEN anomaly THEN 4 ELSE 3 END AS severity,
  'open' AS status, 'ML_STREAMING_DETECTION' AS rule_name,
  format('Real-time detection: {} (confidence {:.2f})', label_code, CAST(confidence AS DOUBLE)) AS description,
  1706745600000000 AS triggered_at
FROM (SELECT *, confidence < 0.05 AS anomaly FROM predictions JOIN attack_labels ON label_id = predicted_label_id)
WHERE label_code <> 'BENIGN' OR anomaly"""))
def _(t):
    scored = t.predictions.join(
        F.broadcast(t.labels), F.col("predicted_label_id") == F.col("label_id")
    ).select(
        "session_id", "prediction_id", F.col("label_code").alias("predicted_label"),
        "confidence", (F.col("confidence") < 0.05).alias("is_anomaly"),
    )
    return A.alerts_from_stream(scored, now())


@query("update_alert_status", with_tables("alerts", """
SELECT alert_id, CASE WHEN severity >= 3 THEN 'resolved' ELSE status END AS status,
  epoch_us(CASE WHEN severity >= 3 THEN coalesce(acknowledged_at, TIMESTAMP '2024-02-01') ELSE acknowledged_at END)
    AS acknowledged_at FROM alerts"""))
def _(t):
    updates = t.alerts.filter(F.col("severity") >= 3).select(
        "alert_id", F.lit("resolved").alias("status")
    )
    return A.update_alert_status(t.alerts, updates, now()).select(
        "alert_id", "status", "acknowledged_at"
    )


@query("expire_staging", with_tables("staging runs", """
SELECT staged_id, run_id FROM staging WHERE run_id NOT IN (SELECT run_id FROM runs
  WHERE status = 'success' AND finished_at < TIMESTAMP '2024-02-01' - INTERVAL 14 DAYS)"""))
def _(t):
    return R.expire_staging(t.staging, t.runs, now())


@query("expire_runs", with_tables("runs staging", """
SELECT run_id, CAST(NULL AS BIGINT) AS staged_id FROM runs WHERE NOT coalesce(finished_at < TIMESTAMP '2024-02-15' - INTERVAL 30 DAYS, false)
UNION ALL SELECT run_id, staged_id FROM staging WHERE run_id NOT IN (
  SELECT run_id FROM runs WHERE coalesce(finished_at < TIMESTAMP '2024-02-15' - INTERVAL 30 DAYS, false))"""))
def _(t):
    runs, staging = R.expire_runs(t.runs, t.staging, F.lit("2024-02-15").cast("timestamp"))
    return runs.select("run_id", F.lit(None).cast("bigint").alias("staged_id")).unionByName(
        staging.select("run_id", "staged_id")
    )


@query("refresh_protocol_distribution", with_tables("packets", """
SELECT protocol, count(*) AS packet_count, CAST(sum(packet_size) AS BIGINT) AS total_bytes,
  1706745600000000 AS refreshed_at FROM packets GROUP BY protocol"""))
def _(t):
    path = f"{shared_folder(t.spark)}/protocol_distribution"
    return R.refresh_protocol_distribution(t.packets, path, now())


@query("cascade_delete_sessions", with_tables("sessions linked predictions alerts", """
SELECT 'sessions' AS part, session_id, count(*) AS rows FROM sessions WHERE protocol <> 'ICMP' GROUP BY session_id
UNION ALL SELECT 'features', session_id, count(*) FROM sessions WHERE protocol <> 'ICMP' GROUP BY session_id
UNION ALL SELECT 'packets', CASE WHEN s.protocol <> 'ICMP' THEN session_id END AS sid, count(*)
  FROM linked l JOIN sessions s USING (session_id) GROUP BY sid
UNION ALL SELECT 'predictions', session_id, count(*) FROM predictions
  WHERE session_id NOT IN (SELECT session_id FROM sessions WHERE protocol = 'ICMP') GROUP BY session_id
UNION ALL SELECT 'alerts', session_id, count(*) FROM alerts
  WHERE session_id NOT IN (SELECT session_id FROM sessions WHERE protocol = 'ICMP') GROUP BY session_id"""))
def _(t):
    linked = t.linked  # first, as it stores the sessions beside other work
    ids = t.sessions.filter(F.col("protocol") == "ICMP").select("session_id")
    result = R.cascade_delete_sessions(
        ids, t.sessions, linked, t.features, t.predictions, t.alerts
    )
    out = None
    for part, df in result._asdict().items():
        counted = df.groupBy("session_id").agg(F.count("*").alias("rows")).select(
            F.lit(part).alias("part"), "session_id", "rows"
        )
        out = counted if out is None else out.unionByName(counted)
    return out
