"""Table schemas and the fixed values every stage agrees on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The 17 model inputs, in model order.
FEATURE_COLS = [
    "duration_sec", "total_bytes", "total_packets",
    "bytes_per_sec", "packets_per_sec",
    "iat_mean", "iat_std", "iat_min", "iat_max",
    "fwd_bwd_byte_ratio", "payload_entropy",
    "unique_dst_ports", "avg_packet_size", "packet_size_std",
    "has_syn", "has_fin", "has_rst",
]
FLAG_FEATURES = ["has_syn", "has_fin", "has_rst"]
NUMERIC_FEATURES = [name for name in FEATURE_COLS if name not in FLAG_FEATURES]

# The label dimension (id, code, severity, description).
ATTACK_LABELS = [
    (1, "BENIGN", 1, "Normal network traffic"),
    (2, "DOS", 4, "Denial of Service"),
    (3, "PROBE", 3, "Scanning / reconnaissance activity"),
    (4, "R2L", 5, "Remote to local intrusion"),
    (5, "U2R", 5, "User to root privilege escalation"),
]
BENIGN = "BENIGN"
ALERT_STATUSES = ("open", "acknowledged", "resolved")
RUN_STATUSES = ("running", "success", "failed")

ATTACK_LABELS_SCHEMA = T.StructType([
    T.StructField("label_id", T.IntegerType(), False),
    T.StructField("label_code", T.StringType(), False),
    T.StructField("severity", T.IntegerType(), False),
    T.StructField("description", T.StringType()),
])

PACKETS_SCHEMA = T.StructType([
    T.StructField("packet_id", T.LongType(), False),
    T.StructField("captured_at", T.TimestampType(), False),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("session_id", T.LongType()),
    T.StructField("src_ip", T.StringType(), False),
    T.StructField("dst_ip", T.StringType(), False),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.StringType(), False),
    T.StructField("packet_size", T.IntegerType(), False),
    T.StructField("tcp_flags", T.StringType()),
    T.StructField("payload_hash", T.StringType()),
    T.StructField("raw_record", T.StringType()),
])

SESSIONS_SCHEMA = T.StructType([
    T.StructField("session_id", T.LongType(), False),
    T.StructField("flow_hash", T.StringType(), False),
    T.StructField("src_ip", T.StringType(), False),
    T.StructField("dst_ip", T.StringType(), False),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.StringType(), False),
    T.StructField("started_at", T.TimestampType(), False),
    T.StructField("ended_at", T.TimestampType()),
    T.StructField("packet_count", T.LongType(), False),
    T.StructField("total_bytes", T.LongType(), False),
])

PREDICTIONS_SCHEMA = T.StructType([
    T.StructField("prediction_id", T.LongType(), False),
    T.StructField("session_id", T.LongType(), False),
    T.StructField("predicted_label_id", T.IntegerType()),
    T.StructField("confidence", T.DecimalType(6, 5), False),
    T.StructField("model_version", T.StringType(), False),
    T.StructField("features", T.StringType()),
    T.StructField("created_at", T.TimestampType(), False),
])

ALERTS_SCHEMA = T.StructType([
    T.StructField("alert_id", T.LongType(), False),
    T.StructField("session_id", T.LongType(), False),
    T.StructField("prediction_id", T.LongType()),
    T.StructField("alert_type", T.StringType(), False),
    T.StructField("severity", T.IntegerType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("rule_name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("triggered_at", T.TimestampType(), False),
    T.StructField("acknowledged_at", T.TimestampType()),
    T.StructField("metadata", T.StringType()),
])

INGESTION_RUNS_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType(), False),
    T.StructField("source_name", T.StringType(), False),
    T.StructField("source_path", T.StringType(), False),
    T.StructField("started_at", T.TimestampType(), False),
    T.StructField("finished_at", T.TimestampType()),
    T.StructField("rows_received", T.LongType(), False),
    T.StructField("rows_inserted", T.LongType(), False),
    T.StructField("rows_rejected", T.LongType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("error_message", T.StringType()),
])

# The nine fields of a live-packet message.
PACKET_MESSAGE_SCHEMA = T.StructType([
    T.StructField("packet_id", T.LongType()),
    T.StructField("captured_at", T.TimestampType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("packet_size", T.IntegerType()),
    T.StructField("tcp_flags", T.StringType()),
])


def attack_labels(spark: SparkSession) -> DataFrame:
    """The five-row label dimension."""
    return spark.createDataFrame(ATTACK_LABELS, ATTACK_LABELS_SCHEMA)
