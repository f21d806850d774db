"""Feature queries."""

from pyspark.sql import functions as F

from packetlake.functions.columns import safe_div, seconds_between
from packetlake.operators import features as X
from packetlake.schemas import FEATURE_COLS
from registry.base import query, with_tables

FEATURE_OUT = """session_id, round(duration_sec, 6) AS duration_sec, total_bytes, total_packets,
  round(bytes_per_sec, 6) AS bytes_per_sec, round(packets_per_sec, 6) AS packets_per_sec,
  round(iat_mean, 6) AS iat_mean, round(iat_std, 6) AS iat_std, round(iat_min, 6) AS iat_min,
  round(iat_max, 6) AS iat_max, round(fwd_bwd_byte_ratio, 6) AS fwd_bwd_byte_ratio,
  round(payload_entropy, 6) AS payload_entropy, unique_dst_ports, round(avg_packet_size, 6) AS avg_packet_size,
  round(packet_size_std, 6) AS packet_size_std, has_syn, has_fin, has_rst"""


@query("safe_div", with_tables("sessions", """
SELECT session_id, round(CASE WHEN total_bytes = 0 THEN 0 ELSE packet_count / total_bytes END, 6) AS quotient
FROM sessions"""))
def _(t):
    return t.sessions.select(
        "session_id", safe_div(F.col("packet_count"), F.col("total_bytes")).alias("quotient")
    )


@query("session_duration", with_tables("sessions", """
SELECT session_id, round((epoch_us(ended_at) - epoch_us(started_at)) / 1e6, 6) AS duration_sec FROM sessions"""))
def _(t):
    return t.sessions.select(
        "session_id", seconds_between(F.col("started_at"), F.col("ended_at")).alias("duration_sec")
    )


@query("session_totals", with_tables("features", "SELECT session_id, total_bytes, total_packets FROM features"))
def _(t):
    moments = X.session_moments(t.sessions, t.linked)
    return moments.select(
        "session_id",
        (F.col("fwd_bytes") + F.col("bwd_bytes")).alias("total_bytes"),
        F.col("packets").alias("total_packets"),
    )


@query("session_rates", with_tables("features", """
SELECT session_id, round(bytes_per_sec, 6) AS bytes_per_sec, round(packets_per_sec, 6) AS packets_per_sec
FROM features"""))
def _(t):
    return t.features.select("session_id", "bytes_per_sec", "packets_per_sec")


@query("iat_stats", with_tables("iat linked", """
SELECT session_id, round(iat_mean, 6) AS iat_mean, round(iat_std, 6) AS iat_std, round(iat_min, 6) AS iat_min,
  round(iat_max, 6) AS iat_max FROM iat WHERE session_id IN
  (SELECT session_id FROM linked GROUP BY session_id HAVING count(*) > 1)"""))
def _(t):
    return X.iat_stats(t.linked)


@query("payload_entropy", with_tables("ent", """
SELECT session_id, round(abs(payload_entropy), 6) AS payload_entropy FROM ent"""))
def _(t):
    return X.payload_entropy(t.linked)


@query("fwd_bwd_byte_ratio", with_tables("features", """
SELECT session_id, round(fwd_bwd_byte_ratio, 6) AS fwd_bwd_byte_ratio FROM features"""))
def _(t):
    moments = X.session_moments(t.sessions, t.linked)
    return moments.select(
        "session_id",
        X.fwd_bwd_ratio(F.col("fwd_bytes"), F.col("bwd_bytes")).alias("fwd_bwd_byte_ratio"),
    )


@query("unique_dst_ports", with_tables("features", "SELECT session_id, unique_dst_ports FROM features"))
def _(t):
    return X.unique_dst_ports(t.linked)


@query("packet_size_stats", with_tables("features", """
SELECT session_id, round(avg_packet_size, 6) AS avg_packet_size, round(packet_size_std, 6) AS packet_size_std
FROM features"""))
def _(t):
    return t.features.select("session_id", "avg_packet_size", "packet_size_std")


@query("flag_indicators", with_tables("features", "SELECT session_id, has_syn, has_fin, has_rst FROM features"))
def _(t):
    return X.session_moments(t.sessions, t.linked).select(
        "session_id", "has_syn", "has_fin", "has_rst"
    )


@query("extract_features", with_tables("features", f"SELECT {FEATURE_OUT} FROM features"))
def _(t):
    return X.extract_features(t.sessions, t.linked)


@query("sessions_without_features", with_tables("sessions", """
SELECT session_id, flow_hash FROM sessions WHERE protocol = 'ICMP'"""))
def _(t):
    done = t.features.join(
        t.sessions.filter(F.col("protocol") != "ICMP").select("session_id"), "session_id"
    )
    return X.sessions_without_features(t.sessions, done).select("session_id", "flow_hash")


@query("empty_feature_rows", with_tables("sessions", f"""
SELECT session_id, {", ".join(
    f"false AS {c}" if c.startswith("has_")
    else f"0 AS {c}" for c in FEATURE_COLS)} FROM sessions"""))
def _(t):
    return X.with_empty_rows(t.sessions, t.features.limit(0))


@query("upsert_features", with_tables("sessions labeled", f"""
SELECT {FEATURE_OUT}, ground_truth_label_id, computed_at FROM (
  SELECT l.* REPLACE (CASE WHEN protocol = 'TCP' THEN total_packets ELSE 2 * total_packets END AS total_packets),
    CASE WHEN protocol = 'TCP' THEN 1704067200000000 ELSE 1735689600000000 END AS computed_at
  FROM labeled l JOIN (SELECT session_id, protocol FROM sessions) s USING (session_id))"""))
def _(t):
    old = t.labeled.withColumn("computed_at", F.lit("2024-01-01").cast("timestamp"))
    new = t.features.withColumn("total_packets", 2 * F.col("total_packets")).join(
        t.sessions.filter(F.col("protocol") != "TCP").select("session_id"), "session_id"
    )
    return X.upsert_features(old, new, F.lit("2025-01-01").cast("timestamp")).select(
        "session_id", *FEATURE_COLS, "ground_truth_label_id", "computed_at"
    )


@query("port_fanout", with_tables("packets", """
SELECT p.packet_id, p.src_ip, count(DISTINCT q.dst_port) AS port_fanout
FROM packets p LEFT JOIN packets q ON q.src_ip = p.src_ip AND q.dst_port IS NOT NULL
  AND epoch_us(q.captured_at) BETWEEN epoch_us(p.captured_at) - 60000000 AND epoch_us(p.captured_at)
GROUP BY p.packet_id, p.src_ip"""))
def _(t):
    return X.port_fanout(t.packets, window_seconds=60)
