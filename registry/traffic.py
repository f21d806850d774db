"""Listing and traffic queries."""

from pyspark.sql import functions as F

from packetlake.functions.columns import packet_status
from packetlake.operators import listings as Ls
from packetlake.operators import traffic as T
from registry.base import query, with_tables
from registry.features import FEATURE_OUT

PACKET_OUT = """packet_id, epoch_us(captured_at) AS captured_at, src_ip, dst_ip, src_port, dst_port,
  protocol, packet_size, tcp_flags, payload_hash"""
ALERT_OUT = """alert_id, session_id, prediction_id, alert_type, severity, status, rule_name, description,
  epoch_us(triggered_at) AS triggered_at, epoch_us(acknowledged_at) AS acknowledged_at"""
SESSION_OUT = """session_id, flow_hash, src_ip, dst_ip, src_port, dst_port, protocol,
  epoch_us(started_at) AS started_at, epoch_us(ended_at) AS ended_at, packet_count, total_bytes"""
MINUTES = """SELECT date_trunc('minute', captured_at) AS minute_bucket, count(*) AS packets_per_minute,
  CAST(sum(packet_size) AS BIGINT) AS bytes_per_minute, count(DISTINCT src_ip) AS active_source_ips
  FROM packets GROUP BY 1"""
AS_OF = "2024-01-01 00:20:00"


@query("list_packets", with_tables("packets", f"""
SELECT {PACKET_OUT} FROM packets WHERE protocol = 'TCP' AND dst_ip = '203.0.113.3'
ORDER BY packets.captured_at DESC, packet_id DESC LIMIT 200 OFFSET 50"""))
def _(t):
    return Ls.list_packets(t.packets, dst_ip="203.0.113.3", protocol="tcp", limit=200, offset=50)


@query("list_sessions", with_tables("sessions", f"""
SELECT {SESSION_OUT} FROM sessions WHERE protocol = 'UDP'
ORDER BY sessions.started_at DESC, session_id DESC LIMIT 100"""))
def _(t):
    return Ls.list_sessions(t.sessions, protocol="udp")


@query("list_alerts", with_tables("alerts", f"""
SELECT {ALERT_OUT} FROM alerts WHERE status = 'open' AND severity >= 3
ORDER BY alerts.triggered_at DESC, alert_id DESC LIMIT 100"""))
def _(t):
    return Ls.list_alerts(t.alerts, status="open", min_severity=3)


@query("list_predictions", with_tables("predictions attack_labels", """
SELECT prediction_id, session_id, predicted_label_id, CAST(confidence AS DOUBLE) AS confidence, model_version,
  label_code AS predicted_label, epoch_us(created_at) AS created_at
FROM predictions LEFT JOIN attack_labels ON label_id = predicted_label_id
WHERE model_version = 'v1_b' AND label_code = 'DOS'
ORDER BY predictions.created_at DESC, prediction_id DESC LIMIT 100"""))
def _(t):
    return Ls.list_predictions(t.predictions, t.labels, model_version="v1_b", label="dos")


@query("list_ingestion_runs", with_tables("runs", """
SELECT run_id, source_name, source_path, epoch_us(started_at) AS started_at, epoch_us(finished_at) AS finished_at,
  rows_received, rows_inserted, rows_rejected, status,
  round((epoch_us(finished_at) - epoch_us(started_at)) / 1e6, 2) AS duration_sec
FROM runs ORDER BY runs.started_at DESC, run_id DESC LIMIT 100"""))
def _(t):
    return Ls.list_ingestion_runs(t.runs)


@query("packet_count", with_tables("packets", "SELECT count(*) AS count FROM packets"))
def _(t):
    return Ls.packet_count(t.packets)


@query("alert_detail", with_tables("alerts sessions predictions attack_labels", """
SELECT a.alert_id, a.session_id, a.prediction_id, a.alert_type, a.severity, a.status, a.rule_name, a.description,
  epoch_us(a.triggered_at) AS triggered_at, epoch_us(a.acknowledged_at) AS acknowledged_at, s.src_ip, s.dst_ip,
  s.src_port, s.dst_port, s.protocol,
  CAST(p.confidence AS DOUBLE) AS confidence, p.model_version, label_code AS predicted_label
FROM alerts a LEFT JOIN sessions s ON s.session_id = a.session_id
LEFT JOIN predictions p ON p.prediction_id = a.prediction_id LEFT JOIN attack_labels ON label_id = predicted_label_id"""))
def _(t):
    detail = Ls.alert_detail(t.alerts, t.sessions, t.predictions, t.labels)
    return detail.select(
        *[c for c in detail.columns if not c.endswith("_details")],
        "session_details.*",
        "prediction_details.confidence", "prediction_details.model_version",
        "prediction_details.predicted_label",
    )


@query("top_ips", with_tables("packets", """
SELECT src_ip AS ip, count(*) AS packet_count, CAST(sum(packet_size) AS BIGINT) AS total_bytes,
  epoch_us(min(captured_at)) AS first_seen, epoch_us(max(captured_at)) AS last_seen
FROM packets GROUP BY src_ip ORDER BY packet_count DESC, ip LIMIT 100"""))
def _(t):
    return T.top_ips(t.packets)


@query("traffic_trends", with_tables("packets", f"""
SELECT epoch_us(minute_bucket) AS minute_bucket, packets_per_minute, bytes_per_minute, active_source_ips
FROM ({MINUTES}) m ORDER BY m.minute_bucket DESC LIMIT 1000"""))
def _(t):
    return T.traffic_trends(t.packets, 1000)


@query("protocol_distribution", with_tables("packets", """
SELECT protocol, count(*) AS packet_count, CAST(sum(packet_size) AS BIGINT) AS total_bytes,
  1706745600000000 AS refreshed_at FROM packets GROUP BY protocol"""))
def _(t):
    return T.protocol_distribution(t.packets, F.lit("2024-02-01").cast("timestamp"))


@query("protocol_share", with_tables("packets", """
SELECT protocol AS name, CAST(greatest(1, floor(count(*) * 100.0 / sum(count(*)) OVER () + 0.5)) AS BIGINT) AS value
FROM (SELECT * FROM packets ORDER BY captured_at DESC, packet_id DESC LIMIT 500) GROUP BY protocol"""))
def _(t):
    return T.protocol_share(t.packets)


@query("traffic_megabits", with_tables("packets", f"""
SELECT epoch_us(minute_bucket) AS minute_bucket,
  CAST(floor(bytes_per_minute * 8 / 1000000 + 0.5) AS BIGINT) AS traffic FROM ({MINUTES})"""))
def _(t):
    return T.traffic_megabits(T.per_minute(t.packets))


@query("peak_traffic", with_tables("packets", f"""
SELECT CAST(max(floor(bytes_per_minute * 8 / 1000000 + 0.5)) AS BIGINT) AS peak_megabits FROM ({MINUTES})"""))
def _(t):
    return T.peak_traffic(T.traffic_megabits(T.per_minute(t.packets)))


@query("latest_rate", with_tables("packets", f"""
SELECT round(arg_max(bytes_per_minute, minute_bucket) * 8 / 1000000 / 60, 2) AS megabits_per_sec FROM ({MINUTES})"""))
def _(t):
    return T.latest_rate(T.per_minute(t.packets))


@query("confidence_histogram", with_tables("predictions", """
SELECT model_version, range, count(confidence) AS count FROM
  (SELECT DISTINCT model_version FROM predictions)
  JOIN (VALUES ('0-20%', 0), ('20-40%', 1), ('40-60%', 2), ('60-80%', 3), ('80-100%', 4)) b(range, bin) ON true
  LEFT JOIN (SELECT model_version, confidence, least(floor(confidence * 5), 4) AS bin FROM predictions) p
  USING (model_version, bin) GROUP BY model_version, range"""))
def _(t):
    return T.confidence_histogram(t.predictions)


@query("severity_buckets", with_tables("alerts", """
SELECT CASE WHEN severity >= 4 THEN 'critical' WHEN severity >= 2 THEN 'medium' ELSE 'low' END AS bucket,
  count(*) AS alerts FROM alerts GROUP BY 1"""))
def _(t):
    return T.severity_buckets(t.alerts)


@query("avg_packet_size", with_tables("sessions", """
SELECT session_id, CAST(floor(total_bytes / packet_count + 0.5) AS BIGINT) AS avg_packet_size FROM sessions"""))
def _(t):
    return T.avg_packet_size(t.sessions)


@query("packet_status", with_tables("packets", """
SELECT packet_id, CASE WHEN packet_size > 1200 THEN 'alert' ELSE 'normal' END AS status FROM packets"""))
def _(t):
    return t.packets.select("packet_id", packet_status(F.col("packet_size")).alias("status"))


@query("live_metrics", with_tables("packets alerts", f"""
SELECT count(*) AS packet_count,
  count(DISTINCT (src_ip, dst_ip)) FILTER (captured_at >= TIMESTAMP '{AS_OF}' - INTERVAL 2 MINUTES) AS active_sessions,
  epoch_us(max(captured_at)) AS last_ingestion, (SELECT count(*) FROM alerts WHERE status = 'open') AS open_alerts
FROM packets"""))
def _(t):
    return T.live_metrics(t.packets, t.alerts, F.lit(AS_OF).cast("timestamp"))


@query("rate_from_counts", with_tables("packets", f"""
SELECT epoch_us(minute_bucket) AS sampled_at, packets_per_minute AS packet_count,
  greatest(coalesce(packets_per_minute - lag(packets_per_minute) OVER (ORDER BY minute_bucket), 0), 0) AS pps
FROM ({MINUTES}) m ORDER BY m.minute_bucket DESC LIMIT 60"""))
def _(t):
    samples = T.per_minute(t.packets).select(
        F.col("minute_bucket").alias("sampled_at"),
        F.col("packets_per_minute").alias("packet_count"),
    )
    return T.rate_from_counts(samples)


@query("alerts_since", with_tables("alerts", """
SELECT alert_id, alert_type, severity, description FROM alerts WHERE alert_id > 100"""))
def _(t):
    return Ls.alerts_since(t.alerts, 100)


@query("session_features_for", with_tables("features sessions", f"""
SELECT {FEATURE_OUT} FROM features WHERE session_id IN (SELECT session_id FROM sessions WHERE protocol = 'TCP')"""))
def _(t):
    return Ls.session_features_for(t.features, t.sessions.filter(F.col("protocol") == "TCP"))
