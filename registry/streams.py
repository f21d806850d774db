"""Streaming queries: the packets are replayed as a message stream, drained,
and the recorded output is read back."""

import uuid

from pyspark.sql import functions as F

from packetlake import schemas
from packetlake.functions.columns import MICROS
from packetlake.session import ROCKSDB_PROVIDER, STATE_STORE_CONF, shared_folder
from packetlake.sources import streams as src
from packetlake.streaming import detect as D
from packetlake.streaming import sessions as XS
from packetlake.streaming import trends as XT
from registry.base import query, with_tables
from registry.ml import Fitted
from registry.traffic import MINUTES

MESSAGE_COLS = [f.name for f in schemas.PACKET_MESSAGE_SCHEMA.fields]
# A last packet of a flow of its own, a day later, moves the watermark past
# everything that was replayed.
CLOSER_ID = -1


def new_folder(t, name):
    return f"{shared_folder(t.spark)}/streams/{name}-{uuid.uuid4().hex}"


_REPLAYS: dict = {}


def replay(t):
    """A stream of the packets, then the closing packet."""
    if t not in _REPLAYS:
        path = new_folder(t, "messages")
        packets = t.packets.select(*MESSAGE_COLS)
        closer = packets.agg(F.max("captured_at").alias("captured_at")).select(
            F.lit(CLOSER_ID).cast("bigint").alias("packet_id"),
            (F.col("captured_at") + F.expr("INTERVAL 1 DAY")).alias("captured_at"),
            F.lit("192.0.2.1").alias("src_ip"), F.lit("192.0.2.2").alias("dst_ip"),
            F.lit(None).cast("int").alias("src_port"), F.lit(None).cast("int").alias("dst_port"),
            F.lit("ICMP").alias("protocol"), F.lit(0).alias("packet_size"),
            F.lit(None).cast("string").alias("tcp_flags"),
        )
        src.packet_messages(packets).write.text(path)
        src.packet_messages(closer).write.mode("append").text(path)
        _REPLAYS[t] = path
    return src.read_packet_stream(t.spark, _REPLAYS[t])


def drain(t, stream, name):
    """Run a streaming query over all that is there and read its output."""
    t.spark.conf.set(STATE_STORE_CONF, ROCKSDB_PROVIDER)
    out = new_folder(t, name)
    running = (
        stream.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", f"{out}-checkpoint").outputMode("append")
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out)


@query("read_packet_stream", with_tables("packets", """
SELECT packet_id, epoch_us(captured_at) AS captured_at, src_ip, dst_ip, src_port, dst_port, protocol,
  packet_size, tcp_flags FROM packets"""))
def _(t):
    return drain(t, replay(t), "packets").filter(F.col("packet_id") != CLOSER_ID)


@query("publish_packet_stream", with_tables("packets", """
SELECT packet_id, json_object('packet_id', packet_id, 'captured_at',
  strftime(captured_at, '%Y-%m-%dT%H:%M:%S.%fZ'), 'src_ip', src_ip, 'dst_ip', dst_ip, 'src_port', src_port,
  'dst_port', dst_port, 'protocol', protocol, 'packet_size', packet_size, 'tcp_flags', tcp_flags)::VARCHAR AS message
FROM packets"""))
def _(t):
    out = new_folder(t, "published")
    src.publish_packet_stream(replay(t), out, f"{out}-checkpoint").awaitTermination()
    return t.spark.read.text(out).select(
        F.get_json_object("value", "$.packet_id").cast("bigint").alias("packet_id"),
        F.col("value").alias("message"),
    ).filter(F.col("packet_id") != CLOSER_ID)


@query("online_sessions", with_tables("built", """
SELECT flow_hash, src_ip, dst_ip, src_port, dst_port, protocol, epoch_us(started_at) AS started_at,
  epoch_us(ended_at) AS ended_at, packet_count, total_bytes FROM built""", idle_micros=5 * MICROS))
def _(t):
    return XS.closed_sessions(drain(t, XS.online_sessions(replay(t)), "closed"))


@query("online_features", with_tables("iat ent features sessions", """
SELECT flow_hash, f.total_packets, f.total_bytes, round(duration_sec, 6) AS duration_sec,
  round(bytes_per_sec, 6) AS bytes_per_sec, round(packets_per_sec, 6) AS packets_per_sec, round(iat_mean, 6) AS iat_mean, round(iat_std, 6) AS iat_std,
  round(iat_min, 6) AS iat_min, round(iat_max, 6) AS iat_max, round(fwd_bwd_byte_ratio, 6) AS fwd_bwd_byte_ratio,
  round(payload_entropy, 6) AS payload_entropy, unique_dst_ports, round(avg_packet_size, 6) AS avg_packet_size,
  round(packet_size_std, 6) AS packet_size_std, has_syn, has_fin, has_rst
FROM features f JOIN sessions USING (session_id)"""))
def _(t):
    closed = drain(t, XS.online_sessions(replay(t), idle_seconds=60), "closed60")
    return XS.closed_features(closed)


@query("gap_sessions", with_tables("keyed", """
SELECT low_ip, high_ip, low_port, high_port, flow_protocol, epoch_us(min(captured_at)) AS started_at,
  epoch_us(max(captured_at)) AS ended_at, count(*) AS packet_count, CAST(sum(packet_size) AS BIGINT) AS total_bytes
FROM (SELECT *, sum(CASE WHEN epoch_us(captured_at) - prev <= 5000000 THEN 0 ELSE 1 END) OVER
    (PARTITION BY low_ip, high_ip, low_port, high_port, flow_protocol ORDER BY captured_at, packet_id) AS seq
  FROM (SELECT *, lag(epoch_us(captured_at)) OVER (PARTITION BY low_ip, high_ip, low_port, high_port, flow_protocol
    ORDER BY captured_at, packet_id) AS prev FROM keyed))
GROUP BY low_ip, high_ip, low_port, high_port, flow_protocol, seq"""))
def _(t):
    return drain(t, XS.gap_sessions(replay(t)), "gaps").filter(F.col("low_ip") != "192.0.2.1")


@query("stream_traffic_trends", with_tables("packets", f"""
SELECT epoch_us(minute_bucket) AS minute_bucket, packets_per_minute, bytes_per_minute, active_source_ips FROM ({MINUTES})"""))
def _(t):
    return drain(t, XT.stream_traffic_trends(replay(t)), "trends")


@query("stream_active_flows", with_tables("packets", """
SELECT as_of, count(*) AS active_sessions FROM (
  SELECT DISTINCT src_ip, dst_ip, unnest(range(second, second + 120 * 1000000, 1000000)) AS as_of FROM (
    SELECT DISTINCT src_ip, dst_ip, epoch_us(date_trunc('second', captured_at)) + 1000000 AS second FROM packets))
GROUP BY as_of"""))
def _(t):
    steps = drain(t, XT.stream_flow_steps(replay(t)), "flow-steps")
    return XT.active_flows(steps)


@query("stream_active_flows_sketch")
def _(t):
    return drain(t, XT.stream_active_flows(replay(t)), "flows")


@query("stream_rate", with_tables("packets", """
SELECT epoch_us(date_trunc('second', captured_at)) AS second, count(*) AS pps FROM packets GROUP BY 1"""))
def _(t):
    return drain(t, XT.stream_rate(replay(t)), "rate")


@query("stream_new_alerts", with_tables("alerts", "SELECT alert_id, alert_type, severity, description FROM alerts"))
def _(t):
    path = new_folder(t, "alert-table")
    alerts = t.alerts
    alerts.write.parquet(path)
    return drain(t, XT.stream_new_alerts(t.spark, path, alerts.schema), "new-alerts")


@query("score_on_close")
def _(t):
    closed = drain(t, XS.online_sessions(replay(t)), "closed-to-score")
    return D.score_closed(closed, Fitted.of(t).model).select(
        "flow_hash", "predicted_label", "confidence", "anomaly_score", "is_anomaly"
    )


@query("stream_detections")
def _(t):
    t.spark.conf.set(STATE_STORE_CONF, ROCKSDB_PROVIDER)
    folder = new_folder(t, "detections")
    D.start_detection(
        XS.online_sessions(replay(t)), Fitted.of(t).model, t.labels, folder,
        f"{folder}-checkpoint", availableNow=True,
    ).awaitTermination()
    return D.current_sessions(t.spark, folder)
