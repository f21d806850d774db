"""Cleaning and ingestion queries."""

from pyspark.sql import functions as F

from packetlake.functions.columns import bounded_int, fingerprint, parse_captured_at
from packetlake.operators import cleaning as C
from packetlake.operators import ingest as G
from registry.base import query, with_tables

CLEAN_OUT = """packet_id, epoch_us(captured_at) AS captured_at, fingerprint, src_ip, dst_ip, src_port,
  dst_port, protocol, packet_size, tcp_flags, payload_hash, is_valid, validation_errors"""
# The first copy of each valid packet key, by packet_id.
INSERTED = """SELECT captured_at, fingerprint, min(packet_id) AS packet_id FROM cleaned
  WHERE is_valid GROUP BY captured_at, fingerprint"""


def checked(t):
    return C.check_packets(t.raw_packets, "packet_id")


@query("parse_captured_at", with_tables("typed_packets", """
SELECT packet_id, epoch_us(captured_at) AS captured_at FROM typed_packets"""))
def _(t):
    return t.raw_packets.select(
        "packet_id", parse_captured_at(F.col("captured_at")).alias("captured_at")
    )


@query("trim_and_upper", with_tables("typed_packets", """
SELECT packet_id, src_ip, dst_ip, protocol FROM typed_packets"""))
def _(t):
    return C.type_columns(t.raw_packets).select("packet_id", "src_ip", "dst_ip", "protocol")


@query("bounded_int", with_tables("typed_packets", """
SELECT packet_id, src_port, dst_port, packet_size FROM typed_packets"""))
def _(t):
    return t.raw_packets.select(
        "packet_id",
        bounded_int(F.col("src_port"), 0, C.MAX_PORT).alias("src_port"),
        bounded_int(F.col("dst_port"), 0, C.MAX_PORT).alias("dst_port"),
        bounded_int(F.col("packet_size"), 0).alias("packet_size"),
    )


@query("validation_errors", with_tables("cleaned", """
SELECT packet_id, is_valid, validation_errors FROM cleaned"""))
def _(t):
    return checked(t).select("packet_id", "is_valid", "validation_errors")


@query("fingerprint", with_tables("cleaned", "SELECT packet_id, fingerprint FROM cleaned"))
def _(t):
    return C.type_columns(t.raw_packets).select("packet_id", fingerprint().alias("fingerprint"))


@query("raw_record", with_tables("typed_packets", """
SELECT packet_id, json_object('captured_at', strftime(captured_at, '%Y-%m-%dT%H:%M:%S.%fZ'),
  'src_ip', src_ip, 'dst_ip', dst_ip, 'src_port', src_port, 'dst_port', dst_port, 'protocol', protocol,
  'packet_size', packet_size, 'tcp_flags', tcp_flags, 'payload_hash', payload_hash)::VARCHAR AS raw_record
FROM typed_packets"""))
def _(t):
    return checked(t).select("packet_id", "raw_record")


@query("clean_packets", with_tables("cleaned", f"SELECT {CLEAN_OUT} FROM cleaned WHERE is_valid"))
def _(t):
    valid, _rejected = C.clean_packets(t.raw_packets, "packet_id")
    return valid.drop("raw_record")


@query("quarantine", with_tables("cleaned", f"SELECT {CLEAN_OUT} FROM cleaned WHERE NOT is_valid"))
def _(t):
    return C.quarantine(checked(t)).drop("raw_record")


@query("error_breakdown", with_tables("cleaned", """
SELECT error_code, count(*) AS rows FROM (
  SELECT unnest(string_split(validation_errors, ',')) AS error_code FROM cleaned WHERE NOT is_valid)
GROUP BY error_code"""))
def _(t):
    return C.error_breakdown(checked(t))


@query("stage_rows", with_tables("cleaned", f"SELECT CAST(7 AS BIGINT) AS run_id, {CLEAN_OUT} FROM cleaned"))
def _(t):
    return G.stage_rows(checked(t), 7).drop("raw_record")


@query("dedup_insert", with_tables("cleaned packets", f"""
SELECT packet_id, epoch_us(captured_at) AS captured_at, fingerprint FROM ({INSERTED})
WHERE (captured_at, fingerprint) NOT IN
  (SELECT captured_at, fingerprint FROM cleaned WHERE is_valid AND protocol = 'UDP')"""))
def _(t):
    valid = checked(t).filter("is_valid")
    loaded = valid.filter(F.col("protocol") == "UDP")
    return G.dedup_insert(valid, loaded, "packet_id").select(
        "packet_id", "captured_at", "fingerprint"
    )


@query("append_packets", with_tables("packets", """
SELECT row_id, message, CASE WHEN message IS NOT NULL THEN 'invalid'
  WHEN protocol <> 'UDP' AND row_id = min(row_id) OVER (PARTITION BY packet_id) THEN 'created'
  ELSE 'duplicate' END AS status
FROM (SELECT row_id, packet_id, protocol, CASE
    WHEN protocol = 'ICMP' AND packet_size < 40 THEN 'Missing required fields: dst_ip'
    WHEN packet_size > 1500 THEN 'packet_size must be >= 0' END AS message
  FROM (SELECT packet_id AS row_id, * FROM packets
    UNION ALL SELECT packet_id + 1000000000000, * FROM packets WHERE tcp_flags = 'SYN'))"""))
def _(t):
    packets = t.packets
    sent = packets.withColumn("row_id", F.col("packet_id"))
    again = packets.filter(F.col("tcp_flags") == "SYN").withColumn(
        "row_id", F.col("packet_id") + 1_000_000_000_000
    )
    rows = sent.unionByName(again).withColumns({
        "dst_ip": F.when(
            ~((F.col("protocol") == "ICMP") & (F.col("packet_size") < 40)), F.col("dst_ip")
        ),
        "packet_size": F.when(F.col("packet_size") > 1500, -1).otherwise(F.col("packet_size")),
    })
    existing = packets.filter(F.col("protocol") == "UDP").withColumn("fingerprint", fingerprint())
    return G.append_packets(rows, existing, "row_id").select("row_id", "status", "message")


@query("delete_packets", with_tables("packets", """
SELECT packet_id, 'kept' AS status FROM packets WHERE protocol <> 'ICMP'
UNION ALL SELECT packet_id, 'deleted' FROM packets WHERE protocol = 'ICMP'
UNION ALL SELECT -packet_id - 1, 'not_found' FROM packets WHERE protocol = 'ICMP'"""))
def _(t):
    icmp = t.packets.filter(F.col("protocol") == "ICMP").select("packet_id")
    ids = icmp.unionByName(icmp.select((-F.col("packet_id") - 1).alias("packet_id")))
    rest, outcome = G.delete_packets(t.packets, ids)
    return rest.select("packet_id", F.lit("kept").alias("status")).unionByName(outcome)


@query("ingestion_run_row", with_tables("cleaned", f"""
SELECT CAST(7 AS BIGINT) AS run_id, 'feed' AS source_name, '/in/feed.csv' AS source_path,
  1704067200000000 AS started_at, 1704067260000000 AS finished_at, count(*) AS rows_received,
  (SELECT count(*) FROM ({INSERTED})) AS rows_inserted, count(*) FILTER (NOT is_valid) AS rows_rejected,
  'success' AS status, CAST(NULL AS VARCHAR) AS error_message FROM cleaned"""))
def _(t):
    rows = checked(t)
    inserted = G.first_per_key(rows.filter("is_valid"), "packet_id")
    at = lambda text: F.lit(text).cast("timestamp")
    return G.ingestion_run_row(
        rows, inserted, 7, "feed", "/in/feed.csv",
        at("2024-01-01 00:00:00"), at("2024-01-01 00:01:00"),
    )


@query("finish_run", with_tables("runs", """
SELECT run_id, epoch_us(CASE WHEN run_id = 7 THEN TIMESTAMP '2024-03-01' ELSE finished_at END) AS finished_at,
  CASE WHEN run_id = 7 THEN 5 ELSE rows_inserted END AS rows_inserted,
  CASE WHEN run_id = 7 THEN 'failed' ELSE status END AS status,
  CASE WHEN run_id = 7 THEN 'disk full' END AS error_message FROM runs"""))
def _(t):
    runs = t.runs.withColumn("error_message", F.lit(None).cast("string"))
    return G.finish_run(
        runs, 7, "failed", 5, 0, F.lit("2024-03-01").cast("timestamp"), "disk full"
    ).select("run_id", "finished_at", "rows_inserted", "status", "error_message")


@query("constraint_violations", with_tables("cleaned sessions linked predictions alerts runs", """
SELECT 'packet_size_not_negative' AS rule, 0 AS violations
UNION ALL SELECT 'confidence_in_unit_range', count(*) FROM predictions WHERE confidence NOT BETWEEN 0 AND 1
UNION ALL SELECT 'label_severity_1_to_5', 0
UNION ALL SELECT 'alert_severity_1_to_5', count(*) FROM alerts WHERE severity NOT BETWEEN 1 AND 5
UNION ALL SELECT 'alert_status_known', count(*) FROM alerts WHERE status NOT IN ('open','acknowledged','resolved')
UNION ALL SELECT 'run_status_known', count(*) FROM runs WHERE status NOT IN ('running','success','failed')
UNION ALL SELECT 'session_ends_after_start', count(*) FROM sessions WHERE ended_at < started_at
UNION ALL SELECT 'packet_key_unique', count(*) FROM (
  SELECT 1 FROM cleaned WHERE is_valid GROUP BY captured_at, fingerprint HAVING count(*) > 1)
UNION ALL SELECT 'flow_hash_unique', 0
UNION ALL SELECT 'prediction_unique', count(*) FROM (
  SELECT 1 FROM predictions GROUP BY session_id, model_version HAVING count(*) > 1)
UNION ALL SELECT 'label_code_unique', 0
UNION ALL SELECT 'packet_session_exists', count(*) FROM cleaned c LEFT JOIN linked l USING (packet_id)
  WHERE is_valid AND l.session_id IN (SELECT session_id FROM sessions WHERE protocol = 'ICMP')
UNION ALL SELECT 'prediction_session_exists', count(*) FROM predictions
  WHERE session_id NOT IN (SELECT session_id FROM sessions WHERE protocol <> 'ICMP')
UNION ALL SELECT 'alert_session_exists', count(*) FROM alerts
  WHERE session_id NOT IN (SELECT session_id FROM sessions WHERE protocol <> 'ICMP')
UNION ALL SELECT 'alert_prediction_exists', 0"""))
def _(t):
    # Copies of packets and a sessions table without ICMP make rules fail.
    packets = checked(t).filter("is_valid").join(
        t.linked.select("packet_id", "session_id"), "packet_id", "left"
    )
    sessions = t.sessions.filter(F.col("protocol") != "ICMP")
    return G.constraint_violations(
        packets, sessions, t.predictions, t.alerts, t.runs, t.labels
    )
