"""Registration, the derived input tables and the SQL text of those tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetlake import schemas
from packetlake.operators import features as feature_ops
from packetlake.operators import labels as label_ops
from packetlake.operators import sessions as session_ops
from packetlake.session import (
    CLEANUP_DEFAULTS,
    EVENTS_PARTITION_BYTES,
    FLOWS_PARTITION_BYTES,
    PACKET_DEFAULTS,
    apply_sql_defaults,
    drop_stages,
    ship_package,
    size_shuffles,
    store_stage,
    stored_bytes,
)
from packetlake.sources import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# The operators as registered, before ``publish`` makes results comparable.
OPERATORS: dict[str, Callable[["Tables"], DataFrame]] = {}


class Tables:
    """Input tables of one folder. The packet tables and the results of
    sessionization and feature extraction are stored once, as a deployment
    stores them, and read back by every query that builds on them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return ev.read_table(self.spark, self.folder, name)

    @cached_property
    def shuffle_partitions(self) -> int:
        """Partitions that hold a bounded share of the stored tables each."""
        return max(
            -(-stored_bytes(self.spark, f"{self.folder}/{name}.parquet") // size)
            for name, size in (("events", EVENTS_PARTITION_BYTES), ("lineitem", FLOWS_PARTITION_BYTES))
        )

    @cached_property
    def packets(self) -> DataFrame:
        return store_stage(ev.packets_from_events(self.table("events")), "packets")

    @cached_property
    def raw_packets(self) -> DataFrame:
        return store_stage(ev.raw_packets(self.packets), "raw-packets")

    @property
    def predictions(self) -> DataFrame:
        return ev.predictions_from_events(self.table("events"))

    @property
    def alerts(self) -> DataFrame:
        return ev.alerts_from_events(self.table("events"))

    @property
    def runs(self) -> DataFrame:
        return ev.runs_from_events(self.table("events"))

    @property
    def staging(self) -> DataFrame:
        return ev.staging_from_events(self.table("events"))

    @cached_property
    def flow_records(self) -> DataFrame:
        return store_stage(ev.flow_records(self.table("lineitem")), "flow-records")

    @property
    def labels(self) -> DataFrame:
        return schemas.attack_labels(self.spark)

    def unlinked_packets(self) -> DataFrame:
        return self.packets.withColumn("session_id", F.lit(None).cast("bigint"))

    def no_sessions(self) -> DataFrame:
        return self.spark.createDataFrame([], schemas.SESSIONS_SCHEMA)

    @cached_property
    def assigned(self) -> DataFrame:
        # What is assigned is kept by packet_id; the packets have the rest.
        scanned = session_ops.scan_unsessionized(self.unlinked_packets())
        return store_stage(
            session_ops.assign_sessions(scanned).select(
                "packet_id", *session_ops.FLOW_KEY, "session_seq", "started_at", "flow_hash"
            ),
            "assigned",
        )

    @cached_property
    def sessions(self) -> DataFrame:
        # Numbering reads them twice.
        built = store_stage(session_ops.build_sessions(self.packets), "built")
        sessions = store_stage(session_ops.upsert_sessions(self.no_sessions(), built), "sessions")
        drop_stages(built)
        return sessions

    @cached_property
    def linked(self) -> DataFrame:
        self.packets  # read by both of the next, which neither keep all cores busy
        with ThreadPoolExecutor(1) as other:
            assigned = other.submit(lambda: self.assigned)
            self.sessions
            assigned.result()
        return store_stage(
            session_ops.link_packets(
                self.unlinked_packets(),
                session_ops.packet_assignments(self.assigned),
                self.sessions,
            ),
            "linked",
        )

    @cached_property
    def features(self) -> DataFrame:
        linked = self.linked  # first, as it stores the sessions beside other work
        return store_stage(feature_ops.extract_features(self.sessions, linked), "features")

    @property
    def raw_labels(self) -> DataFrame:
        return ev.raw_labels(self.sessions)

    @cached_property
    def labeled(self) -> DataFrame:
        """Features with ground_truth_label_id."""
        bare = self.features.withColumn("ground_truth_label_id", F.lit(None).cast("int"))
        return store_stage(
            label_ops.apply_labels(bare, self.raw_labels, self.labels), "labeled"
        )


_TABLES: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, folder: str) -> Tables:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _TABLES:
        apply_sql_defaults(spark, **PACKET_DEFAULTS, **CLEANUP_DEFAULTS)
        ship_package()
        _TABLES[key] = Tables(spark, folder)
    size_shuffles(spark, _TABLES[key].shuffle_partitions)
    return _TABLES[key]


def round6(value: Column) -> Column:
    """Six decimals, halves away from zero in binary, as DuckDB rounds."""
    scaled = F.floor(F.abs(value) * 1e6 + 0.5) / 1e6
    return F.when(F.abs(value) >= 1e9, value).otherwise(
        F.when(value < 0, -scaled).otherwise(scaled)
    )


def publish(df: DataFrame) -> DataFrame:
    """Comparable columns: timestamps as microseconds, doubles to 6 decimals,
    arrays as comma-joined text."""
    out = []
    for field in df.schema:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            value = F.unix_micros(value)
        elif isinstance(field.dataType, (T.DoubleType, T.DecimalType)):
            value = round6(value.cast("double"))
        elif isinstance(field.dataType, T.ArrayType):
            value = F.concat_ws(",", value)
        out.append(value.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL text."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return publish(fn(tables(spark, folder)))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        OPERATORS[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --- SQL text of the derived tables -----------------------------------------

FEATURE_LIST = ", ".join(schemas.FEATURE_COLS)

CTES = {
    "packets": """
SELECT event_id AS packet_id, captured_at,
  CASE WHEN event_type='view' THEN srv ELSE cli END AS src_ip,
  CASE WHEN event_type='view' THEN cli ELSE srv END AS dst_ip,
  CASE WHEN svc=2 THEN NULL WHEN event_type='view' THEN srv_port ELSE cli_port END AS src_port,
  CASE WHEN svc=2 THEN NULL WHEN event_type='view' THEN cli_port ELSE srv_port END AS dst_port,
  CASE svc WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'ICMP' END AS protocol,
  CAST(floor(value*4) AS INTEGER) AS packet_size,
  CASE WHEN svc<>0 THEN NULL WHEN event_type='signup' THEN 'SYN' WHEN event_type='view' THEN 'SYN,ACK'
       WHEN event_type='click' THEN 'ACK' WHEN event_type='purchase' THEN 'PSH,ACK'
       WHEN k % 2 = 0 THEN 'RST' ELSE 'FIN,ACK' END AS tcp_flags,
  sha256(CAST(event_id AS VARCHAR)) AS payload_hash
FROM (SELECT *, k % 3 AS svc,
    '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS cli,
    '203.0.113.' || CAST(user_id % 7 + 1 AS VARCHAR) AS srv,
    CAST(CASE k % 3 WHEN 0 THEN 443 ELSE 53 END AS INTEGER) AS srv_port,
    CAST(49152 + user_id % 16384 AS INTEGER) AS cli_port
  FROM (SELECT event_id, user_id, event_type, value,
      CAST(json_extract_string(props,'$.k') AS INTEGER) AS k,
      make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) // 1000) AS captured_at
    FROM events) e) t""",
    "raw_base": """
SELECT packet_id,
  CASE WHEN packet_id % 101 = 0 THEN 'not-a-time'
       ELSE strftime(captured_at,'%Y-%m-%dT%H:%M:%S.%fZ') END AS captured_at,
  CASE WHEN packet_id % 103 = 0 THEN '' ELSE ' ' || src_ip END AS src_ip,
  CASE WHEN packet_id % 107 = 0 THEN NULL ELSE dst_ip END AS dst_ip,
  CASE WHEN packet_id % 131 = 0 THEN '70000' ELSE CAST(src_port AS VARCHAR) END AS src_port,
  CAST(dst_port AS VARCHAR) AS dst_port,
  CASE WHEN packet_id % 109 = 0 THEN '  ' WHEN packet_id % 2 = 0 THEN lower(protocol) || ' '
       ELSE protocol END AS protocol,
  CASE WHEN packet_id % 113 = 0 THEN '-5' WHEN packet_id % 127 = 0 THEN 'abc'
       ELSE CAST(packet_size AS VARCHAR) END AS packet_size,
  tcp_flags, payload_hash
FROM packets""",
    "raw_packets": "SELECT * FROM raw_base UNION ALL SELECT * FROM raw_base WHERE tcp_flags = 'SYN'",
    "typed_packets": """
SELECT packet_id, try_cast(replace(replace(captured_at,'T',' '),'Z','') AS TIMESTAMP) AS captured_at,
  trim(src_ip) AS src_ip, trim(dst_ip) AS dst_ip,
  CASE WHEN try_cast(src_port AS INTEGER) BETWEEN 0 AND 65535 THEN try_cast(src_port AS INTEGER) END AS src_port,
  CASE WHEN try_cast(dst_port AS INTEGER) BETWEEN 0 AND 65535 THEN try_cast(dst_port AS INTEGER) END AS dst_port,
  upper(trim(protocol)) AS protocol,
  CASE WHEN try_cast(packet_size AS INTEGER) >= 0 THEN try_cast(packet_size AS INTEGER) END AS packet_size,
  tcp_flags, payload_hash
FROM raw_packets""",
    "cleaned": """
SELECT *, errs = '' AS is_valid, errs AS validation_errors FROM (
SELECT *, concat_ws(',',
    CASE WHEN captured_at IS NULL THEN 'invalid_captured_at' END,
    CASE WHEN coalesce(src_ip,'') = '' THEN 'missing_src_ip' END,
    CASE WHEN coalesce(dst_ip,'') = '' THEN 'missing_dst_ip' END,
    CASE WHEN coalesce(protocol,'') = '' THEN 'missing_protocol' END,
    CASE WHEN packet_size IS NULL THEN 'invalid_packet_size' END) AS errs,
  sha256(concat_ws('|', coalesce(strftime(captured_at,'%Y-%m-%dT%H:%M:%S.%fZ'),''),
    coalesce(src_ip,''), coalesce(dst_ip,''), coalesce(CAST(src_port AS VARCHAR),''),
    coalesce(CAST(dst_port AS VARCHAR),''), coalesce(protocol,''),
    coalesce(CAST(packet_size AS VARCHAR),''), coalesce(payload_hash,''))) AS fingerprint
FROM typed_packets) c""",
    "predictions": """
SELECT event_id AS prediction_id, event_id // 2 AS session_id,
  CASE WHEN event_id % 6 = 5 THEN NULL ELSE CAST(1 + event_id % 6 AS INTEGER) END AS predicted_label_id,
  CAST(CAST((event_id * 37) % 10001 AS DECIMAL(9,4)) / 10000 AS DECIMAL(6,5)) AS confidence,
  CASE WHEN event_id % 2 = 0 THEN 'v1_a' ELSE 'v1_b' END AS model_version, ts AS created_at
FROM events""",
    "alerts": """
SELECT event_id AS alert_id, event_id // 2 AS session_id,
  CASE WHEN event_id % 4 <> 0 THEN event_id END AS prediction_id,
  CASE WHEN event_id % 2 = 0 THEN 'ml_prediction' ELSE 'DOS' END AS alert_type,
  CAST(event_id % 5 + 1 AS INTEGER) AS severity,
  CASE event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'acknowledged' ELSE 'resolved' END AS status,
  'high_confidence_non_benign' AS rule_name, 'derived alert' AS description,
  ts AS triggered_at, CASE WHEN event_id % 3 <> 0 THEN ts END AS acknowledged_at
FROM events WHERE event_type = 'error'""",
    "event_runs": """
SELECT event_id AS staged_id, event_type AS source_name, ts, value,
  CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 5 +
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3
  ELSE 4 END AS BIGINT) AS run_id FROM events""",
    "runs": """
SELECT run_id, source_name, '/in/' || source_name AS source_path, min(ts) AS started_at,
  CASE WHEN run_id % 7 <> 0 THEN max(ts) END AS finished_at, count(*) AS rows_received,
  count(*) FILTER (value >= 20) AS rows_inserted, count(*) FILTER (value < 20) AS rows_rejected,
  CASE WHEN run_id % 7 = 0 THEN 'running' WHEN run_id % 5 = 0 THEN 'failed' ELSE 'success' END AS status
FROM event_runs GROUP BY run_id, source_name""",
    "staging": "SELECT staged_id, run_id FROM event_runs",
    "attack_labels": """
SELECT * FROM (VALUES (1,'BENIGN',1),(2,'DOS',4),(3,'PROBE',3),(4,'R2L',5),(5,'U2R',5))
  t(label_id, label_code, severity)""",
    "keyed": """
SELECT *, CASE WHEN sw THEN dst_ip ELSE src_ip END AS low_ip, CASE WHEN sw THEN src_ip ELSE dst_ip END AS high_ip,
  CASE WHEN sw THEN dp ELSE sp END AS low_port, CASE WHEN sw THEN sp ELSE dp END AS high_port,
  upper(protocol) AS flow_protocol
FROM (SELECT *, src_ip > dst_ip OR (src_ip = dst_ip AND sp > dp) AS sw
  FROM (SELECT *, coalesce(CAST(src_port AS VARCHAR),'') AS sp, coalesce(CAST(dst_port AS VARCHAR),'') AS dp
    FROM packets) a) b""",
    "flagged": """
SELECT *, CASE WHEN prev_at IS NULL OR epoch_us(captured_at) - epoch_us(prev_at) > {idle}
    OR coalesce(prev_flags LIKE '%FIN%' OR prev_flags LIKE '%RST%', false) THEN 1 ELSE 0 END AS brk
FROM (SELECT *, lag(captured_at) OVER w AS prev_at, lag(upper(tcp_flags)) OVER w AS prev_flags FROM keyed
  WINDOW w AS (PARTITION BY low_ip, high_ip, low_port, high_port, flow_protocol ORDER BY captured_at, packet_id)) f""",
    "sequenced": """
SELECT *, sum(brk) OVER (PARTITION BY low_ip, high_ip, low_port, high_port, flow_protocol
    ORDER BY captured_at, packet_id) AS session_seq FROM flagged""",
    "started": """
SELECT *, min(captured_at) OVER (PARTITION BY low_ip, high_ip, low_port, high_port, flow_protocol, session_seq)
    AS started_at FROM sequenced""",
    "hashed": """
SELECT *, sha1(unhex('a3f1c8d0e7b44f2a9d6e1c2b3a4f5e6d') || encode(concat_ws('|', low_ip, high_ip, low_port, high_port,
    flow_protocol, strftime(started_at, '%Y-%m-%dT%H:%M:%S') ||
    CASE WHEN epoch_us(started_at) % 1000000 = 0 THEN '' ELSE '.' || strftime(started_at, '%f') END
    || '+00:00'))) AS h FROM started""",
    "assigned": """
SELECT *, substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' ||
    substr('89ab', 1 + (instr('0123456789abcdef', substr(h,17,1)) - 1) % 4, 1) || substr(h,18,3)
    || '-' || substr(h,21,12) AS flow_hash FROM hashed""",
    "built": """
SELECT session_seq, flow_hash, low_ip AS src_ip, high_ip AS dst_ip,
  try_cast(low_port AS INTEGER) AS src_port, try_cast(high_port AS INTEGER) AS dst_port,
  flow_protocol AS protocol, started_at, max(captured_at) AS ended_at, count(*) AS packet_count,
  CAST(sum(packet_size) AS BIGINT) AS total_bytes
FROM assigned GROUP BY ALL""",
    "sessions": """
SELECT row_number() OVER (ORDER BY flow_hash) AS session_id, * FROM (
  SELECT flow_hash, src_ip, dst_ip, src_port, dst_port, protocol, started_at, max(ended_at) AS ended_at,
    CAST(sum(packet_count) AS BIGINT) AS packet_count, CAST(sum(total_bytes) AS BIGINT) AS total_bytes
  FROM built GROUP BY ALL)""",
    "linked": """
SELECT p.packet_id, p.captured_at, p.src_ip, p.dst_ip, p.src_port, p.dst_port, p.protocol, p.packet_size,
  p.tcp_flags, s.session_id, s.src_ip AS session_src FROM assigned p JOIN sessions s USING (flow_hash)""",
    "gaps": """
SELECT session_id, epoch_us(captured_at) - epoch_us(lag(captured_at) OVER
  (PARTITION BY session_id ORDER BY captured_at, packet_id)) AS gap FROM linked""",
    "iat": """
SELECT session_id, coalesce(avg(gap) / 1e6, 0) AS iat_mean, coalesce(stddev_samp(gap) / 1e6, 0) AS iat_std,
  coalesce(min(gap) / 1e6, 0) AS iat_min, coalesce(max(gap) / 1e6, 0) AS iat_max FROM gaps GROUP BY session_id""",
    "ent": """
SELECT session_id, -sum(c / t * log2(c / t)) AS payload_entropy FROM (
  SELECT session_id, packet_size, CAST(count(*) AS DOUBLE) AS c, CAST(sum(count(*)) OVER (PARTITION BY session_id) AS DOUBLE) AS t
  FROM linked GROUP BY session_id, packet_size) GROUP BY session_id""",
    "features": """
SELECT b.session_id, duration_sec, total_bytes, total_packets,
  CASE WHEN duration_sec = 0 THEN 0 ELSE total_bytes / duration_sec END AS bytes_per_sec,
  CASE WHEN duration_sec = 0 THEN 0 ELSE total_packets / duration_sec END AS packets_per_sec,
  iat_mean, iat_std, iat_min, iat_max,
  fwd / greatest(bwd, 1.0) AS fwd_bwd_byte_ratio, abs(payload_entropy) AS payload_entropy,
  unique_dst_ports, avg_packet_size, packet_size_std, has_syn, has_fin, has_rst
FROM (SELECT session_id, (epoch_us(max(captured_at)) - epoch_us(min(captured_at))) / 1e6 AS duration_sec,
    CAST(sum(packet_size) AS BIGINT) AS total_bytes, count(*) AS total_packets,
    CAST(coalesce(sum(packet_size) FILTER (src_ip = session_src), 0) AS DOUBLE) AS fwd,
    CAST(coalesce(sum(packet_size) FILTER (src_ip <> session_src), 0) AS DOUBLE) AS bwd,
    CAST(count(DISTINCT dst_port) AS INTEGER) AS unique_dst_ports,
    avg(packet_size) AS avg_packet_size, coalesce(stddev_samp(packet_size), 0) AS packet_size_std,
    coalesce(bool_or(tcp_flags LIKE '%SYN%'), false) AS has_syn,
    coalesce(bool_or(tcp_flags LIKE '%FIN%'), false) AS has_fin,
    coalesce(bool_or(tcp_flags LIKE '%RST%'), false) AS has_rst
  FROM linked GROUP BY session_id) b JOIN iat USING (session_id) JOIN ent USING (session_id)""",
    "raw_labels": """
SELECT session_id, CASE session_id % 8 WHEN 0 THEN 'BENIGN' WHEN 1 THEN ' DDoS' WHEN 2 THEN 'PortScan' WHEN 3 THEN 'Bot'
  WHEN 4 THEN 'ssh-patator' WHEN 5 THEN 'u2r' WHEN 6 THEN 'mystery' END AS label, session_id AS row_no FROM sessions
UNION ALL SELECT session_id, 'Normal', session_id + 1000000000000 FROM sessions WHERE protocol = 'TCP' AND packet_count = 1
UNION ALL SELECT -session_id - 1, 'dos hulk', session_id FROM sessions WHERE protocol = 'ICMP'""",
    "coded_labels": """
SELECT session_id, row_no, label, CASE lower(trim(label)) WHEN 'ddos' THEN 'DOS' WHEN 'dos hulk' THEN 'DOS'
  WHEN 'portscan' THEN 'PROBE' WHEN 'bot' THEN 'R2L' WHEN 'ssh-patator' THEN 'R2L' WHEN 'u2r' THEN 'U2R'
  ELSE 'BENIGN' END AS label_code FROM raw_labels""",
    "truth": """
SELECT session_id, label_id AS ground_truth_label_id FROM (
  SELECT session_id, arg_max(label_code, row_no) AS label_code FROM coded_labels GROUP BY session_id)
  JOIN attack_labels USING (label_code)""",
    "labeled": "SELECT f.*, t.ground_truth_label_id FROM features f LEFT JOIN truth t USING (session_id)",
    "flow_text": """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_key,
  'flows_' || lower(l_linestatus) || '_' || year(l_shipdate) || '.csv' AS source_file,
  l_linenumber = 7 AS is_header, CAST(l_quantity AS INTEGER) AS qty, CAST(floor(l_extendedprice) AS BIGINT) AS price,
  l_partkey % 65536 AS port, 'flag-' || lower(l_returnflag) AS label FROM lineitem""",
    "flows": """
SELECT row_key, source_file, price * 100 / 1e6 AS duration_sec, CAST(qty * 40 + bwd AS DOUBLE) AS total_bytes,
  CAST(qty + qty % 9 AS DOUBLE) AS total_packets, CAST(price % 1000 AS DOUBLE) AS bytes_per_sec,
  CAST(price % 100 AS DOUBLE) AS packets_per_sec, CAST(price % 11 AS DOUBLE) AS iat_mean,
  CAST(price % 13 AS DOUBLE) AS iat_std, CAST(price % 3 AS DOUBLE) AS iat_min, CAST(price % 17 AS DOUBLE) AS iat_max,
  CAST(qty * 40 AS DOUBLE) / CASE WHEN bwd = 0 THEN 1 ELSE bwd END AS fwd_bwd_byte_ratio, 0.0::DOUBLE AS payload_entropy,
  CAST(port AS DOUBLE) AS unique_dst_ports, CAST(qty * 2 AS DOUBLE) AS avg_packet_size,
  CAST(qty % 4 AS DOUBLE) AS packet_size_std, CAST(qty % 2 AS DOUBLE) AS has_syn, CAST(price % 2 AS DOUBLE) AS has_fin,
  CAST((qty + price) % 2 AS DOUBLE) AS has_rst, upper(label) AS label_code
FROM (SELECT *, CASE WHEN qty % 5 = 0 THEN 0 ELSE qty * 7 END AS bwd FROM flow_text)
WHERE NOT is_header AND qty NOT IN (13, 17, 19)""",
}

# Which tables each table reads.
DEPENDS = {
    "raw_base": ["packets"], "raw_packets": ["raw_base"], "typed_packets": ["raw_packets"],
    "cleaned": ["typed_packets"], "runs": ["event_runs"], "staging": ["event_runs"],
    "keyed": ["packets"], "flagged": ["keyed"], "sequenced": ["flagged"], "started": ["sequenced"],
    "hashed": ["started"], "assigned": ["hashed"], "built": ["assigned"], "sessions": ["built"],
    "linked": ["assigned", "sessions"], "gaps": ["linked"], "iat": ["gaps"], "ent": ["linked"],
    "features": ["linked", "iat", "ent"], "raw_labels": ["sessions"], "coded_labels": ["raw_labels"],
    "truth": ["coded_labels", "attack_labels"], "labeled": ["features", "truth"],
    "flows": ["flow_text"],
}


def with_tables(names: str, body: str, idle_micros: int = 60_000_000) -> str:
    """``body`` preceded by the WITH clause for ``names`` and what they read."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in DEPENDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    parts = []
    for name in ordered:
        text = CTES[name].strip()
        if name == "flagged":
            text = text.replace("{idle}", str(idle_micros))
        parts.append(f"{name} AS ({text})")
    # A body may go on with further tables of its own.
    return f"WITH {', '.join(parts)}\n{body.strip()}"
