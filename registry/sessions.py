"""Sessionization queries."""

from pyspark.sql import functions as F

from packetlake.functions.columns import has_tcp_terminator
from packetlake.operators import sessions as S
from registry.base import query, with_tables

SESSION_OUT = """flow_hash, src_ip, dst_ip, src_port, dst_port, protocol,
  epoch_us(started_at) AS started_at, epoch_us(ended_at) AS ended_at, packet_count, total_bytes"""


@query("scan_unsessionized", with_tables("packets", """
SELECT packet_id, epoch_us(captured_at) AS captured_at, src_ip, dst_ip, src_port, dst_port,
  protocol, packet_size, tcp_flags FROM packets"""))
def _(t):
    return S.scan_unsessionized(t.unlinked_packets())


@query("flow_key", with_tables("keyed", """
SELECT packet_id, low_ip, high_ip, low_port, high_port, flow_protocol FROM keyed"""))
def _(t):
    return S.flow_key(t.packets).select("packet_id", *S.FLOW_KEY)


@query("has_tcp_terminator", with_tables("packets", """
SELECT packet_id, coalesce(upper(tcp_flags) LIKE '%FIN%' OR upper(tcp_flags) LIKE '%RST%', false) AS terminates
FROM packets"""))
def _(t):
    return t.packets.select(
        "packet_id", has_tcp_terminator(F.col("tcp_flags")).alias("terminates")
    )


@query("assign_sessions", with_tables("started", """
SELECT packet_id, CAST(session_seq AS BIGINT) AS session_seq, epoch_us(started_at) AS started_at FROM started"""))
def _(t):
    return S.assign_sessions(t.packets).select("packet_id", "session_seq", "started_at")


@query("build_sessions", with_tables("built", f"SELECT {SESSION_OUT} FROM built"))
def _(t):
    return S.build_sessions(t.packets)


@query("build_sessions_idle_20s", with_tables(
    "built", f"SELECT {SESSION_OUT} FROM built", idle_micros=20_000_000))
def _(t):
    return S.build_sessions(t.packets, idle_seconds=20)


@query("flow_hash", with_tables("assigned", """
SELECT flow_hash, low_ip, high_ip, low_port, high_port, flow_protocol,
  epoch_us(started_at) AS started_at, count(*) AS packets FROM assigned GROUP BY ALL"""))
def _(t):
    return t.assigned.groupBy("flow_hash", *S.FLOW_KEY, "started_at").agg(
        F.count("*").alias("packets")
    )


@query("packet_assignments", with_tables("assigned", "SELECT packet_id, flow_hash FROM assigned"))
def _(t):
    return S.packet_assignments(S.assign_sessions(t.packets))


@query("upsert_sessions", with_tables("sessions", """
SELECT session_id, flow_hash, src_ip, dst_ip, src_port, dst_port, protocol, epoch_us(started_at) AS started_at,
  epoch_us(ended_at) AS ended_at, 2 * packet_count AS packet_count, 2 * total_bytes AS total_bytes
FROM sessions"""))
def _(t):
    # The same batch once more: every session is known and its sums double.
    return S.upsert_sessions(t.sessions, S.build_sessions(t.packets))


@query("link_packets", with_tables("linked", "SELECT packet_id, session_id FROM linked"))
def _(t):
    linked = S.link_packets(
        t.unlinked_packets(), S.packet_assignments(t.assigned), t.sessions
    )
    return linked.select("packet_id", "session_id")


@query("sessionize_increment", with_tables("sessions linked", f"""
SELECT CAST(NULL AS BIGINT) AS packet_id, session_id, {SESSION_OUT} FROM sessions
UNION ALL BY NAME SELECT packet_id, session_id FROM linked"""))
def _(t):
    sessions, packets = S.sessionize_increment(t.unlinked_packets(), t.no_sessions())
    return sessions.unionByName(
        packets.select("packet_id", "session_id"), allowMissingColumns=True
    )
