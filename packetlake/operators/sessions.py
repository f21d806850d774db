"""Group packets into bidirectional flow sessions.

A session ends when the idle gap is exceeded or after a packet that carries a
TCP terminator. Packets are ordered per flow by ``captured_at, packet_id``.
All ordering runs on (flow, time slice), see ``functions.ordered``: one flow
may hold a large share of all packets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetlake.functions.columns import (
    MICROS,
    has_tcp_terminator,
    isoformat_utc,
    port_text,
    time_slice,
    uuid5,
)
from packetlake.functions.ordered import carry_slices, hashed_row_number, slice_window

IDLE_SECONDS = 60.0
SLICE_SECONDS = 10.0

FLOW_KEY = ["low_ip", "high_ip", "low_port", "high_port", "flow_protocol"]
UNSESSIONIZED_COLS = [
    "packet_id", "captured_at", "src_ip", "dst_ip",
    "src_port", "dst_port", "protocol", "packet_size", "tcp_flags",
]
SESSION_COLS = [
    "flow_hash", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
    "started_at", "ended_at", "packet_count", "total_bytes",
]


def scan_unsessionized(packets: DataFrame) -> DataFrame:
    """Packets without a session, only the columns sessionization reads."""
    return packets.filter(F.col("session_id").isNull()).select(*UNSESSIONIZED_COLS)


def flow_key_columns() -> list[Column]:
    """The canonical flow key of a packet; both directions give the same key.

    Endpoints compare as text, address first, then port.
    """
    src_port, dst_port = port_text(F.col("src_port")), port_text(F.col("dst_port"))
    swap = (F.col("src_ip") > F.col("dst_ip")) | (
        (F.col("src_ip") == F.col("dst_ip")) & (src_port > dst_port)
    )

    def pick(if_swapped: Column, otherwise: Column, name: str) -> Column:
        return F.when(swap, if_swapped).otherwise(otherwise).alias(name)

    return [
        pick(F.col("dst_ip"), F.col("src_ip"), "low_ip"),
        pick(F.col("src_ip"), F.col("dst_ip"), "high_ip"),
        pick(dst_port, src_port, "low_port"),
        pick(src_port, dst_port, "high_port"),
        F.upper("protocol").alias("flow_protocol"),
    ]


def flow_key(packets: DataFrame) -> DataFrame:
    return packets.select("*", *flow_key_columns())


def flow_hash() -> Column:
    """Session identifier from the flow key and the session's start."""
    return uuid5(F.concat_ws("|", *FLOW_KEY, isoformat_utc(F.col("started_at"))))


def _micros_after(earlier: Column, later: Column) -> Column:
    return F.unix_micros(later) - F.unix_micros(earlier)


def _sliced_flows(
    packets: DataFrame, idle_seconds: float, slice_seconds: float
) -> DataFrame:
    """Packets with flow key, time slice and the breaks seen inside the slice."""
    in_slice = W.partitionBy(*FLOW_KEY, "_slice").orderBy("captured_at", "packet_id")
    upto_here = in_slice.rowsBetween(W.unboundedPreceding, W.currentRow)
    idle = int(idle_seconds * MICROS)
    gap = _micros_after(F.lag("captured_at").over(in_slice), F.col("captured_at"))
    return (
        packets.select(
            "*",
            *flow_key_columns(),
            time_slice(F.col("captured_at"), slice_seconds).alias("_slice"),
            has_tcp_terminator(F.col("tcp_flags")).alias("_ends"),
        )
        .withColumn(
            "_break",
            F.coalesce((gap > idle) | F.lag("_ends").over(in_slice), F.lit(False)),
        )
        .withColumn("_local", F.sum(F.col("_break").cast("bigint")).over(upto_here))
        .withColumn("_last", F.lead("packet_id").over(in_slice).isNull())
        .withColumn("_tail", F.col("_last") & F.col("_ends"))
    )


def _slice_carry(sliced: DataFrame, idle_seconds: float) -> DataFrame:
    """Per slice: sessions started before it and when its open session began."""
    idle = int(idle_seconds * MICROS)

    def carried(window: W) -> list[Column]:
        gap = _micros_after(F.lag("_last_at").over(window), F.col("_first_at"))
        starts = F.coalesce(
            (gap > idle) | F.lag("_last_ends").over(window), F.lit(True)
        )
        return [
            F.col("_breaks"), F.col("_first_at"), F.col("_last_break"),
            starts.alias("_starts"),
        ]

    summary = carry_slices(
        sliced,
        FLOW_KEY,
        "_slice",
        [
            F.min("captured_at").alias("_first_at"),
            F.max("captured_at").alias("_last_at"),
            F.max("_tail").alias("_last_ends"),
            F.max("_local").alias("_breaks"),
            F.max(F.when(F.col("_break"), F.col("captured_at"))).alias("_last_break"),
        ],
        carried,
    )
    window = slice_window(FLOW_KEY, "_slice")
    before = window.rowsBetween(W.unboundedPreceding, -1)
    upto = window.rowsBetween(W.unboundedPreceding, W.currentRow)
    started = F.col("_starts").cast("bigint")
    newest_start = F.coalesce(
        F.col("_last_break"), F.when(F.col("_starts"), F.col("_first_at"))
    )
    return summary.select(
        *FLOW_KEY,
        "_slice",
        # Sequence number of the session the slice's first packet belongs to.
        (F.sum(started + F.col("_breaks")).over(upto) - F.col("_breaks")).alias("_base"),
        F.when(F.col("_starts"), F.col("_first_at"))
        .otherwise(F.last(newest_start, ignorenulls=True).over(before))
        .alias("_head_start"),
    )


def assign_sessions(
    packets: DataFrame,
    idle_seconds: float = IDLE_SECONDS,
    slice_seconds: float = SLICE_SECONDS,
) -> DataFrame:
    """Every packet with ``session_seq`` (per flow, from 1), ``started_at`` of
    its session and ``flow_hash``."""
    sliced = _sliced_flows(packets, idle_seconds, slice_seconds)
    in_slice = (
        W.partitionBy(*FLOW_KEY, "_slice")
        .orderBy("captured_at", "packet_id")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    local_start = F.last(
        F.when(F.col("_break"), F.col("captured_at")), ignorenulls=True
    ).over(in_slice)
    rows = sliced.withColumn("_local_start", local_start)
    return (
        rows.join(_slice_carry(sliced, idle_seconds), [*FLOW_KEY, "_slice"])
        .withColumn("session_seq", F.col("_base") + F.col("_local"))
        .withColumn("started_at", F.coalesce("_local_start", "_head_start"))
        .withColumn("flow_hash", flow_hash())
        .select(*packets.columns, *FLOW_KEY, "session_seq", "started_at", "flow_hash")
    )


def build_sessions(
    packets: DataFrame,
    idle_seconds: float = IDLE_SECONDS,
    slice_seconds: float = SLICE_SECONDS,
) -> DataFrame:
    """One row per session with its time span, packet count and bytes.

    Packets shrink to one fragment per (slice, session) where they were
    sorted. Only the first and the last fragment of a slice can belong to a
    session that crosses slices: those meet per flow, at most two per slice.
    All other fragments are whole sessions and keep partitions of their own,
    so one shuffle of fragments serves both without a join.
    """
    fragments = _sliced_flows(packets, idle_seconds, slice_seconds).groupBy(
        *FLOW_KEY, "_slice", "_local"
    ).agg(
        F.min("captured_at").alias("_from"),
        F.max("captured_at").alias("_to"),
        F.count("*").alias("_packets"),
        F.sum("packet_size").alias("_bytes"),
        F.max("_last").alias("_is_tail"),
        F.max("_tail").alias("_ended"),
    )
    crosses = (F.col("_local") == 0) | F.col("_is_tail")
    place = ["_own_slice", "_own_local"]
    placed = fragments.withColumns({
        name: F.when(~crosses, F.col(column))
        for name, column in zip(place, ("_slice", "_local"))
    })
    in_flow = W.partitionBy(*FLOW_KEY, *place).orderBy("_slice", "_local")
    gap = _micros_after(F.lag("_to").over(in_flow), F.col("_from"))
    starts = F.coalesce(
        (F.col("_local") > 0) | (gap > int(idle_seconds * MICROS))
        | F.lag("_ended").over(in_flow),
        F.lit(True),
    )
    number = F.sum(F.col("_starts").cast("bigint")).over(
        in_flow.rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        placed.withColumn("_starts", starts)
        .withColumn("_number", number)
        .groupBy(*FLOW_KEY, *place, "_number")
        .agg(
            F.min("_from").alias("started_at"),
            F.max("_to").alias("ended_at"),
            F.sum("_packets").alias("packet_count"),
            F.sum("_bytes").alias("total_bytes"),
        )
        .select(
            flow_hash().alias("flow_hash"),
            F.col("low_ip").alias("src_ip"),
            F.col("high_ip").alias("dst_ip"),
            F.col("low_port").try_cast("int").alias("src_port"),
            F.col("high_port").try_cast("int").alias("dst_port"),
            F.col("flow_protocol").alias("protocol"),
            "started_at",
            "ended_at",
            "packet_count",
            "total_bytes",
        )
    )


def packet_assignments(assigned: DataFrame) -> DataFrame:
    """packet_id -> flow_hash."""
    return assigned.select("packet_id", "flow_hash")


def upsert_sessions(existing: DataFrame, new: DataFrame, last_id: int | None = None) -> DataFrame:
    """The sessions table after inserting ``new``; a known flow_hash keeps its
    row but takes the later end and adds packets and bytes.

    ``existing`` has session_id. Rows new to the table get the next ids, in
    flow_hash order. Sessions of ``new`` that share a flow_hash merge too.
    Where ``existing`` is only part of the table, ``last_id`` is the highest id
    in use.
    """
    kept = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "started_at"]
    both = existing.select("session_id", *SESSION_COLS).unionByName(
        new.select(F.lit(None).cast("bigint").alias("session_id"), *SESSION_COLS)
    )
    # A shared flow_hash means the same flow and start, so any row's kept
    # columns will do.
    merged = both.groupBy("flow_hash").agg(
        F.max("session_id").alias("session_id"),
        *[F.first(name).alias(name) for name in kept],
        F.max("ended_at").alias("ended_at"),
        F.sum("packet_count").alias("packet_count"),
        F.sum("total_bytes").alias("total_bytes"),
    )
    known = merged.filter(F.col("session_id").isNotNull())
    fresh = merged.filter(F.col("session_id").isNull()).drop("session_id")
    if last_id is None:
        last = existing.agg(F.coalesce(F.max("session_id"), F.lit(0)).alias("m")).scalar()
    else:
        last = F.lit(last_id)
    numbered = hashed_row_number(
        fresh, [], F.replace("flow_hash", F.lit("-"), F.lit("")), "_rank"
    ).withColumn("session_id", (last + F.col("_rank")).cast("bigint"))
    return known.select("session_id", *SESSION_COLS).unionByName(
        numbered.select("session_id", *SESSION_COLS)
    )


def session_ids(assignments: DataFrame, sessions: DataFrame) -> DataFrame:
    """packet_id -> session_id.

    A session of very many packets makes one partition of the packets' side
    large. The join keeps all packets and asks for no order afterwards, so
    adaptive execution splits such a partition and repeats its sessions.
    """
    ids = sessions.select("flow_hash", "session_id")
    return assignments.join(ids, "flow_hash", "left").select("packet_id", "session_id")


def link_packets(
    packets: DataFrame, assignments: DataFrame, sessions: DataFrame
) -> DataFrame:
    """Packets with session_id set from their assignment."""
    resolved = session_ids(assignments, sessions).withColumnRenamed("session_id", "_new_id")
    return (
        packets.join(resolved, "packet_id", "left")
        .withColumn("session_id", F.coalesce("_new_id", "session_id"))
        .select(*packets.columns)
    )


def sessionize_increment(
    packets: DataFrame, sessions: DataFrame, idle_seconds: float = IDLE_SECONDS
) -> tuple[DataFrame, DataFrame]:
    """One incremental run over the packets that have no session yet.

    Returns the sessions table and the packets table after the run.
    """
    open_packets = scan_unsessionized(packets)
    assigned = assign_sessions(open_packets, idle_seconds)
    merged = upsert_sessions(sessions, build_sessions(open_packets, idle_seconds))
    return merged, link_packets(packets, packet_assignments(assigned), merged)
