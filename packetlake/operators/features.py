"""The 17-column feature vector of a session.

``session_moments`` reduces packets to mergeable sums per session and
``finish_features`` turns those sums into the vector. The streaming operator
keeps the same sums as state and ends in the same ``finish_features``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetlake.functions.columns import (
    MICROS,
    has_flag,
    safe_div,
    seconds_between,
    time_slice,
)
from packetlake.functions.ordered import carry_slices
from packetlake.schemas import FEATURE_COLS, FLAG_FEATURES

SLICE_SECONDS = 10.0
EXACT = "decimal(38,0)"


def sample_std(count: Column, total: Column, squares: Column) -> Column:
    """Sample deviation from exact integer sums, 0.0 below two values.

    The sums are decimals, so equal values give exactly zero.
    """
    spread = count.cast(EXACT) * squares - total.cast(EXACT) * total.cast(EXACT)
    n = count.cast("double")
    return F.when(
        count > 1, F.sqrt(spread.cast("double") / (n * (n - 1)))
    ).otherwise(F.lit(0.0))


def packet_gaps(
    packets: DataFrame, key: str = "session_id", slice_seconds: float = SLICE_SECONDS
) -> DataFrame:
    """(key, gap in microseconds) between neighbouring packets of a key."""
    rows = packets.select(
        key,
        F.unix_micros("captured_at").alias("_at"),
        time_slice(F.col("captured_at"), slice_seconds).alias("_slice"),
    ).filter(F.col(key).isNotNull())
    in_slice = W.partitionBy(key, "_slice").orderBy("_at")
    inner = rows.select(key, (F.col("_at") - F.lag("_at").over(in_slice)).alias("gap"))
    outer = carry_slices(
        rows,
        [key],
        "_slice",
        [F.min("_at").alias("_first"), F.max("_at").alias("_last")],
        lambda w: [(F.col("_first") - F.lag("_last").over(w)).alias("gap")],
    )
    return inner.unionByName(outer.select(key, "gap")).filter(F.col("gap").isNotNull())


def iat_stats(packets: DataFrame, key: str = "session_id") -> DataFrame:
    """Inter-arrival mean, sample deviation, minimum and maximum in seconds.

    Keys with fewer than two packets have no row; ``iat_defaults`` fills them.
    """
    gap = F.col("gap")
    return (
        packet_gaps(packets, key)
        .groupBy(key)
        .agg(
            F.count("*").alias("_gaps"),
            F.sum(gap.cast(EXACT)).alias("_sum"),
            F.sum(gap.cast(EXACT) * gap.cast(EXACT)).alias("_squares"),
            F.min(gap).alias("_min"),
            F.max(gap).alias("_max"),
        )
        .select(
            key,
            (F.col("_sum").cast("double") / F.col("_gaps") / MICROS).alias("iat_mean"),
            (
                sample_std(
                    F.col("_gaps"), F.col("_sum"), F.col("_squares").cast(EXACT)
                ) / MICROS
            ).alias("iat_std"),
            (F.col("_min") / float(MICROS)).alias("iat_min"),
            (F.col("_max") / float(MICROS)).alias("iat_max"),
        )
    )


def payload_entropy(packets: DataFrame, key: str = "session_id") -> DataFrame:
    """Base-2 Shannon entropy of the packet sizes per key, nulls left out."""
    sizes = (
        packets.filter(F.col("packet_size").isNotNull())
        .groupBy(key, "packet_size")
        .agg(F.count("*").alias("_n"))
    )
    return sizes.groupBy(key).agg(
        entropy(F.sum("_n"), F.sum(F.col("_n") * F.log2("_n"))).alias("payload_entropy")
    )


def entropy(count: Column, sum_n_log_n: Column) -> Column:
    """log2(N) - sum(n log2 n) / N, never below zero."""
    return F.greatest(F.log2(count) - sum_n_log_n / count, F.lit(0.0))


def unique_dst_ports(packets: DataFrame, key: str = "session_id") -> DataFrame:
    """Distinct non-null destination ports per key, both directions counted."""
    return packets.groupBy(key).agg(
        F.count_distinct("dst_port").cast("int").alias("unique_dst_ports")
    )


def session_moments(sessions: DataFrame, packets: DataFrame) -> DataFrame:
    """Sums per session_id from which the vector is finished.

    Packets first collapse to one cell per (session, source, size), so a
    session with very many packets joins its row with few cells.
    """
    cells = (
        packets.filter(F.col("session_id").isNotNull())
        .groupBy("session_id", "src_ip", "packet_size")
        .agg(
            F.count("*").alias("_n"),
            F.min("captured_at").alias("_first"),
            F.max("captured_at").alias("_last"),
            *[
                F.max(has_flag(F.col("tcp_flags"), name[4:].upper())).alias(name)
                for name in FLAG_FEATURES
            ],
        )
    )
    size = F.col("packet_size").cast(EXACT)
    bytes_ = F.col("_n") * F.col("packet_size").cast("bigint")
    forward = F.col("src_ip") == F.col("_session_src")
    by_size = (
        cells.join(
            sessions.select("session_id", F.col("src_ip").alias("_session_src")),
            "session_id",
        )
        .groupBy("session_id", "packet_size")
        .agg(
            F.sum("_n").alias("_n"),
            F.sum(F.when(forward, bytes_).otherwise(0)).alias("_fwd"),
            F.sum(F.when(forward, 0).otherwise(bytes_)).alias("_bwd"),
            F.min("_first").alias("_first"),
            F.max("_last").alias("_last"),
            *[F.max(name).alias(name) for name in FLAG_FEATURES],
        )
    )
    n = F.when(F.col("packet_size").isNotNull(), F.col("_n"))
    return by_size.groupBy("session_id").agg(
        F.min("_first").alias("first_at"),
        F.max("_last").alias("last_at"),
        F.sum("_n").alias("packets"),
        F.coalesce(F.sum(n), F.lit(0)).alias("sized_packets"),
        F.coalesce(F.sum("_fwd"), F.lit(0)).alias("fwd_bytes"),
        F.coalesce(F.sum("_bwd"), F.lit(0)).alias("bwd_bytes"),
        F.coalesce(F.sum((F.col("_n") * size * size).cast(EXACT)), F.lit(0))
        .cast(EXACT).alias("size_squares"),
        F.coalesce(F.sum(n * F.log2(n)), F.lit(0.0)).alias("size_n_log_n"),
        *[F.max(name).alias(name) for name in FLAG_FEATURES],
    )


def finish_features(moments: DataFrame, *extra: str) -> DataFrame:
    """session_id (and ``extra`` columns) with the vector, from the sums,
    ``unique_dst_ports`` and the four inter-arrival columns."""
    total = F.col("fwd_bytes") + F.col("bwd_bytes")
    duration = seconds_between(F.col("first_at"), F.col("last_at"))
    sized = F.col("sized_packets")
    computed = {
        "duration_sec": duration,
        "total_bytes": total,
        "total_packets": F.col("packets"),
        "bytes_per_sec": safe_div(total, duration),
        "packets_per_sec": safe_div(F.col("packets"), duration),
        "fwd_bwd_byte_ratio": fwd_bwd_ratio(F.col("fwd_bytes"), F.col("bwd_bytes")),
        "payload_entropy": F.when(
            sized > 0, entropy(sized, F.col("size_n_log_n"))
        ).otherwise(0.0),
        "unique_dst_ports": F.coalesce("unique_dst_ports", F.lit(0)),
        "avg_packet_size": safe_div(total, sized),
        "packet_size_std": sample_std(sized, total, F.col("size_squares")),
    }
    for name in ("iat_mean", "iat_std", "iat_min", "iat_max"):
        computed[name] = F.coalesce(name, F.lit(0.0))
    return moments.select(
        "session_id",
        *extra,
        *[computed.get(name, F.col(name)).alias(name) for name in FEATURE_COLS],
    )


def fwd_bwd_ratio(forward: Column, backward: Column) -> Column:
    return forward.cast("double") / F.greatest(backward.cast("double"), F.lit(1.0))


def extract_features(sessions: DataFrame, packets: DataFrame) -> DataFrame:
    """session_id and the 17 features; sessions without packets get zeros."""
    with_packets = finish_features(
        session_moments(sessions, packets)
        .join(unique_dst_ports(packets.filter(F.col("session_id").isNotNull())), "session_id", "left")
        .join(iat_stats(packets), "session_id", "left")
    )
    return with_empty_rows(sessions, with_packets)


def with_empty_rows(sessions: DataFrame, features: DataFrame) -> DataFrame:
    """Add a zero/false row for every session that has no feature row."""
    types = dict(features.dtypes)
    zero = lambda name: F.lit(False) if name in FLAG_FEATURES else F.lit(0)
    return sessions.select("session_id").join(features, "session_id", "left").select(
        "session_id",
        *[F.coalesce(F.col(c), zero(c).cast(types[c])).alias(c) for c in FEATURE_COLS],
    )


def sessions_without_features(sessions: DataFrame, features: DataFrame) -> DataFrame:
    return sessions.join(features.select("session_id"), "session_id", "left_anti")


def upsert_features(existing: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The feature table after the upsert: new values win, a row's label stays,
    ``computed_at`` moves to ``now`` for every row of ``new``."""
    old, fresh = existing.alias("old"), new.alias("new")
    is_new = F.col("new.session_id").isNotNull()
    return old.join(fresh, F.col("old.session_id") == F.col("new.session_id"), "full_outer").select(
        F.coalesce("new.session_id", "old.session_id").alias("session_id"),
        *[
            F.when(is_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
            for c in FEATURE_COLS
        ],
        F.col("old.ground_truth_label_id").alias("ground_truth_label_id"),
        F.when(is_new, now).otherwise(F.col("old.computed_at")).alias("computed_at"),
    )


def port_fanout(
    packets: DataFrame, window_seconds: float = 60.0, slice_seconds: float = 600.0
) -> DataFrame:
    """Per packet, distinct destination ports its source used in the trailing
    window (both ends included).

    Each (source, port) is a set of spans during which the port counts; the
    answer at a time is spans begun minus spans ended, a running sum per
    source over time slices, so no set is ever built.
    """
    width = int(window_seconds * MICROS)
    rows = packets.select(
        "packet_id",
        "src_ip",
        "dst_port",
        F.unix_micros("captured_at").alias("_at"),
        time_slice(F.col("captured_at"), slice_seconds).alias("_slice"),
    )
    known = rows.filter(F.col("dst_port").isNotNull())
    port_key = ["src_ip", "dst_port"]
    in_slice = W.partitionBy(*port_key, "_slice").orderBy("_at", "packet_id")
    neighbours = carry_slices(
        known,
        port_key,
        "_slice",
        [F.min("_at").alias("_first"), F.max("_at").alias("_last")],
        lambda w: [
            F.lag("_last").over(w).alias("_slice_prev"),
            F.lead("_first").over(w).alias("_slice_next"),
        ],
    )
    spans = (
        known.withColumn("_prev", F.lag("_at").over(in_slice))
        .withColumn("_next", F.lead("_at").over(in_slice))
        .join(neighbours, [*port_key, "_slice"])
        .withColumn("_prev", F.coalesce("_prev", "_slice_prev"))
        .withColumn("_next", F.coalesce("_next", "_slice_next"))
    )
    begins = F.coalesce(F.col("_at") - F.col("_prev") > width, F.lit(True))
    ends = F.coalesce(F.col("_next") - F.col("_at") > width, F.lit(True))
    # One time line per source: packets and span starts first, ends after.
    steps = spans.select(
        "packet_id", "src_ip", "_at", F.lit(0).alias("_kind"),
        begins.cast("int").alias("_step"),
    ).unionByName(
        rows.filter(F.col("dst_port").isNull()).select(
            "packet_id", "src_ip", "_at", F.lit(0).alias("_kind"), F.lit(0).alias("_step")
        )
    ).unionByName(
        spans.filter(ends).select(
            F.lit(None).cast("bigint").alias("packet_id"), "src_ip",
            (F.col("_at") + width).alias("_at"), F.lit(1).alias("_kind"),
            F.lit(-1).alias("_step"),
        )
    ).withColumn("_slice", F.floor(F.col("_at") / int(slice_seconds * MICROS)))
    offsets = carry_slices(
        steps,
        ["src_ip"],
        "_slice",
        [F.sum("_step").alias("_steps")],
        lambda w: [(F.sum("_steps").over(w) - F.col("_steps")).alias("_open")],
    )
    on_line = W.partitionBy("src_ip", "_slice").orderBy("_at", "_kind")
    return (
        steps.withColumn("_here", F.sum("_step").over(on_line))
        .filter(F.col("packet_id").isNotNull())
        .join(offsets, ["src_ip", "_slice"])
        .select(
            "packet_id", "src_ip",
            (F.col("_open") + F.col("_here")).alias("port_fanout"),
        )
    )
