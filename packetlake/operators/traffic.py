"""Traffic summaries behind the dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetlake.functions.columns import round_half_up, severity_bucket

ACTIVE_MINUTES = 2
RATE_SAMPLES = 60
SHARE_PACKETS = 500


def top_ips(packets: DataFrame, k: int = 100) -> DataFrame:
    """Sources with the most packets."""
    return (
        packets.groupBy(F.col("src_ip").alias("ip"))
        .agg(
            F.count("*").alias("packet_count"),
            F.sum("packet_size").alias("total_bytes"),
            F.min("captured_at").alias("first_seen"),
            F.max("captured_at").alias("last_seen"),
        )
        .orderBy(F.desc("packet_count"), "ip")
        .limit(k)
    )


def per_minute(packets: DataFrame) -> DataFrame:
    """Packets, bytes and distinct sources per minute."""
    return packets.groupBy(
        F.date_trunc("minute", "captured_at").alias("minute_bucket")
    ).agg(
        F.count("*").alias("packets_per_minute"),
        F.sum("packet_size").alias("bytes_per_minute"),
        F.count_distinct("src_ip").alias("active_source_ips"),
    )


def traffic_trends(packets: DataFrame, k: int = 100) -> DataFrame:
    """The newest ``k`` minutes."""
    return per_minute(packets).orderBy(F.desc("minute_bucket")).limit(k)


def protocol_distribution(packets: DataFrame, refreshed_at: Column) -> DataFrame:
    return (
        packets.groupBy("protocol")
        .agg(F.count("*").alias("packet_count"), F.sum("packet_size").alias("total_bytes"))
        .withColumn("refreshed_at", refreshed_at)
    )


def protocol_share(packets: DataFrame, newest: int = SHARE_PACKETS, k: int = 6) -> DataFrame:
    """Whole-percent protocol mix of the newest packets; NO_DATA if none."""
    recent = packets.orderBy(F.desc("captured_at"), F.desc("packet_id")).limit(newest)
    name = F.upper(F.coalesce(F.nullif(F.col("protocol"), F.lit("")), F.lit("OTHER")))
    counts = recent.groupBy(name.alias("name")).agg(F.count("*").alias("_n"))
    # At most ``newest`` packets reach this window.
    percent = F.col("_n") / F.sum("_n").over(W.partitionBy()) * 100
    share = (
        counts.select("name", F.greatest(F.lit(1), round_half_up(percent)).alias("value"))
        .orderBy(F.desc("value"), "name")
        .limit(k)
    )
    placeholder = packets.limit(1).agg(F.count("*").alias("_n")).filter("_n = 0").select(
        F.lit("NO_DATA").alias("name"), F.lit(100).cast("bigint").alias("value")
    )
    return share.unionByName(placeholder)


def traffic_megabits(trends: DataFrame) -> DataFrame:
    """Whole megabits per minute, oldest first."""
    bits = F.coalesce("bytes_per_minute", F.lit(0)) * 8
    return trends.select(
        "minute_bucket", round_half_up(bits / 1_000_000).alias("traffic")
    ).orderBy("minute_bucket")


def peak_traffic(megabits: DataFrame) -> DataFrame:
    return megabits.agg(F.coalesce(F.max("traffic"), F.lit(0)).alias("peak_megabits"))


def latest_rate(trends: DataFrame) -> DataFrame:
    """Megabits per second of the newest minute, 2 decimals."""
    newest = F.max_by("bytes_per_minute", "minute_bucket")
    return trends.agg(
        F.round(F.coalesce(newest, F.lit(0)) * 8 / 1_000_000 / 60, 2).alias("megabits_per_sec")
    )


def confidence_histogram(predictions: DataFrame) -> DataFrame:
    """Predictions per model version in five bins of width 0.2, empty bins
    included; the last bin is closed."""
    per_version = predictions.groupBy("model_version").agg(*[
        F.count_if(_bin(F.col("confidence")) == i).alias(_bin_name(i)) for i in range(5)
    ])
    return per_version.unpivot(
        ["model_version"], [_bin_name(i) for i in range(5)], "range", "count"
    )


def _bin(confidence: Column) -> Column:
    return F.least(F.floor(confidence * 5), F.lit(4))


def _bin_name(i: int) -> str:
    return f"{i * 20}-{i * 20 + 20}%"


def severity_buckets(alerts: DataFrame, high_name: str = "critical") -> DataFrame:
    return alerts.groupBy(severity_bucket(F.col("severity"), high_name).alias("bucket")).agg(
        F.count("*").alias("alerts")
    )


def avg_packet_size(sessions: DataFrame) -> DataFrame:
    """Whole bytes per packet of each session, 0 without packets."""
    size = F.when(F.col("packet_count") > 0, round_half_up(
        F.col("total_bytes") / F.col("packet_count")
    )).otherwise(0)
    return sessions.select("session_id", size.alias("avg_packet_size"))


def live_metrics(packets: DataFrame, alerts: DataFrame, as_of: Column) -> DataFrame:
    """One row: packets, flows active in the last two minutes, open alerts and
    the newest capture time."""
    recent = F.col("captured_at") >= as_of - F.expr(f"INTERVAL {ACTIVE_MINUTES} MINUTES")
    open_alerts = (
        alerts.filter(F.col("status") == "open").agg(F.count("*").alias("n")).scalar()
    )
    return packets.agg(
        F.count("*").alias("packet_count"),
        F.count_distinct(F.when(recent, F.struct("src_ip", "dst_ip"))).alias("active_sessions"),
        F.max("captured_at").alias("last_ingestion"),
    ).withColumn("open_alerts", open_alerts)


def rate_from_counts(samples: DataFrame, keep: int = RATE_SAMPLES) -> DataFrame:
    """Growth between neighbouring (sampled_at, packet_count) samples, never
    below zero, for the newest ``keep`` samples.

    Only ``keep + 1`` samples are kept before they are ordered in one task.
    """
    newest = samples.orderBy(F.desc("sampled_at")).limit(keep + 1)
    by_time = W.orderBy("sampled_at")
    growth = F.col("packet_count") - F.lag("packet_count").over(by_time)
    return (
        newest.select(
            "sampled_at", "packet_count",
            F.greatest(F.coalesce(growth, F.lit(0)), F.lit(0)).alias("pps"),
        )
        .orderBy(F.desc("sampled_at"))
        .limit(keep)
    )
