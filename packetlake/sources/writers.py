"""File sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlake.functions.columns import packet_status, strip_host_mask

# Column headers of the dashboard exports.
PACKET_EXPORT = [
    "Packet ID", "Status", "Timestamp", "Source IP", "Destination IP",
    "Protocol", "Size", "TCP Flags",
]

EXPORT_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_parquet(df: DataFrame, path: str, *partition_by: str, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_packets(packets: DataFrame, path: str, mode: str = "append") -> None:
    """The packet table, partitioned by capture date so that time filters prune."""
    dated = packets.withColumn("capture_date", F.to_date("captured_at"))
    write_parquet(dated, path, "capture_date", mode=mode)


def write_staging(valid: DataFrame, rejected: DataFrame, run_id: int, path: str) -> None:
    """Both row sets of a run in a partition of its own, which retention can
    drop without touching other runs."""
    rows = valid.unionByName(rejected).withColumn("run_id", F.lit(run_id).cast("bigint"))
    write_parquet(rows, path, "run_id", mode="append")


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Header and rows of the current selection, times to the microsecond."""
    out = df.select(*columns) if columns else df
    out.write.option("header", True).option("timestampFormat", EXPORT_TIME).csv(path)


def packets_export(packets: DataFrame) -> DataFrame:
    """The packet list as it is exported."""
    return packets.select(
        F.col("packet_id"),
        packet_status(F.col("packet_size")),
        F.col("captured_at"),
        strip_host_mask(F.col("src_ip")),
        strip_host_mask(F.col("dst_ip")),
        F.col("protocol"),
        F.col("packet_size"),
        F.coalesce("tcp_flags", F.lit("")),
    ).toDF(*PACKET_EXPORT)


def write_report(report: DataFrame, folder: str, stamp: str) -> str:
    """A quality report as ``feature_quality_<stamp>.json``."""
    path = f"{folder}/feature_quality_{stamp}.json"
    report.coalesce(1).write.json(path)  # one record
    return path
