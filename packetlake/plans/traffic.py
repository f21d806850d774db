"""Traffic summaries from partial aggregates, one folder for each run.

A refresh aggregates only the runs that came since the last one; what it stores
merges by sums, minima and maxima. Reports read the partial tables, never the
packets, and equal a full recomputation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetlake.operators.traffic import ACTIVE_MINUTES
from packetlake.plans.batch import PACKET_TABLE_SCHEMA
from packetlake.plans.warehouse import Warehouse
from packetlake.session import store_stage

SOURCES, MINUTES, PAIRS, PROTOCOLS = "traffic_sources", "traffic_minutes", "traffic_pairs", "traffic_protocols"


def _counts() -> list[Column]:
    return [F.count("*").alias("packet_count"), F.sum("packet_size").alias("total_bytes")]


def partials(packets: DataFrame) -> dict[str, DataFrame]:
    """Mergeable aggregates of some packets, with their run_id."""
    seen = [F.min("captured_at").alias("first_seen"), F.max("captured_at").alias("last_seen")]
    minute = F.date_trunc("minute", "captured_at").alias("minute_bucket")
    return {
        SOURCES: packets.groupBy("run_id", F.col("src_ip").alias("ip")).agg(*_counts(), *seen),
        MINUTES: packets.groupBy("run_id", minute, "src_ip").agg(*_counts()),
        # A pair is active while its last packet is recent.
        PAIRS: packets.groupBy("run_id", "src_ip", "dst_ip").agg(F.max("captured_at").alias("last_seen")),
        PROTOCOLS: packets.groupBy("run_id", "protocol").agg(*_counts()),
    }


# Order within a run's files, by which filters skip row groups.
_SORTED = {SOURCES: "packet_count DESC", MINUTES: "minute_bucket DESC", PAIRS: "last_seen DESC"}


def refresh(house: Warehouse) -> list[int]:
    """Aggregate the runs that have no partials yet; returns them. The table of
    protocols is written last, so a run counts only when all tables have it."""
    done = set(house.run_ids(PROTOCOLS))
    waiting = [run for run in house.run_ids("packets") if run not in done]
    for run in waiting:
        packets = house.read_runs("packets", PACKET_TABLE_SCHEMA).filter(F.col("run_id") == run)
        for table, rows in partials(packets).items():
            if table in _SORTED:
                rows = rows.sortWithinPartitions(F.expr(_SORTED[table].split(" ")[0]).desc())
            house.write_run(table, rows, run)
    return waiting


def _read(house: Warehouse, table: str) -> DataFrame:
    """Partials of the runs that all tables have."""
    return house.read_runs(table).filter(F.col("run_id").isin(house.run_ids(PROTOCOLS)))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ip").agg(
        F.sum("packet_count").alias("packet_count"), F.sum("total_bytes").alias("total_bytes"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )


def _kth(counts: DataFrame, k: int) -> int:
    """The k-th largest count, 0 where there are fewer."""
    top = counts.orderBy(F.desc("n")).limit(k).agg(F.count("*").alias("rows"), F.min("n").alias("least")).first()
    return top.least if top.rows == k else 0


def top_sources(partial: DataFrame, k: int, runs: int) -> DataFrame:
    """The k sources with most packets over ``runs`` partial lists, exact.

    Three phases. Sums over each list's first k rows give a lower bound of the
    k-th total; a source below that bound over the number of lists in all lists
    is out. Sums over the rows that reach this share give a better bound, and
    for each source an upper one: what it may have in the other lists. Only
    sources whose upper bound reaches the lower one are summed in full.
    """
    heads = partial.withColumn(
        "rank", F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("packet_count"), "ip"))
    ).filter(F.col("rank") <= k)
    bound = _kth(heads.groupBy("ip").agg(F.sum("packet_count").alias("n")), k)
    share = max(1, -(-bound // runs))
    large = store_stage(
        partial.filter(F.col("packet_count") >= share)
        .groupBy("ip").agg(F.sum("packet_count").alias("n"), F.count("*").alias("lists")), "large-sources",
    )
    better = max(bound, _kth(large, k))
    # In a list where it does not reach the share it has less than that.
    upper = F.col("n") + (F.lit(runs) - F.col("lists")) * (share - 1)
    candidates = large.filter(upper >= better).select("ip")
    return (
        _merged(partial.join(candidates, "ip", "left_semi"))
        .orderBy(F.desc("packet_count"), "ip").limit(k)
    )


def top_ips(house: Warehouse, k: int = 100) -> DataFrame:
    """Sources with the most packets."""
    runs = len(house.run_ids(PROTOCOLS))
    return top_sources(_read(house, SOURCES), k, max(runs, 1))


def traffic_trends(house: Warehouse, k: int = 100) -> DataFrame:
    """The newest ``k`` minutes; older rows of the partials are skipped."""
    rows = _read(house, MINUTES)
    newest = rows.select("minute_bucket").distinct().orderBy(F.desc("minute_bucket")).limit(k)
    oldest = newest.agg(F.min("minute_bucket").alias("m")).first().m
    by_source = rows.filter(F.col("minute_bucket") >= F.lit(oldest)).groupBy("minute_bucket", "src_ip").agg(
        F.sum("packet_count").alias("packets"), F.sum("total_bytes").alias("bytes")
    )
    return by_source.groupBy("minute_bucket").agg(
        F.sum("packets").alias("packets_per_minute"), F.sum("bytes").alias("bytes_per_minute"),
        F.count("*").alias("active_source_ips"),
    ).orderBy(F.desc("minute_bucket")).limit(k)


def protocol_distribution(house: Warehouse, refreshed_at: Column) -> DataFrame:
    return (
        _read(house, PROTOCOLS).groupBy("protocol")
        .agg(F.sum("packet_count").alias("packet_count"), F.sum("total_bytes").alias("total_bytes"))
        .withColumn("refreshed_at", refreshed_at)
    )


def live_metrics(house: Warehouse, alerts: DataFrame, as_of: Column) -> DataFrame:
    """One row: packets, pairs active in the last two minutes, open alerts and
    the newest capture time."""
    recent = as_of - F.expr(f"INTERVAL {ACTIVE_MINUTES} MINUTES")
    pairs = _read(house, PAIRS)
    active = pairs.filter(F.col("last_seen") >= recent).select("src_ip", "dst_ip").distinct()
    return _read(house, PROTOCOLS).agg(F.sum("packet_count").alias("packet_count")).select(
        F.coalesce("packet_count", F.lit(0).cast(T.LongType())).alias("packet_count"),
        active.agg(F.count("*")).scalar().alias("active_sessions"),
        pairs.agg(F.max("last_seen")).scalar().alias("last_ingestion"),
        alerts.filter(F.col("status") == "open").agg(F.count("*")).scalar().alias("open_alerts"),
    )
