"""Network tables derived from the generic ``events`` and ``lineitem`` tables.

The derivation is row-wise and deterministic, so the tables grow with their
inputs. It gives tests, the benchmark and the registered queries realistic
traffic: bidirectional TCP/UDP/ICMP flows, terminators, dirty text fields,
predictions, alerts and audit rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlake.functions.columns import iso_micros

# 2024-01-01 UTC. Event time is compressed a thousandfold from there, so that
# idle gaps of seconds and minutes occur.
EPOCH_MICROS = 1_704_067_200_000_000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _event_micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def packets_from_events(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    client = F.concat(
        F.lit("10.0."), F.floor(F.col("user_id") / 256).cast("string"),
        F.lit("."), (F.col("user_id") % 256).cast("string"),
    )
    server = F.concat(F.lit("203.0.113."), (F.col("user_id") % 7 + 1).cast("string"))
    server_port = F.when(F.col("svc") == 0, 443).otherwise(53)
    client_port = (F.lit(49152) + F.col("user_id") % 16384).cast("int")
    reply = F.col("event_type") == "view"
    captured = F.timestamp_micros(
        EPOCH_MICROS + F.floor((_event_micros() - EPOCH_MICROS) / 1000)
    )
    flags = (
        F.when(F.col("svc") != 0, F.lit(None))
        .when(F.col("event_type") == "signup", "SYN")
        .when(reply, "SYN,ACK")
        .when(F.col("event_type") == "click", "ACK")
        .when(F.col("event_type") == "purchase", "PSH,ACK")
        .when(F.col("k") % 2 == 0, "RST")
        .otherwise("FIN,ACK")
    )
    ported = F.col("svc") != 2
    return (
        events.withColumn("k", k)
        .withColumn("svc", (F.col("k") % 3).cast("int"))
        .select(
            F.col("event_id").alias("packet_id"),
            captured.alias("captured_at"),
            F.when(reply, server).otherwise(client).alias("src_ip"),
            F.when(reply, client).otherwise(server).alias("dst_ip"),
            F.when(ported, F.when(reply, server_port).otherwise(client_port)).alias("src_port"),
            F.when(ported, F.when(reply, client_port).otherwise(server_port)).alias("dst_port"),
            F.when(F.col("svc") == 0, "TCP").when(F.col("svc") == 1, "UDP")
            .otherwise("ICMP").alias("protocol"),
            F.floor(F.col("value") * 4).cast("int").alias("packet_size"),
            flags.alias("tcp_flags"),
            F.sha2(F.col("event_id").cast("string"), 256).alias("payload_hash"),
        )
    )


def raw_packets(packets: DataFrame) -> DataFrame:
    """The packets as dirty text, with every SYN packet received twice."""
    spoil = lambda n: F.col("packet_id") % n == 0
    dirty = packets.select(
        "packet_id",
        F.when(spoil(101), "not-a-time").otherwise(iso_micros(F.col("captured_at")))
        .alias("captured_at"),
        F.when(spoil(103), "").otherwise(F.concat(F.lit(" "), "src_ip")).alias("src_ip"),
        F.when(~spoil(107), F.col("dst_ip")).alias("dst_ip"),
        F.when(spoil(131), "70000").otherwise(F.col("src_port").cast("string")).alias("src_port"),
        F.col("dst_port").cast("string").alias("dst_port"),
        F.when(spoil(109), "  ")
        .when(spoil(2), F.concat(F.lower("protocol"), F.lit(" ")))
        .otherwise(F.col("protocol")).alias("protocol"),
        F.when(spoil(113), "-5").when(spoil(127), "abc")
        .otherwise(F.col("packet_size").cast("string")).alias("packet_size"),
        "tcp_flags",
        "payload_hash",
    )
    return dirty.unionByName(dirty.filter(F.col("tcp_flags") == "SYN"))


def predictions_from_events(events: DataFrame) -> DataFrame:
    event_id = F.col("event_id")
    return events.select(
        event_id.alias("prediction_id"),
        F.floor(event_id / 2).cast("bigint").alias("session_id"),
        F.when(event_id % 6 != 5, 1 + event_id % 6).cast("int").alias("predicted_label_id"),
        (((event_id * 37) % 10001) / F.lit(10000.0)).cast("decimal(6,5)").alias("confidence"),
        F.when(event_id % 2 == 0, "v1_a").otherwise("v1_b").alias("model_version"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def alerts_from_events(events: DataFrame) -> DataFrame:
    """An alert table that exercises every status and severity."""
    event_id = F.col("event_id")
    status = (
        F.when(event_id % 3 == 0, "open").when(event_id % 3 == 1, "acknowledged")
        .otherwise("resolved")
    )
    return events.filter(F.col("event_type") == "error").select(
        event_id.alias("alert_id"),
        F.floor(event_id / 2).cast("bigint").alias("session_id"),
        F.when(event_id % 4 != 0, event_id).alias("prediction_id"),
        F.when(event_id % 2 == 0, "ml_prediction").otherwise("DOS").alias("alert_type"),
        (event_id % 5 + 1).cast("int").alias("severity"),
        status.alias("status"),
        F.lit("high_confidence_non_benign").alias("rule_name"),
        F.lit("derived alert").alias("description"),
        F.col("ts").cast("timestamp").alias("triggered_at"),
        F.when(event_id % 3 != 0, F.col("ts").cast("timestamp")).alias("acknowledged_at"),
    )


def runs_from_events(events: DataFrame) -> DataFrame:
    """One ingestion run per day and event type."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    kind = (
        F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 1)
        .when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3)
        .otherwise(4)
    )
    runs = events.groupBy(
        (day * 5 + kind).cast("bigint").alias("run_id"), F.col("event_type").alias("source_name")
    ).agg(
        F.min(F.col("ts").cast("timestamp")).alias("started_at"),
        F.max(F.col("ts").cast("timestamp")).alias("_last"),
        F.count("*").alias("rows_received"),
        F.count_if(F.col("value") >= 20).alias("rows_inserted"),
        F.count_if(F.col("value") < 20).alias("rows_rejected"),
    )
    status = (
        F.when(F.col("run_id") % 7 == 0, "running").when(F.col("run_id") % 5 == 0, "failed")
        .otherwise("success")
    )
    return runs.select(
        "run_id", "source_name", F.concat(F.lit("/in/"), "source_name").alias("source_path"),
        "started_at", F.when(F.col("run_id") % 7 != 0, F.col("_last")).alias("finished_at"),
        "rows_received", "rows_inserted", "rows_rejected", status.alias("status"),
    )


def staging_from_events(events: DataFrame) -> DataFrame:
    """Staged rows that belong to the runs of ``runs_from_events``."""
    runs = runs_from_events(events).select("run_id", "source_name", "started_at")
    run_day = runs.select(
        "run_id", "source_name", F.col("started_at").cast("date").alias("_day")
    )
    rows = events.select(
        F.col("event_id").alias("staged_id"),
        F.col("event_type").alias("source_name"),
        F.col("ts").cast("date").alias("_day"),
    )
    return rows.join(run_day, ["source_name", "_day"]).select("staged_id", "run_id")


def raw_labels(sessions: DataFrame) -> DataFrame:
    """External labels per session: (session_id, label, row_no), the short
    TCP ones given twice with different text."""
    pick = F.col("session_id") % 8
    label = (
        F.when(pick == 0, "BENIGN").when(pick == 1, " DDoS").when(pick == 2, "PortScan")
        .when(pick == 3, "Bot").when(pick == 4, "ssh-patator").when(pick == 5, "u2r")
        .when(pick == 6, "mystery")
    )
    first = sessions.select(
        "session_id", label.alias("label"), F.col("session_id").alias("row_no")
    )
    again = sessions.filter(
        (F.col("protocol") == "TCP") & (F.col("packet_count") == 1)
    ).select(
        "session_id", F.lit("Normal").alias("label"),
        (F.col("session_id") + 1_000_000_000_000).alias("row_no"),
    )
    unknown = sessions.filter(F.col("protocol") == "ICMP").select(
        (-F.col("session_id") - 1).alias("session_id"), F.lit("dos hulk").alias("label"),
        F.col("session_id").alias("row_no"),
    )
    return first.unionByName(again).unionByName(unknown)


def flow_records(lineitem: DataFrame) -> DataFrame:
    """Flow export rows as text, with repeated headers, infinities and gaps.

    ``source_file`` stands for the file a row came from.
    """
    text = lambda c: c.cast("string")
    header = F.col("l_linenumber") == 7
    part = lambda c, name: F.when(header, F.lit(name)).otherwise(text(c)).alias(name)
    qty = F.col("l_quantity").cast("int")
    price = F.floor(F.col("l_extendedprice")).cast("bigint")
    return lineitem.select(
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
        ).alias("row_key"),
        F.concat(
            F.lit("flows_"), F.lower("l_linestatus"), F.lit("_"),
            text(F.year("l_shipdate")), F.lit(".csv"),
        ).alias("source_file"),
        part(price * 100, "Flow Duration"),
        part(qty * 40, "TotLen Fwd Pkts"),
        part(F.when(qty % 5 == 0, 0).otherwise(qty * 7), "TotLen Bwd Pkts"),
        part(qty, "Tot Fwd Pkts"),
        part(qty % 9, "Tot Bwd Pkts"),
        F.when(qty == 13, "Infinity").when(qty == 17, "NaN").otherwise(text(price % 1000))
        .alias("Flow Byts/s"),
        F.when(qty == 19, "-Infinity").otherwise(text(price % 100)).alias("Flow Pkts/s"),
        part(price % 11, "Flow IAT Mean"),
        part(price % 13, "Flow IAT Std"),
        part(price % 3, "Flow IAT Min"),
        part(price % 17, "Flow IAT Max"),
        part(qty * 2, "Pkt Size Avg"),
        part(qty % 4, "Pkt Len Std"),
        part(qty % 2, "SYN Flag Cnt"),
        part(price % 2, "FIN Flag Cnt"),
        part((qty + price) % 2, "RST Flag Cnt"),
        part(F.col("l_partkey") % 65536, "Dst Port"),
        F.when(header, "Label").otherwise(F.concat(F.lit("flag-"), F.lower("l_returnflag"))).alias("Label"),
    )
