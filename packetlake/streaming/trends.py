"""Windowed traffic aggregates and change feeds over streams."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

WATERMARK = "10 seconds"
ALERT_POLL = "5 seconds"
# Seconds for which a flow stays active after a packet.
ACTIVE_SECONDS = 120
STEP_SCHEMA = "as_of timestamp, step bigint"
STEP_ROW = Row("as_of", "step")


def stream_traffic_trends(packets: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Packets, bytes and distinct sources per minute.

    Each source of a minute is summed up first, so the second step counts rows.
    """
    by_source = (
        packets.withWatermark("captured_at", watermark)
        .groupBy(F.window("captured_at", "1 minute").alias("minute"), "src_ip")
        .agg(F.count("*").alias("packets"), F.sum("packet_size").alias("bytes"))
    )
    return (
        by_source.groupBy(F.window(F.window_time("minute"), "1 minute").alias("w"))
        .agg(
            F.sum("packets").alias("packets_per_minute"),
            F.sum("bytes").alias("bytes_per_minute"),
            F.count("src_ip").alias("active_source_ips"),
        )
        .select(
            F.col("w.start").alias("minute_bucket"),
            "packets_per_minute", "bytes_per_minute", "active_source_ips",
        )
    )


def stream_active_flows(packets: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """(Approximate) distinct (source, destination) of the last two minutes,
    each second.

    Packets first become one sketch per second, so only sketches, not packets,
    are copied into the 120 overlapping windows.
    """
    per_second = (
        packets.withWatermark("captured_at", watermark)
        .groupBy(F.window("captured_at", "1 second").alias("second"))
        .agg(F.hll_sketch_agg(F.concat_ws("|", "src_ip", "dst_ip"), F.lit(14)).alias("flows"))
    )
    return (
        per_second.groupBy(F.window(F.window_time("second"), "2 minutes", "1 second").alias("w"))
        .agg(F.hll_sketch_estimate(F.hll_union_agg("flows")).alias("active_sessions"))
        .select(F.col("w.end").alias("as_of"), "active_sessions")
    )


class ActiveFlows(StatefulProcessor):
    """One step up when a flow becomes active and one down when it ends. The
    state of a flow is one number, the second after its last packet's."""

    def __init__(self, seconds: int) -> None:
        self.lasts = 1000 * seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen_until", "seen_until bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stored = self.state.get()
        before = seen = stored[0] if stored else None
        # The rows are the seconds with packets, in whole milliseconds.
        for at in sorted(row["second_end"] for row in rows):
            if seen is None or at > seen + self.lasts:
                if seen is not None:
                    yield step(seen + self.lasts, -1)
                yield step(at, 1)
            seen = at
        if seen + self.lasts <= timerValues.getCurrentWatermarkInMs():
            yield step(seen + self.lasts, -1)
            seen = None
        if before is not None:
            self.handle.deleteTimer(before + self.lasts)
        if seen is None:
            self.state.clear()
        else:
            self.state.update((seen,))
            self.handle.registerTimer(seen + self.lasts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        stored = self.state.get()
        if stored is not None:
            self.state.clear()
            yield step(stored[0] + self.lasts, -1)

    def close(self) -> None:
        pass


def step(at: int, change: int) -> Row:
    return STEP_ROW(datetime.datetime.fromtimestamp(at / 1000, datetime.timezone.utc), change)


def stream_flow_steps(
    packets: DataFrame, watermark: str = WATERMARK, seconds: int = ACTIVE_SECONDS
) -> DataFrame:
    """(as_of, step): changes of the number of active (source, destination)
    pairs, exact and the same for any cut of the stream.

    A pair is active as of a whole second if it sent a packet in the ``seconds``
    before it. Packets of a pair and second become one row before the keyed state.
    """
    per_second = (
        packets.withWatermark("captured_at", watermark)
        .groupBy("src_ip", "dst_ip", F.window("captured_at", "1 second").alias("second"))
        .agg(F.count("*").alias("packets"))
        .select(
            "src_ip", "dst_ip", F.window_time("second").alias("event_time"),
            F.unix_millis("second.end").alias("second_end"),
        )
    )
    return per_second.groupBy("src_ip", "dst_ip").transformWithState(
        statefulProcessor=ActiveFlows(seconds),
        outputStructType=STEP_SCHEMA, outputMode="append", timeMode="EventTime",
    )


def active_flows(steps: DataFrame) -> DataFrame:
    """(as_of, active_sessions) of each second with an active pair, from steps.

    Sums run within hours and over hours, so no task holds more than the
    seconds of an hour or one row for each hour.
    """
    second = F.col("as_of")
    changes = steps.groupBy("as_of").agg(F.sum("step").alias("change")).withColumn(
        "hour", F.date_trunc("hour", second)
    )
    by_hour = W.orderBy("hour")
    hours = changes.groupBy("hour").agg(
        F.sum("change").alias("total"), F.min("as_of").alias("begins")
    ).select(
        "hour",
        (F.sum("total").over(by_hour.rowsBetween(W.unboundedPreceding, 0)) - F.col("total")).alias("before"),
        F.lead("begins").over(by_hour).alias("next_begins"),
    )
    inside = W.partitionBy("hour").orderBy("as_of")
    levels = changes.join(hours, "hour").select(
        "as_of",
        (F.col("before") + F.sum("change").over(inside.rowsBetween(W.unboundedPreceding, 0))).alias("active_sessions"),
        F.coalesce(F.lead("as_of").over(inside), "next_begins").alias("until"),
    )
    one = F.expr("INTERVAL 1 SECOND")
    # The last change leaves no pair active.
    return levels.filter("active_sessions > 0 AND until IS NOT NULL").select(
        F.explode(F.sequence(second, F.col("until") - one, one)).alias("as_of"), "active_sessions"
    )


def stream_rate(packets: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Packets per second."""
    return (
        packets.withWatermark("captured_at", watermark)
        .groupBy(F.window("captured_at", "1 second").alias("w"))
        .agg(F.count("*").alias("pps"))
        .select(F.col("w.start").alias("second"), "pps")
    )


def stream_new_alerts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Alerts as they are appended to the alert table at ``path``; start the
    query with a ``processingTime`` trigger of ``ALERT_POLL``."""
    return spark.readStream.schema(schema).parquet(path).select(
        "alert_id", "alert_type", "severity", "description"
    )
