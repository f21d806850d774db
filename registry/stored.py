"""Queries over the stored tables of the batch jobs: increments, updates, expiry."""

import uuid

from pyspark.sql import functions as F

from packetlake.functions.columns import MICROS
from packetlake.plans import batch, live, traffic
from packetlake.plans.warehouse import Warehouse
from packetlake.schemas import ALERTS_SCHEMA, PREDICTIONS_SCHEMA, SESSIONS_SCHEMA
from packetlake.session import ROCKSDB_PROVIDER, STATE_STORE_CONF, shared_folder
from packetlake.streaming import sessions as XS
from packetlake.streaming.detect import score_closed
from registry.base import ORACLES, query, with_tables
from registry.ingest import INSERTED, checked
from registry.streams import drain, replay
from registry.traffic import AS_OF


def new_house(t):
    return Warehouse(t.spark, f"{shared_folder(t.spark)}/houses/{uuid.uuid4().hex}")


def write_packets(house, packets, run_id):
    house.write_run(
        "packets", packets.withColumn("capture_date", F.to_date("captured_at")), run_id, "capture_date"
    )


@query("stored_sessions", with_tables("sessions linked", """
SELECT s.session_id, flow_hash, src_ip, dst_ip, src_port, dst_port, protocol, epoch_us(started_at) AS started_at,
  epoch_us(ended_at) AS ended_at, packet_count * (1 + CAST(n.again AS INTEGER)) AS packet_count,
  total_bytes * (1 + CAST(n.again AS INTEGER)) AS total_bytes
FROM sessions s JOIN (SELECT session_id, min(packet_id) % 100 = 0 AS again FROM linked GROUP BY session_id) n
  ON n.session_id = s.session_id"""))
def _(t):
    # A second run brings the packets of about 1 % of the sessions again.
    house = new_house(t)
    write_packets(house, t.unlinked_packets(), 1)
    batch.sessionize(house)
    grown = t.linked.groupBy("session_id").agg(F.min("packet_id").alias("p")).filter("p % 100 = 0")
    again = t.linked.join(grown.select("session_id"), "session_id", "left_semi").withColumn(
        "session_id", F.lit(None).cast("bigint")
    ).withColumn("packet_id", F.col("packet_id") + 1_000_000_000_000)
    write_packets(house, again.select(t.packets.columns), 2)
    batch.sessionize(house)
    batch.compact(house, most=1)
    return house.read("sessions")


@query("stored_alert_updates", with_tables("alerts", """
SELECT alert_id, CASE WHEN severity >= 3 AND alert_id % 50 = 0 THEN 'resolved' ELSE status END AS status FROM alerts"""))
def _(t):
    house = new_house(t)
    house.merge("alerts", batch.ALERT_KEY, t.alerts)
    updates = t.alerts.filter("severity >= 3 AND alert_id % 50 = 0").select(
        "alert_id", F.lit("resolved").alias("status")
    )
    return batch.update_alerts(house, updates).select("alert_id", "status")


@query("expire_stored_runs", with_tables("runs staging", """
SELECT CAST(run_id AS BIGINT) AS run_id, CAST(NULL AS BIGINT) AS staged_id FROM runs
  WHERE NOT coalesce(finished_at < TIMESTAMP '2024-02-15' - INTERVAL 30 DAYS, false)
UNION ALL SELECT CAST(run_id AS BIGINT), staged_id FROM staging WHERE run_id NOT IN (SELECT run_id FROM runs
  WHERE coalesce(finished_at < TIMESTAMP '2024-02-15' - INTERVAL 30 DAYS
    OR (status = 'success' AND finished_at < TIMESTAMP '2024-02-15' - INTERVAL 14 DAYS), false))"""))
def _(t):
    house = new_house(t)
    for name, rows in (("ingestion_runs", t.runs), ("staging", t.staging)):
        # One folder for each run, as the jobs write them.
        rows.repartition("run_id").write.mode("overwrite").partitionBy("run_id").parquet(house.path(name))
    batch.expire(house, F.lit("2024-02-15").cast("timestamp"))
    return house.read_runs("ingestion_runs").select(
        F.col("run_id").cast("bigint").alias("run_id"), F.lit(None).cast("bigint").alias("staged_id")
    ).unionByName(house.read_runs("staging").select(F.col("run_id").cast("bigint").alias("run_id"), "staged_id"))


def traffic_house(t):
    """Packets in three runs of unequal size, the last one after a refresh."""
    house = new_house(t)
    packets = t.unlinked_packets()
    write_packets(house, packets.filter("packet_id % 10 < 7"), 1)
    write_packets(house, packets.filter("packet_id % 10 BETWEEN 7 AND 8"), 2)
    traffic.refresh(house)
    write_packets(house, packets.filter("packet_id % 10 = 9"), 3)
    traffic.refresh(house)
    return house


def same_as(name):
    """The SQL text of the query that computes the same from all packets."""
    return ORACLES[name]


@query("stored_top_ips", same_as("top_ips"))
def _(t):
    return traffic.top_ips(traffic_house(t))


@query("stored_traffic_trends", same_as("traffic_trends"))
def _(t):
    return traffic.traffic_trends(traffic_house(t), 1000)


@query("stored_protocols", same_as("protocol_distribution"))
def _(t):
    return traffic.protocol_distribution(traffic_house(t), F.lit("2024-02-01").cast("timestamp"))


@query("stored_live_metrics", same_as("live_metrics"))
def _(t):
    return traffic.live_metrics(traffic_house(t), t.alerts, F.lit(AS_OF).cast("timestamp"))


def dos_of(bytes_, packets):
    return F.when((bytes_ > DETECTED_BYTES) | (packets >= DETECTED_PACKETS), "DOS").otherwise("BENIGN")


DETECTED_BYTES, DETECTED_PACKETS = 1500, 3


class ByVolume:
    """A plain rule as a model, so that SQL can follow it."""

    version = "by-volume"

    def score(self, features):
        return features.withColumn(
            "predicted_label", dos_of(F.col("total_bytes"), F.col("total_packets"))
        ).withColumn("confidence", F.lit(0.95)).withColumn("anomaly_score", F.lit(0.0)).withColumn(
            "is_anomaly", F.col("total_packets") >= DETECTED_PACKETS
        )


DETECTED = f"total_bytes > {DETECTED_BYTES} OR packet_count >= {DETECTED_PACKETS}"


@query("score_on_close_rule", with_tables("built", f"""
SELECT flow_hash, CASE WHEN {DETECTED} THEN 'DOS' ELSE 'BENIGN' END AS predicted_label, 0.95 AS confidence,
  packet_count >= {DETECTED_PACKETS} AS is_anomaly FROM built""", idle_micros=5 * MICROS))
def _(t):
    closed = drain(t, XS.online_sessions(replay(t)), "closed-for-rule")
    return score_closed(closed, ByVolume()).select("flow_hash", "predicted_label", "confidence", "is_anomaly")


@query("stored_detections", with_tables("built", f"""
SELECT flow_hash, packet_count, total_bytes, 2 AS predicted_label_id, 'DOS' AS alert_type,
  CASE WHEN packet_count >= {DETECTED_PACKETS} THEN 4 ELSE 3 END AS severity,
  count(*) OVER () AS last_session, count(*) OVER () AS last_prediction, count(*) OVER () AS last_alert
FROM built WHERE {DETECTED}""", idle_micros=5 * MICROS))
def _(t):
    # Sessions, predictions and alerts of a live job, joined by their ids.
    house = new_house(t)
    t.spark.conf.set(STATE_STORE_CONF, ROCKSDB_PROVIDER)
    live.start_detection(
        XS.online_sessions(replay(t)), ByVolume(), house, f"{house.folder}-checkpoint", availableNow=True
    ).awaitTermination()
    sessions, predictions, alerts = (
        house.read(name, schema) for name, schema in (
            ("sessions", SESSIONS_SCHEMA), ("predictions", PREDICTIONS_SCHEMA), ("alerts", ALERTS_SCHEMA))
    )
    last = [df.agg(F.max(name)).scalar() for df, name in (
        (sessions, "session_id"), (predictions, "prediction_id"), (alerts, "alert_id"))]
    return sessions.join(predictions, "session_id").join(
        alerts.select("prediction_id", "alert_type", "severity"), "prediction_id"
    ).select(
        "flow_hash", "packet_count", "total_bytes", "predicted_label_id", "alert_type", "severity",
        *[n.alias(name) for n, name in zip(last, ("last_session", "last_prediction", "last_alert"), strict=True)],
    )


@query("stored_dedup_insert", with_tables("cleaned packets", f"""
SELECT epoch_us(captured_at) AS captured_at, fingerprint FROM ({INSERTED})
WHERE (captured_at, fingerprint) NOT IN
  (SELECT captured_at, fingerprint FROM cleaned WHERE is_valid AND protocol = 'UDP')"""))
def _(t):
    # A first run stores what is UDP; the second brings everything.
    house = new_house(t)
    udp = checked(t).filter("is_valid AND protocol = 'UDP'").select("packet_id")
    batch.ingest(house, t.raw_packets.join(udp, "packet_id", "left_semi").drop("packet_id"), 1, "feed", "udp")
    batch.ingest(house, t.raw_packets.drop("packet_id"), 2, "feed", "all")
    return house.read_runs("packets", batch.PACKET_TABLE_SCHEMA).filter("run_id = 2").select(
        "captured_at", "fingerprint"
    )
