"""Live batches in the main tables, and scoring of chosen sessions."""

import pytest
from pyspark.sql import functions as F

from helpers import packet, packets
from packetlake.operators import sessions as S
from packetlake.operators.models import RULES_VERSION
from packetlake.plans import batch, live
from packetlake.plans.warehouse import Warehouse
from packetlake.schemas import SESSIONS_SCHEMA
from packetlake.streaming import sessions as XS

NOW = "2026-05-01"


def now():
    return F.lit(NOW).cast("timestamp")


class ByBytes:
    """More than 100 bytes are a denial of service, more than 900 an anomaly."""

    version = "bytes"

    def score(self, features):
        return features.withColumn(
            "predicted_label", F.when(F.col("total_bytes") > 100, "DOS").otherwise("BENIGN")
        ).withColumn("confidence", F.lit(0.95)).withColumn(
            "anomaly_score", F.lit(-0.5)
        ).withColumn("is_anomaly", F.col("total_bytes") > 900)


def closed_of(spark, rows):
    """The fragments of packets that are within a second, as closed sessions."""
    found = XS.slice_fragments(XS.flow_slices(packets(spark, rows)))
    return found.select(*S.FLOW_KEY, F.explode("fragments").alias("f")).select(
        *S.FLOW_KEY, *[F.col(f"f.{name}").alias(name) for name in XS.SUMS]
    )


def batches(spark, n):
    for k in range(n):
        yield k, closed_of(spark, [
            packet(10 * k + i, 100 * k + 0.1 * i, src=f"10.0.{k}.{i}", size=60 + 300 * (i % 4)) for i in range(8)
        ])


def tables(house):
    sessions = house.read("sessions").select("session_id", "flow_hash", "packet_count", "total_bytes")
    predictions = house.read("predictions").select("prediction_id", "session_id", "predicted_label_id", "model_version")
    alerts = house.read("alerts").select("alert_id", "session_id", "prediction_id", "severity", "rule_name", "status")
    return [sorted(map(tuple, df.collect())) for df in (sessions, predictions, alerts)]


def test_killed_between_any_two_writes(spark, tmp_path, monkeypatch):
    results = []
    for fail_at in (None, 0, 1, 2):
        house = Warehouse(spark, str(tmp_path / str(fail_at)))
        for k, closed in batches(spark, 2):
            if k == 1 and fail_at is not None:
                real, calls = Warehouse.merge, []

                def merge(self, *rest, real=real, calls=calls, fail_at=fail_at, **named):
                    calls.append(1)
                    if len(calls) > fail_at:
                        raise OSError("killed")
                    return real(self, *rest, **named)

                with monkeypatch.context() as patch:
                    patch.setattr(Warehouse, "merge", merge)
                    with pytest.raises(OSError):
                        live.record_batch(house, closed, ByBytes(), now(), k)
            live.record_batch(house, closed, ByBytes(), now(), k)
        results.append(tables(house))
    assert all(found == results[0] for found in results[1:])
    sessions, predictions, alerts = results[0]
    assert [row[0] for row in sessions] == list(range(1, 13))
    assert [row[0] for row in predictions] == [row[0] for row in alerts] == list(range(1, 13))
    assert {row[3] for row in alerts} == {3, 4}


def test_compaction_keeps_the_ledger(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    for k, closed in batches(spark, 3):
        live.record_batch(house, closed, ByBytes(), now(), k)
    before = tables(house)
    assert batch.raise_alerts(house).count() == len(before[2])  # live batches raised theirs
    batch.compact(house, most=0)
    assert tables(house) == before
    assert len(house.keyed("sessions").notes) == 2
    for k, closed in batches(spark, 3):  # all of them again
        live.record_batch(house, closed, ByBytes(), now(), k)
    assert tables(house) == before


def test_score_or_rules(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    rows = packets(spark, [packet(i, 100 * i, size=50 + 100 * i) for i in range(4)])
    sessions = S.upsert_sessions(spark.createDataFrame([], SESSIONS_SCHEMA), S.build_sessions(rows))
    batch.merge_changed(house, "sessions", batch.SESSION_KEY, sessions, "session_id")
    labelled = house.read("sessions").filter("session_id <= 2").select("session_id", "total_bytes")
    features = labelled.select(
        "session_id", *[
            F.col(f.name) if f.name == "total_bytes" else F.lit(None).cast(f.dataType).alias(f.name)
            for f in batch.FEATURES_SCHEMA.fields if f.name != "session_id"
        ]
    )
    house.merge("session_features", batch.FEATURE_KEY, features)
    wanted = spark.createDataFrame([(1,), (2,), (3,), (3,), (99,)], "session_id int")
    for _ in range(2):  # a second time changes nothing
        found = live.score_or_rules(house, ByBytes(), wanted, now()).collect()
        assert {(r.session_id, r.model_version) for r in found} == {(1, "bytes"), (2, "bytes"), (3, RULES_VERSION)}
        assert sorted(r.prediction_id for r in found) == [1, 2, 3]
    dos = [r.session_id for r in found if r.predicted_label_id == 2]
    assert sorted(r.session_id for r in house.read("alerts").collect()) == sorted(dos)
