import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import START, packet, packets
from packetlake import schemas
from packetlake.operators import alerts as A
from packetlake.operators import listings as Ls
from packetlake.operators import retention as R
from packetlake.operators import traffic as T


def now():
    return F.lit("2026-05-01").cast("timestamp")


def predictions(spark, rows):
    return spark.createDataFrame(
        [(i, i, label, Decimal(c), "v1") for i, (label, c) in enumerate(rows)],
        "prediction_id long, session_id long, predicted_label_id int, "
        "confidence decimal(8,6), model_version string",
    )


def test_alert_threshold_compares_the_stored_value(spark):
    rows = predictions(spark, [
        (2, "0.899996"), (2, "0.899994"), (1, "0.99"), (None, "0.99"), (9, "0.99"), (5, "0.9"),
    ])
    out = A.alerts_from_predictions(rows, schemas.attack_labels(spark), now()).collect()
    assert sorted(r.prediction_id for r in out) == [0, 5]
    assert {(r.severity, r.status, r.alert_type) for r in out} == {(4, "open", "ml_prediction")}


def test_stream_alert_rule(spark):
    rows = spark.createDataFrame(
        [(1, 1, "BENIGN", 0.9, False), (2, 2, "BENIGN", 0.9, True), (3, 3, "DOS", 0.185, False)],
        "session_id long, prediction_id long, predicted_label string, confidence double, is_anomaly boolean",
    )
    out = {r.session_id: r for r in A.alerts_from_stream(rows, now()).collect()}
    assert set(out) == {2, 3} and out[2].severity == 4 and out[3].severity == 3
    assert out[3].description == f"Real-time detection: DOS (confidence {0.185:.2f})"


def test_alert_status_changes(spark):
    early = datetime.datetime(2026, 1, 1)
    alerts = spark.createDataFrame(
        [(1, "open", None), (2, "acknowledged", early), (3, "open", None), (4, "resolved", early)],
        "alert_id long, status string, acknowledged_at timestamp",
    )
    updates = spark.createDataFrame(
        [(1, "acknowledged"), (2, "resolved"), (4, "open"), (4, None), (3, "closed")],
        "alert_id long, status string",
    )
    out = {r.alert_id: r for r in A.update_alert_status(alerts, updates, now()).collect()}
    assert (out[1].status, out[1].acknowledged_at) == ("acknowledged", datetime.datetime(2026, 5, 1))
    assert (out[2].status, out[2].acknowledged_at) == ("resolved", early)
    assert (out[3].status, out[3].acknowledged_at) == ("open", None)
    assert (out[4].status, out[4].acknowledged_at) == ("open", early)
    assert {r.alert_id for r in A.refused_updates(updates).collect()} == {3, 4}
    twice = spark.createDataFrame(
        [(1, "resolved", 1), (1, "acknowledged", 2)], "alert_id long, status string, at int"
    )
    late = A.update_alert_status(alerts, twice, now(), "at").collect()
    assert len(late) == 4 and {r.status for r in late if r.alert_id == 1} == {"acknowledged"}
    furthest = A.update_alert_status(alerts, twice, now()).filter("alert_id = 1").collect()
    assert [r.status for r in furthest] == ["resolved"]


@pytest.mark.parametrize("limit, offset", [(0, 0), (1001, 0), (10, -1)])
def test_page_limits(spark, limit, offset):
    with pytest.raises(ValueError):
        Ls.list_packets(packets(spark, []), limit=limit, offset=offset)


def test_pages_are_newest_first(spark):
    rows = packets(spark, [packet(i, i % 5, protocol="UDP" if i % 2 else "TCP") for i in range(20)])
    first = [r.packet_id for r in Ls.list_packets(rows, protocol="udp", limit=4).collect()]
    second = [r.packet_id for r in Ls.list_packets(rows, protocol="udp", limit=4, offset=4).collect()]
    assert first == [19, 9, 13, 3] and second == [17, 7, 11, 1]


def test_listing_uses_top_k(spark):
    plan = Ls.list_packets(packets(spark, [packet(1, 0)]))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    packets(spark, [packet(1, 0)]).write.parquet(path)
    listed = Ls.list_packets(spark.read.parquet(path), src_ip="10.0.0.1", protocol="tcp")
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(src_ip,10.0.0.1)" in plan and "EqualTo(protocol,TCP)" in plan
    counted = T.top_ips(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<captured_at:timestamp,src_ip:string,packet_size:int>" in counted


def test_alert_detail_keeps_alerts_without_session(spark):
    alerts = spark.createDataFrame(
        [(1, 5, 7), (2, 99, None)], "alert_id long, session_id long, prediction_id long"
    )
    sessions = spark.createDataFrame(
        [(5, "a", "b", 1, 2, "TCP")],
        "session_id long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string",
    )
    preds = spark.createDataFrame(
        [(7, Decimal("0.5"), "v1", 2)],
        "prediction_id long, confidence decimal(6,5), model_version string, predicted_label_id int",
    )
    detail = Ls.alert_detail(alerts, sessions, preds, schemas.attack_labels(spark))
    out = {r.alert_id: r for r in detail.collect()}
    assert out[1].session_details.src_ip == "a" and out[1].prediction_details.predicted_label == "DOS"
    assert out[2].session_details is None and out[2].prediction_details is None


def test_protocol_share(spark):
    rows = [packet(i, i, protocol="TCP") for i in range(600)] + [packet(1000, 999, protocol="icmp")]
    got = [(r.name, r.value) for r in T.protocol_share(packets(spark, rows)).collect()]
    assert got == [("TCP", 100), ("ICMP", 1)]
    assert [tuple(r) for r in T.protocol_share(packets(spark, [])).collect()] == [("NO_DATA", 100)]


def test_minutes_and_rates(spark):
    rows = packets(spark, [packet(1, 0, size=7_500_000), packet(2, 70, size=62_500)])
    minutes = T.per_minute(rows)
    assert [r.traffic for r in T.traffic_megabits(minutes).collect()] == [60, 1]
    assert T.peak_traffic(T.traffic_megabits(minutes)).first()[0] == 60
    assert T.latest_rate(minutes).first()[0] == 0.01
    assert T.latest_rate(T.per_minute(packets(spark, []))).first()[0] == 0.0


def test_confidence_bins(spark):
    rows = predictions(spark, [(1, c) for c in ("0", "0.2", "0.59", "0.8", "1")])
    got = {r["range"]: r["count"] for r in T.confidence_histogram(rows).collect()}
    assert got == {"0-20%": 1, "20-40%": 1, "40-60%": 1, "60-80%": 0, "80-100%": 2}


def test_severity_names(spark):
    rows = spark.createDataFrame([(5,), (4,), (2,), (1,), (None,)], "severity int")
    got = {r.bucket: r.alerts for r in T.severity_buckets(rows, "high").collect()}
    assert got == {"high": 2, "medium": 1, "low": 2}


def test_live_metrics(spark):
    rows = packets(spark, [packet(1, 0), packet(2, 100), packet(3, 110), packet(4, 119, src="x")])
    alerts = spark.createDataFrame([("open",), ("resolved",)], "status string")
    as_of = F.lit(START + datetime.timedelta(seconds=125))
    row = T.live_metrics(rows, alerts, as_of).first()
    assert (row.packet_count, row.active_sessions, row.open_alerts) == (4, 2, 1)


def test_rates_never_go_below_zero(spark):
    rows = [(START + datetime.timedelta(seconds=i), n) for i, n in enumerate([5, 9, 3, 4])]
    samples = spark.createDataFrame(rows, "sampled_at timestamp, packet_count long")
    assert [r.pps for r in T.rate_from_counts(samples, 3).collect()] == [1, 0, 4]
    assert [r.pps for r in T.rate_from_counts(samples).collect()] == [1, 0, 4, 0]


def test_retention(spark):
    day = lambda d: datetime.datetime(2026, 4, d)
    runs = spark.createDataFrame(
        [(1, "success", day(1)), (2, "failed", day(1)), (3, "success", day(20)),
         (4, "running", None)],
        "run_id long, status string, finished_at timestamp",
    )
    staging = spark.createDataFrame([(i, 1 + i % 4) for i in range(8)], "staged_id long, run_id long")
    kept = R.expire_staging(staging, runs, now())
    assert {r.run_id for r in kept.collect()} == {2, 3, 4}
    later = F.lit("2026-05-02").cast("timestamp")
    left, rows = R.expire_runs(runs, staging, later)
    assert {r.run_id for r in left.collect()} == {3, 4} == {r.run_id for r in rows.collect()}


def test_cascade_unlinks_packets(spark):
    ids = spark.createDataFrame([(1,)], "session_id long")
    table = spark.createDataFrame([(1,), (2,)], "session_id long")
    linked = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "packet_id long, session_id long")
    out = R.cascade_delete_sessions(ids, table, linked, table, table, table)
    assert {r.packet_id: r.session_id for r in out.packets.collect()} == {1: None, 2: 2, 3: None}
    assert [r.session_id for r in out.alerts.collect()] == [2]
