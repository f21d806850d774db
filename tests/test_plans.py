import pytest
from pyspark.sql import functions as F

from packetlake.operators import listings as Ls
from packetlake.operators import sessions as S
from packetlake.plans import batch
from packetlake.plans.training import train
from packetlake.plans.warehouse import Warehouse
from packetlake.operators import training as T
from packetlake.schemas import attack_labels
from packetlake.sources.events import packets_from_events, read_table

FOLDER = "/root/testdata/sf0.001"


def as_text(df):
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns if c != "packet_id"])


def test_pipeline_from_file_to_alert(spark, tmp_path, monkeypatch):
    house = Warehouse(spark, str(tmp_path / "house"))
    packets = packets_from_events(read_table(spark, FOLDER, "events"))
    half = packets.filter("packet_id < 500")
    csv = str(tmp_path / "half.csv")
    as_text(half).write.option("header", True).csv(csv)

    first = batch.ingest_file(house, csv, 1).first()
    assert (first.rows_received, first.rows_inserted, first.rows_rejected) == (500, 500, 0)
    assert first.status == "success"
    # The same file again: nothing new. A repeated run id: the same result.
    again = batch.ingest_file(house, csv, 2).first()
    assert (again.rows_received, again.rows_inserted) == (500, 0)
    retry = batch.ingest_file(house, csv, 1).first()
    assert retry.rows_inserted == 500

    assert batch.sessionize(house) == 2
    sessions = house.read("sessions")
    assert sessions.count() == S.build_sessions(half).select("flow_hash").distinct().count()
    batch.ingest(house, as_text(packets), 3, "feed", "events")
    assert batch.sessionize(house) == 1
    assert batch.sessionize(house) == 0
    linked = batch.linked_packets(house)
    assert linked.count() == packets.count() == linked.filter("session_id IS NOT NULL").count()
    assert linked.select("packet_id").distinct().count() == packets.count()

    features = batch.compute_features(house)
    assert features.count() == house.read("sessions").count()
    assert features.agg(F.sum("total_packets")).first()[0] == packets.count()
    raw = features.select(
        "session_id", F.when(F.col("total_bytes") > 150, "ddos").otherwise("benign").alias("label"),
        F.col("session_id").alias("row_no"),
    )
    labeled = batch.load_labels(house, raw)
    assert labeled.filter("ground_truth_label_id IS NULL").count() == 0

    rows = T.training_export(labeled, attack_labels(spark))
    model = train(spark, rows, "v1_20260101000000", trees=5, depth=5, folds=2).model
    # A job that ends before the alerts leaves them to the next one.
    with monkeypatch.context() as patch:
        patch.setattr(batch, "raise_alerts", lambda *_: (_ for _ in ()).throw(OSError("no space")))
        with pytest.raises(OSError):
            batch.score(house, model)
    predictions = batch.score(house, model)
    assert predictions.count() == features.count()
    certain = predictions.filter("confidence >= 0.9 AND predicted_label_id = 2").count()
    alerts = house.read("alerts")
    assert certain > 0 and alerts.count() == certain
    # Nothing is left to score, so no second alert.
    batch.score(house, model)
    assert house.read("alerts").count() == certain
    assert Ls.list_alerts(alerts, status="open", limit=5).count() == 5


@pytest.mark.parametrize("fail_on", ["sessions", "links"])
def test_sessionize_again_after_a_failed_write(spark, tmp_path, monkeypatch, fail_on):
    packets = packets_from_events(read_table(spark, FOLDER, "events")).filter("packet_id < 300")
    results = []
    for name, broken in (("calm", False), ("broken", True)):
        house = Warehouse(spark, str(tmp_path / name))
        batch.ingest(house, as_text(packets.filter("packet_id < 150")), 1, "feed", "events")
        batch.ingest(house, as_text(packets.filter("packet_id >= 150")), 2, "feed", "events")
        if broken:
            writes = []

            def fails(self, table, *rest, kind, **named):
                if table == fail_on:
                    writes.append(table)
                    if table == "sessions" or len(writes) == 2:
                        raise OSError("no space")
                return kind(self, table, *rest, **named)

            with monkeypatch.context() as patch:
                for method in ("write_run", "merge"):
                    kind = getattr(Warehouse, method)
                    patch.setattr(Warehouse, method, lambda *a, kind=kind, **k: fails(*a, kind=kind, **k))
                with pytest.raises(OSError):
                    batch.sessionize(house)
        batch.sessionize(house)
        assert batch.sessionize(house) == 0
        sessions = house.read("sessions").drop("created_at", "updated_at")
        links = batch.linked_packets(house).select("packet_id", "session_id")
        results.append([sorted(map(str, df.collect())) for df in (sessions, links)])
    assert results[0] == results[1]


def test_a_half_written_run_does_not_count(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path / "house"))
    house.write_run("links", spark.range(3), 7)
    (tmp_path / "house" / "links" / "run_id=8").mkdir()
    assert house.run_ids("links") == [7]


def test_strict_run_leaves_nothing(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path / "house"))
    bad = spark.createDataFrame(
        [("x", "a", "b", "tcp", "1")],
        "captured_at string, src_ip string, dst_ip string, protocol string, packet_size string",
    )
    with pytest.raises(ValueError, match="1 rows"):
        batch.ingest(house, bad, 1, "feed", "bad", strict=True)
    assert not house.exists("ingestion_runs") and not house.exists("staging")


def test_checked_rows_are_written_once(spark, tmp_path, monkeypatch):
    house = Warehouse(spark, str(tmp_path / "house"))
    rows = spark.createDataFrame(
        [("2026-01-01T00:00:00Z", "a", "b", "tcp", "1"), ("x", "a", "b", "tcp", "1")],
        "captured_at string, src_ip string, dst_ip string, protocol string, packet_size string",
    )
    stages, store = [], batch.store_stage
    monkeypatch.setattr(batch, "store_stage", lambda df, name, *by: stages.append(name) or store(df, name, *by))
    for _ in range(2):
        audit = batch.ingest(house, rows, 1, "feed", "rows").first()
        assert (audit.rows_received, audit.rows_inserted, audit.rows_rejected) == (2, 1, 1)
    assert stages == [] and house.children("staging/_incoming") == []
    # Rows that cannot be read leave those of the run's last attempt.
    unreadable = rows.withColumn("src_ip", F.raise_error(F.lit("unreadable")).cast("string"))
    with pytest.raises(Exception, match="unreadable"):
        batch.ingest(house, unreadable, 1, "feed", "rows")
    staged = house.read_runs("staging")
    assert staged.count() == 2 and {"run_id", "is_valid", "validation_errors", "raw_record"} <= set(staged.columns)
    assert house.read_runs("packets").count() == 1


def test_failed_run_is_recorded(spark, tmp_path, monkeypatch):
    house = Warehouse(spark, str(tmp_path / "house"))
    good = spark.createDataFrame(
        [("2026-01-01T00:00:00Z", "a", "b", "tcp", "1")],
        "captured_at string, src_ip string, dst_ip string, protocol string, packet_size string",
    )

    def broken(*_args):
        raise RuntimeError("no space left")

    monkeypatch.setattr(batch, "dedup_insert", broken)
    with pytest.raises(RuntimeError):
        batch.ingest(house, good, 1, "feed", "good")
    row = batch.ingestion_runs(house).first()
    assert (row.status, row.error_message, row.rows_inserted) == ("failed", "no space left", 0)
