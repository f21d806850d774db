"""Keyed tables, expiry of stored runs, and jobs that touch only what changes."""

import os

import pytest
from pyspark.sql import functions as F

from packetlake.operators import sessions as S
from packetlake.plans import batch
from packetlake.plans.keyed import KeyedTable
from packetlake.plans.warehouse import Warehouse
from packetlake.schemas import ALERTS_SCHEMA, INGESTION_RUNS_SCHEMA
from packetlake.sources.events import packets_from_events, read_table

FOLDER = "/root/testdata/sf0.001"


def now():
    return F.lit("2024-03-01").cast("timestamp")


def files_of(folder):
    return {
        os.path.join(at, name): os.path.getmtime(os.path.join(at, name))
        for at, _, names in os.walk(folder) for name in names if name.endswith(".parquet")
    }


def contents(df):
    return sorted(map(tuple, df.collect()))


def values(spark, low, high, mark):
    return spark.range(low, high).select(F.col("id"), F.lit(mark).alias("mark"))


def test_a_commit_writes_only_the_buckets_it_touches(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    house.merge("t", ["id"], values(spark, 0, 2000, "a"))
    before = files_of(tmp_path / "t")
    house.merge("t", ["id"], values(spark, 7, 9, "b"))
    after = files_of(tmp_path / "t")
    new = after.keys() - before.keys()
    assert before.items() <= after.items() and len(new) <= 2
    assert sum(os.path.getsize(f) for f in new) < sum(os.path.getsize(f) for f in before) / 2
    want = sorted((k, "b" if k in (7, 8) else "a") for k in range(2000))
    assert contents(house.read("t")) == want
    # Buckets of one commit are read without a shuffle.
    table = house.keyed("t")
    single = [b for b, commits in table.live().items() if len(commits) == 1]
    plan = table.read(single)._jdf.queryExecution().executedPlan().toString()
    assert len(single) >= 14 and "Exchange" not in plan
    assert contents(table.matching(values(spark, 8, 10, "").select(F.col("id").cast("int")))) == [(8, "b"), (9, "a")]


def test_deletes_compaction_and_vacuum(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    for k in range(4):
        house.merge("t", ["id"], values(spark, 10 * k, 10 * k + 30, f"m{k}"), [k], last_id=k)
    house.keyed("t").delete(spark.range(0, 3))
    house.merge("t", ["id"], values(spark, 2, 3, "again"))
    want = contents(house.read("t"))
    assert (2, "again") in want and (1, "m0") not in want and len(want) == 58
    table = house.keyed("t")
    assert table.last_id == 3 and table.all_runs() == {0, 1, 2, 3}
    full = table.compact(most=1)
    assert full and contents(house.read("t")) == want
    assert all(len(c) == 1 for c in house.keyed("t").live().values())
    held = len(files_of(tmp_path / "t"))
    assert house.keyed("t").vacuum() > 0
    assert len(files_of(tmp_path / "t")) < held and contents(house.read("t")) == want
    assert house.keyed("t").compact(most=1) == []


def test_a_commit_without_its_note_does_not_count(spark, tmp_path, monkeypatch):
    house = Warehouse(spark, str(tmp_path))
    house.merge("t", ["id"], values(spark, 0, 20, "a"))
    with monkeypatch.context() as patch:
        # Ends after the rows, before the note.
        patch.setattr(Warehouse, "children", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            KeyedTable.commit(object_without_note(house), values(spark, 0, 9, "lost"))
    assert contents(house.read("t")) == [(k, "a") for k in range(20)]
    house.merge("t", ["id"], values(spark, 5, 6, "b"))
    assert contents(house.read("t")) == sorted((k, "b" if k == 5 else "a") for k in range(20))


def object_without_note(house):
    table = KeyedTable.__new__(KeyedTable)
    table.house, table.name = house, "t"
    table.notes, table.key, table.n_buckets = [], ["id"], 16
    from packetlake.plans.keyed import Note

    table.notes = [Note(1, ["id"], 16, [], [], [], 0)]
    return table


def test_increments_equal_one_upsert(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path / "house"))
    packets = packets_from_events(read_table(spark, FOLDER, "events"))
    table = packets.withColumn("capture_date", F.to_date("captured_at"))
    house.write_run("packets", table, 1, "capture_date")
    assert batch.sessionize(house) == 1
    before = files_of(tmp_path / "house" / "sessions")
    # A few packets come again under other ids: their sessions grow.
    again = table.filter("packet_id < 10").withColumn("packet_id", F.col("packet_id") + 1_000_000)
    house.write_run("packets", again, 2, "capture_date")
    assert batch.sessionize(house) == 1
    after = files_of(tmp_path / "house" / "sessions")
    assert before.items() <= after.items() and len(after) - len(before) <= 10
    empty = spark.createDataFrame([], batch.SESSIONS_SCHEMA)
    first = S.upsert_sessions(empty, S.build_sessions(packets))
    want = S.upsert_sessions(first, S.build_sessions(again))
    columns = ["session_id", *S.SESSION_COLS]
    key = lambda df: sorted(map(str, df.select(columns).collect()))
    assert key(house.read("sessions")) == key(want)


def test_status_updates_and_deletion_of_sessions(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path / "house"))
    packets = packets_from_events(read_table(spark, FOLDER, "events")).filter("packet_id < 200")
    house.write_run(
        "packets", packets.withColumn("capture_date", F.to_date("captured_at")), 1, "capture_date"
    )
    batch.sessionize(house)
    batch.compute_features(house)
    alerts = house.read("sessions").select(
        F.col("session_id").alias("alert_id"), "session_id", F.lit(None).cast("bigint").alias("prediction_id"),
        F.lit("x").alias("alert_type"), F.lit(4).alias("severity"), F.lit("open").alias("status"),
        F.lit("r").alias("rule_name"), F.lit("d").alias("description"), now().alias("triggered_at"),
        F.lit(None).cast("timestamp").alias("acknowledged_at"), F.lit(None).cast("string").alias("metadata"),
    ).select(*ALERTS_SCHEMA.fieldNames())
    house.merge("alerts", ["alert_id"], alerts)
    updates = spark.createDataFrame([(1, "resolved"), (2, "lost")], "alert_id bigint, status string")
    stored = batch.update_alerts(house, updates)
    assert [r.alert_id for r in stored.filter("status <> 'open'").collect()] == [1]
    assert stored.count() == alerts.count()
    total = house.read("sessions").count()
    batch.delete_sessions(house, spark.range(1, 4).select(F.col("id").alias("session_id")))
    for name in ("sessions", "session_features", "alerts"):
        assert house.read(name).count() == total - 3, name
    linked = batch.linked_packets(house)
    assert linked.count() == 200
    assert linked.filter("session_id IS NULL").count() == packets.join(
        S.assign_sessions(packets).select("packet_id", "flow_hash"), "packet_id"
    ).join(
        S.upsert_sessions(spark.createDataFrame([], batch.SESSIONS_SCHEMA), S.build_sessions(packets))
        .filter("session_id < 4").select("flow_hash"), "flow_hash"
    ).count()
    batch.compact(house, most=1)
    assert house.read("sessions").count() == total - 3


def audited(spark, house, run_id, status, finished):
    row = (run_id, "file", "x", None, None, 1, 1, 0, status, None)
    schema = "run_id bigint, source_name string, source_path string, started_at timestamp, " \
        "finished_at timestamp, rows_received bigint, rows_inserted bigint, rows_rejected bigint, " \
        "status string, error_message string"
    df = spark.createDataFrame([row], schema).withColumn("finished_at", F.lit(finished).cast("timestamp"))
    house.write_run("ingestion_runs", df.withColumn("started_at", F.col("finished_at")), run_id)
    house.write_run("staging", spark.range(run_id).select(F.col("id").alias("staged_id")), run_id)


def expired_house(spark, folder):
    house = Warehouse(spark, str(folder))
    for run_id, status, finished in (
        (1, "success", "2024-01-01"), (2, "success", "2024-02-10"), (3, "failed", "2024-02-10"),
        (4, "success", "2024-02-28"), (5, "running", None),
    ):
        audited(spark, house, run_id, status, finished)
    return house


def state(house):
    staged = house.read_runs("staging", None)
    return (
        sorted({r.run_id for r in staged.select("run_id").collect()}),
        sorted(r.run_id for r in batch.ingestion_runs(house).collect()),
    )


def test_expiry_drops_folders_without_reading_them(spark, tmp_path):
    house = expired_house(spark, tmp_path)
    # A staged file that cannot be read does not matter: it is never opened.
    for name in os.listdir(tmp_path / "staging" / "run_id=1"):
        if name.endswith(".parquet"):
            (tmp_path / "staging" / "run_id=1" / name).write_bytes(b"not parquet")
    assert batch.expire(house, now()) == {"staging": [1, 2], "ingestion_runs": [1]}
    assert state(house) == ([3, 4, 5], [2, 3, 4, 5])
    assert not os.path.exists(tmp_path / "staging" / "run_id=2")
    assert batch.expire(house, now()) == {"staging": [], "ingestion_runs": []}
    assert set(batch.ingestion_runs(house).columns) == set(INGESTION_RUNS_SCHEMA.fieldNames())


def test_expiry_after_an_end_between_tombstone_and_drop(spark, tmp_path, monkeypatch):
    house = expired_house(spark, tmp_path)
    with monkeypatch.context() as patch:
        patch.setattr(Warehouse, "remove", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            batch.expire(house, now())
    assert os.path.exists(tmp_path / "staging" / "run_id=1")
    assert state(house)[0] == [3, 4, 5]  # readers leave the runs out already
    batch.expire(house, now())
    assert state(house) == ([3, 4, 5], [2, 3, 4, 5])
    assert not os.path.exists(tmp_path / "staging" / "run_id=1")
