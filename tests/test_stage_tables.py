"""The stored tables that the registered queries share."""

import datetime

import pytest
from pyspark.sql import functions as F

from packetlake.operators import sessions as S
from packetlake.session import PACKET_DEFAULTS, SHUFFLE_CONF
from packetlake.sources.readers import read_packets
from registry import base, sources


@pytest.fixture
def folder(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    kinds = ["signup", "view", "click", "purchase", "error"]
    spark.createDataFrame(
        [(k, start + datetime.timedelta(hours=7 * k), k % 9, kinds[k % 5], float(k % 50), f'{{"k": {k % 11}}}')
         for k in range(400)],
        "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    ).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_assigned_keeps_only_what_packets_lack(spark, folder):
    tables = base.Tables(spark, folder)
    assigned = tables.assigned
    assert assigned.columns == ["packet_id", *S.FLOW_KEY, "session_seq", "started_at", "flow_hash"]
    whole = S.assign_sessions(tables.packets).select(assigned.columns)
    assert sorted(map(str, assigned.collect())) == sorted(map(str, whole.collect()))
    assert "payload_hash" in tables.linked.columns and tables.linked.count() == 400


def test_sessions_are_built_once_before_they_are_numbered(spark, folder, monkeypatch):
    stored, dropped = [], []
    store, drop = base.store_stage, base.drop_stages
    monkeypatch.setattr(base, "store_stage", lambda df, name: (stored.append(name), store(df, name))[1])
    monkeypatch.setattr(base, "drop_stages", lambda df: (dropped.append(df.stage_paths[0]), drop(df)))
    sessions = base.Tables(spark, folder).sessions
    assert stored == ["packets", "built", "sessions"]
    assert len(dropped) == 1 and "/built-" in dropped[0]
    assert sorted(r["session_id"] for r in sessions.collect()) == list(range(1, sessions.count() + 1))


def test_network_tables_bound_what_a_task_reads(spark, folder):
    before = {key: spark.conf.get(key) for key in PACKET_DEFAULTS}
    try:
        for key in PACKET_DEFAULTS:
            spark.conf.set(key, "1g")
        base.tables(spark, folder)
        assert {key: spark.conf.get(key) for key in PACKET_DEFAULTS} == PACKET_DEFAULTS
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_json_files_are_dealt_to_tasks_by_size(spark, tmp_path):
    # Three arrays of 11 MB each: with Spark's 128 MB they shared a task at 2 cores.
    filler = "x" * 1000
    spark.range(33_000).selectExpr("id", f"'{filler}' AS text").groupBy(
        F.expr("id % 3").alias("bucket")
    ).agg(F.expr("to_json(collect_list(struct(id, text)))").alias("value")).write.partitionBy(
        "bucket"
    ).text(f"{tmp_path}/in.json")
    cores = "spark.sql.files.minPartitionNum"
    try:
        spark.conf.set(cores, "1")
        found = read_packets(spark, f"{tmp_path}/in.json")
        assert found.count() == 33_000 and found.schema["id"].dataType.simpleString() == "string"
        assert found.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset(cores)


def test_shuffles_begin_with_partitions_for_the_size_of_the_tables(spark, folder, monkeypatch):
    # However few the session has: partitions that grow with the input spill.
    before = spark.conf.get(SHUFFLE_CONF, None)
    size = base.stored_bytes(spark, f"{folder}/events.parquet")
    assert size > 0 and base.stored_bytes(spark, f"{folder}/none.parquet") == 0
    try:
        monkeypatch.setattr(base, "EVENTS_PARTITION_BYTES", size // 40)
        tables = base.tables(spark, folder)
        wanted = -(-size // (size // 40))
        assert int(spark.conf.get(SHUFFLE_CONF)) == wanted >= 40
        moved = tables.packets.groupBy("packet_id").count().repartition("count")
        assert f"hashpartitioning(packet_id#" in (plan := moved._jdf.queryExecution().toString())
        assert f", {wanted})" in plan
        monkeypatch.setattr(base, "_TABLES", {})
        monkeypatch.setattr(base, "EVENTS_PARTITION_BYTES", size)
        base.tables(spark, folder)  # a small folder afterwards: the session's own number
        assert spark.conf.get(SHUFFLE_CONF) == spark.conf.get("spark.sql.shuffle.partitions")
    finally:
        spark.conf.unset(SHUFFLE_CONF) if before is None else spark.conf.set(SHUFFLE_CONF, before)


def test_flow_files_are_written_without_a_stored_table(spark, tmp_path):
    shipped = datetime.datetime(1996, 9, 13)
    spark.createDataFrame(
        [(k, k % 7, k % 5, k % 7 + 1, float(k % 50 + 1), 901.5 + k, "RNA"[k % 3], "OF"[k % 2], shipped)
         for k in range(60)],
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    tables = base.Tables(spark, str(tmp_path))
    found = sources.flow_files(tables).drop("source_file")
    assert "flow_records" not in vars(tables)
    whole = tables.flow_records.select(found.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))
