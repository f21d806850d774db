import random
import uuid

import pytest
from pyspark.sql import functions as F

from helpers import packet, packets
from packetlake import schemas
from packetlake.functions.columns import FLOW_NAMESPACE, has_tcp_terminator, uuid5
from packetlake.operators import sessions as S
from packetlake.session import store_stage


def keys(spark, *rows):
    got = S.flow_key(packets(spark, rows)).select(*S.FLOW_KEY).collect()
    return [tuple(r) for r in got]


def built(spark, rows, **options):
    out = S.build_sessions(packets(spark, rows), **options)
    return sorted((r.packet_count, r.total_bytes) for r in out.collect())


def test_both_directions_have_one_key(spark):
    a, b = keys(
        spark, packet(1, 0), packet(2, 1, "10.0.0.2", "10.0.0.1", 443, 12345)
    )
    assert a == b


def test_other_flow_has_other_key(spark):
    a, b = keys(spark, packet(1, 0), packet(2, 0, dst="10.0.0.9"))
    assert a != b


def test_null_ports(spark):
    (key,) = keys(spark, packet(1, 0, sport=None, dport=None, protocol="icmp"))
    assert key == ("10.0.0.1", "10.0.0.2", "", "", "ICMP")


def test_ports_compare_as_text(spark):
    (key,) = keys(spark, packet(1, 0, src="10.0.0.1", dst="10.0.0.1", sport=443, dport=12345))
    assert key[2:4] == ("12345", "443")


@pytest.mark.parametrize(
    "flags, ends",
    [("FIN,ACK", True), ("rst", True), ("SYN,ACK", False), (None, False), ("", False)],
)
def test_terminators(spark, flags, ends):
    df = spark.createDataFrame([(flags,)], "f string")
    assert df.select(has_tcp_terminator(F.col("f")).alias("t")).first().t is ends


def test_no_packets_no_sessions(spark):
    assert built(spark, []) == []


def test_single_packet(spark):
    assert built(spark, [packet(1, 0)]) == [(1, 100)]


def test_idle_gap_splits(spark):
    rows = [packet(1, 0, size=100), packet(2, 10, size=200), packet(3, 130, size=150)]
    assert built(spark, rows) == [(1, 150), (2, 300)]


def test_gap_equal_to_timeout_does_not_split(spark):
    assert built(spark, [packet(1, 0), packet(2, 60)]) == [(2, 200)]


@pytest.mark.parametrize("timeout, sessions", [(60, 1), (20, 2)])
def test_timeout_is_a_parameter(spark, timeout, sessions):
    rows = [packet(1, 0), packet(2, 30)]
    assert len(built(spark, rows, idle_seconds=timeout)) == sessions


@pytest.mark.parametrize("flags", ["FIN,ACK", "RST"])
def test_terminator_belongs_to_the_old_session(spark, flags):
    rows = [
        packet(1, 0, flags="SYN"), packet(2, 1, flags=flags),
        packet(3, 2, "10.0.0.2", "10.0.0.1", 443, 12345, flags="SYN"),
    ]
    assert built(spark, rows) == [(1, 100), (2, 200)]


def test_same_start_gives_one_hash_and_merges(spark):
    rows = [packet(1, 0, flags="FIN"), packet(2, 0)]
    new = S.build_sessions(packets(spark, rows))
    assert [r.packet_count for r in new.collect()] == [1, 1]
    assert new.select("flow_hash").distinct().count() == 1
    empty = spark.createDataFrame([], schemas.SESSIONS_SCHEMA)
    (merged,) = S.upsert_sessions(empty, new).collect()
    assert (merged.session_id, merged.packet_count, merged.total_bytes) == (1, 2, 200)


@pytest.mark.parametrize("seconds, text", [(0, "08:00:00"), (0.05, "08:00:00.050000")])
def test_flow_hash_is_a_name_based_uuid(spark, seconds, text):
    (row,) = S.build_sessions(packets(spark, [packet(1, seconds)])).collect()
    name = f"10.0.0.1|10.0.0.2|12345|443|TCP|2026-04-20T{text}+00:00"
    assert row.flow_hash == str(uuid.uuid5(uuid.UUID(FLOW_NAMESPACE), name))


def test_uuid5_equals_python(spark):
    names = [f"name {i}" for i in range(200)]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(
        "n", uuid5(F.col("n")).alias("u")
    )
    space = uuid.UUID(FLOW_NAMESPACE)
    assert all(r.u == str(uuid.uuid5(space, r.n)) for r in got.collect())


def brute_force(rows, idle):
    """Session number per packet id from a plain loop over one sorted flow."""
    sessions, last = {}, {}
    for number, at, src, dst, sport, dport, proto, _size, flags in sorted(
        rows, key=lambda r: (r[1], r[0])
    ):
        ends = [(src, "" if sport is None else str(sport)), (dst, "" if dport is None else str(dport))]
        key = (*sorted(ends), proto)
        seq, before, ended = last.get(key, (0, None, False))
        if before is None or ended or (at - before).total_seconds() > idle:
            seq += 1
        last[key] = (seq, at, bool(flags and ("FIN" in flags or "RST" in flags)))
        sessions[number] = (key, seq)
    return sessions


@pytest.mark.parametrize("slice_seconds", [1, 10, 3600])
@pytest.mark.parametrize("seed", [1, 2])
def test_slices_do_not_change_sessions(spark, slice_seconds, seed):
    rng = random.Random(seed)
    rows = []
    for number in range(600):
        hot = rng.random() < 0.5  # half of all packets in one flow
        host = "10.0.0.1" if hot else f"10.0.0.{rng.randint(1, 4)}"
        rows.append(packet(
            number, rng.choice([rng.uniform(0, 900), rng.randint(0, 900)]), src=host,
            flags=rng.choice([None, "ACK", "ACK", "SYN", "FIN,ACK"]),
            size=rng.randint(40, 1500),
        ))
    want = brute_force(rows, 5)
    got = S.assign_sessions(packets(spark, rows), 5, slice_seconds).collect()
    assert len(got) == len(rows)
    assert {r.packet_id: r.session_seq for r in got} == {n: s for n, (_, s) in want.items()}
    starts = {}
    for number, at, *_ in rows:
        starts[want[number]] = min(at, starts.get(want[number], at))
    assert all(r.started_at == starts[want[r.packet_id]] for r in got)
    total = S.build_sessions(packets(spark, rows), 5, slice_seconds)
    assert total.count() == len(set(want.values()))
    assert total.agg(F.sum("packet_count")).first()[0] == len(rows)


def test_second_run_only_takes_new_packets(spark):
    rows = packets(spark, [packet(1, 0), packet(2, 5)]).withColumn(
        "session_id", F.lit(None).cast("bigint")
    )
    empty = spark.createDataFrame([], schemas.SESSIONS_SCHEMA)
    sessions, linked = S.sessionize_increment(rows, empty)
    assert {r.session_id for r in linked.collect()} == {1}
    late = packets(spark, [packet(3, 8)]).withColumn("session_id", F.lit(None).cast("bigint"))
    sessions2, linked2 = S.sessionize_increment(linked.unionByName(late), sessions)
    # The flow goes on, but the run starts a session of its own.
    assert sorted(r.packet_count for r in sessions2.collect()) == [1, 2]
    ids = {r.packet_id: r.session_id for r in linked2.collect()}
    assert ids[1] == ids[2] == 1 and ids[3] == 2


def test_upsert_adds_to_known_sessions(spark):
    new = S.build_sessions(packets(spark, [packet(1, 0), packet(2, 5)]))
    empty = spark.createDataFrame([], schemas.SESSIONS_SCHEMA)
    once = S.upsert_sessions(empty, new)
    (twice,) = S.upsert_sessions(once, new).collect()
    assert (twice.session_id, twice.packet_count, twice.total_bytes) == (1, 4, 400)


def test_sessions_of_any_size_link_alike(spark):
    rows = packets(spark, [packet(i, i) for i in range(5)] + [packet(9, 0, dst="10.0.0.7")])
    empty = spark.createDataFrame([], schemas.SESSIONS_SCHEMA)
    sessions = S.upsert_sessions(empty, S.build_sessions(rows))
    linked = S.session_ids(S.packet_assignments(S.assign_sessions(rows)), sessions)
    counts = linked.groupBy("session_id").count().join(sessions, "session_id").collect()
    assert sorted((r["count"], r.packet_count) for r in counts) == [(1, 1), (5, 5)]


def test_packets_of_a_hot_session_are_split(spark):
    hot = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 5000)
    rows = spark.range(0, 300_000, 1, 8).select(
        F.col("id").alias("packet_id"), F.md5(hot.cast("string")).alias("flow_hash")
    )
    sessions = store_stage(
        rows.select("flow_hash").distinct().withColumn("session_id", F.crc32("flow_hash")),
        "sessions",
    )
    small = {
        "spark.sql.shuffle.partitions": "64",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {key: spark.conf.get(key, None) for key in small}
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        linked = S.session_ids(rows, sessions)
        found = linked.collect()
        plan = linked._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert "skew=true" in plan
    assert len(found) == 300_000 and all(r.session_id is not None for r in found)
