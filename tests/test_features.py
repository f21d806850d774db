import math

import pytest
from pyspark.sql import functions as F

from helpers import packet, packets
from packetlake.functions.columns import safe_div
from packetlake.operators import features as X
from packetlake.schemas import FEATURE_COLS


def one_session(spark, rows, src="10.0.0.1"):
    sessions = spark.createDataFrame([(1, src)], "session_id long, src_ip string")
    linked = packets(spark, rows).withColumn("session_id", F.lit(1).cast("bigint"))
    (row,) = X.extract_features(sessions, linked).collect()
    return row


@pytest.mark.parametrize("n, d, want", [(10, 2, 5.0), (10, 0, 0.0)])
def test_safe_div(spark, n, d, want):
    row = spark.range(1).select(safe_div(F.lit(n), F.lit(d)).alias("q")).first()
    assert row.q == want


@pytest.mark.parametrize("times, mean, low, high", [
    ([0, 1, 11], 5.5, 1.0, 10.0), ([0, 2, 6], 3.0, 2.0, 4.0), ([0, 5, 10], 5.0, 5.0, 5.0),
])
def test_inter_arrival(spark, times, mean, low, high):
    row = one_session(spark, [packet(i, t) for i, t in enumerate(times)])
    assert (row.iat_mean, row.iat_min, row.iat_max) == (mean, low, high)


def test_inter_arrival_of_one_packet(spark):
    row = one_session(spark, [packet(1, 0)])
    assert (row.iat_mean, row.iat_std, row.iat_min, row.iat_max) == (0, 0, 0, 0)
    assert (row.bytes_per_sec, row.packets_per_sec, row.packet_size_std) == (0, 0, 0)


@pytest.mark.parametrize("sizes, want", [
    ([100, 100, 200, 200], 1.0), ([80, 80, 80], 0.0), ([1, 2, 3, 4], 2.0),
])
def test_entropy(spark, sizes, want):
    row = one_session(spark, [packet(i, i, size=s) for i, s in enumerate(sizes)])
    assert row.payload_entropy == pytest.approx(want)


def test_whole_vector(spark):
    row = one_session(spark, [
        packet(1, 0, flags="SYN"), packet(2, 4), packet(3, 10, size=100),
    ])
    assert row.duration_sec == 10 and row.total_bytes == 300 and row.total_packets == 3
    assert row.bytes_per_sec == 30 and row.packets_per_sec == pytest.approx(0.3)
    assert row.iat_mean == 5.0 and row.iat_std == pytest.approx(math.sqrt(2))
    assert row.has_syn and not row.has_fin and not row.has_rst
    assert row.avg_packet_size == 100 and row.packet_size_std == 0.0


def test_direction_ratio(spark):
    row = one_session(spark, [
        packet(1, 0, size=100), packet(2, 1, size=200),
        packet(3, 2, "10.0.0.2", "10.0.0.1", 443, 12345, size=100),
    ])
    assert row.fwd_bwd_byte_ratio == 3.0


def test_flags_and_ports(spark):
    row = one_session(spark, [
        packet(1, 0, dport=80, flags="SYN"), packet(2, 1, dport=443, flags="fin,ack"),
        packet(3, 2, dport=8080, flags="RST"), packet(4, 3, dport=None),
    ])
    assert row.has_syn and row.has_fin and row.has_rst
    assert row.unique_dst_ports == 3


def test_session_without_packets(spark):
    row = one_session(spark, [])
    assert all(not row[c] for c in FEATURE_COLS)


def test_gaps_across_slices(spark):
    rows = [packet(i, t) for i, t in enumerate([0, 3, 9.5, 10.5, 31, 31, 95])]
    linked = packets(spark, rows).withColumn("session_id", F.lit(1).cast("bigint"))
    for width in (1, 10, 1000):
        gaps = sorted(r.gap for r in X.packet_gaps(linked, slice_seconds=width).collect())
        assert gaps == [0, 1_000_000, 3_000_000, 6_500_000, 20_500_000, 64_000_000]


@pytest.mark.parametrize("slice_seconds", [1, 7, 10_000])
def test_port_fanout(spark, slice_seconds):
    import random

    rng = random.Random(5)
    rows = [
        packet(i, rng.randint(0, 200), src=f"10.0.0.{rng.choice([1, 1, 2])}",
               dport=rng.choice([None, 22, 53, 80, 443]))
        for i in range(300)
    ]
    got = X.port_fanout(packets(spark, rows), 20, slice_seconds).collect()
    want = {
        r[0]: len({
            q[5] for q in rows
            if q[2] == r[2] and q[5] is not None and 0 <= (r[1] - q[1]).total_seconds() <= 20
        })
        for r in rows
    }
    assert {r.packet_id: r.port_fanout for r in got} == want
