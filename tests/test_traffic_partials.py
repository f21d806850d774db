"""Traffic reports from partial aggregates equal a full recomputation."""

import random
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from packetlake.operators import traffic as full
from packetlake.plans import traffic
from packetlake.plans.warehouse import Warehouse
from packetlake.sources.events import packets_from_events, read_table

FOLDER = "/root/testdata/sf0.001"


def contents(df):
    return sorted(map(str, df.collect()))


def test_reports_read_new_runs_only(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    packets = packets_from_events(read_table(spark, FOLDER, "events"))
    for run, rule in ((1, "packet_id % 5 < 3"), (2, "packet_id % 5 = 3"), (3, "packet_id % 5 = 4")):
        rows = packets.filter(rule).withColumn("capture_date", F.to_date("captured_at"))
        house.write_run("packets", rows, run, "capture_date")
        assert traffic.refresh(house) == [run]
        # Packets of a run that is aggregated are not looked at again.
        for at in (tmp_path / "packets" / f"run_id={run}").glob("capture_date=*"):
            shutil.rmtree(at)
            at.mkdir()
    assert traffic.refresh(house) == []
    stamp = F.lit("2024-02-01").cast("timestamp")
    as_of = F.lit("2024-01-01 00:20:00").cast("timestamp")
    for k in (1, 7, 100, 10_000):
        want = full.top_ips(packets, k).collect()
        assert traffic.top_ips(house, k).collect() == want
    columns = ["minute_bucket", "packets_per_minute", "bytes_per_minute", "active_source_ips"]
    assert contents(traffic.traffic_trends(house, 9).select(columns)) == contents(
        full.traffic_trends(packets, 9).select(columns)
    )
    assert contents(traffic.protocol_distribution(house, stamp)) == contents(
        full.protocol_distribution(packets, stamp)
    )
    alerts = spark.createDataFrame([("open",), ("open",), ("resolved",)], "status string")
    got = traffic.live_metrics(house, alerts, as_of).first()
    want = full.live_metrics(packets, alerts, as_of).first()
    assert got.asDict() == want.asDict()


@pytest.mark.parametrize("seed", range(3))
def test_three_phases_find_the_exact_top(spark, seed):
    draw = random.Random(seed)
    rows, total = [], Counter()
    runs = 6
    for run in range(runs):
        for ip in range(80):
            # Some sources are large in no list, but in their sum.
            n = draw.choice([0, 1, 2, 3, 50, 20 if ip % 7 == seed else 0])
            if n:
                rows.append((run, f"10.0.0.{ip}", n, 10 * n, None, None))
                total[f"10.0.0.{ip}"] += n
    schema = "run_id int, ip string, packet_count bigint, total_bytes bigint, first_seen timestamp, last_seen timestamp"
    partial = spark.createDataFrame(rows, schema)
    for k in (1, 5, 12):
        got = [(r.ip, r.packet_count) for r in traffic.top_sources(partial, k, runs).collect()]
        assert got == sorted(total.items(), key=lambda x: (-x[1], x[0]))[:k]
