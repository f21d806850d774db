import json

import pytest
from pyspark.sql import functions as F

from packetlake.operators import cleaning as C
from packetlake.operators import ingest as G
from packetlake.sources import readers, writers

HEADER = "captured_at,src_ip,dst_ip,src_port,dst_port,protocol,packet_size,tcp_flags,payload_hash"


def raw(spark, **columns):
    base = {
        "captured_at": "2026-04-14T10:00:00Z", "src_ip": "10.0.0.1", "dst_ip": "10.0.0.2",
        "protocol": "tcp", "packet_size": "60",
    }
    base.update(columns)
    names = [n for n, v in base.items() if v is not ...]
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([tuple(base[n] for n in names)], schema)


def check(spark, **columns):
    return C.check_packets(raw(spark, **columns)).first()


def test_csv_ingests_once(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(
        HEADER + "\n2025-11-03T23:59:58Z,198.51.100.7,203.0.113.90,40001,8443,TCP,77,PSH,f0\n"
        "2025-11-04T00:00:00.5Z,203.0.113.90,198.51.100.7,8443,40001,TCP,1301,,f1\n"
        "2025-11-04T06:30:00Z,192.0.2.33,198.51.100.7,,,ICMP,0,,\n"
    )
    valid, rejected = C.clean_packets(readers.read_packets(spark, str(path)))
    assert valid.count() == 3 and rejected.count() == 0
    numbered = valid.withColumn("n", F.monotonically_increasing_id())
    first = G.dedup_insert(numbered, numbered.limit(0), "n")
    assert first.count() == 3
    assert G.dedup_insert(numbered, first, "n").count() == 0


def test_json_with_unknown_names_becomes_constants(spark, tmp_path):
    path = tmp_path / "in.json"
    path.write_text(json.dumps([
        {"timestamp": "2025-11-05T07:08:19Z", "source_ip": "198.51.100.20", "sport": 40123,
         "protocol": "icmp", "size": 93, "tcp_flags": "URG"},
        {"time": "2025-11-05T07:08:41Z", "src": "203.0.113.5", "protocol": "tcp", "length": 1111},
    ]))
    rows = C.check_packets(readers.read_packets(spark, str(path))).collect()
    assert all(r.is_valid for r in rows) and len(rows) == 2
    assert {(r.src_ip, r.dst_ip, r.packet_size, r.src_port) for r in rows} == {
        ("192.168.1.100", "10.0.0.1", 0, None)
    }
    assert {r.captured_at.second for r in rows} == {19, 41}
    record = json.loads(next(r.raw_record for r in rows if r.captured_at.second == 41))
    assert record["src"] == "203.0.113.5" and record["tcp_flags"] is None


def test_unknown_suffix_is_refused(spark):
    with pytest.raises(ValueError):
        readers.read_packets(spark, "/in/packets.xml")


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match=r"\['captured_at', 'protocol'\]"):
        C.check_packets(raw(spark, captured_at=..., protocol=...))


@pytest.mark.parametrize("columns, errors", [
    ({}, []),
    ({"captured_at": "yesterday"}, ["invalid_captured_at"]),
    ({"src_ip": "  ", "dst_ip": None}, ["missing_src_ip", "missing_dst_ip"]),
    ({"protocol": ""}, ["missing_protocol"]),
    ({"packet_size": "-1"}, ["invalid_packet_size"]),
    ({"packet_size": "1.5"}, ["invalid_packet_size"]),
    ({"packet_size": "many"}, ["invalid_packet_size"]),
    ({"src_port": "70000"}, []),
    ({"captured_at": None, "packet_size": None}, ["invalid_captured_at", "invalid_packet_size"]),
])
def test_validation(spark, columns, errors):
    row = check(spark, **columns)
    assert row.validation_errors == errors and row.is_valid is (not errors)


def test_ports_out_of_range_become_null(spark):
    row = check(spark, src_port="70000", dst_port="443")
    assert row.src_port is None and row.dst_port == 443


def test_aliases_and_coalesce(spark):
    df = spark.createDataFrame(
        [(None, "2026-04-14T10:00:00Z", "5", None, "7", "tcp")],
        "`Timestamp ` string, time string, `Dst Port` string, "
        "`TotLen Fwd Pkts` string, `TotLen Bwd Pkts` string, PROTOCOL string",
    )
    row = C.check_packets(df).first()
    assert row.is_valid and row.dst_port == 5 and row.packet_size == 7 and row.protocol == "TCP"
    assert C.check_packets(df).columns == C.CLEAN_COLUMNS


def test_strict_gate(spark):
    C.strict_gate(C.check_packets(raw(spark)))
    with pytest.raises(ValueError, match="1 rows"):
        C.strict_gate(C.check_packets(raw(spark, protocol=" ")))


def test_many_copies_insert_once(spark):
    copies = C.check_packets(
        spark.range(2000).select(
            F.col("id").cast("string").alias("n"), *[
                F.lit(v).alias(c) for c, v in {
                    "captured_at": "2026-04-14T10:00:00Z", "src_ip": "a", "dst_ip": "b",
                    "protocol": "udp", "packet_size": "1", "payload_hash": "x",
                }.items()
            ]
        ), "n",
    ).withColumn("n", F.col("n").cast("bigint"))
    (row,) = G.dedup_insert(copies, copies.limit(0), "n").collect()
    assert row.n == 0


def test_append_reports_each_row(spark):
    rows = raw(spark).select(
        F.col("captured_at").cast("timestamp").alias("captured_at"), "src_ip", "dst_ip",
        F.lit("x").alias("src_port"), F.lit(None).cast("string").alias("dst_port"), "protocol",
        "packet_size", F.lit(None).cast("string").alias("payload_hash"), F.lit(1).alias("row"),
    )
    good = rows.withColumns({"src_port": F.lit("70000"), "row": F.lit(2)})
    again = good.withColumn("row", F.lit(3))
    lacking = good.withColumns({"row": F.lit(4), "src_ip": F.lit(None).cast("string")})
    batch = rows.unionByName(good).unionByName(again).unionByName(lacking)
    empty = spark.createDataFrame([], "captured_at timestamp, fingerprint string")
    got = {r.row: (r.status, r.message) for r in G.append_packets(batch, empty, "row").collect()}
    assert got == {
        1: ("invalid", "src_port must be an integer"), 2: ("created", None),
        3: ("duplicate", None), 4: ("invalid", "Missing required fields: src_ip"),
    }


def test_run_rows(spark):
    runs = spark.createDataFrame([], "run_id long")
    now = F.lit("2026-01-01").cast("timestamp")
    started = G.start_run(runs, "file", "/in/a.csv", 5, now)
    assert (started.first().run_id, started.first().status) == (1, "running")
    done = G.finish_run(started, 1, "success", 4, 1, now).first()
    assert (done.status, done.rows_inserted, done.rows_rejected) == ("success", 4, 1)
    with pytest.raises(ValueError):
        G.finish_run(started, 1, "gone", 0, 0, now)


def test_staging_keeps_both_row_sets(spark, tmp_path):
    rows = C.check_packets(raw(spark).unionByName(raw(spark, protocol=" ")))
    path = str(tmp_path / "staging")
    writers.write_staging(rows.filter("is_valid"), C.quarantine(rows), 3, path)
    back = spark.read.parquet(path)
    assert {(r.run_id, r.is_valid) for r in back.collect()} == {(3, True), (3, False)}


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "2026-04-14 10:00:00", "10.0.0.1/32", "10.0.0.2", "TCP", 1300, None)],
        "packet_id int, captured_at string, src_ip string, dst_ip string, protocol string, "
        "packet_size int, tcp_flags string",
    )
    path = str(tmp_path / "export")
    writers.export_csv(writers.packets_export(df), path)
    (row,) = spark.read.option("header", True).csv(path).collect()
    assert row["Status"] == "alert" and row["Source IP"] == "10.0.0.1"


def test_packet_table_is_partitioned_by_day(spark, tmp_path):
    path = str(tmp_path / "packets")
    rows = C.check_packets(raw(spark).unionByName(raw(spark, captured_at="2026-04-15T01:00:00Z")))
    writers.write_packets(rows, path)
    day = spark.read.parquet(path).filter("capture_date = '2026-04-15'")
    assert day.count() == 1
    assert "PartitionFilters: [isnotnull(capture_date" in day._jdf.queryExecution().toString()
