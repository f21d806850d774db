"""File sources and sinks: the derived tables are written as the files a source
reads, in the shared folder, and read back whole."""

import uuid

from pyspark.sql import functions as F

from packetlake.operators import cleaning as C
from packetlake.operators import training as T
from packetlake.session import shared_folder
from packetlake.sources import events as ev
from packetlake.sources import readers, writers
from registry.base import query, with_tables
from registry.ingest import CLEAN_OUT
from registry.training import FLOW_OUT, FLOW_TEXT_SQL

RAW_COLUMNS = (
    "packet_id", "captured_at", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
    "packet_size", "tcp_flags", "payload_hash",
)
# Packets of one JSON array, so that a file holds a bounded number of objects.
ARRAY_PACKETS = 20_000
# Texts are compared with blank and missing ones taken for the same, as CSV does.
RAW_SQL = "SELECT " + ", ".join(
    f"coalesce(CAST({name} AS VARCHAR), '') AS {name}" for name in RAW_COLUMNS
) + " FROM raw_packets"


def new_path(t, name):
    return f"{shared_folder(t.spark)}/files/{name}-{uuid.uuid4().hex}"


def write_csv(df, path):
    """CSV with the blanks around values that the table has."""
    (
        df.write.option("header", True).option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def raw_text(df):
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in RAW_COLUMNS])


@query("read_packets_csv", with_tables("raw_packets", RAW_SQL))
def _(t):
    path = new_path(t, "packets") + ".csv"
    write_csv(t.raw_packets, path)
    return raw_text(readers.read_packets(t.spark, path))


@query("read_packets_json", with_tables("raw_packets", RAW_SQL))
def _(t):
    path = new_path(t, "packets") + ".json"
    bucket = F.floor(F.col("packet_id") / ARRAY_PACKETS)
    (
        t.raw_packets.groupBy(bucket.alias("bucket"))
        .agg(F.to_json(F.collect_list(F.struct(*RAW_COLUMNS))).alias("value"))
        .write.partitionBy("bucket").text(path)
    )
    return raw_text(readers.read_packets(t.spark, path))


def flow_files(t):
    """Exports of three layouts: in order; reversed with a column more; without
    the label column, which the reader skips."""
    # Derived anew for each file set: a stored table of 19 texts a row, read back
    # three times, costs more than the texts.
    path = new_path(t, "flows")
    flows = ev.flow_records(t.table("lineitem"))
    names = list(T.FLOW_COLUMNS)
    first = flows.filter(F.col("source_file").startswith("flows_o"))
    second = flows.filter(~F.col("source_file").startswith("flows_o"))
    write_csv(first.select(*[F.col(f"`{n}`") for n in names]), f"{path}/first")
    write_csv(
        second.select(F.col("row_key").alias("Flow ID"), *[F.col(f"`{n}`") for n in names[::-1]]),
        f"{path}/second",
    )
    write_csv(flows.select(*[F.col(f"`{n}`") for n in names if n != "Label"]), f"{path}/third")
    return readers.read_flow_csvs(t.spark, f"{path}/*/*.csv")


@query("read_flow_csvs", with_tables("flow_text", f"SELECT * EXCLUDE (row_key, is_header) FROM ({FLOW_TEXT_SQL})"))
def _(t):
    return T.flow_columns(flow_files(t))


@query("union_flow_files", with_tables("flows", f"SELECT {FLOW_OUT}, label_code FROM flows"))
def _(t):
    return T.process_flows(flow_files(t))


@query("read_labels_csv", with_tables("raw_labels", """
SELECT session_id, coalesce(label, '') AS label FROM raw_labels"""))
def _(t):
    path = new_path(t, "labels")
    write_csv(
        t.raw_labels.select(F.col("label").alias("LABEL"), F.col("session_id").alias(" Session_ID ")),
        path,
    )
    found = readers.read_labels_csv(t.spark, path)
    # The place of a row in its file is not a value of the table.
    return found.select("session_id", F.coalesce("label", F.lit("")).alias("label"))


@query("write_packets", with_tables("packets", """
SELECT packet_id, epoch_us(captured_at) AS captured_at, src_ip, dst_ip, src_port, dst_port, protocol, packet_size,
  tcp_flags, payload_hash, strftime(captured_at, '%Y-%m-%d') AS capture_date FROM packets"""))
def _(t):
    path = new_path(t, "packet-table")
    writers.write_packets(t.packets, path)
    return readers.read_parquet(t.spark, path).select(
        *RAW_COLUMNS, F.col("capture_date").cast("string").alias("capture_date")
    )


@query("write_staging", with_tables("cleaned", f"SELECT CAST(7 AS BIGINT) AS run_id, {CLEAN_OUT} FROM cleaned"))
def _(t):
    path = new_path(t, "staging")
    valid, rejected = C.clean_packets(t.raw_packets, "packet_id")
    writers.write_staging(valid, rejected, 7, path)
    found = readers.read_parquet(t.spark, path).drop("raw_record")
    return found.withColumn("run_id", F.col("run_id").cast("bigint"))


@query("export_csv", with_tables("packets", """
SELECT CAST(packet_id AS VARCHAR) AS "Packet ID", CASE WHEN packet_size > 1200 THEN 'alert' ELSE 'normal' END AS "Status",
  epoch_us(captured_at) AS "Timestamp", src_ip AS "Source IP", dst_ip AS "Destination IP", protocol AS "Protocol",
  CAST(packet_size AS VARCHAR) AS "Size", coalesce(tcp_flags, '') AS "TCP Flags" FROM packets"""))
def _(t):
    path = new_path(t, "export")
    writers.export_csv(writers.packets_export(t.packets), path)
    found = t.spark.read.option("header", True).csv(path)
    return found.withColumn("Timestamp", F.col("Timestamp").cast("timestamp")).fillna("", ["TCP Flags"])


# --- headers -----------------------------------------------------------------


def renamed(t):
    """Packets under headers of an export: other names, case and blanks, sizes in
    two columns of which the first has gaps, and an unknown column."""
    size = F.col("packet_size")
    return t.raw_packets.select(
        "packet_id",
        F.col("captured_at").alias(" Timestamp"), "src_ip", F.col("dst_ip").alias("DST_IP "),
        F.col("src_port").alias("Src Port"), F.col("dst_port").alias("Dst Port"),
        F.col("protocol").alias("Protocol"),
        F.when(F.col("packet_id") % 3 != 0, size).alias("TotLen Fwd Pkts"),
        size.alias("Pkt Len Max"), "tcp_flags", "payload_hash", F.lit("x").alias("Colour"),
    )


@query("normalize_columns", with_tables("raw_packets", "SELECT *, 'x' AS colour FROM raw_packets"))
def _(t):
    return C.normalize_columns(renamed(t))


@query("clean_renamed_packets", with_tables("cleaned", f"SELECT {CLEAN_OUT} FROM cleaned"))
def _(t):
    return C.check_packets(renamed(t), "packet_id").drop("raw_record")


# Neither addresses nor optional columns: stand-ins and nulls.
BARE = ("packet_id", "captured_at", "dst_port", "protocol")


@query("fill_absent_columns", with_tables("raw_packets", f"""
SELECT {", ".join(BARE)}, '192.168.1.100' AS src_ip, '10.0.0.1' AS dst_ip, '0' AS packet_size FROM raw_packets"""))
def _(t):
    return C.fill_absent_columns(t.raw_packets.select(*BARE))


@query("clean_layout", with_tables("typed_packets", """
SELECT packet_id, epoch_us(captured_at) AS captured_at, '192.168.1.100' AS src_ip, '10.0.0.1' AS dst_ip,
  CAST(NULL AS INTEGER) AS src_port, dst_port, protocol, 0 AS packet_size, CAST(NULL AS VARCHAR) AS tcp_flags,
  CAST(NULL AS VARCHAR) AS payload_hash, errs = '' AS is_valid, errs AS validation_errors,
  sha256(concat_ws('|', coalesce(strftime(captured_at,'%Y-%m-%dT%H:%M:%S.%fZ'),''), '192.168.1.100', '10.0.0.1', '',
    coalesce(CAST(dst_port AS VARCHAR),''), coalesce(protocol,''), '0', '')) AS fingerprint
FROM (SELECT *, concat_ws(',', CASE WHEN captured_at IS NULL THEN 'invalid_captured_at' END,
  CASE WHEN coalesce(protocol,'') = '' THEN 'missing_protocol' END) AS errs FROM typed_packets)"""))
def _(t):
    return C.check_packets(t.raw_packets.select(*BARE), "packet_id").drop("raw_record")


def refusals(t, checks):
    """What each of (name, action) is refused with, null if it is not."""
    rows = []
    for name, action in checks:
        try:
            action()
            rows.append((name, None))
        except ValueError as refused:
            rows.append((name, str(refused)))
    return t.spark.createDataFrame(rows, "part string, message string")


@query("strict_gate", with_tables("cleaned", """
SELECT 'all' AS part, 'Strict mode: ' || count(*) || ' rows failed validation' AS message FROM cleaned WHERE NOT is_valid
UNION ALL SELECT 'valid', NULL
UNION ALL SELECT 'columns', 'Missing required columns: [''captured_at'', ''protocol'']'"""))
def _(t):
    checked = C.check_packets(t.raw_packets, "packet_id")
    return refusals(t, [
        ("all", lambda: C.strict_gate(checked)),
        ("valid", lambda: C.strict_gate(checked.filter("is_valid"))),
        ("columns", lambda: C.check_packets(t.raw_packets.drop("captured_at", "protocol"))),
    ])
