"""Normalise and validate raw packet rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlake.functions.columns import bounded_int, fingerprint, parse_captured_at, strip

# Header text -> packet column.
COLUMN_ALIASES = {
    "timestamp": "captured_at",
    "time": "captured_at",
    "dst port": "dst_port",
    "src port": "src_port",
    "protocol": "protocol",
    "totlen fwd pkts": "packet_size",
    "totlen bwd pkts": "packet_size",
    "pkt len max": "packet_size",
    "label": "label",
}
# Stand-ins for columns a flow export does not have.
ABSENT_COLUMN_VALUES = {
    "src_ip": "192.168.1.100",
    "dst_ip": "10.0.0.1",
    "packet_size": "0",
}
# Columns a source must have, and the layout of cleaned rows.
REQUIRED_COLUMNS = ["captured_at", "dst_ip", "packet_size", "protocol", "src_ip"]
CLEAN_COLUMNS = [
    "captured_at", "fingerprint", "src_ip", "dst_ip", "src_port", "dst_port",
    "protocol", "packet_size", "tcp_flags", "payload_hash", "raw_record",
    "is_valid", "validation_errors",
]
MAX_PORT = 65535


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trim and lower headers and apply the aliases. Several inputs for one
    name are coalesced from left to right."""
    inputs: dict[str, list[Column]] = {}
    for column in df.columns:
        header = column.strip().lower()
        name = COLUMN_ALIASES.get(header, header)
        inputs.setdefault(name, []).append(F.col(f"`{column}`"))
    return df.select(
        *[(F.coalesce(*cols) if len(cols) > 1 else cols[0]).alias(name)
          for name, cols in inputs.items()]
    )


def fill_absent_columns(df: DataFrame) -> DataFrame:
    absent = {
        name: F.lit(value)
        for name, value in ABSENT_COLUMN_VALUES.items() if name not in df.columns
    }
    return df.withColumns(absent) if absent else df


def require_columns(df: DataFrame) -> DataFrame:
    missing = sorted(set(REQUIRED_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def type_columns(df: DataFrame) -> DataFrame:
    """Parse times, trim text and bound numbers; optional columns appear as null."""
    present = lambda name: (
        F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
    )
    return df.withColumns({
        "captured_at": (
            F.col("captured_at") if dict(df.dtypes)["captured_at"] == "timestamp"
            else parse_captured_at(strip(present("captured_at")))
        ),
        "src_ip": strip(present("src_ip")),
        "dst_ip": strip(present("dst_ip")),
        "protocol": strip(F.upper(present("protocol"))),
        "src_port": bounded_int(present("src_port"), 0, MAX_PORT),
        "dst_port": bounded_int(present("dst_port"), 0, MAX_PORT),
        "packet_size": bounded_int(present("packet_size"), 0),
        "tcp_flags": present("tcp_flags"),
        "payload_hash": present("payload_hash"),
    })


def validation_errors() -> Column:
    """Error codes of a typed row, in fixed order; empty if it is valid."""
    blank = lambda name: F.coalesce(F.col(name), F.lit("")) == ""
    checks = [
        (F.col("captured_at").isNull(), "invalid_captured_at"),
        (blank("src_ip"), "missing_src_ip"),
        (blank("dst_ip"), "missing_dst_ip"),
        (blank("protocol"), "missing_protocol"),
        (F.col("packet_size").isNull(), "invalid_packet_size"),
    ]
    return F.array_compact(F.array(*[F.when(bad, code) for bad, code in checks]))


def raw_record(df: DataFrame) -> Column:
    """The typed row as JSON text, unknown extra columns and nulls included."""
    fields = [F.col(f"`{name}`") for name in df.columns]
    return F.to_json(
        F.struct(*fields),
        {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"},
    )


def check_packets(df: DataFrame, *extra: str) -> DataFrame:
    """Every row in the 13-column clean layout, valid or not, in one pass.

    ``extra`` input columns (row ids) are passed through in front.
    """
    typed = type_columns(require_columns(fill_absent_columns(normalize_columns(df))))
    record = raw_record(typed.drop(*extra))
    return (
        typed.withColumn("raw_record", record)
        .withColumn("validation_errors", validation_errors())
        .withColumn("is_valid", F.size("validation_errors") == 0)
        .withColumn("fingerprint", fingerprint())
        .select(*extra, *CLEAN_COLUMNS)
    )


def clean_packets(df: DataFrame, *extra: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows)."""
    checked = check_packets(df, *extra)
    return checked.filter("is_valid"), quarantine(checked)


def quarantine(checked: DataFrame) -> DataFrame:
    """Rejected rows with their error codes."""
    return checked.filter(~F.col("is_valid"))


def error_breakdown(checked: DataFrame) -> DataFrame:
    """Rows per error code; a row with several errors counts under each."""
    return (
        checked.select(F.explode("validation_errors").alias("error_code"))
        .groupBy("error_code")
        .agg(F.count("*").alias("rows"))
    )


def strict_gate(checked: DataFrame) -> None:
    """Raise before anything is written if a row was rejected."""
    rejected = quarantine(checked).count()
    if rejected:
        raise ValueError(f"Strict mode: {rejected} rows failed validation")
