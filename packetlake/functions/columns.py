"""Row-level column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: namespace of the name-based flow identifiers.
FLOW_NAMESPACE = "a3f1c8d0-e7b4-4f2a-9d6e-1c2b3a4f5e6d"

FINGERPRINT_FIELDS = [
    "captured_at", "src_ip", "dst_ip", "src_port", "dst_port",
    "protocol", "packet_size", "payload_hash",
]

MICROS = 1_000_000
WHITE_SPACE = " \t\n\r\x0b\x0c"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
TIME_LAYOUTS = (
    "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a",
)


def safe_div(numerator: Column, denominator: Column) -> Column:
    """Quotient as double, 0.0 where the denominator is zero."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(
        numerator.cast("double") / denominator
    )


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def parse_captured_at(text: Column) -> Column:
    """Timestamp in the session time zone; unreadable text becomes null.

    ISO text first, then the layouts of flow exports: day first, and month
    first with AM or PM. A time without a date is unreadable.
    """
    parsed = F.coalesce(
        F.try_to_timestamp(text), *(F.try_to_timestamp(text, F.lit(x)) for x in TIME_LAYOUTS)
    )
    return F.when(~text.rlike(r"^T?\d{1,2}:"), parsed)


def bounded_int(text: Column, low: int | None = None, high: int | None = None) -> Column:
    """Whole number within ``[low, high]``, or within the 32 bits of the column
    it is stored in; anything else becomes null."""
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    keep = (number == F.floor(number)) & (F.abs(number) <= 2_147_483_647)
    if low is not None:
        keep = keep & (number >= low)
    if high is not None:
        keep = keep & (number <= high)
    return F.when(keep, number.try_cast("int"))


def iso_micros(ts: Column) -> Column:
    """UTC text with six fraction digits, the one rendering used in hashes."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def isoformat_utc(ts: Column) -> Column:
    """ISO text with ``+00:00``; the fraction is left out when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, ".SSSSSS")
    return F.concat(
        whole,
        F.when(F.unix_micros(ts) % MICROS == 0, F.lit("")).otherwise(fraction),
        F.lit("+00:00"),
    )


def fingerprint() -> Column:
    """SHA-256 over the eight identifying packet fields, null as empty text."""
    texts = [
        F.coalesce(
            iso_micros(F.col(name)) if name == "captured_at" else F.col(name).cast("string"),
            F.lit(""),
        )
        for name in FINGERPRINT_FIELDS
    ]
    return F.sha2(F.concat_ws("|", *texts), 256)


def uuid5(name: Column, namespace: str = FLOW_NAMESPACE) -> Column:
    """Name-based (SHA-1) UUID text."""
    digest = F.sha1(
        F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8"))
    )
    # The variant nibble keeps its two low bits and gets 10 in front of them.
    variant = F.lower(
        F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8)
    )
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def port_text(port: Column) -> Column:
    return F.coalesce(port.cast("string"), F.lit(""))


def has_flag(flags: Column, *names: str) -> Column:
    """True if any of ``names`` occurs in the flag text, in any case."""
    upper = F.upper(flags)
    found = F.lit(False)
    for name in names:
        found = found | upper.contains(name)
    return F.coalesce(found, F.lit(False))


def has_tcp_terminator(flags: Column) -> Column:
    return has_flag(flags, "FIN", "RST")


def round_half_up(value: Column) -> Column:
    """Nearest whole number, halves upward."""
    return F.floor(value + 0.5)


def severity_bucket(severity: Column, high_name: str = "critical") -> Column:
    """``high_name`` from 4, ``medium`` from 2, else ``low``; null counts as 1."""
    level = F.coalesce(severity, F.lit(1))
    return (
        F.when(level >= 4, high_name).when(level >= 2, "medium").otherwise("low")
    )


def packet_status(size: Column) -> Column:
    return F.when(F.coalesce(size, F.lit(0)) > 1200, "alert").otherwise("normal")


def strip_host_mask(ip: Column) -> Column:
    """Address text without a ``/32`` suffix."""
    return F.regexp_replace(ip, "/32$", "")


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(float(MICROS))


def time_slice(ts: Column, seconds: float) -> Column:
    """Index of the fixed-width time slice that holds ``ts``."""
    return F.floor(F.unix_micros(ts) / F.lit(int(seconds * MICROS))).cast("bigint")
