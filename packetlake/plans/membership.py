"""Which packets may be stored already: bitmaps of key hashes.

Each run stores, for each capture date, a bitmap of the hashes of its packet
keys. A new packet whose bit is in no bitmap of its date is new for certain;
only the others meet the stored keys. The bitmap of a run is sized by all keys
of the date so far, so false alarms stay near one in ``BITS_PER_KEY`` for the
first run and grow with the logarithm of the number of runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetlake.operators.ingest import PACKET_KEY
from packetlake.plans.warehouse import Warehouse

FILTERS = "packet_filters"
BITS_PER_KEY = 64
# Bits of one stored bitmap, as Spark's bitmap functions cut them.
BUCKET_BITS = 32_768
FILTER_SCHEMA = T.StructType([
    T.StructField("capture_date", T.DateType()),
    T.StructField("bits", T.LongType()),
    T.StructField("n_keys", T.LongType()),
    T.StructField("bucket", T.LongType()),
    T.StructField("bitmap", T.BinaryType()),
    T.StructField("run_id", T.IntegerType()),
])


def _position(bits: Column) -> Column:
    return F.pmod(F.xxhash64(*PACKET_KEY), bits)


def _has_bit(bitmap: Column, position: Column) -> Column:
    byte = F.substring(bitmap, (position / 8).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.expr("1").bitwiseAND(F.floor(value / F.pow(F.lit(2), position % 8)).cast("int")) == 1


def write_filter(house: Warehouse, packets: DataFrame, run_id: int) -> None:
    """Store the bitmaps of a run; ``packets`` has its keys and capture dates."""
    before = (
        house.read_runs(FILTERS, FILTER_SCHEMA).filter(F.col("run_id") != run_id)
        .select("run_id", "capture_date", "n_keys").distinct()
        .groupBy("capture_date").agg(F.sum("n_keys").alias("before"))
    )
    # One row for each date of the run.
    sizes = packets.groupBy("capture_date").agg(F.count("*").alias("n_keys")).join(
        before, "capture_date", "left"
    ).select(
        "capture_date", "n_keys",
        F.greatest(
            F.lit(BUCKET_BITS),
            F.pow(F.lit(2), F.ceil(F.log2(BITS_PER_KEY * (F.col("n_keys") + F.coalesce("before", F.lit(0)))))),
        ).cast("bigint").alias("bits"),
    )
    placed = packets.select("capture_date", *PACKET_KEY).join(F.broadcast(sizes), "capture_date").select(
        "capture_date", "bits", "n_keys", _position(F.col("bits")).alias("position")
    )
    bitmaps = placed.groupBy(
        "capture_date", "bits", "n_keys", F.floor(F.col("position") / BUCKET_BITS).alias("bucket")
    ).agg(F.bitmap_construct_agg(F.col("position") % BUCKET_BITS).alias("bitmap"))
    house.write_run(FILTERS, bitmaps, run_id)


def may_be_known(house: Warehouse, rows: DataFrame, row_id: str, run_id: int) -> DataFrame:
    """The rows (with their key columns) whose bit is set in a filter of their
    date, filters of ``run_id`` aside."""
    filters = house.read_runs(FILTERS, FILTER_SCHEMA).filter(F.col("run_id") != run_id)
    dated = rows.select(row_id, *PACKET_KEY, F.to_date("captured_at").alias("capture_date"))
    # Sizes are powers of two: a few for each date.
    sizes = filters.select("capture_date", "bits").distinct()
    asked = dated.join(F.broadcast(sizes), "capture_date").withColumn(
        "position", _position(F.col("bits"))
    ).withColumn("bucket", F.floor(F.col("position") / BUCKET_BITS))
    merged = filters.groupBy("capture_date", "bits", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    met = asked.join(merged, ["capture_date", "bits", "bucket"]).filter(
        _has_bit(F.col("bitmap"), F.col("position") % BUCKET_BITS)
    )
    return met.select(row_id, *PACKET_KEY).dropDuplicates([row_id])
