"""File sources. Text inputs are read as strings; the operators cast."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetlake.operators.training import FLOW_COLUMNS

READERS = {".csv": "csv", ".json": "json"}
HEADER_READERS = 16


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Raw packets from a .csv or .json path, chosen by its suffix."""
    suffix = path[path.rfind("."):].lower() if "." in path else ""
    if suffix not in READERS:
        raise ValueError(f"Unsupported input file: {path}. Use .csv or .json")
    return read_packets_csv(spark, path) if suffix == ".csv" else read_packets_json(spark, path)


def read_packets_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def read_packets_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects per file; keys a row lacks are null. Scalars are
    kept as text."""
    return spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)


def list_files(spark: SparkSession, glob: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(status.getPath().toString() for status in fs.globStatus(path) or [])


def read_flow_csvs(spark: SparkSession, glob: str) -> DataFrame:
    """The mapped columns of every flow CSV with its ``source_file`` name.

    Exports differ in columns and their order, so files are read in one scan
    per distinct header. Files that cannot be read or lack a mapped column are
    skipped.
    """

    def header(file: str) -> tuple[str, ...]:
        try:  # only the first line is read
            return tuple(spark.read.option("header", True).csv(file).columns)
        except Exception:  # an unreadable file is skipped like one without the columns
            return ()

    files = list_files(spark, glob)
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        headers = list(pool.map(header, files))
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file, columns in zip(files, headers):
        if set(FLOW_COLUMNS) <= set(columns):
            by_header.setdefault(columns, []).append(file)
    if not by_header:
        raise ValueError(f"No flow file with the columns {sorted(FLOW_COLUMNS)} at {glob}")
    parts = [
        spark.read.option("header", True)
        .option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
        .csv(group)
        .select(
            F.col("_metadata.file_name").alias("source_file"),
            *[F.col(f"`{name}`") for name in FLOW_COLUMNS],
        )
        for group in by_header.values()
    ]
    return reduce(DataFrame.unionByName, parts)


def read_labels_csv(
    spark: SparkSession, path: str, id_col: str = "session_id", label_col: str = "label"
) -> DataFrame:
    """(session_id, label, row_no). ``row_no`` orders rows as in the file: by
    file, block and position within the block."""
    raw = spark.read.option("header", True).csv(path)
    names = {column.strip().lower(): column for column in raw.columns}
    for wanted in (id_col.lower(), label_col.lower()):
        if wanted not in names:
            raise ValueError(f"Column '{wanted}' not found. Available: {sorted(names)}")
    return raw.select(
        F.col(f"`{names[id_col.lower()]}`").try_cast("bigint").alias("session_id"),
        F.col(f"`{names[label_col.lower()]}`").alias("label"),
        F.struct(
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("position"),
        ).alias("row_no"),
    )


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)
