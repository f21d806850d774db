"""Where the batch job keeps its tables.

Packet-sized tables only ever grow by one folder per ingestion run, which a
retry overwrites; a run that expires gets a tombstone, then its folder goes.
Tables with a key (sessions, features, predictions, alerts) take increments as
commits by bucket, see ``keyed``. Small tables may be rewritten as a new version
next to the old one, so no job overwrites what it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from packetlake.plans.keyed import KeyedTable, nullable
from packetlake.session import COMPRESSION

DROPPED = "_dropped"
INCOMING = "_incoming"
VERSION = "version="


class Warehouse:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def _place(self, name: str):
        """The file system and path of a folder of the warehouse."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def children(self, table: str) -> list[str]:
        fs, root = self._place(table)
        if not fs.exists(root):
            return []
        return [status.getPath().getName() for status in fs.listStatus(root)]

    def remove(self, name: str) -> bool:
        """Delete a folder; false where there is none."""
        fs, path = self._place(name)
        return bool(fs.delete(path, True))

    def exists(self, table: str) -> bool:
        return any(not name.startswith(("_", ".")) for name in self.children(table))

    # --- grown by run ---

    def write_run(self, table: str, df: DataFrame, run_id: int, *partition_by: str) -> None:
        writer = df.drop("run_id").write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.path(table)}/run_id={run_id}", compression=COMPRESSION)

    def receive_run(self, table: str, df: DataFrame, run_id: int) -> DataFrame:
        """Write the rows of a run where no reader of the table sees them."""
        self.write_run(f"{table}/{INCOMING}", df, run_id)
        return self.spark.read.parquet(f"{self.path(table)}/{INCOMING}/run_id={run_id}")

    def refuse_run(self, table: str, run_id: int) -> None:
        self.remove(f"{table}/{INCOMING}/run_id={run_id}")

    def accept_run(self, table: str, run_id: int) -> DataFrame:
        """Make received rows those of the run; they are not written again."""
        name = f"run_id={run_id}"
        self.remove(f"{table}/{name}")
        (fs, received), (_, place) = self._place(f"{table}/{INCOMING}/{name}"), self._place(f"{table}/{name}")
        if not fs.rename(received, place):
            raise OSError(f"cannot move {received} to {place}")
        return self.spark.read.parquet(self.path(f"{table}/{name}"))

    def read_runs(self, table: str, schema: T.StructType | None = None) -> DataFrame:
        """All runs of a table but those with a tombstone, whose files are not
        even listed."""
        if schema is not None and not self.exists(table):
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        dropped = self.dropped_runs(table)
        if not dropped:
            return reader.parquet(self.path(table))
        kept = [
            name for name in self.children(table)
            if name.startswith("run_id=") and int(name.removeprefix("run_id=")) not in dropped
        ]
        if not kept and schema is not None:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path(table)}/{name}" for name in kept]
        return reader.option("basePath", self.path(table)).parquet(*paths)

    def run_ids(self, table: str) -> list[int]:
        """Runs whose folder was written to the end, without dropped ones."""
        dropped = self.dropped_runs(table)
        return sorted(
            run for name in self.children(table)
            if name.startswith("run_id=") and (run := int(name.removeprefix("run_id="))) not in dropped
            and "_SUCCESS" in self.children(f"{table}/{name}")
        )

    def dropped_runs(self, table: str) -> set[int]:
        return {int(name) for name in self.children(f"{table}/{DROPPED}") if name.isdigit()}

    def drop_runs(self, table: str, runs: list[int]) -> list[int]:
        """Take runs out of a table without reading it: first a tombstone each,
        by which readers leave them out, then their folders. Ended in between,
        the next call deletes what is left. Returns the runs whose folder went."""
        for run in runs:
            fs, stone = self._place(f"{table}/{DROPPED}/{run}")
            fs.create(stone, True).close()
        return [
            run for run in sorted(self.dropped_runs(table)) if self.remove(f"{table}/run_id={run}")
        ]

    # --- changed by key ---

    def keyed(self, table: str, key: list[str] | None = None) -> KeyedTable:
        return KeyedTable(self, table, key)

    def merge(
        self, table: str, key: list[str], rows: DataFrame, runs: list[int] | None = None, last_id: int = 0
    ) -> DataFrame:
        """Store the new state of the keys in ``rows``; returns the table."""
        stored = self.keyed(table, key)
        stored.commit(rows, runs, last_id)
        return self.read(table, rows.schema)

    def matching(self, table: str, keys: DataFrame, schema: T.StructType) -> DataFrame:
        """The stored rows of some keys, none where the table is not there yet."""
        rows = self.keyed(table).matching(keys) if KeyedTable.known(self, table) else None
        return self.spark.createDataFrame([], nullable(schema)) if rows is None else rows

    # --- replaced by version ---

    def _latest(self, table: str) -> int:
        versions = [
            int(name.removeprefix(VERSION))
            for name in self.children(table)
            if name.startswith(VERSION)
            and "_SUCCESS" in self.children(f"{table}/{name}")
        ]
        return max(versions, default=0)

    def replace(self, table: str, df: DataFrame) -> DataFrame:
        """Publish a new version of a small table."""
        target = f"{self.path(table)}/{VERSION}{self._latest(table) + 1}"
        df.write.mode("overwrite").parquet(target)
        return self.spark.read.parquet(target)

    def read(self, table: str, schema: T.StructType | None = None) -> DataFrame:
        if KeyedTable.known(self, table):
            rows = self.keyed(table).read()
            return self.spark.createDataFrame([], nullable(schema)) if rows is None and schema else rows
        latest = self._latest(table)
        if latest == 0 and schema is not None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.path(table)}/{VERSION}{latest}")
