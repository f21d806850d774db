"""Tables with a key that increments change: merge on read, by bucket.

Rows are dealt to buckets by the hash of their key. A commit is a folder with
one subfolder for each bucket it touches; it holds the new state of the rows it
changes, or marks them deleted. A note, written last, makes a commit count: a
job that ended before it leaves a folder that the next commit overwrites. What a
key looks like now is its newest row among a bucket's commits. Compaction
rewrites only buckets with many commits; the rest of the table stays as it is.
"""

from __future__ import annotations

from typing import TYPE_CHECKING, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from packetlake.plans.warehouse import Warehouse

BUCKETS = 16
# Commits of a bucket after which compaction rewrites it.
MOST_COMMITS = 8
# Files a bucket's part of one commit may have.
FILES = 8
DELETED = "_deleted"
COMMIT = "commit="
BUCKET = "bucket="
NOTE_SCHEMA = (
    "commit int, key array<string>, n_buckets int, buckets array<int>, rewritten array<int>, "
    "runs array<int>, last_id bigint"
)


class Note(NamedTuple):
    commit: int
    key: list[str]
    n_buckets: int
    buckets: list[int]  # that have rows in this commit
    rewritten: list[int]  # whose earlier commits it replaces
    runs: list[int]
    last_id: int


class KeyedTable:
    """A table of the warehouse; ``key`` and ``n_buckets`` count for a new one."""

    def __init__(
        self, house: Warehouse, name: str, key: list[str] | None = None, n_buckets: int = BUCKETS
    ) -> None:
        self.house, self.name = house, name
        self.notes = self._read_notes()
        self.key = self.notes[0].key if self.notes else key
        self.n_buckets = self.notes[0].n_buckets if self.notes else n_buckets

    @staticmethod
    def known(house: Warehouse, name: str) -> bool:
        return house.exists(f"{name}_commits")

    def _read_notes(self) -> list[Note]:
        """One small row for each commit."""
        done = [
            name for name in self.house.children(f"{self.name}_commits")
            if name.startswith(COMMIT) and "_SUCCESS" in self.house.children(f"{self.name}_commits/{name}")
        ]
        if not done:
            return []
        paths = [f"{self.house.path(self.name)}_commits/{name}" for name in done]
        rows = self.house.spark.read.schema(NOTE_SCHEMA).parquet(*paths).collect()
        return sorted(Note(*row) for row in rows)

    @property
    def last_id(self) -> int:
        return max((note.last_id for note in self.notes), default=0)

    def all_runs(self) -> set[int]:
        return {run for note in self.notes for run in note.runs}

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.n_buckets)).cast("int")

    def live(self) -> dict[int, list[int]]:
        """The commits of each bucket that count."""
        found: dict[int, list[int]] = {}
        for note in self.notes:
            for bucket in note.rewritten:
                found.pop(bucket, None)
            for bucket in note.buckets:
                found.setdefault(bucket, []).append(note.commit)
        return found

    def _folder(self, commit: int, bucket: int) -> str:
        return f"{self.house.path(self.name)}/{COMMIT}{commit}/{BUCKET}{bucket}"

    def _scan(self, places: list[tuple[int, int]]) -> DataFrame:
        """Stored rows, with ``commit``, of (commit, bucket) folders."""
        reader = self.house.spark.read.option("basePath", self.house.path(self.name))
        return reader.parquet(*[self._folder(*place) for place in places]).drop("bucket")

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The table's rows now, or those of some buckets; None where nothing is
        stored. A bucket of one commit is read as it is, without a shuffle."""
        live = {b: c for b, c in self.live().items() if buckets is None or b in buckets}
        single = [(c[0], b) for b, c in live.items() if len(c) == 1]
        several = [(commit, b) for b, c in live.items() if len(c) > 1 for commit in c]
        parts = [self._scan(single).drop("commit")] if single else []
        if several:
            found = self._scan(several)
            values = [c for c in found.columns if c not in (*self.key, "commit")]
            newest = found.groupBy(*self.key).agg(F.max_by(F.struct(*values), "commit").alias("_row"))
            parts.append(newest.select(*self.key, "_row.*"))
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return rows.filter(~F.col(DELETED)).drop(DELETED)

    def read_commits(self, commits: list[int]) -> DataFrame | None:
        """The rows as some commits wrote them."""
        places = [(n.commit, b) for n in self.notes if n.commit in commits for b in n.buckets]
        if not places:
            return None
        return self._scan(places).filter(~F.col(DELETED)).drop(DELETED, "commit")

    def matching(self, keys: DataFrame) -> DataFrame | None:
        """The rows whose key is in ``keys``; only the buckets of these keys are
        read, whose numbers are what reaches the driver."""
        if not self.live():
            return None
        # The hash depends on the type.
        stored = self._scan([(c[-1], b) for b, c in self.live().items()][:1]).schema
        wanted = keys.select(*[F.col(k).cast(stored[k].dataType).alias(k) for k in self.key]).distinct()
        buckets = [row[0] for row in wanted.select(self.bucket_of()).distinct().collect()]
        rows = self.read(buckets)
        return None if rows is None else rows.join(wanted, self.key, "left_semi")

    def commit(
        self, rows: DataFrame, runs: list[int] | None = None, last_id: int = 0,
        rewritten: list[int] | None = None,
    ) -> None:
        """Store the new state of the keys in ``rows``, one row for each."""
        commit = self.notes[-1].commit + 1 if self.notes else 1
        if DELETED not in rows.columns:
            rows = rows.withColumn(DELETED, F.lit(False))
        part = F.pmod(F.xxhash64(*self.key, F.lit(1)), F.lit(FILES))
        (
            rows.withColumn("bucket", self.bucket_of()).repartition("bucket", part)
            .write.mode("overwrite").partitionBy("bucket")
            .parquet(f"{self.house.path(self.name)}/{COMMIT}{commit}")
        )
        buckets = sorted(
            int(name.removeprefix(BUCKET)) for name in self.house.children(f"{self.name}/{COMMIT}{commit}")
            if name.startswith(BUCKET)
        )
        note = Note(
            commit, self.key, self.n_buckets, buckets, rewritten or [], runs or [], max(last_id, self.last_id)
        )
        self.house.spark.createDataFrame([note], NOTE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
            f"{self.house.path(self.name)}_commits/{COMMIT}{commit}"
        )
        self.notes.append(note)

    def delete(self, keys: DataFrame) -> None:
        """Mark the keys deleted that are there."""
        rows = self.matching(keys)
        if rows is not None:
            self.commit(rows.withColumn(DELETED, F.lit(True)))

    def compact(self, most: int = MOST_COMMITS) -> list[int]:
        """Rewrite the buckets with more than ``most`` commits; returns them."""
        full = sorted(b for b, commits in self.live().items() if len(commits) > most)
        if full:
            self.commit(self.read(full), rewritten=full)
        return full

    def vacuum(self, keep: int = 0) -> int:
        """Delete folders of all but the newest ``keep`` commits that no reader
        needs; returns how many."""
        live = {(commit, b) for b, commits in self.live().items() for commit in commits}
        old = self.notes[:len(self.notes) - keep] if keep else self.notes
        gone = [(n.commit, b) for n in old for b in n.buckets if (n.commit, b) not in live]
        removed = 0
        for commit, bucket in gone:
            removed += self.house.remove(f"{self.name}/{COMMIT}{commit}/{BUCKET}{bucket}")
        # Of the live batches, of which there is one every few seconds, only the
        # newest one's note has to stay.
        batches = [n for n in self.notes if n.runs and max(n.runs) < 0]
        for note in batches[:-1]:
            if not any((note.commit, b) in live for b in note.buckets):
                self.house.remove(f"{self.name}_commits/{COMMIT}{note.commit}")
                self.notes.remove(note)
        return removed


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
