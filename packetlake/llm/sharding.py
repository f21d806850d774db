"""Shards by best-fit-decreasing bin packing of groups that stay together.

A group is all documents with one text. Groups are summed by digest, so a group
of copies is one item however many rows it has. Small groups are first packed
into bundles of a fixed share of a shard, in parallel; the bundles, whose
number depends on the shares and not on the documents, are then packed into the
shards. Both steps sort by size and put each item into the bin with the tightest
room, found in a balanced tree of the bins' rooms.

For a fixed number of shards the capacity is the smallest one for which the
packing needs no more shards. A group larger than an even share gets a shard of
its own, and the other shards share the rest.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetlake.llm.common import whole_text
from packetlake.session import store_stage

SHARDS = 40
OVERHEAD = 16
# Bundles that make up a shard. At most twice shards * BUNDLES + one for each
# task of bundles reach the driver.
BUNDLES = 192
# Groups that one task sorts and packs.
GROUPS_PER_TASK = 500_000


class RoomTree:
    """A treap of (room, bin): balanced by random priorities."""

    def __init__(self) -> None:
        self._root: list | None = None  # [key, priority, left, right]
        self._draw = random.Random(0).random

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest (room, bin) with room >= size."""
        best, node = None, self._root
        while node:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is not None:
            self._root = self._without(self._root, best)
        return best

    def add(self, room: int, number: int) -> None:
        key = (room, number)
        left, right = self._split(self._root, key)
        self._root = self._join(self._join(left, [key, self._draw(), None, None]), right)

    def _split(self, node: list | None, key: tuple) -> tuple:
        if not node:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _join(self, low: list | None, high: list | None) -> list | None:
        if not low or not high:
            return low or high
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high

    def _without(self, node: list, key: tuple) -> list | None:
        if node[0] == key:
            return self._join(node[2], node[3])
        side = 2 if key < node[0] else 3
        node[side] = self._without(node[side], key)
        return node


def best_fit(sizes: list[int], capacity: int, limit: int | None = None) -> list[int] | None:
    """The bin of each of the descending ``sizes``; None beyond ``limit`` bins.
    An item above the capacity fills a bin of its own."""
    tree, bins, n = RoomTree(), [], 0
    smallest = sizes[-1] if sizes else 0
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            if n == limit:
                return None
            found, n = (max(capacity, size), n), n + 1
        room, number = found
        if room - size >= smallest:
            tree.add(room - size, number)
        bins.append(number)
    return bins


def fit_shards(sizes: list[int], shards: int) -> list[int]:
    """The shard of each of the descending ``sizes``, with the smallest
    capacity that best-fit-decreasing manages."""
    total, own = sum(sizes), 0
    while own < min(shards - 1, len(sizes)) and sizes[own] * (shards - own) > total:
        total -= sizes[own]
        own += 1
    rest, bins = sizes[own:], shards - own
    low = max([-(-total // bins), *rest[:1]])
    high = max(low, 1)
    while (packed := best_fit(rest, high, bins)) is None:
        high += max(1, high // 4)
    while low < high:
        middle = (low + high) // 2
        tried = best_fit(rest, middle, bins)
        if tried is None:
            low = middle + 1
        else:
            packed, high = tried, middle
    return [*range(own), *(own + number for number in packed)]


def sized_documents(docs: DataFrame) -> DataFrame:
    """(row, doc_id, size, text_crc32, digest): null texts are empty ones."""
    data = F.encode(whole_text(), "UTF-8")
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(data) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(data).alias("text_crc32"), F.unhex(F.sha2(data, 256)).alias("digest"),
    )


def bundle_groups(groups: DataFrame, grain: int, tasks: int) -> DataFrame:
    """(digest, bundle, bytes): the groups packed into bundles of ``grain``
    bytes, each task on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [
            (-size, digest)
            for batch in batches
            for digest, size in zip(*batch.to_pydict().values(), strict=True)
        ]
        items.sort()
        bins = best_fit([-size for size, _ in items], grain)
        first = TaskContext.get().partitionId() << 32
        yield pa.RecordBatch.from_arrays(
            [pa.array([digest for _, digest in items], pa.binary()),
             pa.array([first + number for number in bins], pa.int64()),
             pa.array([-size for size, _ in items], pa.int64())],
            ["digest", "bundle", "bytes"],
        )

    return groups.select("digest", "bytes").repartition(tasks, "digest").mapInArrow(
        run, "digest binary, bundle bigint, bytes bigint"
    )


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``.

    Equal texts share a shard, and a null text counts as an empty one. Slots
    are gapless from 0 in each shard. Null ids and repeated rows stay; other
    columns are not looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sized = store_stage(sized_documents(docs), "sized")
    groups = store_stage(sized.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    n_groups, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    grain = max(1, total // (shards * BUNDLES))
    tasks = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), n_groups // GROUPS_PER_TASK + 1
    )
    bundled = store_stage(bundle_groups(groups, grain, tasks), "bundles")
    bundles = sorted(
        (-row["bytes"], row["bundle"])
        for row in bundled.groupBy("bundle").agg(F.sum("bytes").alias("bytes")).collect()
    )
    placed = fit_shards([-size for size, _ in bundles], shards)
    table = spark.createDataFrame(
        [(bundle, shard) for (_, bundle), shard in zip(bundles, placed, strict=True)],
        "bundle bigint, shard int",
    )
    located = bundled.join(F.broadcast(table), "bundle").select("digest", "shard")
    return number_rows(sized.join(located, "digest"))


def number_rows(located: DataFrame) -> DataFrame:
    """Slots: rows are numbered within (shard, chunk), a chunk being the rows of
    one input partition, and the chunks' counts give where each begins."""
    # The upper bits of a row number are its partition.
    located = store_stage(
        located.withColumn("chunk", F.shiftright("row", 33)).drop("digest"), "located"
    )
    ahead = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    begins = located.groupBy("shard", "chunk").agg(F.count("*").alias("n")).select(
        "shard", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("begin")
    )
    inside = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("row"))
    return (
        located.withColumn("inside", inside)
        .join(begins, ["shard", "chunk"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("inside") - 1).alias("slot"))
    )
