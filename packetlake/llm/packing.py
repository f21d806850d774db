"""Sum-of-squares packing of token ids into windows of a fixed size.

Each partition packs its documents as they come, with a level array of its own:
N[h] counts the open windows filled up to level h. A piece of size s goes to
the level h, or to a new window, for which the sum of N[h]^2 becomes smallest.
Documents longer than a window give whole windows first; only their rest is
placed. When the input ends (or more than ``OPEN_WINDOWS`` are open) the
fullest open windows are topped up with pieces cut from the emptiest ones, so
at most one window of a partition stays partly filled. That one is cut into
sequences whose lengths are powers of two, which need no padding.

Nothing is shuffled: the work and the memory of a task depend on its partition
alone, and a task that runs again gives the same sequences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlake.llm.bpe import tokenizer_coder

# Open windows of a task before the emptiest are used up to fill the fullest.
OPEN_WINDOWS = 4096
# Id bytes after which rows go to Spark.
BATCH_BYTES = 4 << 20
# Sequence numbers of one partition.
SEQUENCES_PER_PARTITION = 1 << 40

PIECE_SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.start, self.ids[:at], self.doc_tokens),
            Piece(self.doc_id, self.start + at, self.ids[at:], self.doc_tokens),
        )


@dataclass
class Window:
    pieces: list[Piece] = field(default_factory=list)
    level: int = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.level += len(piece.ids)


class SumOfSquaresPacker:
    """Places pieces and gives back the windows that are done."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[list[Window]] = [[] for _ in range(capacity)]
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """The level, 0 for a new window, with the smallest growth of the sum
        of squares; the fullest of equal ones."""
        room = self.capacity - size
        counts = self.counts
        growth = 2 * counts[size:room + size + 1] + 1
        growth[room] = 0  # a full window leaves the array
        growth[1:] += 1 - 2 * counts[1:room + 1]
        growth[1:][counts[1:room + 1] == 0] = np.iinfo(np.int64).max
        return room - int(np.argmin(growth[::-1]))

    def add(self, piece: Piece) -> Iterator[Window]:
        """Windows that the document completes."""
        while len(piece.ids) > self.capacity:
            head, piece = piece.cut(self.capacity)
            yield Window([head], self.capacity)
        level = self.level_for(len(piece.ids))
        window = self._take(level) if level else Window()
        window.add(piece)
        if window.level == self.capacity:
            yield window
        else:
            self._put(window)
        if self.n_open > OPEN_WINDOWS:
            windows = self._all()
            yield from self._top_up(windows, len(windows) // 2)
            for window in windows:
                self._put(window)

    def finish(self) -> Iterator[Window]:
        windows = self._all()
        yield from self._top_up(windows, 1)
        for window in windows:
            yield from _powers_of_two(window)

    def _take(self, level: int) -> Window:
        self.counts[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _put(self, window: Window) -> None:
        if window.level:
            self.counts[window.level] += 1
            self.n_open += 1
            self.open[window.level].append(window)

    def _all(self) -> list[Window]:
        """All open windows, the emptiest first; none stays open."""
        windows = [w for level in self.open for w in level]
        self.open = [[] for _ in range(self.capacity)]
        self.counts[:] = 0
        self.n_open = 0
        return windows

    def _top_up(self, windows: list[Window], leave: int) -> Iterator[Window]:
        """Fill the last windows of the list from the first ones until no more
        than ``leave`` are left."""
        first = 0
        while len(windows) - first > leave:
            window = windows.pop()
            while window.level < self.capacity and first < len(windows):
                source, room = windows[first], self.capacity - window.level
                piece = source.pieces.pop()
                if len(piece.ids) > room:
                    piece, rest = piece.cut(room)
                    source.pieces.append(rest)
                source.level -= len(piece.ids)
                window.add(piece)
                first += not source.level
            if window.level == self.capacity:
                yield window
            else:
                windows.append(window)
                break
        del windows[:first]


def _powers_of_two(window: Window) -> Iterator[Window]:
    pieces = window.pieces[::-1]
    for bit in reversed(range(window.level.bit_length())):
        if not window.level >> bit & 1:
            continue
        part = Window()
        while part.level < 1 << bit:
            piece, room = pieces.pop(), (1 << bit) - part.level
            if len(piece.ids) > room:
                piece, rest = piece.cut(room)
                pieces.append(rest)
            part.add(piece)
        yield part


def pack_documents(
    docs: DataFrame, path: str, pattern: str, capacity: int = 2048, separator: int = 1
) -> DataFrame:
    """Pieces of all documents: (doc_id, start, length, ids, doc_tokens,
    sequence_id, offset), ``ids`` as little-endian unsigned 32-bit numbers.

    Each document is its ids and the separator. A null or empty text is the
    separator alone; null ids and repeated rows are packed like any other row;
    other columns are not looked at; an empty table gives no pieces. A very
    long text fills windows of its own and costs its task its own size only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer_coder(path, pattern)
        packer = SumOfSquaresPacker(capacity)
        sequence = TaskContext.get().partitionId() * SEQUENCES_PER_PARTITION

        def windows() -> Iterator[Window]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    ids = np.append(coder.encode(text.as_py() or ""), separator).astype("<u4")
                    yield from packer.add(Piece(doc_id.as_py(), 0, ids, len(ids)))
            yield from packer.finish()

        rows: list[tuple] = []
        held = 0
        for window in windows():
            offset = 0
            for piece in window.pieces:
                length = len(piece.ids)
                rows.append((
                    piece.doc_id, piece.start, length, piece.ids.tobytes(),
                    piece.doc_tokens, sequence, offset,
                ))
                offset += length
            sequence += 1
            held += 4 * offset
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, PIECE_SCHEMA
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.binary() if name == "ids" else pa.int64() for name in names]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(column), kind) for column, kind in zip(columns, kinds, strict=True)], names
    )


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )
