"""Random forest over tables too large for whole trees in one task.

Features are cut into at most 32 bins. Nodes of many rows are split by counts
that all tasks add up; a node of at most ``TASK_ROWS`` drawn rows is handed,
with those rows, to one task that grows the rest of its branch. All fits of a
cross-validation grow together, so their trees share the passes over the rows.
Nodes are numbered as in a heap: the children of n are 2n and 2n + 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlake.schemas import FEATURE_COLS
from packetlake.session import drop_stages, store_stage

BINS = 32
# Accuracy of the sketch that chooses the bins' borders.
BORDER_ACCURACY = 10_000
# Drawn rows of a node whose branch one task grows.
TASK_ROWS = 1 << 20
# Rows that a task scores at a time, and rows of which it counts or deals the
# different ones at a time: what is handed on grows with the number of blocks.
BLOCK_ROWS = 1 << 17
GROW_BLOCK_ROWS = 1 << 20
# Counts for each row up to which nodes are counted in a table, not sorted.
DENSE_CELLS = 16
LEAF = -1
_FIELDS = len(FEATURE_COLS)
_SHARE = math.ceil(math.sqrt(_FIELDS))
# Distribution of how often a row is drawn for a tree: Poisson of mean 1.
_DRAWS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
# The digests from which a row is drawn once, twice and so on: the upper 53 bits
# of a digest are its share.
_DRAW_DIGESTS = np.array([math.ceil(d * 2.0**53) << 11 for d in _DRAWS if d < 1], np.uint64)
# Rows whose digests fit into a core's cache.
_CACHED = 1 << 14
_ROW = np.dtype([("bins", "u1", _FIELDS), ("label", "u1"), ("weight", "<i4")])
GROWN = "tree int, nodes binary"
PACKED = "tree int, feature binary, cut binary, code binary, shares binary, gained array<double>"


def node_type(classes: int) -> np.dtype:
    """One node: rows with ``bin <= cut`` go left; ``counts`` by class."""
    return np.dtype([
        ("id", "<i8"), ("feature", "i1"), ("cut", "u1"), ("gain", "<f8"), ("counts", "<i4", classes),
    ])


def mix(values: np.ndarray) -> np.ndarray:
    """Evenly spread 64-bit digests of integers (splitmix64)."""
    z = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _salted(values: np.ndarray, *salt: int) -> np.ndarray:
    state = np.zeros(1, np.uint64)
    for part in salt:
        state = mix(state ^ np.uint64(part))
    return mix(values.astype(np.uint64) ^ state)


def drawn(rows: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree."""
    times = np.zeros(len(rows), np.int8)
    for at in range(0, len(rows), _CACHED):
        digest, part = _salted(rows[at:at + _CACHED], seed, 1, tree), times[at:at + _CACHED]
        for least in _DRAW_DIGESTS:  # few rows are drawn often
            more = digest >= least
            if not more.any():
                break
            part += more
    return times


def folds_of(rows: np.ndarray, seed: int, folds: int) -> np.ndarray:
    return (_salted(rows, seed, 2) % np.uint64(max(folds, 1))).astype(np.int64)


def tried_features(nodes: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """The features tried at each node (a row for each), without repeats."""
    keys = nodes[:, None].astype(np.uint64) * np.uint64(_FIELDS) + np.arange(_FIELDS, dtype=np.uint64)
    order = np.argsort(_salted(keys.ravel(), seed, 3, tree).reshape(keys.shape), axis=1)
    return np.sort(order[:, :_SHARE], axis=1)


# --- bins --------------------------------------------------------------------


def bin_borders(rows: DataFrame) -> list[list[float]]:
    """Per feature, up to 31 different borders at even ranks."""
    ranks = [k / BINS for k in range(1, BINS)]
    found = rows.agg(*[
        F.percentile_approx(c, ranks, BORDER_ACCURACY).alias(c) for c in FEATURE_COLS
    ]).first()
    return [sorted({v for v in found[c] or [] if v == v}) for c in FEATURE_COLS]


def to_bins(values: np.ndarray, borders: list[list[float]]) -> np.ndarray:
    """Bin numbers: a value is at most border b where its bin is at most b."""
    return np.stack(
        [np.searchsorted(np.array(b), values[:, k]) for k, b in enumerate(borders)], axis=1
    ).astype(np.uint8).reshape(len(values), _FIELDS)


def binned(rows: DataFrame, borders: list[list[float]], parts: int) -> DataFrame:
    """(row, label, bins) of ``rows`` with ``label`` and the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([
                batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(_FIELDS)
            ], axis=1)
            bins = [part.tobytes() for part in to_bins(values, borders)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bins, pa.binary())],
                ["row", "label", "bins"],
            )

    numbered = rows.select(
        F.monotonically_increasing_id().alias("row"), F.col("label").cast("int").alias("label"),
        *FEATURE_COLS,
    )
    return numbered.mapInArrow(run, "row bigint, label int, bins binary").repartition(parts)


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of bytes: where the different ones come first, in the order of
    their bytes, which compresses well, and the place of each row among these."""
    flat = np.ascontiguousarray(rows)
    kind = f"V{flat.shape[1]}"
    words = np.zeros((len(flat), -(-flat.shape[1] // 8)), np.uint64)
    words.view(np.uint8).reshape(len(flat), -1)[:, :flat.shape[1]] = flat
    digest = np.zeros(len(flat), np.uint64)
    for k in range(words.shape[1]):
        digest = mix(digest ^ words[:, k])
    _, first, place = np.unique(digest, return_index=True, return_inverse=True)
    place = place.ravel()
    if (words[first[place]] != words).any():  # two rows share a digest
        _, first, place = np.unique(flat.view(kind).ravel(), return_index=True, return_inverse=True)
        return first, place.ravel()
    order = np.argsort(np.ascontiguousarray(flat[first]).view(kind).ravel())
    to = np.empty(len(order), np.int64)
    to[order] = np.arange(len(order))
    return first[order], to[place]


def _bytes(column: pa.Array) -> np.ndarray:
    """Binary values of ``_FIELDS`` bytes as rows."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].reshape(-1, _FIELDS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Row numbers, different (bins, label) and each row's place among these."""

    def block(kept: list) -> tuple:
        rows, labels, bins = (
            pa.concat_arrays([b.column(k) for b in kept]) for k in range(3)
        )
        both = np.column_stack([_bytes(bins), labels.to_numpy().astype(np.uint8)])
        first, place = distinct(both)
        return rows.to_numpy(), both[first, :_FIELDS], both[first, _FIELDS], place

    kept, size = [], 0
    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
            size += batch.num_rows
        if size >= GROW_BLOCK_ROWS:
            yield block(kept)
            kept, size = [], 0
    if kept:
        yield block(kept)


# --- splits ------------------------------------------------------------------


def best_cuts(
    node: np.ndarray, cut: np.ndarray, label: np.ndarray, weight: np.ndarray,
    classes: int, least: int,
) -> tuple[np.ndarray, np.ndarray]:
    """(purity after the best cut by one feature, that cut) of the nodes 0, 1, ...
    of which each has a row; a purity below 0 means no cut leaves ``least``
    rows on both sides. Purity is the sum of squared counts over the count."""
    key = node * BINS + cut
    cells = (int(node.max()) + 1) * BINS
    if cells * classes <= DENSE_CELLS * len(key):
        counts = np.bincount(
            key * classes + label, weight, cells * classes
        ).reshape(cells, classes)
        key = np.flatnonzero(counts @ np.ones(classes))
        upto = np.cumsum(counts[key], axis=0)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        counts = np.zeros((len(key), classes))
        counts[np.arange(len(key)), label[order]] = weight[order]
        ends = np.flatnonzero(np.append(key[1:] != key[:-1], True))
        upto, key = np.cumsum(counts, axis=0)[ends], key[ends]
    last = np.flatnonzero(np.append(key[1:] // BINS != key[:-1] // BINS, True))
    starts = np.append(0, last[:-1] + 1)
    of = np.repeat(np.arange(len(last)), last - starts + 1)
    before = np.vstack([np.zeros((1, classes)), upto[last[:-1]]])
    left = upto - before[of]
    right = upto[last][of] - upto
    # Counts are whole numbers, so their sums and squares are exact in any order.
    n_left, n_right = left @ np.ones(classes), right @ np.ones(classes)
    squares = [np.einsum("ij,ij->i", side, side) for side in (left, right)]
    fits = (n_left >= least) & (n_right >= least)
    purity = np.where(fits, squares[0] / n_left + squares[1] / np.maximum(n_right, 1), -1.0)
    best = np.maximum.reduceat(purity, starts)
    at = np.flatnonzero(purity == best[of])
    first = at[np.searchsorted(of[at], np.arange(len(last)))]
    return best, key[first] % BINS


def choose(
    ids: np.ndarray, counts: np.ndarray, tried: np.ndarray, purities: np.ndarray,
    cuts: np.ndarray, classes: int,
) -> np.ndarray:
    """Nodes from the best of the tried features, leaves where none gains."""
    nodes = np.zeros(len(ids), node_type(classes))
    every = np.arange(len(ids))
    best = purities.argmax(axis=1)
    n = counts.sum(axis=1)
    now = (counts.astype(float) ** 2).sum(axis=1) / n
    gain = (purities[every, best] - now) / n
    split = gain > 1e-12
    nodes["id"], nodes["counts"] = ids, counts
    nodes["feature"] = np.where(split, tried[every, best], LEAF)
    nodes["cut"] = np.where(split, cuts[every, best], 0)
    nodes["gain"] = np.where(split, gain, 0.0)
    return nodes


def _collapsed(rows: np.ndarray) -> np.ndarray:
    """The different (bins, label) of drawn rows, with the sums of their draws."""
    both = np.column_stack([rows["bins"], rows["label"]])
    first, place = distinct(both)
    out = rows[first]
    out["weight"] = np.bincount(place, rows["weight"], len(first))
    return out


def grow_branch(
    root: int, rows: np.ndarray, seed: int, tree: int, classes: int, depth: int, least: int
) -> np.ndarray:
    """The nodes from ``root`` down, from its drawn rows."""
    # Rows stay where they are; ``row`` is where the bins of each live one begin.
    bins = np.ascontiguousarray(rows["bins"]).ravel()
    row, at = np.arange(len(rows)) * _FIELDS, np.zeros(len(rows), np.int64)
    label, weight = rows["label"].astype(np.int64), rows["weight"].astype(float)
    ids, done = np.array([root], np.int64), []
    level = int(root).bit_length() - 1
    while len(ids):
        counts = np.bincount(
            at * classes + label, weight, len(ids) * classes
        ).reshape(-1, classes).astype(np.int64)
        n = counts.sum(axis=1)
        may = (n >= 2 * least) & (counts.max(axis=1) < n) & (level < depth)
        tried = tried_features(ids, seed, tree)
        purities, cuts = np.full(tried.shape, -1.0), np.zeros(tried.shape, np.int64)
        live = np.flatnonzero(may.take(at))
        row, label, weight, at = (v.take(live) for v in (row, label, weight, at))
        if len(at):
            place = (np.cumsum(may) - 1).take(at)
            for k in range(_SHARE):
                cut = bins.take(row + tried[:, k].take(at)).astype(np.int64)
                purities[may, k], cuts[may, k] = best_cuts(place, cut, label, weight, classes, least)
        nodes = choose(ids, counts, tried, purities, cuts, classes)
        done.append(nodes)
        split = nodes["feature"] >= 0
        live = np.flatnonzero(split.take(at))
        row, label, weight, at = (v.take(live) for v in (row, label, weight, at))
        right = bins.take(row + nodes["feature"].take(at)) > nodes["cut"].take(at)
        at = 2 * (np.cumsum(split) - 1).take(at) + right
        ids = (2 * ids[split][:, None] + np.arange(2)).ravel()
        level += 1
    return np.concatenate(done)


# --- trees -------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """The nodes of a tree as arrays in the order of their numbers. ``left`` is
    the place of the left child; the right one follows it."""

    ids: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """The number of the last node that each row reaches."""
        return self.ids[walk(self.feature, self.cut, self.left, bins)]


def walk(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The place of the last node that each row reaches."""
    at, live = np.zeros(len(bins), np.int32), np.arange(len(bins))
    while len(live):
        tested = feature[at[live]]
        live, tested = live[tested >= 0], tested[tested >= 0]
        here = at[live]
        at[live] = left[here] + (bins[live, tested] > cut[here])
    return at


def as_tree(nodes: np.ndarray) -> Tree:
    nodes = nodes[np.argsort(nodes["id"])]
    ids = np.ascontiguousarray(nodes["id"])
    left = np.searchsorted(ids, 2 * ids).astype(np.int32)
    return Tree(ids, nodes["feature"].copy(), nodes["cut"].copy(), left)


def scoring_arrays(nodes: np.ndarray) -> tuple[np.ndarray, ...]:
    """feature and cut in the order of the nodes' numbers, for each leaf the
    place of its class shares, and the different shares: some 3 bytes a node, as
    each worker that scores holds all trees."""
    nodes = nodes[np.argsort(nodes["id"])]
    counts = np.ascontiguousarray(nodes["counts"][nodes["feature"] < 0])
    _, first, code = np.unique(
        counts.view(f"V{counts.itemsize * counts.shape[1]}").ravel(),
        return_index=True, return_inverse=True,
    )
    different = counts[first].astype(float)
    shares = (different / different.sum(axis=1, keepdims=True)).astype(np.float32)
    small = np.uint16 if len(first) <= 1 << 16 else np.int32
    return nodes["feature"].copy(), nodes["cut"].copy(), code.ravel().astype(small), shares


def packed_trees(nodes: DataFrame, classes: int) -> DataFrame:
    """(tree, scoring arrays, gain of each feature) of whole trees, by tasks."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        whole = np.frombuffer(b"".join(pdf["nodes"]), node_type(classes))
        # In the order of the numbers, as the sum depends on it.
        inner = np.sort(whole[whole["feature"] >= 0], order="id")
        gained = np.bincount(inner["feature"], inner["gain"] * inner["counts"].sum(axis=1), _FIELDS)
        feature, cut, code, shares = scoring_arrays(whole)
        kind = np.array([code.itemsize], np.uint8).tobytes()
        return pd.DataFrame({
            "tree": [int(key[0])], "feature": [feature.tobytes()], "cut": [cut.tobytes()],
            "code": [kind + code.tobytes()], "shares": [shares.tobytes()], "gained": [gained.tolist()],
        })

    return nodes.groupBy("tree").applyInPandas(pack, PACKED)


def unpacked(row, classes: int) -> tuple[np.ndarray, ...]:
    """The scoring arrays of a row of ``packed_trees``."""
    kind = np.uint16 if row["code"][0] == 2 else np.int32
    return (
        np.frombuffer(row["feature"], np.int8), np.frombuffer(row["cut"], np.uint8),
        np.frombuffer(bytes(row["code"][1:]), kind),
        np.frombuffer(row["shares"], np.float32).reshape(-1, classes),
    )


def _tops(tops: dict[int, list], classes: int) -> dict[int, Tree]:
    """The trees as far as they are grown; waiting nodes count as leaves."""
    return {tree: as_tree(np.array(nodes, node_type(classes))) for tree, nodes in tops.items()}


def _weights(rows: np.ndarray, seed: int, tree: int, trees: int, fold: np.ndarray) -> np.ndarray:
    """Draws of the rows for a tree; fit 0 is over all, fit f leaves out fold f - 1."""
    weight = drawn(rows, seed, tree)
    fit = tree // trees
    return weight if fit == 0 else np.where(fold == fit - 1, 0, weight)


def grow_forest(
    vectors: DataFrame, total: int, classes: int, trees: int, depth: int, folds: int,
    least: int, seed: int, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """(tree, nodes) of all fits over ``vectors`` (row, label, bins): tree
    numbers below ``trees`` are over all rows, the next ``trees`` without fold
    0, and so on. A tree may come in several pieces."""
    spark = vectors.sparkSession
    kind = node_type(classes)
    blank = lambda node: (node, LEAF, 0, 0.0, (0,) * classes)
    tops = {tree: [blank(1)] for tree in range(trees * (folds + 1))}
    wide = {tree: [1] for tree in tops} if total > task_rows else {}
    waiting = {tree: [] if wide else [1] for tree in tops}
    while wide:
        splits = _wide_splits(vectors, _tops(tops, classes), wide, seed, trees, folds, classes, least)
        wide = {}
        for row in splits.collect():  # a split for each node of many rows
            tree, node = row["tree"], np.frombuffer(row["nodes"], kind)[0]
            tops[tree] = [n for n in tops[tree] if n[0] != node["id"]] + [node.item()]
            if node["feature"] < 0:
                continue
            level = int(node["id"]).bit_length()
            for child, size in zip((2 * int(node["id"]), 2 * int(node["id"]) + 1), row["sizes"]):
                tops[tree].append(blank(child))
                if size > task_rows and level < depth:
                    wide.setdefault(tree, []).append(child)
                else:
                    waiting[tree].append(child)
    known = _tops(tops, classes)
    open_nodes = {tree: np.sort(np.array(nodes, np.int64)) for tree, nodes in waiting.items() if nodes}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bins, label, place in _blocks(batches):
            fold = folds_of(rows, seed, folds)
            for tree, nodes in open_nodes.items():
                weight = np.bincount(
                    place, _weights(rows, seed, tree, trees, fold), len(bins)
                ).astype(np.int64)
                node = known[tree].walk(bins)
                found = np.flatnonzero((weight > 0) & np.isin(node, nodes))
                found = found[np.argsort(node[found], kind="stable")]
                packed = np.zeros(len(found), _ROW)
                packed["bins"], packed["label"], packed["weight"] = bins[found], label[found], weight[found]
                which, starts = np.unique(node[found], return_index=True)
                pieces = [p.tobytes() for p in np.split(packed, starts[1:])] if len(which) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(which), pa.int32()), pa.array(which, pa.int64()),
                     pa.array(pieces, pa.binary())], ["tree", "node", "rows"],
                )

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(key[0]), int(key[1])
        rows = _collapsed(np.frombuffer(b"".join(pdf["rows"]), _ROW))
        grown = grow_branch(node, rows, seed, tree, classes, depth, least)
        return pd.DataFrame({"tree": [tree], "nodes": [grown.tobytes()]})

    # Drawn rows of all trees, dealt so that a task gets about a block of them.
    parts = max(
        2 * spark.sparkContext.defaultParallelism, total * len(tops) // (16 * BLOCK_ROWS)
    )
    dealt = vectors.mapInArrow(deal, "tree int, node bigint, rows binary").repartition(
        parts, "tree", "node"
    )
    grown = dealt.groupBy("tree", "node").applyInPandas(finish, GROWN)
    first = [
        (tree, np.array([n for n in nodes if n[0] not in set(waiting[tree])], kind).tobytes())
        for tree, nodes in tops.items()
    ]
    return grown.unionByName(spark.createDataFrame([r for r in first if r[1]], GROWN))


def _wide_splits(
    vectors: DataFrame, known: dict[int, Tree], wide: dict[int, list[int]], seed: int,
    trees: int, folds: int, classes: int, least: int,
) -> DataFrame:
    """(tree, one split node, sizes of its children) of the nodes in ``wide``,
    from counts of the tried features that all tasks add up."""
    asked = {tree: np.sort(np.array(nodes, np.int64)) for tree, nodes in wide.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bins, label, place in _blocks(batches):
            fold = folds_of(rows, seed, folds)
            for tree, nodes in asked.items():
                weight = np.bincount(place, _weights(rows, seed, tree, trees, fold), len(bins))
                node = known[tree].walk(bins)
                found = np.flatnonzero((weight > 0) & np.isin(node, nodes))
                at = np.searchsorted(nodes, node[found])
                tried = tried_features(nodes, seed, tree)
                sums = np.stack([
                    np.bincount(
                        (at * BINS + bins[found, tried[at, k]]) * classes + label[found],
                        weight[found], len(nodes) * BINS * classes,
                    ).reshape(len(nodes), -1) for k in range(_SHARE)
                ], axis=1).astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(nodes), pa.int32()), pa.array(nodes, pa.int64()),
                     pa.array([s.tobytes() for s in sums], pa.binary())], ["tree", "node", "sums"],
                )

    def split(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree, ids = int(key[0]), np.array([key[1]], np.int64)
        sums = sum(np.frombuffer(s, "<i4").astype(np.int64) for s in pdf["sums"])
        sums = sums.reshape(_SHARE, BINS, classes)
        counts = sums[0].sum(axis=0)[None, :]
        purities, cuts = np.full((1, _SHARE), -1.0), np.zeros((1, _SHARE), np.int64)
        for k in range(_SHARE):
            cut, label = np.nonzero(sums[k])
            if len(cut):
                purities[:, k], cuts[:, k] = best_cuts(
                    np.zeros(len(cut), np.int64), cut, label, sums[k][cut, label], classes, least
                )
        nodes = choose(ids, counts, tried_features(ids, seed, tree), purities, cuts, classes)
        slot = int(purities[0].argmax())
        left = int(sums[slot][: int(nodes["cut"][0]) + 1].sum())
        return pd.DataFrame({
            "tree": [tree], "nodes": [nodes.tobytes()], "sizes": [[left, int(counts.sum()) - left]],
        })

    return vectors.mapInArrow(count, "tree int, node bigint, sums binary").groupBy(
        "tree", "node"
    ).applyInPandas(split, "tree int, nodes binary, sizes array<bigint>")


@dataclass(frozen=True)
class Forest:
    """A grown forest: its nodes as a stored table (tree, nodes), and where it
    is known the table of its ``packed_trees``."""

    nodes: DataFrame
    borders: list[list[float]]
    classes: int
    packed: DataFrame | None = None

    @cached_property
    def _loaded(self) -> tuple[list, np.ndarray]:
        """A broadcast for each tree and the importance of each feature. The
        driver holds the trees of two files at a time."""
        context = self.nodes.sparkSession.sparkContext
        packed = self.packed or store_stage(packed_trees(self.nodes, self.classes), "forest-packed")
        found = [
            (row["tree"], context.broadcast(unpacked(row, self.classes)), np.array(row["gained"]))
            for row in packed.toLocalIterator(prefetchPartitions=True)
        ]
        if not self.packed:
            drop_stages(packed)
        found.sort(key=lambda tree: tree[0])  # sums of shares depend on the order
        shares = np.zeros(_FIELDS)
        for _, _, gained in found:
            if gained.sum() > 0:
                shares += gained / gained.sum()
        return [tree for _, tree, _ in found], shares / shares.sum() if shares.sum() > 0 else shares

    @property
    def importances(self) -> list[float]:
        """Mean over the trees of each feature's share of the gained purity."""
        return self._loaded[1].tolist()

    def probabilities(self) -> Column:
        """The mean class shares at the leaves that a row of scaled features
        reaches, summing to one."""
        trees, borders, classes = self._loaded[0], self.borders, self.classes

        @F.pandas_udf("array<double>")
        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            # Each tree is unpacked once for a block of batches.
            def scored(block: list[np.ndarray]) -> Iterator[pd.Series]:
                bins = np.concatenate(block)
                first, place = distinct(bins)
                found = mean_shares([t.value for t in trees], bins[first], classes)[place]
                for rows in np.split(found, np.cumsum([len(b) for b in block])[:-1]):
                    yield pd.Series(list(rows))

            block, size = [], 0
            for batch in batches:
                block.append(to_bins(batch.to_numpy(dtype=float), borders))
                size += len(batch)
                if size >= BLOCK_ROWS:
                    yield from scored(block)
                    block, size = [], 0
            if block:
                yield from scored(block)

        return score(F.struct(*[F.col(c).cast("double").alias(c) for c in FEATURE_COLS]))


def mean_shares(trees: list[tuple], bins: np.ndarray, classes: int) -> np.ndarray:
    """Mean class shares over trees given as ``scoring_arrays``."""
    total = np.zeros((len(bins), classes))
    for feature, cut, code, shares in trees:
        # The children of the inner nodes follow the root in pairs, in the same order.
        inner = np.cumsum(feature >= 0, dtype=np.int32)
        last = walk(feature, cut, 2 * inner - 1, bins)
        total += shares[code[last - inner[last]]]
    return total / total.sum(axis=1, keepdims=True)


def weighted_f1(counts: dict[tuple[int, int], int], classes: int) -> float:
    """F1 of each class, weighted by its rows, from (label, predicted) counts."""
    table = np.zeros((classes, classes))
    for (label, predicted), rows in counts.items():
        table[label, predicted] = rows
    hit, true, said = np.diag(table), table.sum(axis=1), table.sum(axis=0)
    f1 = np.divide(2 * hit, true + said, out=np.zeros(classes), where=true + said > 0)
    return float((f1 * true).sum() / max(true.sum(), 1))


def fold_scores(vectors: DataFrame, fits: list[Forest], seed: int) -> list[float]:
    """Weighted F1 of each fit on the fold it was not grown from. Fits take
    turns, so a worker holds the trees of one; its broadcasts go with it."""
    folds = len(fits)

    def score(k: int, fit: Forest) -> float:
        trees, classes = fit._loaded[0], fit.classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, bins, label, place in _blocks(batches):
                weight = np.bincount(place, folds_of(rows, seed, folds) == k, len(bins)).astype(np.int64)
                left_out = np.flatnonzero(weight)
                best = mean_shares([t.value for t in trees], bins[left_out], classes).argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label[left_out].astype(np.int32)), pa.array(best.astype(np.int32)),
                     pa.array(weight[left_out], pa.int64())], ["label", "predicted", "rows"],
                )

        found = vectors.mapInArrow(run, "label int, predicted int, rows bigint").groupBy(
            "label", "predicted"
        ).agg(F.sum("rows").alias("rows")).collect()  # at most classes squared
        for tree in trees:
            tree.destroy()
        return weighted_f1({(r["label"], r["predicted"]): r["rows"] for r in found}, classes)

    return [score(k, fit) for k, fit in enumerate(fits)]


def fit_forest(
    rows: DataFrame, classes: int, trees: int, depth: int, folds: int, least: int, seed: int,
    task_rows: int = TASK_ROWS,
) -> tuple[Forest, list[float]]:
    """The forest over ``rows`` (``label`` and the scaled features) and the
    weighted F1 of the fits of a cross-validation."""
    spark = rows.sparkSession
    borders = bin_borders(rows)
    parts = 2 * spark.sparkContext.defaultParallelism
    vectors = store_stage(binned(rows, borders, parts), "forest-rows")
    # A folder for each fit, so that a fit is read without the others.
    fit = F.floor(F.col("tree") / trees).cast("int").alias("fit")
    grown = store_stage(
        grow_forest(
            vectors, vectors.count(), classes, trees, depth, folds, least, seed, task_rows
        ).select("*", fit),
        "forest-nodes", "fit",
    )
    packed = store_stage(
        packed_trees(grown.drop("fit"), classes).select("*", fit), "forest-packed", "fit"
    )
    of_fit = lambda table, k: table.filter(F.col("fit") == k).drop("fit")
    forests = [
        Forest(of_fit(grown, k), borders, classes, of_fit(packed, k)) for k in range(folds + 1)
    ]
    scores = fold_scores(vectors, forests[1:], seed) if folds else []
    drop_stages(vectors)
    return forests[0], scores


def load_forest(
    spark: SparkSession, path: str, borders: list[list[float]], classes: int,
    packed: str | None = None,
) -> Forest:
    """The forest stored at ``path``, its packed trees at ``packed`` if they were stored."""
    trees = spark.read.schema(PACKED).parquet(packed) if packed else None
    return Forest(spark.read.schema(GROWN).parquet(path), borders, classes, trees)
