"""Exact top-k inner products over norm buckets.

Vectors are grouped by length into half-octave levels and cut into blocks of a
bounded size, longest first. Queries meet the blocks in rounds of doubling size.
After a round each query knows the k-th best score so far, a lower bound for the
next one, so a round hands on about as many rows for each query as the last. A
level is looked at only by queries whose length times the level's longest vector
reaches their bound. Inside a block the bound becomes a local cosine threshold:
where it is low, only the length of a candidate prunes; where it is high, the
query's largest coordinates bound the candidate's ones, and only vectors within
those bounds are verified by their whole inner product. Queries whose bounds
leave much of the block are verified together, as one product of matrices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetlake.session import drop_stages, store_stage

K = 20
SCALE = 64.0
# Candidates of a block, and queries that meet it at a time.
BLOCK_ROWS = 2048
QUERY_ROWS = 512
# Local cosine from which coordinates prune, and the coordinates looked at.
COORDINATE_COSINE = 0.4
FOCUS = 3
# A candidate in so many tells whether a query's coordinates leave at most this
# share of them.
PROBE_STEP = 16
PRUNED_SHARE = 1 / 8
SLACK = 1e-9
EXACT = float(1 << 53)
LARGEST = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """(row, vec_id, v array<bigint>, norm, level): vectors that are null or
    hold a null or non-finite component are left out."""
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    usable = F.col("embedding").isNotNull() & F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return (
        vectors.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("vec_id").cast("bigint").alias("vec_id"), "embedding",
        )
        .where(usable)
        .select("row", "vec_id", scaled.alias("v"))
        .withColumn("norm", norm)
        .withColumn(
            "level", F.when(F.col("norm") > 0, F.floor(2 * F.log2("norm"))).otherwise(-1).cast("int")
        )
    )


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond 53 bits in whole numbers, beyond 64 bits the
    largest or least such number."""
    bound = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(1, left.shape[-1])
    if bound < EXACT:
        return (left @ right.T).astype(np.int64)

    def whole(values: np.ndarray) -> np.ndarray:
        return np.array([int(v) for v in values.ravel()], object).reshape(values.shape)

    exact = whole(left) @ whole(right.T)
    return np.clip(exact, -LARGEST - 1, LARGEST).astype(np.int64)


def _intervals(queries: np.ndarray, cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest coordinates of each query (a row for each), and the least and
    the largest value there of a unit vector within the cosine."""
    directions = queries / np.sqrt((queries**2).sum(axis=1))[:, None]
    focus = np.argsort(-np.abs(directions), axis=1)[:, :FOCUS]
    direction = np.take_along_axis(directions, focus, axis=1)
    cosine = np.minimum(cosines, 1.0)[:, None]
    spread = np.sqrt(np.maximum(0.0, (1 - direction**2) * (1 - cosine**2))) + SLACK
    # Above the cosine the interval only shrinks towards the query, but for
    # the side on which the query's own coordinate lies.
    low = np.where(direction <= -cosine, -1.0 - SLACK, direction * cosine - spread)
    high = np.where(direction >= cosine, 1.0 + SLACK, direction * cosine + spread)
    return focus, low, high


def _survivors(unit: np.ndarray, focus: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The candidates whose coordinates are within the bounds of a query."""
    near = np.arange(len(unit))
    for f, least, most in zip(focus, low, high, strict=True):
        values = unit[near, f]
        near = near[(values >= least) & (values <= most)]
    return near


def score_blocks(pairs: DataFrame, k: int) -> DataFrame:
    """The best k of each query in each block it meets, at or above its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, stored = batch.column("queries"), batch.column("candidates")
            for i in range(batch.num_rows):
                yield _score_block(asked[i].values, stored[i].values, k)

    return pairs.select("queries", "candidates").mapInArrow(
        run, "query_row bigint, query_id bigint, vec_id bigint, row bigint, score bigint"
    )


def _first_k(groups: np.ndarray, k: int) -> np.ndarray:
    """Of values in ascending order, which are among the first k of their kind."""
    starts = np.searchsorted(groups, groups)
    return np.arange(len(groups)) - starts < k


def _score_block(asked: pa.StructArray, stored: pa.StructArray, k: int) -> pa.RecordBatch:
    vectors = [part.field("v") for part in (asked, stored)]
    width = max(pc.max(v.value_lengths()).as_py() for v in vectors)
    candidates = _matrix(vectors[1], width)
    norms = np.sqrt((candidates**2).sum(axis=1))
    order = np.argsort(-norms, kind="stable")
    candidates, norms = candidates[order], norms[order]
    queries = _matrix(vectors[0], width)
    lengths = np.sqrt((queries**2).sum(axis=1))
    rows = stored.field("row").to_numpy(zero_copy_only=False)[order]
    # Null ids come last among equal scores.
    stored_ids = stored.field("vec_id").take(pa.array(order))
    ids = pc.fill_null(stored_ids, LARGEST).to_numpy(zero_copy_only=False)
    own = asked.field("row").to_numpy(zero_copy_only=False)
    bounds = pc.fill_null(asked.field("bound"), -math.inf).to_numpy(zero_copy_only=False)
    unit = candidates / np.where(norms > 0, norms, 1)[:, None]

    # By length: how many of the longest candidates may reach each bound.
    reach, cosines = np.full(len(asked), len(stored)), np.zeros(len(asked))
    bounded = (bounds > 0) & (lengths > 0)
    least = bounds[bounded] / lengths[bounded] * (1 - SLACK)
    reach[bounded] = np.searchsorted(-norms, -least, side="right")
    cosines[bounded] = least / norms[0] - SLACK if norms[0] else 0.0

    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(query: np.ndarray, near: np.ndarray, scores: np.ndarray) -> None:
        good = (rows[near] != own[query]) & (scores >= bounds[query])
        query, near, scores = query[good], near[good], scores[good]
        # By ~score, as the least number has no negative.
        best = np.lexsort((rows[near], ids[near], ~scores, query))
        best = best[_first_k(query[best], k)]
        found.append((query[best], near[best], scores[best]))

    narrow = np.flatnonzero((cosines >= COORDINATE_COSINE) & (reach > 0))
    focus, low, high = _intervals(queries[narrow], cosines[narrow])
    # Bounds that leave much of some candidates save nothing: one product for
    # all such queries costs less than looking at their coordinates.
    some = unit[::PROBE_STEP][:, focus]
    left = ((some >= low) & (some <= high)).all(axis=2).mean(axis=0)
    pruned = left <= PRUNED_SHARE
    narrow, focus, low, high = (part[pruned] for part in (narrow, focus, low, high))
    whole = reach > 0
    whole[narrow] = False
    wide = np.flatnonzero(whole)
    if len(wide):
        longest = int(reach[wide].max())
        products = _products(queries[wide], candidates[:longest])
        hit = (np.arange(longest) < reach[wide, None]) & (products >= bounds[wide, None])
        free = np.flatnonzero(bounds[wide] == -math.inf)
        if len(free) and longest > k + 1:
            # Those without a bound reach all: the best k and, if among them, the query itself.
            best = np.partition(products[free], longest - k - 1, axis=1)[:, longest - k - 1]
            hit[free] &= products[free] >= best[:, None]
        at, near = np.nonzero(hit)
        keep(wide[at], near, products[at, near])
    verified = []
    for i, *bounds_of in zip(narrow, focus, low, high, strict=True):
        near = _survivors(unit[:reach[i]], *bounds_of)
        if len(near):
            scores = _products(candidates[near], queries[i][None, :])[:, 0]
            verified.append((np.full(len(near), i), near, scores))
    if verified:
        keep(*(np.concatenate(part) for part in zip(*verified, strict=True)))
    query, near, scores = (
        np.concatenate([np.empty(0, np.int64), *part]) for part in (zip(*found, strict=True) if found else [[]] * 3)
    )
    return pa.RecordBatch.from_arrays(
        [pa.array(own[query]), asked.field("vec_id").take(pa.array(query)),
         stored_ids.take(pa.array(near)), pa.array(rows[near]), pa.array(scores)],
        ["query_row", "query_id", "vec_id", "row", "score"],
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(
        Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    )
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _round(
    queries: DataFrame, blocks: DataFrame, spec: list[tuple[int, int, int, float]], sets: int, k: int
) -> DataFrame:
    """Scores of the queries (row, vec_id, v, norm, bound) in the blocks of
    ``spec``: level, first and last block, longest vector."""
    met = F.filter(
        F.array(*(
            F.struct(
                F.lit(level).alias("level"), F.lit(first).alias("first"), F.lit(last).alias("last"),
                F.lit(longest).alias("longest"),
            )
            for level, first, last, longest in spec
        )),
        lambda x: F.col("bound").isNull() | (F.col("norm") * (1 + SLACK) * x["longest"] >= F.col("bound")),
    )
    asked = (
        queries.withColumn("met", F.explode(met))
        .groupBy(
            F.pmod(F.xxhash64("row"), F.lit(sets)).alias("set"),
            F.col("met.level").alias("level"), F.col("met.first").alias("first"), F.col("met.last").alias("last"),
        )
        .agg(F.collect_list(F.struct("row", "vec_id", "v", "bound")).alias("queries"))
        .withColumn("block", F.explode(F.sequence("first", "last")))
    )
    inside = F.lit(False)
    for level, first, last, _ in spec:
        inside = inside | ((F.col("level") == level) & F.col("block").between(first, last))
    # Merged, as a broadcast of blocks, which are many times their stored size in
    # memory, would have to fit into the driver. The right side has a row for each key.
    return score_blocks(asked.join(blocks.where(inside).hint("merge"), ["level", "block"]), k)


def rounds_of(levels: list[tuple[int, int, float]]) -> list[list[tuple[int, int, int, float]]]:
    """The blocks of (level, blocks, longest), longest level first, in rounds of
    1, 1, 2, 4, ... blocks."""
    out, size, room = [], 1, 1
    current: list[tuple[int, int, int, float]] = []
    for level, blocks, longest in sorted(levels, reverse=True):
        at = 0
        while at < blocks:
            take = min(room, blocks - at)
            current.append((level, at, at + take - 1, longest))
            at, room = at + take, room - take
            if not room:
                out.append(current)
                current, room = [], size
                size *= 2
    return [*out, current] if current else out


def top_products(vectors: DataFrame, query_step: int = 20, k: int = K, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each row
    whose vec_id is divisible by ``query_step``, among all rows but itself.

    Components are floor(64 * x); they and the scores end at 64 bits: what is
    beyond is the largest or least such number. Ties go to the smaller vec_id; a
    repeated row is a candidate, and a query of its own if its id says so; a null
    id is never a query and comes last among ties. Vectors of unequal length are
    compared as if the shorter ended in zeros. Other columns are not looked at;
    an empty table gives no rows.
    """
    table = store_stage(integer_vectors(vectors), "vectors")
    # One row for each half octave of lengths: at most about 2,000 for doubles.
    levels = [
        (x["level"], -(-x["n"] // block_rows), x["longest"] * (1 + SLACK))
        for x in table.groupBy("level").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()
    ]
    count = F.create_map(*[F.lit(v) for level, n, _ in levels for v in (level, n)] or [F.lit(0), F.lit(1)])
    blocks = store_stage(
        table.groupBy("level", F.pmod(F.xxhash64("row"), count[F.col("level")]).cast("int").alias("block"))
        .agg(F.collect_list(F.struct("row", "vec_id", "v")).alias("candidates")), "blocks",
    )
    queries = store_stage(table.where(F.col("vec_id") % query_step == 0).select("row", "vec_id", "v", "norm"), "queries")
    sets = -(-queries.count() // QUERY_ROWS) or 1
    best = None
    for spec in rounds_of(levels):
        if best is None:
            bounded = queries.withColumn("bound", F.lit(None).cast("double"))
        else:
            # Below the k-th score, as large ones are rounded as doubles.
            least = F.min("score").cast("double")
            bounds = best.groupBy(F.col("query_row").alias("row")).agg(
                F.when(F.count("*") == k, least - F.abs(least) * F.lit(SLACK) - 1).alias("bound")
            )
            bounded = queries.join(bounds, "row", "left")
        found = _round(bounded, blocks, spec, sets, k)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        last, best = best, store_stage(_best(found, k), "best")
        if last is not None:
            drop_stages(last)
    if best is None:
        return table.where("false").selectExpr(
            "vec_id AS query_id", "CAST(0 AS INT) AS rank", "vec_id", "CAST(0 AS BIGINT) AS score"
        )
    drop_stages(blocks, queries, table)
    return best.select("query_id", "rank", "vec_id", "score")
