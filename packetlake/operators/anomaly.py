"""Isolation forest: trees grown on small samples, scores over all rows.

Every tree needs at most 256 rows, so growing is one small group per tree.
The node table is bounded by trees and sample size (about 51,000 rows) and
travels to the executors with the scoring function.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlake.functions.ordered import exact_quantiles, hashed_row_number
from packetlake.schemas import FEATURE_COLS
from packetlake.session import drop_stages, store_stage

# Forest parameters.
TREES = 100
SAMPLE_ROWS = 256
CONTAMINATION = 0.05
SEED = 42

NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, path double"
)
LEAF = -1
# Rows that walk the trees at a time and stay in a core's cache.
CACHED_ROWS = 4096


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(tree: int, values: np.ndarray, seed: int) -> pd.DataFrame:
    """The nodes of one isolation tree, breadth first from node 0."""
    rng = np.random.default_rng([seed, tree])
    max_depth = math.ceil(math.log2(max(len(values), 2)))
    nodes: list[list] = []
    pending = [(np.arange(len(values)), 0)]
    taken = 0
    while taken < len(pending):
        rows, depth = pending[taken]
        part = values[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= max_depth or len(rows) <= 1 or not len(varying):
            nodes.append([tree, taken, LEAF, 0.0, LEAF, LEAF, depth + average_path(len(rows))])
        else:
            feature = int(rng.choice(varying))
            threshold = float(rng.uniform(low[feature], high[feature]))
            goes_left = part[:, feature] <= threshold
            left = len(pending)
            pending += [(rows[goes_left], depth + 1), (rows[~goes_left], depth + 1)]
            nodes.append([tree, taken, feature, threshold, left, left + 1, 0.0])
        taken += 1
    return pd.DataFrame(
        nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "path"]
    )


def tree_samples(rows: DataFrame, row_id: str, trees: int, sample_rows: int, seed: int) -> DataFrame:
    """``rows`` with a ``tree`` column, ``sample_rows`` rows (or all, if there
    are fewer) per tree."""
    total = rows.count()
    drawn = [
        (tree, int(number) + 1)
        for tree in range(trees)
        for number in np.random.default_rng([seed, tree]).choice(
            total, min(sample_rows, total), replace=False
        )
    ]
    # At most trees * sample_rows pairs, whatever the number of rows.
    pairs = rows.sparkSession.createDataFrame(drawn, "tree int, _rank bigint")
    ident = F.concat_ws("|", F.col(row_id).cast("string"), F.lit(str(seed)))
    numbered = hashed_row_number(rows, [], F.md5(ident), "_rank")
    return numbered.join(F.broadcast(pairs), "_rank").drop("_rank")


def _packed(tree: pd.DataFrame) -> tuple:
    """(depth, feature, threshold, left, path) by node; the right child follows
    the left one, and a leaf leads to itself."""
    feature, left = tree["feature"].to_numpy(np.intp), tree["left"].to_numpy(np.intp)
    leaf = feature == LEAF
    depth = np.zeros(len(feature), int)
    for node in np.flatnonzero(~leaf):  # parents come before their children
        depth[left[node]:left[node] + 2] = depth[node] + 1
    return (
        int(depth.max()), np.where(leaf, 0, feature),
        np.where(leaf, np.inf, tree["threshold"].to_numpy()),
        np.where(leaf, np.arange(len(leaf)), left), tree["path"].to_numpy(),
    )


def _path_lengths(trees: list[tuple], values: np.ndarray) -> np.ndarray:
    """The sum of the path lengths of each row, in the order of the trees."""
    total = np.zeros(len(values))
    for start in range(0, len(values), CACHED_ROWS):
        # What is not a number goes right, as the largest ones do.
        part = values[start:start + CACHED_ROWS]
        part = np.where(np.isnan(part), np.inf, part)
        flat, row = part.ravel(), np.arange(len(part)) * part.shape[1]
        lengths = total[start:start + CACHED_ROWS]
        for depth, feature, threshold, left, path in trees:
            at = np.zeros(len(part), np.intp)
            for _ in range(depth):
                right = flat.take(row + feature.take(at)) > threshold.take(at)
                at = left.take(at) + right
            lengths += path.take(at)
    return total


@dataclass(frozen=True)
class IsolationForest:
    nodes: pd.DataFrame
    sample_rows: int
    offset: float

    def raw_score(self) -> Column:
        """Column of -2^(-mean path / expected path), lower is stranger."""
        trees = [
            _packed(part) for _, part in self.nodes.sort_values(["tree", "node"]).groupby("tree")
        ]
        expected = max(average_path(self.sample_rows), 1e-12)

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for batch in batches:
                total = _path_lengths(trees, batch.to_numpy(dtype=float))
                yield pd.Series(-np.power(2.0, -total / len(trees) / expected))

        return score(F.struct(*[F.col(c).cast("double").alias(c) for c in FEATURE_COLS]))

    def score(self, scaled: DataFrame) -> DataFrame:
        """``scaled`` with ``anomaly_score`` (below 0 is an anomaly) and
        ``is_anomaly``."""
        scored = scaled.withColumn("anomaly_score", self.raw_score() - F.lit(self.offset))
        return scored.withColumn("is_anomaly", F.col("anomaly_score") < 0)

    def node_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, NODE_SCHEMA)


def fit_isolation_forest(
    scaled: DataFrame, row_id: str, trees: int = TREES, sample_rows: int = SAMPLE_ROWS,
    contamination: float = CONTAMINATION, seed: int = SEED,
) -> IsolationForest:
    """Grow the forest on scaled training rows and set the offset so that the
    ``contamination`` share of them scores below zero."""
    samples = tree_samples(scaled.select(row_id, *FEATURE_COLS), row_id, trees, sample_rows, seed)

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(row_id)[FEATURE_COLS].to_numpy(dtype=float)
        return grow_tree(int(key[0]), ordered, seed)

    nodes = samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    used = min(sample_rows, samples.filter("tree = 0").count())
    forest = IsolationForest(nodes, used, 0.0)
    # The quantile reads the scores twice.
    scores = store_stage(
        scaled.select(F.lit("score").alias("name"), forest.raw_score().alias("value")),
        "anomaly-scores",
    )
    offset = exact_quantiles(scores, "name", "value", [contamination]).first()["quantile"]
    drop_stages(scores)
    return IsolationForest(nodes, used, float(offset))
