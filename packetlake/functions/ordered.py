"""Ordered computations that never put one whole group into one task.

A plain window sorts all rows of a key in a single task, so one hot key holds
up the job. Here a key's rows are cut into slices along the sort order. Each
slice is ordered on its own, a summary row per slice (far smaller than the
data) is ordered per key, and what a slice must know about the slices before
it is joined back. Keys must not be null, since they are joined on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIGEST_PREFIX = 4  # hex digits, so at most 65,536 slices per key

# Exact quantiles: accuracy of the sketch that brackets a rank, and how far the
# bracket reaches on both sides, ten times what the sketch may be off.
SKETCH_ACCURACY = 100_000
BRACKET_MARGIN = 1e-4


def slice_window(keys: Sequence[str], slice_col: str) -> W:
    return W.partitionBy(*keys).orderBy(slice_col)


def carry_slices(
    rows: DataFrame,
    keys: Sequence[str],
    slice_col: str,
    summary: Sequence[Column],
    carried: Callable[[W], Sequence[Column]],
) -> DataFrame:
    """One row per (keys, slice) with values carried along the slices.

    ``summary`` aggregates a slice; ``carried`` turns those aggregates into
    the columns to hand out, given the window over a key's slices.
    """
    window = slice_window(keys, slice_col)
    totals = rows.groupBy(*keys, slice_col).agg(*summary)
    return totals.select(*keys, slice_col, *carried(window))


def hashed_row_number(
    df: DataFrame,
    keys: Sequence[str],
    digest: Column,
    out: str,
    at_most: int | None = None,
    total: str = "_total",
) -> DataFrame:
    """Row number per key in the order of a hex ``digest``.

    A digest is uniform, so slicing on its first digits gives even slices
    whatever the size of a key. With ``at_most``, slices that start beyond it
    are dropped before anything is sorted. Another name for ``total`` keeps
    the number of rows per key in that column.
    """
    rows = df.withColumn("_digest", digest).withColumn(
        "_slice", F.substring("_digest", 1, DIGEST_PREFIX)
    )
    offsets = carry_slices(
        rows,
        keys,
        "_slice",
        [F.count("*").alias("_n")],
        lambda w: [
            (F.sum("_n").over(w) - F.col("_n")).alias("_offset"),
            F.sum("_n").over(W.partitionBy(*keys)).alias(total),
        ],
    )
    if at_most is not None:
        offsets = offsets.filter(F.col("_offset") < at_most)
    in_slice = W.partitionBy(*keys, "_slice").orderBy("_digest")
    numbered = rows.join(offsets, [*keys, "_slice"]).withColumn(
        out, F.col("_offset") + F.row_number().over(in_slice)
    )
    if at_most is not None:
        numbered = numbered.filter(F.col(out) <= at_most)
    return numbered.drop("_digest", "_slice", "_offset", "_total")


def exact_quantiles(
    long_form: DataFrame, key: str, value: str, probabilities: Sequence[float]
) -> DataFrame:
    """Exact linearly interpolated quantiles of ``value`` per ``key``.

    A quantile sketch brackets each wanted rank. The distinct values inside
    the bracket (about 0.02 % of a large column) are ranked; of the rows below
    and above, only the count and the nearest value are kept. The sketch names
    the value at rank ``p * n`` and interpolation starts from ``p * (n - 1)``,
    so in a column of few rows the wanted ranks may be those nearest values.
    Output: ``key, probability, quantile``. ``key`` must have few values
    (feature names): its bracket rows are broadcast.
    """
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    low_p = [max(p - BRACKET_MARGIN, 0.0) for p in probabilities]
    high_p = [min(p + BRACKET_MARGIN, 1.0) for p in probabilities]
    half = len(low_p)
    present = long_form.select(key, value).filter(F.col(value).isNotNull())
    stats = present.groupBy(key).agg(
        F.count("*").alias("_n"),
        F.percentile_approx(value, low_p + high_p, SKETCH_ACCURACY).alias("_ends"),
    )
    brackets = stats.select(
        key,
        "_n",
        F.slice("_ends", 1, half).alias("_low"),
        F.slice("_ends", half + 1, half).alias("_high"),
    ).select(
        key,
        "_n",
        F.posexplode(F.arrays_zip(wanted.alias("p"), F.col("_low"), F.col("_high"))).alias(
            "_i", "_b"
        ),
    ).select(
        key,
        F.col("_b.p").alias("probability"),
        F.col("_b._low").alias("_low"),
        F.col("_b._high").alias("_high"),
        ((F.col("_n") - 1) * F.col("_b.p")).alias("_rank"),
    )
    # Values on one side of a bracket collapse to one row per key and probability.
    side = F.when(F.col(value) < F.col("_low"), -1).when(F.col(value) > F.col("_high"), 1).otherwise(0)
    counts = (
        present.join(F.broadcast(brackets), key)
        .withColumn("_side", side)
        .groupBy(
            key, "probability", "_rank", "_side",
            F.when(F.col("_side") == 0, F.col(value)).alias("_inside"),
        )
        .agg(
            F.count("*").alias("_count"),
            F.min(value).alias("_least"),
            F.max(value).alias("_largest"),
        )
        .withColumn("_value", F.when(F.col("_side") < 0, F.col("_largest")).otherwise(F.col("_least")))
    )
    ranked = counts.withColumn(
        "_upto",
        F.sum("_count").over(
            W.partitionBy(key, "probability")
            .orderBy("_side", "_value")
            .rowsBetween(W.unboundedPreceding, W.currentRow)
        ),
    )
    # Zero-based ranks [upto - count, upto - 1] hold this value.
    at_rank = lambda rank: F.max(
        F.when(
            (rank >= F.col("_upto") - F.col("_count")) & (rank < F.col("_upto")),
            F.col("_value"),
        )
    )
    below = F.floor(F.col("_rank"))
    above = F.ceil(F.col("_rank"))
    return (
        ranked.groupBy(key, "probability", "_rank")
        .agg(at_rank(below).alias("_lo"), at_rank(above).alias("_hi"))
        .select(
            key,
            "probability",
            (
                F.col("_lo")
                + (F.col("_hi") - F.col("_lo")) * (F.col("_rank") - F.floor("_rank"))
            ).alias("quantile"),
        )
    )
