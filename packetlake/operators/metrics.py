"""Classifier evaluation from (label, prediction) pairs.

Everything but the AUC is computed from the confusion counts, one row per
pair of labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetlake.functions.ordered import carry_slices

SCORE_SLICES = 1_000_000


def confusion_counts(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return scored.groupBy(
        F.col(label).alias("label"), F.col(prediction).alias("prediction")
    ).agg(F.count("*").alias("n"))


def confusion_matrix(counts: DataFrame) -> DataFrame:
    """A row per true label, a column per predicted label, both sorted."""
    names = counts.select(F.explode(F.array("label", "prediction")).alias("name")).distinct()
    cells = names.select(F.col("name").alias("label")).join(counts, "label", "left")
    ordered = [r.name for r in names.orderBy("name").collect()]  # the label set
    return (
        cells.groupBy("label").pivot("prediction", ordered).agg(F.sum("n"))
        .fillna(0, ordered).orderBy("label")
    )


def per_class(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label; undefined ratios are 0."""
    truth = counts.select(
        F.col("label").alias("class"), F.col("n").alias("support"),
        F.lit(0).cast("bigint").alias("predicted"),
        F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"),
    )
    claimed = counts.select(
        F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"),
        F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hit"),
    )
    sums = truth.unionByName(claimed).groupBy("class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "hit")]
    )
    ratio = lambda n, d: F.when(d == 0, 0.0).otherwise(n / d)
    hit = F.col("hit")
    return sums.select(
        "class",
        ratio(hit, F.col("predicted")).alias("precision"),
        ratio(hit, F.col("support")).alias("recall"),
        ratio(2 * hit, F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "hit",
    )


def _averages(classes: DataFrame, name: str, weight: Column) -> DataFrame:
    total = F.sum(weight)
    return classes.agg(
        *[(F.sum(F.col(m) * weight) / total).alias(m) for m in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
    ).select(F.lit(name).alias("class"), "precision", "recall", "f1", "support")


def overall_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy and weighted precision, recall and F1 in one row."""
    w = F.col("support")
    return per_class(counts).agg(
        (F.sum("hit") / F.sum(w)).alias("accuracy"),
        *[(F.sum(F.col(m) * w) / F.sum(w)).alias(m) for m in ("precision", "recall", "f1")],
    )


def classification_report(counts: DataFrame) -> DataFrame:
    """A row per class, then the macro and weighted averages."""
    classes = per_class(counts)
    return (
        classes.drop("hit")
        .unionByName(_averages(classes, "macro avg", F.lit(1.0)))
        .unionByName(_averages(classes, "weighted avg", F.col("support")))
    )


def class_auc(scores: DataFrame) -> DataFrame:
    """Area under the ROC curve per class from (class, score, is_positive).

    Equal scores collapse first. A positive ranks above every negative of a
    lower score and above half of those with its own score; the negatives
    below are a running sum over score slices.
    """
    tallies = scores.groupBy("class", "score").agg(
        F.count_if("is_positive").alias("_pos"), F.count_if(~F.col("is_positive")).alias("_neg")
    ).withColumn("_slice", F.floor(F.col("score") * SCORE_SLICES))
    offsets = carry_slices(
        tallies, ["class"], "_slice", [F.sum("_neg").alias("_negs")],
        lambda w: [(F.sum("_negs").over(w) - F.col("_negs")).alias("_below")],
    )
    in_slice = W.partitionBy("class", "_slice").orderBy("score")
    below = F.col("_below") + F.sum("_neg").over(in_slice) - F.col("_neg")
    ranked = tallies.join(offsets, ["class", "_slice"]).withColumn(
        "_wins", F.col("_pos") * (below + F.col("_neg") / 2)
    )
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return ranked.groupBy("class").agg(
        F.when(pairs > 0, F.sum("_wins") / pairs).alias("auc")
    )


def one_vs_rest(scored: DataFrame, probabilities: str, classes: list[str],
                label: str = "label") -> DataFrame:
    """(class, score, is_positive) per row and class of a probability array."""
    entries = F.array(*[
        F.struct(
            F.lit(name).alias("class"),
            F.col(probabilities)[i].alias("score"),
            (F.col(label) == name).alias("is_positive"),
        )
        for i, name in enumerate(classes)
    ])
    return scored.select(F.inline(entries))


def auc_ovr(scored: DataFrame, probabilities: str, classes: list[str],
            label: str = "label") -> DataFrame:
    """Macro one-vs-rest AUC; two classes use the second, one class gives 0."""
    if len(classes) < 2:
        return scored.sparkSession.range(1).select(F.lit(0.0).alias("auc"))
    scores = one_vs_rest(scored, probabilities, classes, label)
    if len(classes) == 2:
        scores = scores.filter(F.col("class") == classes[1])
    return class_auc(scores).agg(F.avg("auc").alias("auc"))
