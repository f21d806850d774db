"""The training job: features -> split -> models -> metrics -> registry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlake.operators import metrics as metric_ops
from packetlake.operators import models as model_ops
from packetlake.operators import training as training_ops
from packetlake.operators.anomaly import fit_isolation_forest
from packetlake.session import store_stage
from packetlake.sources.model_store import save_model


@dataclass(frozen=True)
class TrainingResult:
    model: model_ops.DetectionModel
    metrics: dict[str, float]
    report: DataFrame
    confusion: DataFrame
    importance: DataFrame
    drift_baseline: DataFrame


def train(
    spark: SparkSession, rows: DataFrame, version: str, row_id: str = "session_id",
    **forest_options,
) -> TrainingResult:
    """Fit and evaluate one model version on labelled rows."""
    split = store_stage(
        training_ops.flags_to_int(training_ops.stratified_split(rows, row_id)), "split"
    )
    part = lambda name: split.filter(F.col("split") == name)
    train_rows, test_rows = part("train"), part("test")
    scaler = training_ops.fit_scaler(train_rows)
    classifier = model_ops.fit_random_forest(train_rows, scaler, **forest_options)
    scaled = scaler.apply(model_ops.model_inputs(train_rows))
    model = model_ops.DetectionModel(
        version, classifier, fit_isolation_forest(scaled, row_id)
    )
    scored = store_stage(
        classifier.predict(test_rows).select(
            F.col("label_code").alias("label"), F.col("predicted_label").alias("prediction"),
            "probabilities",
        ),
        "test-scores",
    )
    counts = metric_ops.confusion_counts(scored)
    overall = metric_ops.overall_metrics(counts).first().asDict()
    auc = metric_ops.auc_ovr(scored, "probabilities", classifier.classes).first().auc
    return TrainingResult(
        model,
        {**overall, "auc_roc": auc},
        metric_ops.classification_report(counts),
        metric_ops.confusion_matrix(counts),
        model_ops.feature_importance(classifier, rows),
        training_ops.drift_baseline(train_rows),
    )


def registry_entry(spark: SparkSession, result: TrainingResult, trained_at: Column) -> DataFrame:
    """The registry row of a trained version."""
    baseline = F.map_from_entries(
        F.collect_list(F.struct("feature", F.struct("mean", "std")))
    )  # 17 rows
    metrics = F.struct(*[F.lit(float(v)).alias(k) for k, v in result.metrics.items()])
    return result.drift_baseline.agg(baseline.alias("drift_baseline")).select(
        F.lit(result.model.version).alias("version"),
        trained_at.alias("trained_at"),
        F.to_json(metrics).alias("metrics"),
        F.to_json(F.struct(metrics.alias("metrics"), "drift_baseline")).alias("metadata"),
    )


def save_result(spark: SparkSession, result: TrainingResult, folder: str, trained_at: str) -> str:
    baseline = {
        r.feature: {"mean": r["mean"], "std": r["std"]} for r in result.drift_baseline.collect()
    }  # 17 rows
    return save_model(
        spark, result.model, folder, result.metrics,
        {
            "numTrees": model_ops.FOREST_TREES, "maxDepth": model_ops.FOREST_DEPTH,
        },
        trained_at, baseline,
    )
