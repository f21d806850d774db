"""Save and load model versions: one folder per version."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from packetlake.operators.anomaly import IsolationForest
from packetlake.operators.forest import Forest, load_forest
from packetlake.operators.models import Classifier, DetectionModel
from packetlake.operators.training import Scaler
from packetlake.schemas import FEATURE_COLS


def save_model(
    spark: SparkSession, model: DetectionModel, folder: str,
    metrics: dict[str, float] | None = None, params: dict | None = None,
    trained_at: str | None = None, drift_baseline: dict | None = None,
) -> str:
    """Write ``folder/version`` and return its path."""
    path = f"{folder}/{model.version}"
    pipeline = model.classifier.pipeline
    grown = isinstance(pipeline, Forest)
    if grown:
        pipeline.nodes.write.mode("overwrite").parquet(f"{path}/trees")
        if pipeline.packed is not None:
            pipeline.packed.write.mode("overwrite").parquet(f"{path}/packed")
    else:
        pipeline.write().overwrite().save(f"{path}/classifier")
    model.forest.node_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/forest")
    metadata = {
        "version": model.version,
        "trained_at": trained_at,
        "metrics": metrics or {},
        "params": params or {},
        "feature_cols": FEATURE_COLS,
        "drift_baseline": drift_baseline or {},
        "classes": model.classifier.classes,
        "borders": pipeline.borders if grown else None,
        "packed": grown and pipeline.packed is not None,
        "scaler": {
            "mean": model.classifier.scaler.mean, "scale": model.classifier.scaler.scale,
        },
        "forest": {"sample_rows": model.forest.sample_rows, "offset": model.forest.offset},
    }
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/metadata")
    return path


def load_model(spark: SparkSession, folder: str, version: str) -> DetectionModel:
    path = f"{folder}/{version}"
    metadata = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    scaler = Scaler(metadata["scaler"]["mean"], metadata["scaler"]["scale"])
    classes, borders = metadata["classes"], metadata.get("borders")
    if borders is None:
        pipeline = PipelineModel.load(f"{path}/classifier")
    else:
        # Models of earlier versions are packed when they are first used.
        packed = f"{path}/packed" if metadata.get("packed") else None
        pipeline = load_forest(spark, f"{path}/trees", borders, len(classes), packed)
    classifier = Classifier(pipeline, scaler, classes)
    nodes = spark.read.parquet(f"{path}/forest").toPandas()  # bounded, see anomaly
    forest = IsolationForest(
        nodes, metadata["forest"]["sample_rows"], metadata["forest"]["offset"]
    )
    return DetectionModel(metadata["version"], classifier, forest)
