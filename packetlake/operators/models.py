"""Rule baselines, classifiers, scoring and the model registry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlake.functions.ordered import hashed_row_number
from packetlake.operators import forest as distributed
from packetlake.operators.anomaly import IsolationForest
from packetlake.operators.labels import label_ids
from packetlake.operators.training import Scaler
from packetlake.schemas import BENIGN, FEATURE_COLS, FLAG_FEATURES

# Thresholds and confidences of the rule baselines.
DOS_PACKETS = 1000
DOS_BYTES = 5_000_000
PROBE_PORTS = 50
PROBE_ICMP_PACKETS = 300
DOS_CONFIDENCE = 0.92
PROBE_CONFIDENCE = 0.81
BENIGN_CONFIDENCE = 0.15
RULES_VERSION = "baseline-rules-v1"
# Training parameters.
FOREST_TREES = 100
FOREST_DEPTH = 20
FOREST_MIN_SPLIT = 5
CV_FOLDS = 3
LOGISTIC_ITERATIONS = 1000
# Above this, trees grow by ``operators.forest``: Spark ML keeps dense counts
# for every node in every task, and the whole forest in each of them to score.
ML_FOREST_ROWS = 20_000
SEED = 42
VERSION_PREFIX = "v1_"


def _looks_like_dos(packets: Column, total_bytes: Column) -> Column:
    return (packets >= DOS_PACKETS) | (total_bytes >= DOS_BYTES)


def rules_classifier(features: DataFrame) -> DataFrame:
    """Features with ``predicted_label`` of the rule baseline."""
    dos = _looks_like_dos(F.col("total_packets"), F.col("total_bytes"))
    return features.withColumn(
        "predicted_label",
        F.when(dos, "DOS").when(F.col("unique_dst_ports") > PROBE_PORTS, "PROBE")
        .otherwise(BENIGN),
    )


def rules_score(sessions: DataFrame, features: DataFrame) -> DataFrame:
    """Rule predictions for sessions that have no features yet."""
    packets = F.coalesce("packet_count", F.lit(0))
    dos = _looks_like_dos(packets, F.coalesce("total_bytes", F.lit(0)))
    probe = (F.upper("protocol") == "ICMP") & (packets > PROBE_ICMP_PACKETS)
    return sessions.join(features.select("session_id"), "session_id", "left_anti").select(
        "session_id",
        F.when(dos, "DOS").when(probe, "PROBE").otherwise(BENIGN).alias("predicted_label"),
        F.when(dos, DOS_CONFIDENCE).when(probe, PROBE_CONFIDENCE)
        .otherwise(BENIGN_CONFIDENCE).alias("confidence"),
        F.lit(RULES_VERSION).alias("model_version"),
        F.to_json(
            F.struct(
                "packet_count", "total_bytes", "protocol",
                F.lit("baseline_rules").alias("strategy"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("features"),
    )


@dataclass(frozen=True)
class Classifier:
    """A fitted pipeline or forest over scaled features and its class names in
    order."""

    pipeline: PipelineModel | distributed.Forest
    scaler: Scaler
    classes: list[str]

    def probabilities(self, features: DataFrame) -> DataFrame:
        """``features`` with ``probabilities`` (array, by class)."""
        # The inputs are scaled under their own names; the originals wait in
        # a struct.
        original = F.struct(*[F.col(f"`{c}`") for c in features.columns]).alias("_row")
        prepared = self.scaler.apply(model_inputs(features.select(original, *features.columns)))
        if isinstance(self.pipeline, distributed.Forest):
            return prepared.select(
                "_row", self.pipeline.probabilities().alias("probabilities")
            ).select("_row.*", "probabilities")
        return self.pipeline.transform(prepared.select("_row", *FEATURE_COLS)).select(
            "_row.*", vector_to_array("probability").alias("probabilities")
        )

    def predict(self, features: DataFrame) -> DataFrame:
        """``predicted_label`` (most probable class) and ``confidence``."""
        names = F.array(*[F.lit(c) for c in self.classes])
        best = F.array_max("probabilities")
        place = F.array_position("probabilities", best).cast("int")
        return self.probabilities(features).select(
            "*", F.element_at(names, place).alias("predicted_label"), best.alias("confidence")
        )


@dataclass(frozen=True)
class DetectionModel:
    """What one model version consists of."""

    version: str
    classifier: Classifier
    forest: IsolationForest

    def score(self, features: DataFrame) -> DataFrame:
        """``features`` with predicted_label, confidence, anomaly_score and
        is_anomaly."""
        classified = self.classifier.predict(features).drop("probabilities")
        original = F.struct(*[F.col(f"`{c}`") for c in classified.columns]).alias("_row")
        scaled = self.classifier.scaler.apply(
            model_inputs(classified.select(original, *features.columns))
        )
        return self.forest.score(scaled.select("_row", *FEATURE_COLS)).select(
            "_row.*", "anomaly_score", "is_anomaly"
        )


def model_inputs(features: DataFrame) -> DataFrame:
    """All 17 inputs as doubles; absent or null inputs count as 0."""
    return features.withColumns({
        c: F.coalesce(
            (F.col(c).cast("int") if c in FLAG_FEATURES else F.col(c)).cast("double"), F.lit(0.0)
        ) if c in features.columns else F.lit(0.0)
        for c in FEATURE_COLS
    })


def _prepare(train: DataFrame, scaler: Scaler) -> tuple[DataFrame, StringIndexer, VectorAssembler]:
    rows = scaler.apply(model_inputs(train))
    indexer = StringIndexer(
        inputCol="label_code", outputCol="label", stringOrderType="alphabetAsc"
    )
    assembler = VectorAssembler(inputCols=FEATURE_COLS, outputCol="features_vec")
    return rows, indexer, assembler


def _finish(indexer_model, stages, scaler: Scaler) -> Classifier:
    # The label indexer is not part of scoring.
    pipeline = PipelineModel(stages) if isinstance(stages, list) else stages
    return Classifier(pipeline, scaler, list(indexer_model.labels))


def fit_logistic(train: DataFrame, scaler: Scaler) -> Classifier:
    """Multinomial logistic regression with unit L2 penalty on the summed loss."""
    rows, indexer, assembler = _prepare(train, scaler)
    indexer_model = indexer.fit(rows)
    vectors = assembler.transform(indexer_model.transform(rows)).select(
        "label", "features_vec"
    ).persist()
    model = LogisticRegression(
        featuresCol="features_vec", family="multinomial", maxIter=LOGISTIC_ITERATIONS,
        standardization=False, regParam=1.0 / max(vectors.count(), 1),
    ).fit(vectors)
    vectors.unpersist()
    return _finish(indexer_model, [assembler, model], scaler)


def fit_random_forest(
    train: DataFrame, scaler: Scaler, trees: int = FOREST_TREES,
    depth: int = FOREST_DEPTH, folds: int = CV_FOLDS, parallelism: int = CV_FOLDS,
    ml_rows: int = ML_FOREST_ROWS,
) -> Classifier:
    """Random forest, checked by cross-validated weighted F1 over the grid.

    A minimum split size of 5 has no exact twin; leaves of at least 2 rows
    come closest. More than ``ml_rows`` rows are fitted by ``operators.forest``.
    """
    rows, indexer, assembler = _prepare(train, scaler)
    indexer_model = indexer.fit(rows)
    if train.count() > ml_rows:
        forest, _ = distributed.fit_forest(
            indexer_model.transform(rows), len(indexer_model.labels), trees, depth, folds,
            max(FOREST_MIN_SPLIT // 2, 1), SEED,
        )
        return _finish(indexer_model, forest, scaler)
    vectors = assembler.transform(indexer_model.transform(rows)).select(
        "label", "features_vec"
    ).persist()
    forest = RandomForestClassifier(
        featuresCol="features_vec", seed=SEED, featureSubsetStrategy="sqrt",
        minInstancesPerNode=max(FOREST_MIN_SPLIT // 2, 1),
        # Deep trees: remember each row's node, with its lineage cut in the
        # checkpoint folder, instead of walking the trees at every level.
        cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=1024,
    )
    grid = (
        ParamGridBuilder().addGrid(forest.numTrees, [trees]).addGrid(forest.maxDepth, [depth])
        .build()
    )
    search = CrossValidator(
        estimator=Pipeline(stages=[forest]), estimatorParamMaps=grid,
        evaluator=MulticlassClassificationEvaluator(metricName="f1"),
        numFolds=folds, seed=SEED, parallelism=parallelism,
    )
    best = search.fit(vectors).bestModel.stages[-1]
    vectors.unpersist()
    return _finish(indexer_model, [assembler, best], scaler)


def feature_importance(model: Classifier, df_source: DataFrame) -> DataFrame:
    """(feature, importance), largest first."""
    if isinstance(model.pipeline, distributed.Forest):
        values = model.pipeline.importances
    else:
        values = model.pipeline.stages[-1].featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip(FEATURE_COLS, values)]
    return df_source.sparkSession.createDataFrame(
        rows, "feature string, importance double"
    ).orderBy(F.desc("importance"), "feature")


# --- model registry ----------------------------------------------------------


def register_model(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """Registry after an upsert on ``version``; the newest entry wins."""
    return registry.unionByName(entries).groupBy("version").agg(
        *[F.max_by(c, "trained_at").alias(c) for c in ("metrics", "metadata")],
        F.max("trained_at").alias("trained_at"),
    ).select("version", "trained_at", "metrics", "metadata")


def latest_version(registry: DataFrame) -> DataFrame:
    """The last version in name order."""
    return registry.filter(F.col("version").startswith(VERSION_PREFIX)).agg(
        F.max("version").alias("version")
    )


def model_registry_list(registry: DataFrame) -> DataFrame:
    """Versions with their headline metrics, newest first."""
    metric = lambda name: F.get_json_object("metrics", f"$.{name}").cast("double").alias(name)
    return registry.select(
        "version", "trained_at", metric("accuracy"), metric("f1"), metric("auc_roc")
    ).orderBy(F.desc("trained_at"), F.desc("version"))


# --- predictions -------------------------------------------------------------


def sessions_to_score(features: DataFrame, predictions: DataFrame, version: str) -> DataFrame:
    """Features of sessions this model version has not scored."""
    done = predictions.filter(F.col("model_version") == version).select("session_id")
    return features.join(done, "session_id", "left_anti")


def prediction_rows(scored: DataFrame, labels: DataFrame, version: str, now: Column) -> DataFrame:
    """Rows for the predictions table from scored features.

    ``scored`` has the features, predicted_label, confidence, anomaly_score
    and is_anomaly. A label the dimension lacks gives a null id.
    """
    record = F.struct(*FEATURE_COLS, "anomaly_score", "is_anomaly")
    return label_ids(
        scored.withColumn("features", F.to_json(record)), labels, "predicted_label"
    ).select(
        "session_id",
        F.col("label_id").alias("predicted_label_id"),
        F.col("confidence").cast("decimal(6,5)").alias("confidence"),
        F.lit(version).alias("model_version"),
        "features",
        now.alias("created_at"),
    )


def batch_score(
    features: DataFrame, predictions: DataFrame, labels: DataFrame,
    model: DetectionModel, now: Column,
) -> DataFrame:
    """Prediction rows for the sessions ``model`` has not scored yet."""
    waiting = sessions_to_score(features, predictions, model.version)
    scored = model.score(waiting.select("session_id", *FEATURE_COLS))
    return prediction_rows(scored, labels, model.version, now)


def upsert_predictions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Predictions after the upsert on (session_id, model_version): a known
    pair keeps its id and takes label, confidence, features and time.

    Rows new to the table have a null prediction_id; ``number_predictions``
    assigns ids.
    """
    key = ["session_id", "model_version"]
    values = [c for c in existing.columns if c not in (*key, "prediction_id") and c in new.columns]
    old = existing.select(*key, "prediction_id", *[F.col(c).alias(f"_old_{c}") for c in values])
    fresh = new.select(*key, F.lit(True).alias("_new"), *values)
    return old.join(fresh, key, "full_outer").select(
        "prediction_id", *key,
        *[F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) for c in values],
    )


def number_predictions(predictions: DataFrame, last_id: int | None = None) -> DataFrame:
    """Ids for the rows that have none, after the highest id in use: that of
    ``predictions``, or ``last_id`` where these are only part of the table."""
    if last_id is None:
        last = predictions.agg(F.coalesce(F.max("prediction_id"), F.lit(0)).alias("m")).scalar()
    else:
        last = F.lit(last_id)
    digest = F.md5(F.concat_ws("|", F.col("session_id").cast("string"), "model_version"))
    fresh = hashed_row_number(
        predictions.filter(F.col("prediction_id").isNull()), [], digest, "_rank"
    ).withColumn("prediction_id", (last + F.col("_rank")).cast("bigint"))
    known = predictions.filter(F.col("prediction_id").isNotNull())
    return known.unionByName(fresh.select(*known.columns))
