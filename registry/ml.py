"""Fitted models. Values depend on the learner, so their queries have no SQL
text; what must hold for any learner is checked by the queries at the end."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from packetlake.operators import anomaly as N
from packetlake.operators import metrics as E
from packetlake.operators import models as M
from packetlake.operators import training as T
from packetlake.session import shared_folder, store_stage
from packetlake.sources.model_store import load_model, save_model
from packetlake.schemas import FEATURE_COLS
from registry.base import query, with_tables
from registry.training import SPLIT_SQL


class Fitted:
    """Models fitted once per input folder and shared by the queries below."""

    _by_tables: dict = {}

    def __init__(self, t):
        self.t = t
        split = T.stratified_split(T.export_labeled(t.labeled, t.labels), "session_id")
        split = store_stage(T.flags_to_int(split), "split")
        self.train = split.filter(F.col("split") == "train")
        self.test = split.filter(F.col("split") == "test")
        self.scaler = T.fit_scaler(self.train)
        self._forest = None
        self._classifier = None

    @classmethod
    def of(cls, t):
        if t not in cls._by_tables:
            cls._by_tables[t] = cls(t)
        return cls._by_tables[t]

    @property
    def classifier(self):
        if self._classifier is None:
            self._classifier = M.fit_random_forest(self.train, self.scaler)
        return self._classifier

    @property
    def forest(self):
        if self._forest is None:
            scaled = self.scaler.apply(M.model_inputs(self.train))
            self._forest = N.fit_isolation_forest(scaled, "session_id")
        return self._forest

    @property
    def model(self):
        # Neither fit keeps all cores busy throughout.
        with ThreadPoolExecutor(1) as other:
            forest = other.submit(lambda: self.forest)
            return M.DetectionModel("v1_20240201000000", self.classifier, forest.result())


@query("fit_logistic")
def _(t):
    fitted = Fitted.of(t)
    scored = M.fit_logistic(fitted.train, fitted.scaler).predict(fitted.test)
    return E.overall_metrics(E.confusion_counts(scored, "label_code", "predicted_label"))


@query("fit_random_forest")
def _(t):
    fitted = Fitted.of(t)
    scored = fitted.classifier.predict(fitted.test)
    return E.overall_metrics(E.confusion_counts(scored, "label_code", "predicted_label"))


@query("predict")
def _(t):
    return Fitted.of(t).classifier.predict(t.features).select(
        "session_id", "predicted_label", "confidence"
    )


@query("feature_importance")
def _(t):
    return M.feature_importance(Fitted.of(t).classifier, t.features)


@query("isolation_forest")
def _(t):
    return Fitted.of(t).forest.node_table(t.spark)


@query("anomaly_score")
def _(t):
    fitted = Fitted.of(t)
    scaled = fitted.scaler.apply(M.model_inputs(t.features))
    return fitted.forest.score(scaled).select("session_id", "anomaly_score", "is_anomaly")


@query("batch_score")
def _(t):
    now = F.lit("2024-02-01").cast("timestamp")
    return M.batch_score(t.features, t.predictions, t.labels, Fitted.of(t).model, now)


@query("save_and_load_model")
def _(t):
    folder = f"{shared_folder(t.spark)}/models"
    save_model(t.spark, Fitted.of(t).model, folder)
    model = load_model(t.spark, folder, "v1_20240201000000")
    return model.score(t.features).select(
        "session_id", "predicted_label", "confidence", "anomaly_score", "is_anomaly"
    )


# --- properties that hold for any fitted model ---------------------------------


TRAIN_SQL = f"SELECT label_code, count(*) AS rows FROM ({SPLIT_SQL}) WHERE split = 'train' GROUP BY label_code"


@query("logistic_calibration", with_tables("labeled attack_labels", f"""
SELECT label_code, rows, true AS mean_equals_share FROM ({TRAIN_SQL})"""))
def _(t):
    # With a free intercept the mean probability of a class is its share.
    fitted = Fitted.of(t)
    classifier = M.fit_logistic(fitted.train, fitted.scaler)
    scored = classifier.probabilities(fitted.train.select("session_id", *FEATURE_COLS))
    means = scored.agg(F.count("*").alias("total"), *[
        F.avg(F.get("probabilities", F.lit(i))).alias(f"mean{i}")
        for i in range(len(classifier.classes))
    ]).select("total", F.inline(F.array(*[
        F.struct(F.lit(name).alias("label_code"), F.col(f"mean{i}").alias("mean"))
        for i, name in enumerate(classifier.classes)
    ])))
    shares = fitted.train.groupBy("label_code").agg(F.count("*").alias("rows"))
    near = F.abs(F.col("mean") - F.col("rows") / F.col("total")) < 1e-3
    return means.join(shares, "label_code").select(
        "label_code", "rows", near.alias("mean_equals_share")
    )


def verdict_columns(classes):
    """What holds for each prediction: a label of the class list whose
    probability is not below an even share."""
    return [
        F.col("predicted_label").isin(*classes).alias("label_known"),
        F.col("confidence").between(1 / len(classes) - 1e-9, 1 + 1e-9).alias("confidence_in_range"),
    ]


@query("predict_properties", with_tables("features", """
SELECT session_id, true AS label_known, true AS confidence_in_range, true AS probabilities_sum_to_one,
  true AS confidence_is_largest FROM features"""))
def _(t):
    classifier = Fitted.of(t).classifier
    scored = classifier.predict(t.features)
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p)
    return scored.select(
        "session_id", *verdict_columns(classifier.classes),
        (F.abs(total - 1) < 1e-9).alias("probabilities_sum_to_one"),
        (F.col("confidence") == F.array_max("probabilities")).alias("confidence_is_largest"),
    )


@query("isolation_forest_properties", with_tables("labeled attack_labels", f"""
SELECT tree, true AS is_binary, least(256, (SELECT CAST(sum(rows) AS BIGINT) FROM ({TRAIN_SQL}))) AS sample_rows
FROM (SELECT unnest(range(100))::INTEGER AS tree)"""))
def _(t):
    forest = Fitted.of(t).forest
    leaves = F.count_if(F.col("feature") == N.LEAF)
    return forest.node_table(t.spark).groupBy("tree").agg(
        (F.count("*") == 2 * leaves - 1).alias("is_binary")
    ).withColumn("sample_rows", F.lit(forest.sample_rows).cast("bigint"))


@query("anomaly_share", with_tables("labeled attack_labels", f"""
SELECT CAST(sum(rows) AS BIGINT) AS train_rows, true AS share_is_contamination FROM ({TRAIN_SQL})"""))
def _(t):
    fitted = Fitted.of(t)
    scored = fitted.forest.score(fitted.scaler.apply(M.model_inputs(fitted.train)))
    below, level = F.col("below"), F.col("level")
    share = N.CONTAMINATION * (F.col("train_rows") - 1) + 1
    return scored.agg(
        F.count("*").alias("train_rows"), F.count_if("is_anomaly").alias("below"),
        # Equal scores at the offset are not below it.
        F.count_if(F.abs("anomaly_score") < 1e-12).alias("level"),
    ).select("train_rows", (
        (below <= share) & (below + level >= share - 1)
    ).alias("share_is_contamination"))


FEATURE_NAMES = ", ".join(f"'{c}'" for c in FEATURE_COLS)


@query("feature_importance_properties", f"""
SELECT unnest([{FEATURE_NAMES}]) AS feature, true AS not_negative, true AS sum_is_one""")
def _(t):
    found = M.feature_importance(Fitted.of(t).classifier, t.features)
    total = found.agg(F.sum("importance")).scalar()
    return found.select(
        "feature", (F.col("importance") >= 0).alias("not_negative"),
        (F.abs(total - 1) < 1e-6).alias("sum_is_one"),
    )


@query("save_and_load_scores", with_tables("features", "SELECT session_id, false AS changed FROM features"))
def _(t):
    model = Fitted.of(t).model
    folder = f"{shared_folder(t.spark)}/models"
    save_model(t.spark, model, folder)
    loaded = load_model(t.spark, folder, model.version)
    values = F.struct("predicted_label", "confidence", "anomaly_score", "is_anomaly")
    before = model.score(t.features).select("session_id", values.alias("before"))
    after = loaded.score(t.features).select("session_id", values.alias("after"))
    return before.join(after, "session_id").select(
        "session_id", (F.col("before") != F.col("after")).alias("changed")
    )


@query("batch_score_sessions", with_tables("features", """
SELECT session_id, 'v1_20240201000000' AS model_version, 1706745600000000 AS created_at, true AS label_known,
  true AS confidence_in_range FROM features"""))
def _(t):
    fitted = Fitted.of(t)
    now = F.lit("2024-02-01").cast("timestamp")
    rows = M.batch_score(t.features, t.predictions, t.labels, fitted.model, now)
    return rows.join(
        F.broadcast(t.labels.withColumnRenamed("label_code", "predicted_label")),
        F.col("predicted_label_id") == F.col("label_id"), "left",
    ).select(
        "session_id", "model_version", "created_at",
        *verdict_columns(fitted.classifier.classes),
    )
