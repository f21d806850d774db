"""Rule baselines, evaluation, registry and prediction queries."""

from pyspark.sql import functions as F

from packetlake.operators import metrics as E
from packetlake.operators import models as M
from registry.base import query, with_tables
from registry.features import FEATURE_OUT

# Labelled scores: a true label and a predicted label per prediction row, and
# three class probabilities made from the confidence.
SCORED_SQL = """scored AS (SELECT prediction_id,
  CASE WHEN confidence > 0.6 THEN 'BENIGN' WHEN prediction_id % 5 < 2 THEN 'DOS' ELSE 'PROBE' END AS label,
  coalesce(label_code, 'BENIGN') AS prediction, CAST(confidence AS DOUBLE) AS p0,
  (1 - CAST(confidence AS DOUBLE)) * ((prediction_id % 7) / 8.0) AS p1,
  (1 - CAST(confidence AS DOUBLE)) * (1 - (prediction_id % 7) / 8.0) AS p2
  FROM predictions LEFT JOIN attack_labels ON label_id = predicted_label_id)"""
CLASS_SQL = """classes AS (SELECT class, sum(hit) AS hit, sum(predicted) AS predicted, sum(support) AS support FROM (
    SELECT label AS class, CASE WHEN label = prediction THEN 1 ELSE 0 END AS hit, 0 AS predicted, 1 AS support FROM scored
    UNION ALL SELECT prediction, 0, 1, 0 FROM scored) GROUP BY class),
  rates AS (SELECT class, CASE WHEN predicted = 0 THEN 0 ELSE hit / predicted END AS precision,
    CASE WHEN support = 0 THEN 0 ELSE hit / support END AS recall,
    CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * hit / (predicted + support) END AS f1,
    CAST(support AS BIGINT) AS support, hit FROM classes)"""
AUC_SQL = """
SELECT class, (sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0)
  / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS auc
FROM (SELECT class, pos, (rank() OVER (PARTITION BY class ORDER BY score) * 2 - 1
    + count(*) OVER (PARTITION BY class, score)) / 2.0 AS r
  FROM (SELECT 'BENIGN' AS class, label = 'BENIGN' AS pos, p0 AS score FROM scored
    UNION ALL SELECT 'DOS', label = 'DOS', p1 FROM scored UNION ALL SELECT 'PROBE', label = 'PROBE', p2 FROM scored))
GROUP BY class"""


def scored_sql(body):
    return with_tables("predictions attack_labels", f", {SCORED_SQL}, {CLASS_SQL}\n{body}")


def scored(t):
    p = F.col("confidence").cast("double")
    share = (F.col("prediction_id") % 7) / 8.0
    return t.predictions.join(
        F.broadcast(t.labels), F.col("predicted_label_id") == F.col("label_id"), "left"
    ).select(
        "prediction_id",
        F.when(F.col("confidence") > 0.6, "BENIGN")
        .when(F.col("prediction_id") % 5 < 2, "DOS").otherwise("PROBE").alias("label"),
        F.coalesce("label_code", F.lit("BENIGN")).alias("prediction"),
        F.array(p, (1 - p) * share, (1 - p) * (1 - share)).alias("probabilities"),
    )


def registry_rows(t):
    """One model version per ingestion run."""
    trained = F.col("started_at")
    return t.runs.select(
        F.concat(F.lit("v1_"), F.date_format(trained, "yyyyMMddHHmmss")).alias("version"),
        trained.alias("trained_at"),
        F.to_json(F.struct(
            (F.col("rows_inserted") / F.col("rows_received")).alias("accuracy"),
            (F.col("rows_inserted") / 1000).alias("f1"),
            (F.col("rows_rejected") / F.col("rows_received")).alias("auc_roc"),
        )).alias("metrics"),
        F.col("source_name").alias("metadata"),
    )


REGISTRY_SQL = """registry AS (SELECT 'v1_' || strftime(started_at, '%Y%m%d%H%M%S') AS version, started_at AS trained_at,
  rows_inserted / rows_received AS accuracy, rows_inserted / 1000 AS f1, rows_rejected / rows_received AS auc_roc,
  source_name AS metadata FROM runs)"""


@query("rules_classifier", with_tables("features", """
SELECT session_id, CASE WHEN total_packets >= 1000 OR total_bytes >= 5000000 THEN 'DOS'
  WHEN unique_dst_ports > 50 THEN 'PROBE' ELSE 'BENIGN' END AS predicted_label
FROM (SELECT session_id, total_packets * 200 AS total_packets, total_bytes * 1000 AS total_bytes,
  unique_dst_ports * 30 AS unique_dst_ports FROM features)"""))
def _(t):
    # Scaled up, so that every rule fires.
    busy = t.features.withColumns({
        "total_packets": F.col("total_packets") * 200,
        "total_bytes": F.col("total_bytes") * 1000,
        "unique_dst_ports": F.col("unique_dst_ports") * 30,
    })
    return M.rules_classifier(busy).select("session_id", "predicted_label")


@query("rules_score", with_tables("sessions", """
SELECT session_id, CASE WHEN dos THEN 'DOS' WHEN probe THEN 'PROBE' ELSE 'BENIGN' END AS predicted_label,
  CASE WHEN dos THEN 0.92 WHEN probe THEN 0.81 ELSE 0.15 END::DOUBLE AS confidence, 'baseline-rules-v1' AS model_version
FROM (SELECT session_id, packets >= 1000 OR bytes >= 5000000 AS dos, protocol = 'ICMP' AND packets > 300 AS probe
  FROM (SELECT session_id, protocol, packet_count * 180 AS packets, total_bytes * 1000 AS bytes FROM sessions
  WHERE protocol <> 'TCP'))"""))
def _(t):
    busy = t.sessions.withColumns({
        "packet_count": F.col("packet_count") * 180, "total_bytes": F.col("total_bytes") * 1000,
    })
    tcp = t.features.join(
        t.sessions.filter(F.col("protocol") == "TCP").select("session_id"), "session_id"
    )
    return M.rules_score(busy, tcp).drop("features")


@query("confusion_counts", scored_sql("SELECT label, prediction, count(*) AS n FROM scored GROUP BY label, prediction"))
def _(t):
    return E.confusion_counts(scored(t))


@query("confusion_matrix", scored_sql(
    "SELECT l.name AS label, " + ", ".join(
        f"count(*) FILTER (prediction = '{c}') AS {c}" for c in ("BENIGN", "DOS", "PROBE", "R2L", "U2R")
    ) + """ FROM (VALUES ('BENIGN'), ('DOS'), ('PROBE'), ('R2L'), ('U2R')) l(name)
LEFT JOIN scored ON label = name GROUP BY l.name"""))
def _(t):
    return E.confusion_matrix(E.confusion_counts(scored(t)))


@query("overall_metrics", scored_sql("""
SELECT round(sum(hit) / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision,
  round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1
FROM rates"""))
def _(t):
    return E.overall_metrics(E.confusion_counts(scored(t)))


@query("classification_report", scored_sql("""
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rates
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
  CAST(sum(support) AS BIGINT) FROM rates
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM rates"""))
def _(t):
    return E.classification_report(E.confusion_counts(scored(t)))


@query("class_auc", scored_sql(f"SELECT class, round(auc, 6) AS auc FROM ({AUC_SQL})"))
def _(t):
    return E.class_auc(E.one_vs_rest(scored(t), "probabilities", ["BENIGN", "DOS", "PROBE"]))


@query("auc_ovr", scored_sql(f"SELECT round(avg(auc), 6) AS auc FROM ({AUC_SQL})"))
def _(t):
    return E.auc_ovr(scored(t), "probabilities", ["BENIGN", "DOS", "PROBE"])


@query("register_model", with_tables("runs", f""", {REGISTRY_SQL}
SELECT version, epoch_us(max(trained_at) + INTERVAL 1 DAY) AS trained_at, 'again' AS metadata FROM registry GROUP BY version"""))
def _(t):
    rows = registry_rows(t)
    again = rows.withColumns({
        "trained_at": F.col("trained_at") + F.expr("INTERVAL 1 DAY"), "metadata": F.lit("again"),
    })
    return M.register_model(rows, again).drop("metrics")


@query("latest_version", with_tables("runs", f", {REGISTRY_SQL} SELECT max(version) AS version FROM registry"))
def _(t):
    return M.latest_version(registry_rows(t))


@query("model_registry_list", with_tables("runs", f""", {REGISTRY_SQL}
SELECT version, epoch_us(trained_at) AS trained_at, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1,
  round(auc_roc, 6) AS auc_roc FROM registry"""))
def _(t):
    return M.model_registry_list(registry_rows(t))


@query("sessions_to_score", with_tables("features predictions", f"""
SELECT {FEATURE_OUT} FROM features WHERE session_id NOT IN
  (SELECT session_id FROM predictions WHERE model_version = 'v1_b')"""))
def _(t):
    return M.sessions_to_score(t.features, t.predictions, "v1_b")


@query("upsert_predictions", with_tables("predictions", """
SELECT prediction_id, session_id, model_version, CASE WHEN model_version = 'v1_a' THEN 2 ELSE predicted_label_id END
    AS predicted_label_id,
  round(CAST(CASE WHEN model_version = 'v1_a' THEN 0.5 ELSE confidence END AS DOUBLE), 6) AS confidence,
  epoch_us(CASE WHEN model_version = 'v1_a' THEN TIMESTAMP '2024-02-01' ELSE created_at END) AS created_at
FROM predictions UNION ALL SELECT DISTINCT NULL, session_id, 'v1_c', 2, 0.5, 1706745600000000 FROM predictions"""))
def _(t):
    values = {
        "predicted_label_id": F.lit(2), "confidence": F.lit(0.5).cast("decimal(6,5)"),
        "created_at": F.lit("2024-02-01").cast("timestamp"),
    }
    again = t.predictions.filter(F.col("model_version") == "v1_a").withColumns(values)
    third = again.withColumn("model_version", F.lit("v1_c"))
    return M.upsert_predictions(t.predictions, again.unionByName(third))


@query("number_predictions", with_tables("predictions", """
SELECT session_id, model_version, (SELECT max(prediction_id) FROM predictions WHERE model_version = 'v1_a')
  + row_number() OVER (ORDER BY md5(session_id || '|' || model_version)) AS prediction_id
FROM predictions WHERE model_version = 'v1_b'
UNION ALL SELECT session_id, model_version, prediction_id FROM predictions WHERE model_version = 'v1_a'"""))
def _(t):
    known = F.when(F.col("model_version") == "v1_a", F.col("prediction_id"))
    return M.number_predictions(
        t.predictions.withColumn("prediction_id", known)
    ).select("session_id", "model_version", "prediction_id")
