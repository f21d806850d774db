"""Label queries."""

from pyspark.sql import functions as F

from packetlake.operators import labels as L
from registry.base import query, with_tables

DISTRIBUTION = """
SELECT label_code, count(*) AS sessions FROM labeled JOIN attack_labels ON label_id = ground_truth_label_id
GROUP BY label_code"""


@query("normalize_label", with_tables("coded_labels", """
SELECT session_id, row_no, label, label_code FROM coded_labels"""))
def _(t):
    return t.raw_labels.select(
        "session_id", "row_no", "label", L.normalize_label(F.col("label")).alias("label_code")
    )


@query("label_ids", with_tables("coded_labels attack_labels", """
SELECT session_id, row_no, label_code, label_id FROM coded_labels LEFT JOIN attack_labels USING (label_code)"""))
def _(t):
    coded = t.raw_labels.select(
        "session_id", "row_no", L.normalize_label(F.col("label")).alias("label_code")
    )
    return L.label_ids(coded, t.labels)


@query("apply_labels", with_tables("labeled", "SELECT session_id, ground_truth_label_id FROM labeled"))
def _(t):
    bare = t.features.withColumn("ground_truth_label_id", F.lit(None).cast("int"))
    return L.apply_labels(bare, t.raw_labels, t.labels).select(
        "session_id", "ground_truth_label_id"
    )


@query("label_load_stats", with_tables("raw_labels sessions", """
SELECT count(s.session_id) AS updated, count(*) - count(s.session_id) AS skipped
FROM raw_labels r LEFT JOIN sessions s USING (session_id)"""))
def _(t):
    return L.label_load_stats(t.features, t.raw_labels, t.labels)


@query("class_distribution", with_tables("labeled attack_labels", f"""
SELECT label_code, sessions, round(sessions * 100.0 / sum(sessions) OVER (), 6) AS percent FROM ({DISTRIBUTION})"""))
def _(t):
    return L.class_distribution(t.labeled, t.labels)


@query("imbalance_ratio", with_tables("labeled attack_labels", f"""
SELECT round(max(sessions) / greatest(min(sessions), 1), 6) AS imbalance_ratio FROM ({DISTRIBUTION})"""))
def _(t):
    return L.imbalance_ratio(L.class_distribution(t.labeled, t.labels))
