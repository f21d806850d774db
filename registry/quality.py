"""Feature quality queries."""

import uuid

from pyspark.sql import functions as F

from packetlake.operators import quality as Q
from packetlake.schemas import FEATURE_COLS, NUMERIC_FEATURES
from packetlake.session import shared_folder
from packetlake.sources import writers
from registry.base import query, with_tables
from registry.labels import DISTRIBUTION

# Quality is measured on features with gaps: iat columns are unknown for
# single-packet sessions and the rates for sessions without a duration.
GAPPY_SQL = """SELECT session_id, ground_truth_label_id, """ + ", ".join(
    f"CASE WHEN total_packets > 1 THEN {c} END AS {c}" if c.startswith("iat_")
    else f"CASE WHEN duration_sec > 0 THEN {c} END AS {c}" if c.endswith("_per_sec")
    else c for c in FEATURE_COLS
) + " FROM labeled"
LONG_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM gappy" for c in NUMERIC_FEATURES
)
NULLS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 4) AS null_rate FROM gappy"
    for c in FEATURE_COLS
)
OUTLIERS_SQL = """SELECT feature, round(avg(CASE WHEN abs(v - m) > 3 * s THEN 1.0 ELSE 0.0 END), 4) AS outlier_rate
FROM long JOIN (SELECT feature, avg(v) AS m, stddev_samp(v) AS s FROM long GROUP BY feature) USING (feature)
WHERE v IS NOT NULL GROUP BY feature"""


def gappy_tables(body):
    return with_tables("labeled", f", gappy AS ({GAPPY_SQL}), long AS ({LONG_SQL})\n{body}")


def gappy(t):
    def value(name):
        if name.startswith("iat_"):
            return F.when(F.col("total_packets") > 1, F.col(name)).alias(name)
        if name.endswith("_per_sec"):
            return F.when(F.col("duration_sec") > 0, F.col(name)).alias(name)
        return F.col(name)

    return t.labeled.select(
        "session_id", "ground_truth_label_id", *[value(c) for c in FEATURE_COLS]
    )


@query("null_rates", gappy_tables(NULLS_SQL))
def _(t):
    return Q.null_rates(gappy(t))


@query("outlier_rates", gappy_tables(OUTLIERS_SQL))
def _(t):
    return Q.outlier_rates(gappy(t))


@query("feature_statistics", gappy_tables("""
SELECT feature, count(v) AS count, round(avg(v), 4) AS mean, round(coalesce(stddev_samp(v), 0), 4) AS std,
  round(min(v), 4) AS min, round(max(v), 4) AS max, round(quantile_cont(v, 0.25), 4) AS p25,
  round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS p75
FROM long GROUP BY feature"""))
def _(t):
    return Q.feature_statistics(gappy(t))


@query("completeness", gappy_tables(f"""
SELECT round(1 - avg(null_rate), 4) AS feature_completeness_score FROM ({NULLS_SQL})"""))
def _(t):
    return Q.completeness(Q.null_rates(gappy(t)))


@query("labeled_counts", with_tables("labeled", """
SELECT count(*) AS total_sessions, count(ground_truth_label_id) AS labeled_sessions,
  count(*) - count(ground_truth_label_id) AS unlabeled_sessions FROM labeled"""))
def _(t):
    return Q.labeled_counts(t.labeled)


@query("quality_flags", gappy_tables(f"""
SELECT * FROM (SELECT feature, 'null_rate' AS measure, null_rate AS rate FROM ({NULLS_SQL})
  UNION ALL SELECT feature, 'outlier_rate', outlier_rate FROM ({OUTLIERS_SQL})) WHERE rate > 0.05"""))
def _(t):
    return Q.quality_flags(Q.null_rates(gappy(t)), Q.outlier_rates(gappy(t)))


MEASURES = ("count", "mean", "std", "min", "max", "p25", "median", "p75")
COUNTS = ("total_sessions", "labeled_sessions", "unlabeled_sessions")
MAPS = ("null_rates", "outlier_rates_3sigma", "class_distribution")
STATISTICS_SQL = """SELECT feature, count(v) AS count, round(avg(v), 4) AS mean,
  round(coalesce(stddev_samp(v), 0), 4) AS std, round(min(v), 4) AS min, round(max(v), 4) AS max,
  round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS median,
  round(quantile_cont(v, 0.75), 4) AS p75 FROM long GROUP BY feature"""
REPORT_SQL = with_tables("labeled attack_labels", f""", gappy AS ({GAPPY_SQL}), long AS ({LONG_SQL}),
classes AS ({DISTRIBUTION}), stats AS ({STATISTICS_SQL}), nulls AS ({NULLS_SQL})
SELECT section, name, CAST(value AS DOUBLE) AS value FROM (
  SELECT 'summary' AS section, 'generated_at' AS name, CAST(1706745600 AS DOUBLE) AS value
  UNION ALL SELECT 'summary', 'total_sessions', count(*) FROM labeled
  UNION ALL SELECT 'summary', 'labeled_sessions', count(ground_truth_label_id) FROM labeled
  UNION ALL SELECT 'summary', 'unlabeled_sessions', count(*) - count(ground_truth_label_id) FROM labeled
  UNION ALL SELECT 'summary', 'feature_completeness_score', round(1 - avg(null_rate), 4) FROM nulls
  UNION ALL SELECT 'summary', 'class_imbalance_ratio', round(max(sessions) / greatest(min(sessions), 1), 2) FROM classes
  UNION ALL SELECT 'null_rates', feature, null_rate FROM nulls
  UNION ALL SELECT 'outlier_rates_3sigma', feature, outlier_rate FROM ({OUTLIERS_SQL})
  UNION ALL SELECT 'class_distribution', label_code, sessions FROM classes
""" + "".join(
    f"  UNION ALL SELECT 'feature_statistics', feature || '.{m}', {m} FROM stats\n" for m in MEASURES
) + ")")


def report_rows(report):
    """(section, name, value) of every figure of a report."""
    def row(section, name, value):
        return F.struct(
            F.lit(section).alias("section"), name.alias("name"), value.cast("double").alias("value")
        )

    summary = F.array(
        row("summary", F.lit("generated_at"), F.unix_seconds("generated_at")),
        *[row("summary", F.lit(c), F.col(c)) for c in
          (*COUNTS, "feature_completeness_score", "class_imbalance_ratio")],
    )
    def entries(section):
        return F.transform(F.map_entries(section), lambda e: row(section, e["key"], e["value"]))

    statistics = F.flatten(F.transform(F.map_entries("feature_statistics"), lambda e: F.array(*[
        row("feature_statistics", F.concat(e["key"], F.lit(f".{m}")), e["value"][m]) for m in MEASURES
    ])))
    return report.select(F.inline(F.concat(summary, *map(entries, MAPS), statistics)))


def report(t):
    return Q.quality_report(gappy(t), t.labels, F.lit("2024-02-01").cast("timestamp"))


@query("quality_report", REPORT_SQL)
def _(t):
    return report_rows(report(t))


@query("write_report", REPORT_SQL)
def _(t):
    made = report(t)
    folder = f"{shared_folder(t.spark)}/files/reports-{uuid.uuid4().hex}"
    path = writers.write_report(made, folder, "20240201")
    return report_rows(t.spark.read.schema(made.schema).json(path))
