import pytest
from pyspark.sql import functions as F

from packetlake import schemas
from packetlake.operators import labels as L
from packetlake.operators import quality as Q
from packetlake.schemas import FEATURE_COLS
from packetlake.sources import readers, writers


def features(spark, rows):
    """Feature rows with one varying value each."""
    df = spark.createDataFrame(rows, "session_id long, v double, ground_truth_label_id int")
    return df.select(
        "session_id", "ground_truth_label_id",
        *[(F.col("v").cast("boolean") if c.startswith("has_") else F.col("v")).alias(c)
          for c in FEATURE_COLS],
    )


@pytest.mark.parametrize("text, code", [
    (" DDoS ", "DOS"), ("Web Attack – XSS", "R2L"), ("benign", "BENIGN"), ("Probe", "PROBE"),
    ("r2l", "R2L"), ("never heard of", "BENIGN"), (None, "BENIGN"), ("", "BENIGN"),
])
def test_normalize_label(spark, text, code):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(L.normalize_label(F.col("t")).alias("c")).first().c == code


def test_labels_csv_last_row_wins(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text(" Session_ID , LABEL\n1,bot\n2,ddos\n1,benign\n9,probe\n")
    raw = readers.read_labels_csv(spark, str(path))
    labels = schemas.attack_labels(spark)
    table = features(spark, [(1, 0.0, None), (2, 0.0, None), (3, 0.0, 5)])
    got = {r.session_id: r.ground_truth_label_id for r in L.apply_labels(table, raw, labels).collect()}
    assert got == {1: 1, 2: 2, 3: 5}
    stats = L.label_load_stats(table, raw, labels).first()
    assert (stats.updated, stats.skipped) == (3, 1)


def test_labels_csv_needs_its_columns(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text("id,label\n1,bot\n")
    with pytest.raises(ValueError, match="session_id"):
        readers.read_labels_csv(spark, str(path))


def test_distribution_and_imbalance(spark):
    table = features(spark, [(i, 0.0, 1 if i < 6 else 2) for i in range(8)])
    classes = L.class_distribution(table, schemas.attack_labels(spark))
    assert [(r.label_code, r.sessions, r.percent) for r in classes.collect()] == [
        ("BENIGN", 6, 75.0), ("DOS", 2, 25.0)
    ]
    assert L.imbalance_ratio(classes).first()[0] == 3.0
    assert L.imbalance_ratio(classes.limit(1)).first()[0] is None


def test_quality_of_gaps_and_outliers(spark):
    rows = [(i, 1.0, None) for i in range(19)] + [(19, 100.0, 2)] + [(20, None, None)]
    table = features(spark, rows)
    nulls = {r.feature: r.null_rate for r in Q.null_rates(table).collect()}
    assert set(nulls) == set(FEATURE_COLS) and set(nulls.values()) == {0.0476}
    outliers = {r.feature: r.outlier_rate for r in Q.outlier_rates(table).collect()}
    assert set(outliers.values()) == {0.05}
    flagged = Q.quality_flags(Q.null_rates(table), Q.outlier_rates(table))
    assert flagged.count() == 0
    assert Q.completeness(Q.null_rates(table)).first()[0] == 0.9524


def test_constant_feature_has_no_outliers(spark):
    table = features(spark, [(i, 2.0, None) for i in range(5)])
    assert {r.outlier_rate for r in Q.outlier_rates(table).collect()} == {0.0}


def test_report_is_one_record(spark, tmp_path):
    table = features(spark, [(i, float(i), 1 + i % 2) for i in range(9)])
    report = Q.quality_report(
        table, schemas.attack_labels(spark), F.lit("2026-01-01").cast("timestamp")
    )
    path = writers.write_report(report, str(tmp_path), "20260101T000000Z")
    (row,) = spark.read.json(path).collect()
    assert row.total_sessions == 9 and row.labeled_sessions == 9
    assert row.feature_completeness_score == 1.0
    assert row.feature_statistics.total_bytes.median == 4.0
    assert row.class_distribution.BENIGN == 5 and row.class_imbalance_ratio == 1.25


def test_empty_table(spark):
    table = features(spark, [])
    assert {r.null_rate for r in Q.null_rates(table).collect()} == {0.0}
    assert {r.outlier_rate for r in Q.outlier_rates(table).collect()} == {0.0}
    assert Q.feature_statistics(table).count() == 0
