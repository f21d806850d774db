import numpy as np
import pytest
from pyspark.sql import functions as F

from packetlake import schemas
from packetlake.operators import anomaly as N
from packetlake.operators import metrics as E
from packetlake.operators import models as M
from packetlake.operators import training as T
from packetlake.plans.training import registry_entry, save_result, train
from packetlake.schemas import FEATURE_COLS, FLAG_FEATURES
from packetlake.sources import readers
from packetlake.sources.model_store import load_model

# A published 13-class confusion matrix (rows true, columns
# predicted, labels sorted) with 82,036 rows and accuracy 0.925825.
MATRIX = """
63211 1 0 212 0 8 5 45 1 0 0 91 0
7 2058 0 0 0 0 0 0 0 0 0 0 0
1 0 2 0 0 0 0 0 0 0 0 0 0
10 0 0 4870 0 0 0 49 0 0 0 0 0
0 0 0 0 13 0 0 0 0 0 0 0 0
11 0 0 0 0 1048 12 0 0 0 0 0 0
1 0 0 0 0 36 248 2 0 0 0 0 0
175 0 0 1993 0 0 0 1140 0 0 0 0 0
0 0 0 0 0 0 0 0 529 0 479 0 0
1 0 0 0 0 0 0 0 0 84 0 0 0
0 0 0 0 0 0 0 0 149 0 1247 0 0
2788 2 0 5 0 0 0 1 0 0 0 149 0
0 0 0 0 0 0 0 0 0 0 0 0 1352
"""


def labeled(spark, n=600):
    """Two separable classes with a little noise."""
    x = F.col("id") % 2
    noise = (F.col("id") * 7919 % 101) / 101
    return spark.range(n).select(
        F.col("id").alias("session_id"),
        *[
            (x == 1 if c in FLAG_FEATURES else 10 * x + noise).alias(c) for c in FEATURE_COLS
        ],
        F.when(x == 1, "DOS").otherwise("BENIGN").alias("label_code"),
    )


@pytest.fixture(scope="module")
def counts(spark):
    cells = [
        (f"c{i:02d}", f"c{j:02d}", int(n))
        for i, line in enumerate(MATRIX.strip().splitlines())
        for j, n in enumerate(line.split()) if n != "0"
    ]
    return spark.createDataFrame(cells, "label string, prediction string, n long")


def test_published_matrix(counts):
    row = E.overall_metrics(counts).first()
    assert round(row.accuracy, 4) == 0.9258 and round(row.f1, 4) == 0.9071
    assert round(row.precision, 4) == 0.9212 and round(row.recall, 4) == 0.9258


def test_published_report(counts):
    rows = {r["class"]: r for r in E.classification_report(counts).collect()}
    macro, weak = rows["macro avg"], rows["c11"]
    assert [round(macro[c], 2) for c in ("precision", "recall", "f1")] == [0.89, 0.79, 0.81]
    assert macro.support == rows["weighted avg"].support == 82036
    assert (round(weak.recall, 2), round(weak.f1, 2), weak.support) == (0.05, 0.09, 2945)


def test_matrix_layout(counts):
    out = E.confusion_matrix(counts)
    assert out.columns == ["label"] + [f"c{i:02d}" for i in range(13)]
    assert [list(r)[1:] for r in out.collect()] == [
        [int(n) for n in line.split()] for line in MATRIX.strip().splitlines()
    ]


def test_auc_against_pair_counting(spark):
    rng = np.random.default_rng(3)
    score = np.round(rng.random(400), 2)
    positive = rng.random(400) < 0.3 + 0.4 * score
    df = spark.createDataFrame(
        [("a", float(s), bool(p)) for s, p in zip(score, positive)],
        "class string, score double, is_positive boolean",
    )
    wins = [
        1.0 if p > n else 0.5 if p == n else 0.0
        for p in score[positive] for n in score[~positive]
    ]
    assert E.class_auc(df).first().auc == pytest.approx(np.mean(wins))


def test_auc_of_one_class_is_zero(spark):
    df = spark.createDataFrame([("A", [1.0])], "label string, p array<double>")
    assert E.auc_ovr(df, "p", ["A"]).first().auc == 0.0


def test_split_is_exact_disjoint_and_complete(spark):
    rows = spark.range(1000).select(
        F.col("id").alias("session_id"),
        F.when(F.col("id") < 800, "A").otherwise("B").alias("label_code"),
    )
    out = T.stratified_split(rows, "session_id")
    sizes = {(r.label_code, r.split): r["count"] for r in out.groupBy("label_code", "split").count().collect()}
    assert sizes == {
        ("A", "train"): 560, ("A", "val"): 120, ("A", "test"): 120,
        ("B", "train"): 140, ("B", "val"): 30, ("B", "test"): 30,
    }
    assert out.select("session_id").distinct().count() == 1000


def test_scaler_uses_the_population(spark):
    rows = labeled(spark).withColumn("iat_min", F.lit(4.0))
    scaler = T.fit_scaler(T.flags_to_int(rows))
    values = np.array([r.duration_sec for r in rows.select("duration_sec").collect()])
    assert scaler.scale["duration_sec"] == pytest.approx(values.std())
    assert scaler.scale["iat_min"] == 1.0
    out = scaler.apply(T.flags_to_int(rows)).agg(F.avg("duration_sec"), F.max("iat_min")).first()
    assert out[0] == pytest.approx(0, abs=1e-9) and out[1] == 0.0


def test_flow_files(spark, tmp_path):
    names = list(T.FLOW_COLUMNS)
    good = ["2000000", "10", "0", "3", "1"] + ["1"] * 12 + ["Benign"]
    lines = [",".join(["Extra"] + names)]
    lines += [",".join(["x"] + good), ",".join(["x"] + names)]
    lines += [",".join(["x"] + good[:5] + [bad] + good[6:]) for bad in ("Infinity", "NaN", "")]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text("\n".join(lines[:2]) + "\n")
    # Another column order, and a file that is no flow export.
    (tmp_path / "c.csv").write_text(
        ",".join(reversed(names)) + "\n" + ",".join(reversed(good)) + "\n"
    )
    (tmp_path / "d.csv").write_text("some,thing\n1,2\n")
    (tmp_path / "e.csv").write_text("")
    raw = readers.read_flow_csvs(spark, str(tmp_path / "*.csv"))
    assert set(raw.columns) == {"source_file", *names}
    rows = T.process_flows(raw, "source_file").collect()
    assert sorted(r.source_file for r in rows) == ["a.csv", "b.csv", "c.csv"]
    for row in rows:
        assert (row.duration_sec, row.total_bytes, row.total_packets) == (2.0, 10.0, 4.0)
        assert row.fwd_bwd_byte_ratio == 10.0 and row.label_code == "BENIGN"


def test_sample_is_exact_and_repeats(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2500, "big.csv").otherwise("s.csv").alias("f"))
    digest = F.md5(F.col("id").cast("string"))
    pick = lambda: T.sample_per_file(rows, "f", digest, 600, {"s.csv": 100})
    out = pick()
    assert {r.f: r["count"] for r in out.groupBy("f").count().collect()} == {"big.csv": 600, "s.csv": 100}
    assert {r.id for r in out.collect()} == {r.id for r in pick().collect()}


def test_rare_classes_go(spark):
    rows = spark.createDataFrame([("A",)] * 12 + [("B",)] * 9, "label_code string")
    assert {r.label_code for r in T.drop_rare_classes(rows).collect()} == {"A"}


def test_rules(spark):
    rows = spark.createDataFrame(
        [(1000, 0, 0), (1, 5_000_000, 99), (1, 1, 51), (1, 1, 50)],
        "total_packets long, total_bytes long, unique_dst_ports int",
    )
    got = [r.predicted_label for r in M.rules_classifier(rows).collect()]
    assert got == ["DOS", "DOS", "PROBE", "BENIGN"]


def test_rules_score_skips_sessions_with_features(spark):
    sessions = spark.createDataFrame(
        [(1, 1000, 1, "tcp"), (2, 301, 1, "icmp"), (3, None, None, "udp"), (4, 5000, 1, "tcp")],
        "session_id long, packet_count long, total_bytes long, protocol string",
    )
    done = spark.createDataFrame([(4,)], "session_id long")
    got = {r.session_id: (r.predicted_label, r.confidence) for r in M.rules_score(sessions, done).collect()}
    assert got == {1: ("DOS", 0.92), 2: ("PROBE", 0.81), 3: ("BENIGN", 0.15)}


def test_average_path():
    assert [N.average_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert N.average_path(256) == pytest.approx(10.244, abs=1e-3)


def test_isolation_forest_finds_the_stranger(spark):
    rows = T.flags_to_int(labeled(spark)).filter("session_id % 2 = 0")
    odd = rows.limit(1).withColumns(
        {"session_id": F.lit(-1).cast("bigint"), **{c: F.lit(500.0) for c in FEATURE_COLS[:14]}}
    )
    both = rows.unionByName(odd)
    scaled = T.fit_scaler(both).apply(both)
    forest = N.fit_isolation_forest(scaled, "session_id", trees=20, sample_rows=64)
    out = forest.score(scaled)
    assert out.orderBy("anomaly_score").first().session_id == -1
    share = out.filter("is_anomaly").count() / out.count()
    assert 0 < share <= 0.06
    again = N.fit_isolation_forest(scaled, "session_id", trees=20, sample_rows=64)
    assert again.offset == forest.offset


def test_every_tree_gets_its_sample(spark):
    rows = spark.range(2000).select(F.col("id").alias("session_id"))
    own = N.tree_samples(rows, "session_id", 10, 100, 1)
    assert {r["count"] for r in own.groupBy("tree").count().collect()} == {100}
    # A tree draws no row twice, whatever the other trees draw.
    assert own.distinct().count() == 1000
    shared = N.tree_samples(rows, "session_id", 10, 300, 1)
    assert {r["count"] for r in shared.groupBy("tree").count().collect()} == {300}


def test_logistic_regression(spark):
    rows = T.flags_to_int(labeled(spark))
    model = M.fit_logistic(rows, T.fit_scaler(rows))
    scored = model.predict(rows)
    assert scored.filter("predicted_label <> label_code").count() == 0
    assert scored.agg(F.min("confidence")).first()[0] > 0.5


def test_training_job_and_store(spark, tmp_path):
    rows = labeled(spark)
    result = train(spark, rows, "v1_20260101000000", trees=5, depth=4, folds=2)
    assert result.metrics["accuracy"] == 1.0 and result.metrics["auc_roc"] == 1.0
    assert result.importance.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    save_result(spark, result, str(tmp_path), "2026-01-01T00:00:00+00:00")
    again = load_model(spark, str(tmp_path), "v1_20260101000000")
    columns = ["session_id", "predicted_label", "confidence", "anomaly_score"]
    key = lambda model: sorted(map(tuple, model.score(rows).select(*columns).collect()))
    assert key(again) == key(result.model)

    empty = spark.createDataFrame(
        [], "version string, trained_at timestamp, metrics string, metadata string"
    )
    at = lambda text: F.lit(text).cast("timestamp")
    registry = M.register_model(empty, registry_entry(spark, result, at("2026-01-01")))
    registry = M.register_model(registry, registry_entry(spark, result, at("2026-01-02")))
    assert M.latest_version(registry).first().version == "v1_20260101000000"
    (listed,) = M.model_registry_list(registry).collect()
    assert listed.accuracy == 1.0 and listed.trained_at.day == 2

    labels = schemas.attack_labels(spark)
    none = spark.createDataFrame([], schemas.PREDICTIONS_SCHEMA)
    scored = M.batch_score(rows.drop("label_code"), none, labels, result.model, at("2026-01-03"))
    stored = M.number_predictions(M.upsert_predictions(none, scored))
    assert sorted(r.prediction_id for r in stored.collect()) == list(range(1, 601))
    assert {r.predicted_label_id for r in stored.collect()} == {1, 2}
    assert '"is_anomaly":' in stored.first().features
    assert M.batch_score(rows, stored, labels, result.model, at("2026-01-04")).count() == 0
