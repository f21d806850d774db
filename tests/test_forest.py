"""The forest of operators.forest: branches grown by single tasks equal those
split by shared counts, and scores, importances and stored models are whole."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from packetlake.operators import anomaly
from packetlake.operators import forest as D
from packetlake.operators import models as M
from packetlake.operators import training as T
from packetlake.operators.anomaly import fit_isolation_forest
from packetlake.schemas import FEATURE_COLS
from packetlake.sources.model_store import load_model, save_model

LABELS = ["BENIGN", "DOS", "PROBE"]


def rows(spark, count=600):
    draw = np.random.default_rng(5).normal(size=(count, len(FEATURE_COLS))).round(2)
    kind = (draw[:, 0] > 0.3).astype(int) + (draw[:, 3] > 0)
    return spark.createDataFrame(
        [(k, LABELS[kind[k]], *map(float, draw[k])) for k in range(count)],
        "session_id bigint, label_code string, " + ", ".join(f"{c} double" for c in FEATURE_COLS),
    )


def nodes_of(forest):
    found = {}
    for row in forest.nodes.collect():
        found.setdefault(row["tree"], []).append(np.frombuffer(row["nodes"], D.node_type(forest.classes)))
    return {
        t: sorted((*n[:4], tuple(n[4].tolist())) for n in np.concatenate(parts).tolist())
        for t, parts in found.items()
    }


def test_wide_and_narrow_nodes_grow_the_same_trees(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows(spark).withColumn("label", F.col("session_id") % 3).write.parquet(path)
    vectors = spark.read.parquet(path)
    narrow, scores = D.fit_forest(vectors, 3, 4, 8, 2, 2, 42)
    wide, again = D.fit_forest(vectors, 3, 4, 8, 2, 2, 42, task_rows=40)
    assert nodes_of(narrow) == nodes_of(wide) and scores == again
    for nodes in nodes_of(narrow).values():
        ids = {n[0]: n for n in nodes}
        for ident, feature, _, _, counts in nodes:
            assert (feature < 0) == (2 * ident not in ids) == (2 * ident + 1 not in ids)
            if feature >= 0:  # no row is lost on the way down, none of 8 levels exceeded
                assert np.array_equal(counts, np.add(ids[2 * ident][4], ids[2 * ident + 1][4]))
                assert min(sum(ids[2 * ident][4]), sum(ids[2 * ident + 1][4])) >= 2
            assert ident < 2 ** 9


def test_large_fits_classify_and_are_stored(spark, tmp_path):
    train = rows(spark)
    scaler = T.fit_scaler(train)
    classifier = M.fit_random_forest(train, scaler, trees=12, depth=8, folds=2, ml_rows=0)
    assert isinstance(classifier.pipeline, D.Forest)
    scored = classifier.predict(train).collect()
    assert len(scored) == 600 and all(abs(sum(r["probabilities"]) - 1) < 1e-9 for r in scored)
    assert sum(r["label_code"] == r["predicted_label"] for r in scored) > 570
    shares = {r["feature"]: r["importance"] for r in M.feature_importance(classifier, train).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9
    assert set(sorted(shares, key=shares.get)[-2:]) == {FEATURE_COLS[0], FEATURE_COLS[3]}
    trees = fit_isolation_forest(scaler.apply(M.model_inputs(train)), "session_id", 3, 16)
    model = M.DetectionModel("v1_a", classifier, trees)
    save_model(spark, model, str(tmp_path))
    loaded = load_model(spark, str(tmp_path), "v1_a")
    columns = ["session_id", "predicted_label", "confidence", "anomaly_score"]
    assert sorted(model.score(train).select(columns).collect()) == sorted(loaded.score(train).select(columns).collect())


def test_cross_validation_scores_rows_left_out(spark):
    labelled = rows(spark).withColumn("label", F.when(F.col(FEATURE_COLS[0]) > 0.3, 1).otherwise(0))
    assert min(D.fit_forest(labelled, 2, 8, 6, 3, 2, 42)[1]) > 0.85
    chance = labelled.withColumn("label", F.pmod(F.xxhash64("session_id"), F.lit(2)))
    assert all(0.3 < score < 0.7 for score in D.fit_forest(chance, 2, 8, 6, 3, 2, 42)[1])
    assert abs(D.weighted_f1({(0, 0): 3, (0, 1): 1, (1, 1): 4}, 2) - (6 / 7 + 8 / 9) / 2) < 1e-12


def test_draws_are_poisson_and_differ_by_tree():
    ids = np.arange(100_000)
    one, other = D.drawn(ids, 42, 0), D.drawn(ids, 42, 1)
    assert abs(one.mean() - 1) < 0.02 and abs(one.var() - 1) < 0.03
    assert abs(np.corrcoef(one, other)[0, 1]) < 0.02
    tried = D.tried_features(ids[1:1000], 42, 0)
    assert all(len(set(t)) == 5 for t in tried.tolist())
    assert np.ptp(np.bincount(tried.ravel(), minlength=17)) < 120


def test_counted_and_sorted_nodes_give_the_same_cuts(monkeypatch):
    random = np.random.default_rng(3)
    packed = np.zeros(5000, D._ROW)
    packed["bins"] = random.integers(0, 32, (5000, len(FEATURE_COLS)))
    packed["label"] = (packed["bins"][:, 0] > 11) + random.integers(0, 2, 5000)
    packed["weight"] = random.integers(1, 4, 5000)
    grown = []
    for cells in (0, D.DENSE_CELLS, 10**6):  # always sorted, either, always counted
        monkeypatch.setattr(D, "DENSE_CELLS", cells)
        grown.append(D.grow_branch(1, packed, 42, 0, 3, 20, 2).tobytes())
    assert grown[0] == grown[1] == grown[2]


def test_fits_are_scored_one_after_the_other(spark, monkeypatch):
    # A worker holds the trees of one fit: those of the one before are gone.
    held, most = set(), []
    load = D.Forest._loaded.func

    def loaded(forest):
        trees, shares = load(forest)
        for tree in trees:
            held.add(tree)
            tree.destroy = lambda t=tree, end=tree.destroy: (held.discard(t), end())
        most.append(len(held))
        return trees, shares

    monkeypatch.setattr(D.Forest, "_loaded", property(loaded))
    labelled = rows(spark).withColumn("label", F.col("session_id") % 2)
    scores = D.fit_forest(labelled, 2, 4, 4, 3, 2, 42)[1]
    assert len(scores) == 3 and most == [4, 4, 4]


def deep_tree(classes=5, count=20_000):
    """The nodes of a deep tree of leaves of few rows, and the rows' bins."""
    random = np.random.default_rng(8)
    packed = np.zeros(count, D._ROW)
    packed["bins"] = random.integers(0, 32, (count, len(FEATURE_COLS)))
    packed["label"], packed["weight"] = random.integers(0, classes, count), 1
    return D.grow_branch(1, packed, 42, 0, classes, 20, 2), packed["bins"].copy()


def test_a_scoring_worker_holds_few_bytes_a_node():
    # All trees of a fit are in each worker; 16 bytes a node filled executors.
    nodes, bins = deep_tree()
    packed = D.scoring_arrays(nodes)
    assert len(nodes) > 5000 and sum(a.nbytes for a in packed) < 5 * len(nodes)
    by_number = {int(n["id"]): n for n in nodes}
    found = D.mean_shares([packed], bins[:300], 5)
    for row, shares in zip(bins[:300], found, strict=True):
        node = by_number[1]
        while node["feature"] >= 0:
            node = by_number[2 * int(node["id"]) + int(row[node["feature"]] > node["cut"])]
        assert np.allclose(shares, node["counts"] / node["counts"].sum(), atol=1e-6)
    same = np.zeros(3, D._ROW)
    same["weight"] = 1
    alone = D.grow_branch(1, same, 42, 0, 5, 20, 2)  # one leaf
    assert D.mean_shares([D.scoring_arrays(alone)], bins[:2], 5).tolist() == [[1, 0, 0, 0, 0]] * 2


def test_scores_do_not_depend_on_batches(spark, monkeypatch):
    train = rows(spark).withColumn("label", F.col("session_id") % 3)
    forest, _ = D.fit_forest(train, 3, 4, 8, 0, 2, 42)
    scored = lambda: {r[0]: r[1] for r in train.coalesce(1).select(
        "session_id", forest.probabilities()).collect()}
    whole = scored()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "37")
        for block in (1, 100, 10**6):
            monkeypatch.setattr(D, "BLOCK_ROWS", block)
            assert scored() == whole
    finally:
        spark.conf.set(key, before)


def test_bins_of_live_rows_stay_in_place():
    # Copying the bins of all live rows twice a level was half of the time.
    taken = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            taken.append(key)
            return super().__getitem__(key)

    packed = np.zeros(2000, D._ROW)
    packed["bins"] = np.random.default_rng(4).integers(0, 32, (2000, len(FEATURE_COLS)))
    packed["label"], packed["weight"] = packed["bins"][:, 0] % 3, 1

    class Rows(dict):
        def __len__(self):
            return 2000

    watched = Rows({name: packed[name] for name in ("label", "weight")}, bins=packed["bins"].view(Watched))
    grown = D.grow_branch(1, watched, 42, 0, 3, 20, 2)
    assert not taken and grown.tobytes() == D.grow_branch(1, packed, 42, 0, 3, 20, 2).tobytes()


def test_fits_have_folders_and_loaded_trees_are_not_packed_again(spark, tmp_path, monkeypatch):
    train = rows(spark)
    scaler = T.fit_scaler(train)
    classifier = M.fit_random_forest(train, scaler, trees=4, depth=6, folds=2, ml_rows=0)
    for table in (classifier.pipeline.nodes, classifier.pipeline.packed):
        files = [r[0] for r in table.select(F.input_file_name()).distinct().collect()]
        assert files and all("/fit=0/" in file for file in files)
        assert {r["tree"] for r in table.select("tree").collect()} == {0, 1, 2, 3}
    trees = fit_isolation_forest(scaler.apply(M.model_inputs(train)), "session_id", 3, 16)
    save_model(spark, M.DetectionModel("v1_p", classifier, trees), str(tmp_path))
    monkeypatch.setattr(D, "packed_trees", None)
    loaded = load_model(spark, str(tmp_path), "v1_p").classifier
    found = [
        sorted(c.probabilities(train).select("session_id", "probabilities").collect())
        for c in (classifier, loaded)
    ]
    assert found[0] == found[1]


def test_the_offset_reads_stored_scores(spark, monkeypatch):
    plans = []
    quantiles = anomaly.exact_quantiles

    def noted(scores, *rest):
        plans.append(scores._jdf.queryExecution().optimizedPlan().toString())
        return quantiles(scores, *rest)

    monkeypatch.setattr(anomaly, "exact_quantiles", noted)
    fit_isolation_forest(rows(spark), "session_id", 3, 16)
    assert plans and not any("Python" in plan for plan in plans)


def test_equal_rows_are_counted_once(monkeypatch):
    draw = np.random.default_rng(3)
    rows = draw.integers(0, 2, (5000, 18)).astype(np.uint8)
    rows[:, 6:] = 0
    for mixed in (D.mix, lambda values: values & np.uint64(1)):  # also where digests meet
        monkeypatch.setattr(D, "mix", mixed)
        first, place = D.distinct(rows)
        assert len(first) == 64 and (rows[first][place] == rows).all()
    monkeypatch.undo()
    # Blocks are large, so that equal rows meet in one.
    count = 200_000
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(count)), pa.array(np.zeros(count, np.int32)), pa.array([bytes(17)] * count, pa.binary())],
        ["row", "label", "bins"],
    )
    pieces = [batch.slice(at, 10_000) for at in range(0, count, 10_000)]
    (numbers, bins, label, place), = D._blocks(iter(pieces))
    assert len(numbers) == count and len(bins) == len(label) == 1 and not place.any()
    # And those of several blocks meet where a branch grows.
    drawn = np.zeros(3000, D._ROW)
    drawn["bins"], drawn["label"], drawn["weight"] = rows[:3000, :17], rows[:3000, 17], 1 + np.arange(3000) % 3
    fewer = D._collapsed(drawn)
    assert len(fewer) == 64 and fewer["weight"].sum() == drawn["weight"].sum()
    assert (D.grow_branch(1, fewer, 42, 0, 2, 6, 2) == D.grow_branch(1, drawn, 42, 0, 2, 6, 2)).all()


def test_draws_follow_the_poisson_distribution_exactly():
    rows = np.arange(100_000)
    share = (D._salted(rows, 42, 1, 7) >> np.uint64(11)) * 2.0 ** -53
    assert (D.drawn(rows, 42, 7) == np.searchsorted(D._DRAWS, share, side="right")).all()


def test_isolation_paths_equal_those_walked_one_by_one():
    draw = np.random.default_rng(2)
    sample = draw.normal(size=(64, len(FEATURE_COLS))).round(1)
    values = draw.normal(size=(5000, len(FEATURE_COLS))).round(1)
    values[0, 3], values[1], values[2], values[3] = np.nan, np.nan, np.inf, -np.inf
    found = [anomaly.grow_tree(k, sample[:1 + 9 * k], 42) for k in range(8)]
    total = np.zeros(len(values))
    for tree in found:
        nodes = tree.to_dict("records")
        for i, row in enumerate(values[:400]):
            node = nodes[0]
            while node["feature"] != anomaly.LEAF:
                node = nodes[int(node["left" if row[int(node["feature"])] <= node["threshold"] else "right"])]
            total[i] += node["path"]
    packed = [anomaly._packed(tree) for tree in found]
    assert [tree[0] for tree in packed][0] == 0
    assert (anomaly._path_lengths(packed, values)[:400] == total[:400]).all()
    assert anomaly._path_lengths(packed, values[:0]).shape == (0,)
