import math

import numpy as np
import pytest

from packetlake.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, x string, n int, component string"


def triangles():
    draw = np.random.default_rng(0)
    turn = np.linalg.qr(draw.normal(size=(40, 40)))[0]
    return {
        "tall": draw.normal(size=(500, 40)),
        "wide": draw.normal(size=(12, 40)),
        "graded": draw.normal(size=(100, 40)) * 10.0 ** -np.arange(0, 10, 0.25),
        "identity": np.eye(40),
        "copies": np.diag(np.repeat([4.0, 3, 2, 1], 10)) @ turn,
        "close": np.diag(1 + 1e-7 * np.arange(40)) @ turn,
        "tiny": np.diag(np.repeat([3, 2, 1, 1e-9], 10)) @ turn,
        "low rank": draw.normal(size=(90, 3)) @ draw.normal(size=(3, 40)),
        "one": draw.normal(size=(7, 1)),
        "zero": np.zeros((5, 6)),
    }


@pytest.mark.parametrize("name", triangles())
def test_singular_pairs(name):
    rows = triangles()[name]
    d = rows.shape[1]
    r = np.zeros((d, d))
    found = np.linalg.qr(rows, mode="r")
    r[:len(found)] = found
    values, vectors = whitening.right_singular_pairs(r)
    want = np.zeros(d)
    exact = np.linalg.svd(rows, compute_uv=False)
    want[:len(exact)] = exact
    top = max(want[0], 1e-300)
    assert np.abs(np.sqrt(values) - want).max() <= 1e-13 * top
    assert np.abs(vectors @ vectors.T - np.eye(d)).max() < 1e-10
    assert np.abs(rows.T @ (rows @ vectors.T) - vectors.T * values).max() <= 1e-12 * top**2


def test_qd_is_accurate_for_small_values():
    diagonal, above = 10.0 ** -np.arange(0.0, 12), 0.3 * 10.0 ** -np.arange(0.0, 11)
    values = np.sqrt(whitening.squared_singular_values(diagonal, above))
    # The inverse of a bidiagonal matrix is exact to the last digits by substitution.
    inverse = np.linalg.inv(np.diag(diagonal) + np.diag(above, 1))
    least = 1 / np.linalg.svd(inverse, compute_uv=False)[0]
    assert values[-1] == pytest.approx(least, rel=1e-12)
    assert np.prod(values) == pytest.approx(np.prod(diagonal), rel=1e-11)


def vectors_of(spark):
    draw = np.random.default_rng(1)
    mixed = draw.normal(size=(300, 20)) @ draw.normal(size=(20, 20))
    rows = [(k, v.tolist()) for k, v in enumerate(mixed)]
    rows += [(1000 + k, rows[7][1]) for k in range(200)] + [(3, rows[3][1])] * 2
    rows += [
        (None, rows[5][1]), (900, None), (901, [None] * 20), (902, [math.nan] * 20),
        (903, [math.inf] + [0.0] * 19), (904, [1.0, 2.0]), (905, []),
    ]
    return rows, spark.createDataFrame([(*r, "a", 1, "b") for r in rows], SCHEMA).repartition(9)


def usable(rows):
    for vec_id, v in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            v = np.array([*v, *[0.0] * (20 - len(v))], np.float32).astype(float)
            yield vec_id, np.floor(64 * v).astype(np.int64) + 1_000_000


def test_whitening_against_dense_algebra(spark):
    rows, df = vectors_of(spark)
    kept = list(usable(rows))
    fit = np.array(sorted({tuple(x) for _, x in kept}), np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit - sums // n) - (sums % n) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:16], basis[:, ::-1][:, :16]
    got = {}
    for r in whitening.whiten(df).collect():
        assert r["n"] == n and r["identity_error"] < 1e-9
        got.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    want = {}
    for vec_id, x in kept:
        deviation = sum((n * int(v) - int(s)) ** 2 for v, s in zip(x, sums, strict=True))
        want.setdefault((vec_id, deviation), []).append(x)
    assert got.keys() == want.keys()
    signs = None
    for key, found in sorted(got.items(), key=str):
        found.sort(key=lambda r: r["component"])
        copies = len(want[key])
        assert [r["component"] for r in found] == [c for c in range(1, 17) for _ in range(copies)]
        y = np.array([r["whitened"] for r in found[::copies]])
        x = (want[key][0] - sums // n) - (sums % n) / n
        exact = x @ basis / np.sqrt(values)
        signs = np.sign(exact * y) if signs is None else signs
        assert np.allclose(y * signs, exact, atol=1e-8)
        assert np.allclose([r["explained"] for r in found[::copies]], values / np.trace(centred.T @ centred / n))


def test_without_variance(spark):
    schema = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        found = whitening.whiten(spark.createDataFrame(rows, schema))
        assert found.collect() == []
        assert found.columns == [x.split(" ")[0] for x in whitening.OUTPUT.split(", ")]
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)).collect()
    assert sorted(r["vec_id"] for r in two) == [1, 2]
    assert [abs(r["whitened"]) for r in two] == pytest.approx([1.0, 1.0])


def test_deviation_beyond_64_bits(spark):
    df = spark.createDataFrame([(1, [1e9]), (2, [-1e9]), (3, [0.0])], "vec_id bigint, embedding array<double>")
    found = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df).collect()}
    assert found == {1: None, 2: None, 3: 0}
