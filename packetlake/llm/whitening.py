"""Whitening of embeddings through a bidiagonal qd singular value solver.

Centred rows are reduced to one triangle by blockwise QR: each partition folds
its blocks into a triangle, and triangles fold into each other in a tree of
bounded fan-in. The triangle, whose size is the dimension's square however many
rows there are, is made bidiagonal by Householder reflections. Shifted
differential quotient-difference steps (dqds) find its singular values to high
relative accuracy, and twisted factorisations, from both ends to the place of
least residual, give the directions.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlake.session import store_stage

SCALE, OFFSET = 64.0, 1_000_000
COMPONENTS = 16
BLOCK_ROWS = 4096
FAN_IN = 16
EPS = float(np.finfo(float).eps)
TINY = float(np.finfo(float).tiny)
# Relative gap below which neighbouring directions are made orthogonal explicitly.
CLOSE = 1e-3
LARGEST = (1 << 63) - 1

OUTPUT = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
    "identity_error double"
)


# --- the dense part: one triangle --------------------------------------------


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and b with (I - b v v') x along the first axis."""
    norm = float(np.sqrt(x @ x))
    v = x.copy()
    if norm == 0:
        return v, 0.0
    v[0] += norm if x[0] >= 0 else -norm
    return v, 2.0 / float(v @ v)


def bidiagonalise(triangle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and W with triangle = Q B W'."""
    a = np.array(triangle, float)
    d = a.shape[1]
    w = np.eye(d)
    for k in range(d):
        v, b = _reflector(a[k:, k])
        a[k:, k:] -= b * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v, b = _reflector(a[k, k + 1:])
            a[k:, k + 1:] -= b * np.outer(a[k:, k + 1:] @ v, v)
            w[:, k + 1:] -= b * np.outer(w[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], bool]:
    """One step; false where the shift exceeds the least eigenvalue."""
    out_q, out_e, d = [], [], q[0] - shift
    for k in range(len(e)):
        if d < 0:
            return q, e, False
        pivot = d + e[k]
        out_q.append(pivot)
        if pivot == 0:
            out_e.append(0.0)
            d = q[k + 1] - shift
        else:
            ratio = q[k + 1] / pivot
            out_e.append(e[k] * ratio)
            d = d * ratio - shift
    out_q.append(d)
    return out_q, out_e, d >= 0


def _least_bound(q: list[float], e: list[float]) -> float:
    """A lower bound of the least eigenvalue: one over the trace of the inverse,
    whose diagonal is one over the pivots of an unshifted step."""
    total, d = 0.0, q[0]
    for k in range(len(q)):
        if d <= TINY:
            return 0.0
        total += 1.0 / d
        if k < len(e):
            d = d * (q[k + 1] / (d + e[k]))
    return (1.0 / total) * (1 - 8 * EPS * len(q))


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> list[float]:
    """Eigenvalues of B'B, falling, by dqds with deflation at the lower end."""
    found: list[float] = []
    blocks = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        rounds = 0
        while q:
            if len(q) == 1:
                found.append(moved + q[0])
                break
            least = EPS**2 * max(q)
            cut = next(
                (k for k in range(len(e) - 1, -1, -1)
                 if e[k] <= EPS**2 * (moved + min(q[k], q[k + 1])) or e[k] <= least * EPS), None,
            )
            if cut is not None:
                blocks.append((q[:cut + 1], e[:cut], moved))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if q[0] < q[-1]:  # the small ones belong at the end
                q, e = q[::-1], e[::-1]
            # The last quotient is close to the least eigenvalue near the end of
            # an iteration; the bound never exceeds it.
            bound = _least_bound(q, e)
            bold = q[-1] - e[-1] if e[-1] < q[-1] / 16 and rounds % 4 != 3 else 0.0
            for shift in (*[bold][:bold > bound], bound, bound / 2, 0.0):
                new_q, new_e, fits = _dqds(q, e, shift)
                if fits:
                    q, e, moved = new_q, new_e, moved + shift
                    break
            else:
                # Rounding left a negative quotient without a shift: it is zero.
                q[-1] = 0.0
                e[-1] = 0.0
            rounds += 1
            if rounds > 100 * (len(q) + 10):
                raise ArithmeticError("the qd iteration did not converge")
    return sorted(found, reverse=True)


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """Unit vector z with B'B z close to ``value`` z: factorise B'B - value from
    the top and from the bottom, and join both where the residual is least."""
    n = len(diagonal)
    q, e = diagonal**2, above**2
    off = diagonal[:-1] * above  # off-diagonal of B'B
    tiny = EPS * EPS * max(value, TINY)
    top, s = np.zeros(max(n - 1, 0)), np.zeros(n)
    s[0] = -value
    for k in range(n - 1):
        pivot = s[k] + q[k]
        pivot = pivot if abs(pivot) > tiny else tiny
        top[k] = off[k] / pivot
        s[k + 1] = (e[k] / pivot) * s[k] - value
    low, p = np.zeros(max(n - 1, 0)), np.zeros(n)
    p[-1] = q[-1] - value
    for k in range(n - 2, -1, -1):
        pivot = e[k] + p[k + 1]
        pivot = pivot if abs(pivot) > tiny else tiny
        low[k] = off[k] / pivot
        p[k] = (q[k] / pivot) * p[k + 1] - value
    residual = s + p + value
    at = int(np.argmin(np.abs(residual)))
    z = np.zeros(n)
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -top[k] * z[k + 1]
    for k in range(at, n - 1):
        z[k + 1] = -low[k] * z[k]
    return z / np.sqrt(z @ z)


def _blocks(diagonal: np.ndarray, above: np.ndarray) -> list[tuple[int, int]]:
    """Stretches between superdiagonal entries that are zero up to rounding."""
    near = np.abs(diagonal)
    cuts = [k + 1 for k, b in enumerate(above) if abs(b) <= EPS * (near[k] + near[k + 1])]
    ends = [0, *cuts, len(diagonal)]
    return list(zip(ends[:-1], ends[1:], strict=True))


def right_singular_pairs(triangle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values, falling, and the unit right singular vectors as rows."""
    diagonal, above, w = bidiagonalise(triangle)
    pairs: list[tuple[float, np.ndarray]] = []
    for low, high in _blocks(diagonal, above):
        a, b = diagonal[low:high], above[low:high - 1]
        values = squared_singular_values(a, b)
        basis = np.zeros((high - low, high - low))
        starts = [k for k in range(high - low) if not k or values[k - 1] - values[k] > CLOSE * values[k - 1]]
        for first, last in zip(starts, [*starts[1:], high - low], strict=True):
            found = np.array([twisted_vector(a, b, value) for value in values[first:last]])
            basis[first:last] = found if last - first == 1 else _apart(found, a, b, values[first])
        for value, z in zip(values, basis, strict=True):
            whole = np.zeros(len(diagonal))
            whole[low:high] = z
            pairs.append((value, whole))
    pairs.sort(key=lambda pair: -pair[0])
    return np.array([value for value, _ in pairs]), np.array([w @ z for _, z in pairs])


def _apart(found: np.ndarray, a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The directions of a close cluster made orthogonal. Where several values
    are equal up to rounding, the twisted vectors may coincide; inverse iteration
    on as many vectors at once then finds the cluster's space."""
    q, r = np.linalg.qr(found.T)
    if np.abs(np.diag(r)).min() > 0.1:
        return (q * np.sign(np.diag(r))).T
    full = np.diag(a) + np.diag(b, 1)
    matrix = full.T @ full
    shifted = matrix - (value * (1 + 4 * EPS) + EPS**2 * np.trace(matrix)) * np.eye(len(a))
    space = np.random.default_rng(len(found)).normal(size=(len(a), len(found)))
    for _ in range(3):
        space, _ = np.linalg.qr(np.linalg.solve(shifted, space))
    _, turn = np.linalg.eigh(space.T @ matrix @ space)
    return (space @ turn[:, ::-1]).T


# --- tables -------------------------------------------------------------------


class Whitening(NamedTuple):
    """What a fit knows: exact counts and sums, directions and variances."""

    n: int
    sums: list[int]
    directions: np.ndarray  # by component
    variances: np.ndarray
    trace: float
    identity_error: float


def integer_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<bigint>) of the vectors without null or non-finite
    entries; shorter vectors are as if they ended in zeros."""
    usable = F.col("embedding").isNotNull() & F.forall(
        "embedding",
        lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))),
    )
    kept = vectors.where(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    width = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    x = F.transform("embedding", lambda c: F.floor(F.lit(SCALE) * c.cast("double")) + OFFSET)
    missing = F.array_repeat(F.lit(OFFSET).cast("bigint"), F.lit(width) - F.size("embedding"))
    return kept.select("vec_id", F.concat(x, missing).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _total(parts: DataFrame) -> dict[int, int]:
    """Sums of (place, value decimal) over all partitions."""
    rows = parts.groupBy("place").agg(F.sum("value").alias("value")).collect()
    return {row["place"]: row["value"] for row in rows}


def counts_and_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums by dimension. What reaches the driver is one number
    for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                # Halves of a number, so that no sum of a batch overflows.
                part = (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
                n, sums = n + len(x), part if sums is None else sums + part
        if n:
            values = [n, *sums]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(values)), pa.int32()), pa.array([str(v) for v in values])],
                ["place", "value"],
            )

    parts = fit.select("x").mapInArrow(run, "place int, value string")
    found = _total(parts.select("place", F.col("value").cast("decimal(38,0)").alias("value")))
    return int(found.get(0, 0)), [int(found[k]) for k in range(1, len(found))]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n; the whole part of the mean goes off exactly."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s - n * (s // n)) / n for s in sums])
    return (x - whole).astype(float) - rest


def triangle_of(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The triangle R of the centred rows' QR factorisation."""
    d = len(sums)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                rows = centred(_matrix(batch.column(0).slice(at, BLOCK_ROWS)), n, sums)
                r = np.linalg.qr(np.vstack([r, rows]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.ravel()], pa.list_(pa.float64()))], ["r"]
            )

    def fold(found: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros((0, d))
        for flat in found["r"]:
            r = np.linalg.qr(np.vstack([r, np.asarray(flat).reshape(-1, d)]), mode="r")
        return pd.DataFrame({"r": [r.ravel()]})

    parts = store_stage(fit.select("x").mapInArrow(reduce_rows, "r array<double>"), "triangles")
    left = parts.count()
    while left > 1:
        groups = -(-left // FAN_IN)
        # Row numbers of few triangles deal them out evenly.
        dealt = parts.withColumn("deal", F.pmod(F.xxhash64("r"), F.lit(groups)))
        parts = store_stage(dealt.groupBy("deal").applyInPandas(fold, "r array<double>"), "triangles")
        left = parts.count()
    r = np.zeros((d, d))
    for row in parts.collect():  # one
        flat = np.array(row["r"]).reshape(-1, d)
        r[:len(flat)] = flat
    return r


def _whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    return centred(x, model.n, model.sums) @ model.directions.T / np.sqrt(model.variances)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit rows' covariance minus the identity."""
    k = len(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                y = _whitened(_matrix(batch.column(0).slice(at, BLOCK_ROWS)), model)
                sums += y.sum(axis=0)
                products += y.T @ y
        values = [*sums, *products.ravel()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(values)), pa.int32()), pa.array(values, pa.float64())], ["place", "value"]
        )

    found = _total(fit.select("x").mapInArrow(run, "place int, value double"))
    values = np.array([found[place] for place in range(k + k * k)]) / model.n
    covariance = values[k:].reshape(k, k) - np.outer(values[:k], values[:k])
    return float(np.abs(covariance - np.eye(k)).max())


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``fit`` (x), null without rows or variance. Directions
    whose variance is zero up to rounding are left out."""
    n, sums = counts_and_sums(fit)
    if not n or not sums:
        return None
    values, directions = right_singular_pairs(triangle_of(fit, n, sums))
    trace = float(values.sum()) / n
    kept = [k for k, v in enumerate(values) if np.sqrt(v) > len(sums) * EPS * np.sqrt(values[0])][:components]
    if not trace or not kept:
        return None
    model = Whitening(n, sums, directions[kept], values[kept] / n, trace, 0.0)
    return model._replace(identity_error=identity_error(fit, model))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n * x - sums) squared; null beyond 64 bits."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s - n * (s // n) for s in sums], object)
    near = x - whole
    reach = int(np.abs(near).max(initial=0)) * n + n
    if reach * reach * max(1, len(sums)) <= LARGEST:
        return ((n * near - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum(v * v for v in n * row - rest) for row in near.astype(object)]
    return [v if v <= LARGEST else None for v in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error)
    for each usable vector and component.

    Vectors that are null or hold a null or non-finite entry take no part;
    shorter ones are as if they ended in zeros. Repeated vectors are fitted once
    and whitened each; null ids stay. Equal variances keep an arbitrary basis of
    their space, the same for all rows. Components without variance do not
    exist, so fewer vectors than components give fewer rows, and a single
    vector, equal vectors or an empty table none. Entries are finite and at most
    about 1e17, so that 64 bits hold them. Other columns are not looked at.
    """
    rows = integer_rows(vectors)
    fit = store_stage(rows.select("x").distinct(), "distinct-vectors")
    model = fit_whitening(fit, components)
    if model is None:
        return rows.where("false").selectExpr(*(
            f"CAST(NULL AS {kind}) AS {name}" for name, kind in (x.split(" ") for x in OUTPUT.split(", "))
        ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.variances)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = _matrix(part.column(1))
                m = len(x)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                moved = deviations(x, model.n, model.sums)
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array([v for v in moved for _ in range(k)], pa.int64()),
                    pa.array(_whitened(x, model).ravel()),
                    pa.array(np.tile(model.variances / model.trace, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ], [part.split(" ")[0] for part in OUTPUT.split(", ")])

    return rows.mapInArrow(run, OUTPUT)
