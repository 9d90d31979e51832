"""Operator 13: whitening of vectors on principal components refined to double precision.

Vectors become integers, floor(256 * c). The fit list holds each distinct integer vector once; its
covariance comes from exact integer sums of centred products, gathered by Spark, so the only matrix
that reaches the driver has dimensions^2 entries. Eigenvectors are found in single precision and
corrected by Ogita-Aishima steps, which need matrix products alone, in extended precision;
eigenvalues too close for a step are told apart by solving the small problem of their subspace.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finite_vector, integer_vector, matrix, stored

COMPONENTS = 4
#: Bits of a limb: products of two limbs, summed over LIMB_ROWS rows, are exact in a double.
LIMB, LIMB_ROWS = 20, 8192
#: Bits of the digits that travel; a long holds the sum of 2^20 of them.
DIGIT = 40
STEPS = 40


def _limbs(z: np.ndarray) -> list[np.ndarray]:
    """Matrices of whole doubles of LIMB bits, lowest first, whose weighted sum is ``z``."""
    out, half = [], 1 << (LIMB - 1)
    while not out or z.any():
        low = ((z + half) & ((1 << LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        z = (z - low) >> LIMB
    return out


def exact_gram(z: np.ndarray) -> np.ndarray:
    """Sum of the rows' outer products, as Python integers."""
    total = np.zeros((z.shape[1],) * 2, object)
    for lo in range(0, len(z), LIMB_ROWS):
        limbs = _limbs(z[lo : lo + LIMB_ROWS])
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def _digits(cells: dict[tuple[int, int], int]) -> pa.RecordBatch:
    """``i, j, place, digit``: signed digits of DIGIT bits of each cell."""
    rows, half = [], 1 << (DIGIT - 1)
    for (i, j), v in cells.items():
        place = 0
        while v:
            low = ((v + half) & ((1 << DIGIT) - 1)) - half
            rows.append((i, j, place, low))
            v, place = (v - low) >> DIGIT, place + 1
    cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["i", "j", "place", "digit"])


def _sums(dims: int):
    """Number of rows, as cell (-1, 0), and sums of each dimension, as cells (i, -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for b in batches:
            n += b.num_rows
            total += matrix(b.column(0), dims).astype(object).sum(0) if b.num_rows else 0
        yield _digits({(-1, 0): n} | {(i, -1): int(v) for i, v in enumerate(total)})

    return run


def _products(dims: int, centre: np.ndarray):
    """Sums of products of centred vectors; the whole part of the mean is taken off first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for b in batches:
            total += exact_gram(matrix(b.column(0), dims) - centre)
        yield _digits({(i, j): int(total[i, j]) for i in range(dims) for j in range(i + 1)})

    return run


def _gathered(fit: DataFrame, function) -> dict[tuple[int, int], int]:
    digits = fit.mapInArrow(function, "i int, j int, place int, digit long").groupBy("i", "j", "place").agg(F.sum("digit").alias("digit"))
    cells: dict[tuple[int, int], int] = {}
    for r in digits.collect():
        cells[r["i"], r["j"]] = cells.get((r["i"], r["j"]), 0) + (r["digit"] << (DIGIT * r["place"]))
    return cells


def _extended(x: Fraction) -> np.longdouble:
    high = float(x)
    return np.longdouble(high) + np.longdouble(float(x - Fraction(high)))


def _clusters(near: np.ndarray) -> Iterator[np.ndarray]:
    """Index sets of more than one member that ``near`` (by rank) chains together."""
    joined = np.array([near[: i + 1, i + 1 :].any() for i in range(len(near) - 1)], bool)
    for part in np.split(np.arange(len(near)), np.flatnonzero(~joined) + 1):
        if len(part) > 1:
            yield part


def refined_eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, both in extended
    precision: single-precision start, then Ogita-Aishima corrections.

    A step with R = I - X'X and S = X'AX moves X by X E, where E = (S + l_j R) / (l_j - l_i), written
    as R / 2 and an antisymmetric part, and R / 2 alone where two eigenvalues are closer than the
    step can tell. Such clusters get the
    eigenvectors of the problem restricted to their subspace, shifted by their mean. Of an
    eigenvalue met several times any basis of its subspace results.
    """
    a = np.asarray(a, np.longdouble)
    size, eye = np.abs(a).max(initial=0), np.eye(len(a), dtype=np.longdouble)
    if not size:
        return np.zeros(len(a), np.longdouble), eye
    a = (a + a.T) / (2 * size)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    norm, last = np.sqrt((a * a).sum()), np.inf
    for _ in range(STEPS):
        r, s = eye - x.T @ x, x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        x, values, r, s = x[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        off = s - np.diag(values)
        reach = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= reach
        middle = (values[None, :] + values[:, None]) / 2
        e = r / 2 + np.where(near, 0, (s + middle * r) / np.where(near, 1, gap))
        x = x + x @ e
        moved = np.abs(e).max()
        for part in _clusters(near & ~np.eye(len(a), dtype=bool)):
            own = x[:, part]
            own = own + own @ (eye[: len(part), : len(part)] - own.T @ own) / 2
            t = own.T @ (a @ own) - values[part].mean() * (own.T @ own)
            t = (t + t.T) / 2
            if scale := np.abs(t).max():
                turn = np.linalg.eigh((t / scale).astype(np.float64))[1][:, ::-1].astype(np.longdouble)
                x[:, part] = own @ turn
        if moved < 1e-17 or (moved < 1e-12 and moved >= last):
            break
        last = moved
    x = x + x @ (eye - x.T @ x) / 2
    x = x / np.sqrt((x * x).sum(0))
    values = (x * (a @ x)).sum(0) * size
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


class Whitening:
    """n, sums, leading eigenvalues and eigenvectors of a fit list, and the trace of its covariance.

    Components whose eigenvalue is nothing beside the first (below 2^-48 of it) have none to divide
    by: their ``whitened`` is null.
    """

    def __init__(self, n: int, sums: list[int], products: dict[tuple[int, int], int], centre: list[int], components: int):
        self.n, self.sums, dims = n, sums, len(sums)
        rest = [s - n * c for s, c in zip(sums, centre, strict=True)]  # sums of what was multiplied
        v = np.zeros((dims, dims), np.longdouble)
        for i in range(dims):
            for j in range(i + 1):
                v[i, j] = v[j, i] = _extended(Fraction(n * products.get((i, j), 0) - rest[i] * rest[j], n * n))
        values, vectors = refined_eigenvectors(v)
        k = min(components, dims)
        vectors = vectors[:, :k] * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None, :], 0)[0] < 0, -1, 1)[:k] if k else vectors[:, :0]
        trace = np.trace(v)
        self.values, self.vectors = np.maximum(values[:k], 0).astype(np.float64), vectors.astype(np.float64)
        self.explained = (values[:k] / trace).astype(np.float64) if trace > 0 else np.full(k, np.nan)
        self.sound = self.values > (2.0**-48) * max(self.values.max(initial=0), 0.0)
        self.identity_error: float | None = None

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Rows of n * x - S as doubles, and the exact sums of their squares (None: over 63 bits)."""
        about = float(self.n) * x.astype(np.float64) - np.array([float(s) for s in self.sums])
        if max(map(abs, self.sums), default=0) < 1 << 62 and (about * about).sum(1).max(initial=0) < 2.0**62:
            y = self.n * x - np.array(self.sums, np.int64)
            return y.astype(np.float64), (y * y).sum(1).tolist()
        y = x.astype(object) * self.n - np.array(self.sums, object)
        return y.astype(np.float64), [v if v < 1 << 63 else None for v in (y * y).sum(1)]

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened components of rows n * x - S (nan for one without variance)."""
        out = np.full((len(y), len(self.values)), np.nan)
        out[:, self.sound] = (y / self.n) @ self.vectors[:, self.sound] / np.sqrt(self.values[self.sound])
        return out


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct vectors of ``vectors (x array<long>)``; None where there are none."""
    dims = vectors.agg(F.max(F.size("x")).alias("d")).first()["d"]
    if dims is None:
        return None
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), dims - F.size("x")))  # vectors that differ in trailing zeros are equal
    fit = stored(vectors.select(F.when(F.size("x") < dims, filled).otherwise(F.col("x")).alias("x")).distinct(), "whiten-fit")
    cells = _gathered(fit, _sums(dims))
    n, sums = cells[-1, 0], [cells.get((i, -1), 0) for i in range(dims)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    model = Whitening(n, sums, _gathered(fit, _products(dims, np.array(centre, np.int64))), centre, components)
    names = [f"w{i}" for i in np.flatnonzero(model.sound)]
    if names:

        def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                w = model.project(model.deviations(matrix(b.column(0), dims))[0])[:, model.sound]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in w.T], names=names)

        pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
        white = fit.mapInArrow(whiten, ", ".join(f"{n} double" for n in names))
        got = white.agg(*(F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
        model.identity_error = max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    return model


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of each row of
    ``rows (vec_id, embedding, ...)`` for each of the first components.

    Rows whose vector is null or holds null or non-finite entries are dropped. Shorter vectors are
    read as if zeros followed, up to the longest; vectors without entries only give rows if others
    have some. Repeated rows give repeated rows but count once in the fit; a null vec_id stays null;
    ties of eigenvalues take any basis. A component without variance has a null ``whitened`` (with
    one distinct vector: all, and ``explained`` and ``identity_error`` too); ``deviation`` is null
    where it exceeds 63 bits. Extra columns are ignored, an empty table gives an empty result.
    Vectors' products are added up on the driver: dimensions^2 numbers.
    """
    spark = rows.sparkSession
    clean = rows.where(finite_vector("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), integer_vector("embedding").alias("x"))
    model = fit_whitening(clean, components)
    if model is None:
        return spark.createDataFrame([], _OUT)
    dims, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, squares = model.deviations(matrix(b.column(1), dims))
            m = b.num_rows
            every = np.repeat(np.arange(m), k)
            cols = [
                b.column(0).take(pa.array(every)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n, np.int64)),
                pa.array(squares, pa.int64()).take(pa.array(every)),
                pa.array(model.project(y).ravel(), from_pandas=True),
                pa.array(np.tile(model.explained, m), from_pandas=True),
                pa.array([model.identity_error] * (m * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _OUT.split(", ")])

    return clean.mapInArrow(run, _OUT)
