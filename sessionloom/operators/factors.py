"""Factors of a sparse matrix by randomised subspace iteration.

The matrix stays a table of entries and each block of vectors a table with a column for each of
them; a product is a join and a grouped sum. What reaches the driver are Gram matrices, as many
numbers as vectors squared.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.sources.scratch import stored

OVERSAMPLE, ITERATIONS = 8, 8


def _names(k: int) -> list[str]:
    return [f"v{i}" for i in range(k)]


def _times(entries: DataFrame, vectors: DataFrame, k: int, turned: bool) -> DataFrame:
    """The matrix (``turned``: its transpose) times a block of vectors ``i, v0, v1, ...``."""
    row, col = ("j", "i") if turned else ("i", "j")
    side = vectors.withColumnRenamed("i", "at")
    return entries.join(side, entries[col] == side["at"]).groupBy(F.col(row).alias("i")).agg(*(F.sum(F.col("w") * F.col(v)).alias(v) for v in _names(k)))


def _gram(vectors: DataFrame, k: int) -> np.ndarray:
    names, out = _names(k), np.zeros((k, k))
    pairs = [(a, b) for a in range(k) for b in range(a + 1)]
    got = vectors.agg(*(F.sum(F.col(names[a]) * F.col(names[b])) for a, b in pairs)).first()
    for (a, b), x in zip(pairs, got, strict=True):
        out[a, b] = out[b, a] = x or 0.0
    return out


def _mixed(vectors: DataFrame, m: np.ndarray) -> DataFrame:
    """Linear combinations of the block's vectors, by the columns of ``m``."""
    names = _names(len(m))
    mix = lambda c: sum((F.col(n) * float(x) for n, x in zip(names[1:], c[1:], strict=True)), F.col(names[0]) * float(c[0]))
    return vectors.select("i", *(mix(c).alias(n) for c, n in zip(m.T, _names(m.shape[1]), strict=True)))


def _orthonormal(vectors: DataFrame, k: int, rounds: int = 2) -> tuple[DataFrame, int]:
    """An orthonormal block of the same span, by rounds over Gram matrices (one is enough between
    products, two at the end); directions that the matrix hasn't got fall away."""
    for _ in range(rounds):
        values, turn = np.linalg.eigh(_gram(vectors, k))
        sound = values > 1e-13 * max(values.max(initial=0.0), 1e-300)
        if not sound.any():
            return vectors, 0
        vectors, k = stored(_mixed(vectors, turn[:, sound] / np.sqrt(values[sound])), "factor-basis"), int(sound.sum())
    return vectors, k


def sparse_svd(entries: DataFrame, k: int, iterations: int = ITERATIONS, oversample: int = OVERSAMPLE, seed: int = 1) -> tuple[list[float], DataFrame, DataFrame]:
    """(singular values, left vectors ``i, v0, ...``, right vectors) of the matrix ``i, j, w``.

    At most ``k`` of them, fewer where the matrix has a smaller rank, falling; entries that share a
    place add up; each pair of vectors has the sign that makes the left one's sum positive. The
    first block comes from hashes of the indices, so results are the same on any layout but for
    rounding. Indices without a vector have only zeros.
    """
    entries = stored(entries.groupBy("i", "j").agg(F.sum(F.col("w").cast("double")).alias("w")).where("w <> 0"), "factor-entries")
    wide = k + oversample
    unit = lambda n: (F.pmod(F.xxhash64("i", F.lit(n), F.lit(seed)), F.lit(1 << 20)) - (1 << 19)) / float(1 << 19)
    start = entries.select(F.col("j").alias("i")).distinct().select("i", *(unit(n).alias(v) for n, v in enumerate(_names(wide))))
    basis, wide = _orthonormal(stored(_times(entries, start, wide, False), "factor-product"), wide)
    for n in range(iterations if wide else 0):
        back, wide = _orthonormal(stored(_times(entries, basis, wide, True), "factor-product"), wide, 1)
        basis, wide = _orthonormal(stored(_times(entries, back, wide, False), "factor-product"), wide, 2 if n == iterations - 1 else 1)
    if not wide:
        none = entries.select("i", F.lit(0.0).alias("v0")).limit(0)
        return [], none, none
    back = stored(_times(entries, basis, wide, True), "factor-product")
    values, turn = np.linalg.eigh(_gram(back, wide))
    keep = [n for n in np.argsort(-values) if values[n] > 1e-20 * values.max()][:k]
    singular, turn = np.sqrt(values[keep]), turn[:, keep]
    left = stored(_mixed(basis, turn), "factor-left")
    sums = left.agg(*(F.sum(v) for v in _names(len(keep)))).first()
    sign = np.where(np.array(sums, float) < 0, -1.0, 1.0)
    return [float(x) for x in singular], _mixed(left, np.diag(sign)), _mixed(back, turn / singular * sign)


def covisit_factors(table: DataFrame, size: int = 32, iterations: int = ITERATIONS, seed: int = 1) -> DataFrame:
    """``aid, vector``: items as left vectors of a co-visitation table ``aid_x, aid_y, wgt``, each
    scaled by the root of its singular value."""
    values, left, _ = sparse_svd(table.select(F.col("aid_x").alias("i"), F.col("aid_y").alias("j"), F.col("wgt").alias("w")), size, iterations, seed=seed)
    return left.select(F.col("i").cast("int").alias("aid"), F.array(*(F.col(v) * float(np.sqrt(x)) for v, x in zip(_names(len(values)), values, strict=True))).cast("array<double>").alias("vector"))
