"""Operator 11: hard negatives by Fagin's threshold algorithm.

Rows are dealt into groups of bounded size. In a group every dimension has a list of its rows
sorted by component. An anchor reads these lists from their high end where its own component is
positive, from the low end where it is negative, to the same depth in all; each row met is scored
at once, exactly, in whole numbers. No row that is still unmet can score more than the threshold,
the anchor's product with the components last read; the search ends when the threshold is strictly
below the k-th score of every window (or its lower bound, where fewer rows were found).

Each pair (group of rows, batch of anchors) is a task group of its own; it returns an anchor's best
k a window, and windows over these give the best of all. The first search finds positives, whose
scores set the windows of the second, for negatives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import finite_vector, integer_vector, matrix, shuffle_partitions, stored

#: Components held by a group of rows, and by a batch of anchors (32,768 rows of 64).
CELLS = 1 << 21
#: Rows of a group where there are few rows in all: fewer are not worth a task.
LEAST_ROWS = 4096
#: Depth of the first read of all lists; each next read doubles it.
DEPTH = 64
#: Beyond any score.
NO_BOUND = 1 << 200


class Lists:
    """Rows (in rising order of their ids) with a sorted list for each dimension."""

    def __init__(self, x: np.ndarray):
        self.x, self.order = x, np.argsort(x, axis=0, kind="stable").T
        self.most = float(np.abs(x.astype(np.float64)).max(initial=0))
        self.wide = None if self.most >= 2.0**52 else x.astype(np.float64)

    def search(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (low, high): its first ``k`` allowed rows by score, then by row, with
        their scores."""
        exact = self.wide is not None and float(np.abs(anchor.astype(np.float64)).sum()) * self.most < 2.0**52
        x, a = (self.wide, anchor.astype(np.float64)) if exact else (self.x.astype(object), anchor.astype(object))
        n = len(x)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64 if exact else object)) for _ in windows]
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen, depth, to = ~allowed, 0, DEPTH
        while windows and depth < n:
            to = n if not len(up) + len(down) else min(n, to)
            met = np.zeros(n, bool)
            met[self.order[up, n - to : n - depth]] = True
            met[self.order[down, depth:to]] = True
            if to == n:
                met[:] = True
            rows = np.flatnonzero(met & ~seen)
            seen |= met
            scores = (x @ a)[rows] if len(rows) * 8 > n else x[rows] @ a
            scores = scores.astype(np.int64) if exact else scores
            for w, (low, high) in enumerate(windows):
                best[w] = _first(best[w], rows, scores, low, high, k)
            threshold = int((a[up] * x[self.order[up, n - to], up]).sum() + (a[down] * x[self.order[down, to - 1], down]).sum())
            if all(threshold < (b[1][-1] if len(b[0]) == k else low) for b, (low, _) in zip(best, windows, strict=True)):
                break
            depth, to = to, 2 * to
        return best


def _first(best: tuple[np.ndarray, np.ndarray], rows: np.ndarray, scores: np.ndarray, low: int, high: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` of those found before and of the new rows within low .. high."""
    fit = np.flatnonzero((scores <= high) & (scores >= low))
    if not len(fit):
        return best
    got = scores[fit]
    if len(fit) > 4 * k and got.dtype != object:
        fit = fit[got >= np.partition(got, len(got) - k)[len(got) - k]]
    rows, scores = np.concatenate([best[0], rows[fit]]), np.concatenate([best[1], scores[fit]])
    order = np.lexsort((rows, -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(rows)), key=lambda i: (-scores[i], rows[i]))[:k])
    return rows[order], scores[order]


_FOUND = "anchor_id long, high long, vec_id long, score long"


def _result(found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.Table:
    """Scores beyond 64 bits are cut to the largest or smallest long."""
    sizes = [len(f[2]) for f in found]
    ids = np.repeat(np.array([f[0] for f in found], np.int64), sizes)
    high = np.repeat(np.array([f[1] for f in found], np.int64), sizes)
    rows = np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.int64)
    scores = [int(max(-(1 << 63), min((1 << 63) - 1, s))) for f in found for s in f[3]]
    return pa.table({"anchor_id": ids, "high": high, "vec_id": rows, "score": pa.array(scores, pa.int64())})


def _unpack(items: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors in rising order of ids; of rows that share one, the first."""
    ids, labels = items.column("vec_id").to_numpy(), items.column("label").to_numpy()
    x = matrix(items.column("x").combine_chunks(), dims)
    order = np.lexsort((*x.T[::-1], labels, ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids, kind="stable")
    ids, labels, x = ids[order], labels[order], x[order]
    new = np.append(True, ids[1:] != ids[:-1]) if len(ids) else np.zeros(0, bool)
    return ids[new], labels[new], x[new]


def _positives(dims: int, k: int):
    def run(items: pa.Table, anchors: pa.Table) -> pa.Table:
        found = []
        if items.num_rows and anchors.num_rows:
            ids, labels, x = _unpack(items, dims)
            a_ids, a_labels, a_x = _unpack(anchors, dims)
            for label in np.unique(a_labels):
                own = np.flatnonzero(labels == label)
                if not len(own):
                    continue
                lists, own_ids = Lists(x[own]), ids[own]
                for i in np.flatnonzero(a_labels == label):
                    [(rows, scores)] = lists.search(a_x[i], own_ids != a_ids[i], [(-NO_BOUND, NO_BOUND)], k)
                    found.append((a_ids[i], 0, own_ids[rows], scores))
        return _result(found)

    return run


def _negatives(dims: int, k: int, share: tuple[int, int]):
    def run(items: pa.Table, anchors: pa.Table) -> pa.Table:
        found = []
        if items.num_rows and anchors.num_rows:
            ids, labels, x = _unpack(items, dims)
            lists, a_x = Lists(x), matrix(anchors.column("x").combine_chunks(), dims)
            for i, (anchor, label, highs) in enumerate(zip(*(anchors.column(c).to_pylist() for c in ("vec_id", "label", "highs")), strict=True)):
                windows = [(-(-share[0] * p // share[1]), p) for p in highs]
                for (_, p), (rows, scores) in zip(windows, lists.search(a_x[i], labels != label, windows, k), strict=True):
                    found.append((anchor, p, ids[rows], scores))
        return _result(found)

    return run


def _searched(rows: DataFrame, anchors: DataFrame, groups: int, batches: int, function) -> DataFrame:
    """``function`` on each pair of a group of rows and a batch of anchors."""
    parts = max(shuffle_partitions(rows.sparkSession), min(groups * batches, 4096))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        # New names for all columns: a cogroup takes equal ones of the two sides for one.
        columns = [F.col(c).alias(c) for c in df.columns]
        dealt = df.select(*columns, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))
        return dealt.repartition(parts, "block", "batch")

    items, asked = dealt(rows, "block", groups, "batch", batches), dealt(anchors, "batch", batches, "block", groups)
    return items.groupBy("block", "batch").cogroup(asked.groupBy("block", "batch")).applyInArrow(function, _FOUND)


def _ranked(found: DataFrame, k: int, *keys: str) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``rows
    (vec_id, label, x array<long>)``; ``is_anchor`` is a condition on them.

    A row's score is its inner product with the anchor; order is by score, then by smaller vec_id. An
    anchor's positives are its first rows of the same label; the negatives of a positive of score p
    are the first rows of other labels with share[0] * p <= share[1] * score <= share[1] * p. So a
    negative p has none.

    Rows with a null vec_id, label or vector take no part; a null component counts as 0. Of rows that
    share a vec_id, the one with the smallest label, then vector, takes part alone. Shorter vectors
    are read as if zeros followed. An anchor without positives, or a positive without negatives,
    gives no row; an empty table gives an empty result; extra columns are ignored. Products are
    exact; those beyond 64 bits are returned as the largest or smallest long, and positives with such a
    score have no negatives. Each row travels once
    for each batch of anchors, each anchor once for each group of rows.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform("x", lambda c: F.coalesce(c, F.lit(0)).cast("long")).alias("x"), is_anchor.alias("asks"))
    rows = stored(rows.where("vec_id is not null and label is not null and x is not null"), "negatives-rows")
    n, asked, dims = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("x"))).first()
    dims = dims or 0
    most = max(64, CELLS // max(dims, 1))
    groups = max(1, -(-n // most), min(-(-n // LEAST_ROWS), 2 * shuffle_partitions(spark)))
    batches = max(1, -(-asked // most))
    every, anchors = rows.drop("asks"), rows.where("asks").drop("asks")
    found = _searched(every, anchors, groups, batches, _positives(dims, positives))
    first = stored(_ranked(found, positives, "anchor_id").select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    highs = first.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_set("positive_score").alias("highs"))
    one = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("a")).select("vec_id", "a.label", "a.x")
    asking = one.join(highs, one["vec_id"] == highs["anchor_id"]).select("vec_id", "label", "x", "highs")
    found = _searched(every, asking, groups, batches, _negatives(dims, negatives, share))
    best = _ranked(found, negatives, "anchor_id", "high").withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score", "high": "positive_score"})
    return first.join(best, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def labelled_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, label, x`` of ``rows (vec_id, embedding, label, ...)`` as whole numbers.

    Rows with a null label, a null vector, or a null or non-finite component are left out. Where
    vec_id is divisible by 7, label becomes (label + 1) % 10.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    clean = rows.where(F.col("label").isNotNull() & finite_vector("embedding"))
    return clean.select("vec_id", label.alias("label"), integer_vector("embedding").alias("x"))
