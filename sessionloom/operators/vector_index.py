"""Exact nearest neighbours over cells of vectors, most of which a query never visits.

Items belong to the nearest of some sampled centres; each keeps its distance to it. A query first
searches the nearest cells that hold n items between them: its n-th best there bounds the answer.
By the triangle inequality a cell whose nearest edge, or an item whose distance to its centre, is
off by more than that bound can't be in the answer, so the second search leaves those out. Vectors
that get past both tests are compared exactly; nothing is approximate.

Cells of many items, and cells that many queries visit, are cut into blocks of bounded size, and
each pair of blocks is a task group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.exprs import stable_hash
from sessionloom.sources.scratch import stored

#: Centres at most; they are held by every task.
CENTRES = 1024
#: Items and queries of a pair of blocks at most.
BLOCK_ITEMS, BLOCK_QUERIES = 65_536, 16_384
#: Scores that a task holds at once, and rows of visits that it hands on at once, at most (or one query's).
ROOM, VISITS = 1 << 20, 1 << 16
#: Room for rounding in comparisons of distances (scores are rounded to nine decimals).
SLACK = 1e-6
#: The cell of zero vectors under the cosine metric, which all queries visit.
ZERO = -1


def prepared(vec: np.ndarray, metric: str) -> np.ndarray:
    """Vectors whose euclidean distances order as the metric does: unit vectors for cosine."""
    if metric != "cosine":
        return vec
    norm = np.sqrt((vec**2).sum(1, keepdims=True))
    return np.divide(vec, norm, out=np.zeros_like(vec), where=norm > 0)


def scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Scores (nine decimals, smaller is nearer) of prepared queries and items."""
    dot = q @ x.T
    return np.round(1 - dot if metric == "cosine" else np.sqrt(np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1) - 2 * dot, 0)), 9)


def nearest(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest scores, ties by id."""
    cut = np.partition(score, n - 1)[n - 1] if len(score) > n else np.inf
    near = np.flatnonzero(score <= cut)
    return near[np.lexsort((ids[near], score[near]))][:n]


def _vectors(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) if len(column) else np.zeros((0, 0))


def _apart(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((q**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * q @ centres.T, 0))


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


class Cells:
    """Centres with the number of items and the radius of each cell."""

    def __init__(self, centres: np.ndarray, metric: str):
        self.centres, self.metric = centres, metric
        self.count, self.radius, self.zeros = np.zeros(len(centres), np.int64), np.zeros(len(centres)), 0

    def assign(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, max(1, ROOM // len(self.centres))):
            vec = prepared(_vectors(b.column(1)), self.metric)
            apart = _apart(vec, self.centres)
            cell = apart.argmin(1)
            gap = apart[np.arange(len(vec)), cell]
            if self.metric == "cosine":
                none = ~vec.any(1)
                cell[none], gap[none] = ZERO, 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(gap)], names=["id", "vector", "cell", "gap"])

    def home(self, apart: np.ndarray, n: int) -> np.ndarray:
        """The nearest cells that hold n items between them."""
        order = np.argsort(apart, kind="stable")
        return order[: int(np.searchsorted(np.cumsum(self.count[order]), n)) + 1]

    def visits(self, n: int, limited: bool):
        """``id, vector, cell, off, bound`` of the cells that queries visit first (bound: none), or,
        given their limits, after that; ``off`` is the query's distance to the cell's centre."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # A query visits all cells at most, and each visit carries its vector.
            for b in _slices(batches, max(1, VISITS // (len(self.centres) + 1))):
                vec = prepared(_vectors(b.column(1)), self.metric)
                apart = _apart(vec, self.centres)
                rows, cells, bounds = [], [], []
                limits = b.column(2).to_numpy() if limited else np.full(b.num_rows, np.inf)
                for i, limit in enumerate(limits):
                    home = self.home(apart[i], n)
                    if limited:
                        away = vec[i].any() or self.metric != "cosine"  # a zero query is as far from everything
                        bound = (np.sqrt(2 * max(limit, 0) + 4e-9) if self.metric == "cosine" else limit) + SLACK * (1 + apart[i]) if away else np.full(len(apart[i]), np.inf)
                        near = np.flatnonzero((self.count > 0) & (apart[i] - self.radius <= bound))
                        got = np.setdiff1d(near, home)
                        bound = bound[got]
                    else:
                        got = home[self.count[home] > 0]
                        bound = np.full(len(got), np.inf)
                        if self.zeros:
                            got, bound = np.append(got, ZERO), np.append(bound, np.inf)
                    rows.append(np.full(len(got), i))
                    cells.append(got)
                    bounds.append(bound)
                at, cell = np.concatenate(rows), np.concatenate(cells)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(cell, pa.int32()), pa.array(apart[at, np.maximum(cell, 0)]), pa.array(np.concatenate(bounds))], names=["id", "vector", "cell", "off", "bound"])

        return run


FOUND = "query long, aid long, distance double"


def _search(n: int, metric: str):
    """The n nearest items of a block for each of its queries; the row without a query counts pairs
    that were compared."""

    def run(items: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_a, out_s, compared = [], [], [], 0
        if items.num_rows and queries.num_rows:
            gap = items.column("gap").to_numpy()
            order = np.argsort(gap, kind="stable")
            gap, ids = gap[order], items.column("id").to_numpy()[order]
            x = prepared(_vectors(items.column("vector")), metric)[order]
            q = prepared(_vectors(queries.column("vector")), metric)
            names, off, bound = (queries.column(c).to_numpy() for c in ("asker", "off", "bound"))
            lo, hi = np.searchsorted(gap, off - bound, side="left"), np.searchsorted(gap, off + bound, side="right")
            for i in range(len(q)):
                if lo[i] < hi[i]:
                    s = scores(q[i : i + 1], x[lo[i] : hi[i]], metric)[0]
                    near = lo[i] + nearest(s, ids[lo[i] : hi[i]], n)
                    compared += hi[i] - lo[i]
                    out_q.append(np.full(len(near), names[i]))
                    out_a.append(ids[near])
                    out_s.append(s[near - lo[i]])
        cat = lambda v, last, t: pa.array(np.concatenate([*v, [0]]).tolist()[:-1] + [last], t)
        return pa.table({"query": cat(out_q, None, pa.int64()), "aid": cat(out_a, None, pa.int64()), "distance": cat(out_s, float(compared), pa.float64())})

    return run


def _visited(items: DataFrame, visits: DataFrame, n: int, metric: str, block_items: int, block_queries: int) -> DataFrame:
    """Searches of all (query, cell) visits; a cell has a row in each of the two small tables."""
    cells = items.groupBy("cell").agg(F.ceil(F.count("*") / block_items).cast("int").alias("blocks"))
    asked = visits.groupBy("cell").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("batches"))
    sizes = F.broadcast(cells.join(asked, "cell"))  # CENTRES + 1 rows at most
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    left = items.join(sizes, "cell").select("cell", mine("blocks").alias("block"), upto("batches").alias("batch"), "id", "vector", "gap")
    right = visits.join(sizes, "cell").select(F.col("cell").alias("cell"), upto("blocks").alias("block"), mine("batches").alias("batch"), F.col("id").alias("asker"), F.col("vector").alias("vector"), "off", "bound")
    keys = ("cell", "block", "batch")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(n, metric), FOUND)


def search(queries: DataFrame, items: DataFrame, n: int, metric: str, centres: int | None = None, block_items: int = BLOCK_ITEMS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query, aid, distance`` of the n nearest ``items (id, vector)`` of each of ``queries (id,
    vector)`` and, without a query, the numbers of pairs compared. Vectors are not null."""
    items = stored(items.select("id", "vector"), "index-items")
    total = items.count()
    wanted = min(centres or CENTRES, max(1, int(np.ceil(np.sqrt(total)))))
    sample = items.orderBy(stable_hash("id"), "id").limit(wanted).select("vector").collect()  # CENTRES vectors at most
    cells = Cells(prepared(np.array([r["vector"] for r in sample], np.float64), metric), metric)
    filed = stored(items.mapInArrow(cells.assign, "id long, vector array<double>, cell int, gap double"), "index-cells")
    for r in filed.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect():
        if r["cell"] == ZERO:
            cells.zeros = r["n"]
        else:
            cells.count[r["cell"]], cells.radius[r["cell"]] = r["n"], r["radius"]
    schema = "id long, vector array<double>, cell int, off double, bound double"
    queries = stored(queries.select("id", "vector"), "index-queries")
    first = stored(_visited(filed, stored(queries.mapInArrow(cells.visits(n, False), schema), "index-visits"), n, metric, block_items, block_queries), "index-first")
    order = F.row_number().over(Window.partitionBy("query").orderBy("distance", "aid"))
    best = first.where("query is not null").withColumn("r", order).where(F.col("r") <= n)
    limits = best.groupBy("query").agg(F.when(F.count("*") >= n, F.max("distance")).otherwise(F.lit(float("inf"))).alias("limit"))
    known = queries.join(limits, queries["id"] == limits["query"], "left").select("id", "vector", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
    more = stored(known.mapInArrow(cells.visits(n, True), schema), "index-visits")
    return first.unionByName(_visited(filed, more, n, metric, block_items, block_queries))
