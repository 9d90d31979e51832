"""The pruned neighbour index against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import neighbours, vector_index

VECTORS = "id long, vector array<double>"


def clustered(rng, n, dims=12, clusters=40):
    """Tight clusters; a third of all vectors are copies of one."""
    centres = 4 * rng.standard_normal((clusters, dims))
    x = centres[rng.integers(0, clusters, n)] + 0.1 * rng.standard_normal((n, dims))
    x[: n // 3] = x[0]
    return x


def brute(queries, items, n, metric):
    ids = np.array([i for i, _ in items])
    x = vector_index.prepared(np.array([v for _, v in items]), metric)
    q = vector_index.prepared(np.array([v for _, v in queries]), metric)
    out = set()
    for (name, _), row in zip(queries, vector_index.scores(q, x, metric), strict=True):
        out |= {(name, int(ids[j])) for j in np.lexsort((ids, row))[:n]}
    return out


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_same_as_all_pairs_and_few_compared(spark, metric):
    rng = np.random.default_rng(3)
    x = clustered(rng, 3000)
    items = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    items += [(9000, [0.0] * 12), (9001, [0.0] * 12)]
    queries = [(100_000 + i, items[int(j)][1]) for i, j in enumerate(rng.integers(1000, 3000, 120))]
    queries += [(200_000, [0.0] * 12), (200_001, [9.0] * 12), (200_002, items[0][1])]
    got = vector_index.search(spark.createDataFrame(queries, VECTORS).repartition(2), spark.createDataFrame(items, VECTORS).repartition(3), 10, metric, block_items=300, block_queries=50)
    got = got.collect()
    best: dict = {}
    for r in got:
        if r["query"] is not None:
            best.setdefault(r["query"], []).append((r["distance"], r["aid"]))
    have = {(q, a) for q, found in best.items() for _, a in sorted(found)[:10]}
    assert have == brute(queries, items, 10, metric)
    compared = sum(r["distance"] for r in got if r["query"] is None)
    share = compared / (len(items) * len(queries))
    assert share < 0.1, share


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_blocks_and_cells_give_one_result(spark, metric):
    """Without clusters, fewer items than n, ties, and null vectors."""
    rng = np.random.default_rng(4)
    items = spark.createDataFrame([(i, [float(c) for c in np.round(rng.standard_normal(5), 1)]) for i in range(400)] + [(5000, None)], "aid int, vector array<double>")
    queries = items.where("aid % 7 = 0 or aid = 5000").select(F.col("aid").alias("query"), "vector")
    for n in (1, 13, 1000):
        key = lambda df: sorted((r["query"], r["rank"], r["aid"]) for r in df.collect())
        plain = key(neighbours.knn_by_vector(queries, items, n, metric))
        assert plain == key(neighbours.knn_by_vector(queries, items, n, metric, block_items=100)) and len(plain) == 58 * min(n, 400)
    assert neighbours.knn_by_vector(queries.limit(0), items, 3, metric, block_items=100).count() == 0
    assert neighbours.knn_by_vector(queries, items.limit(0), 3, metric, block_items=0).count() == 0
