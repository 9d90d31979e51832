"""What a task of the nearest-neighbour search holds at once."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from sessionloom.operators import neighbours, vector_index


def table(vectors, ids, **more):
    return pa.table({"id": ids, "vector": pa.array(list(vectors), pa.list_(pa.float64())), **more})


def test_scores_of_a_block_are_bounded():
    """Scores of 256 queries with all items of a block took 373 MB."""
    rng = np.random.default_rng(3)
    items, queries = rng.standard_normal((60_000, 4)), rng.standard_normal((256, 4))
    block = table(np.concatenate([items, queries]), np.arange(60_256), is_query=np.arange(60_256) >= 60_000)
    tracemalloc.start()
    got = neighbours._nearest(3, "euclidean")(block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    first = [int(np.argmin(((items - q) ** 2).sum(1))) for q in queries]
    assert got.column("query").to_pylist() == [60_000 + i for i in range(256) for _ in range(3)] and got.column("aid").to_pylist()[::3] == first


@pytest.mark.parametrize("limited", [False, True])
def test_visits_are_handed_on_in_bounded_batches(limited):
    """Queries that no bound helps visit all cells, each with its vector: 400,000 rows at once here."""
    rng = np.random.default_rng(4)
    cells = vector_index.Cells(rng.standard_normal((400, 4)), "euclidean")
    cells.count[:], cells.radius[:] = 1, 100
    queries = table(rng.standard_normal((1000, 4)), np.arange(1000), limit=np.full(1000, 50.0))
    # The first search visits the cells that hold n items between them, the second all others.
    batches = list(cells.visits(2 if limited else 390, limited)(iter(queries.to_batches())))
    assert max(b.num_rows for b in batches) <= vector_index.VISITS
    assert sum(b.num_rows for b in batches) == 1000 * (398 if limited else 390)
