"""Co-visitation tables that take new events, and their factors, against tables built at once and numpy."""

import random

import numpy as np
import pytest

from sessionloom.operators import covisit, factors

EVENTS = "session long, aid int, ts long, type int"


def log(seed, n=3000, sessions=60):
    rng = random.Random(seed)
    rows = [(rng.randrange(sessions), rng.randrange(25), rng.randrange(20) * 20_000, rng.randrange(3)) for _ in range(n)]
    return rows + [(999, a, 100, 0) for a in range(100)]  # one session far longer than its tail


@pytest.mark.parametrize("types", [(0, 1, 2), (1, 2)])
def test_merged_equals_built_at_once(spark, types):
    rules = covisit.CovisitRules(types=types)
    rows = sorted(log(1), key=lambda r: (r[2], random.Random(r[1]).random()))
    df = lambda part: spark.createDataFrame(part, EVENTS)
    parts = [rows[1000:1800], rows[:1000], rows[1800:], []]  # old events after new ones, and a day without any
    state = covisit.covisit_state(df(parts[0]), rules)
    for part in parts[1:]:
        state = covisit.merge_covisitation(state, df(part))
    whole = covisit.covisit_state(df(rows), rules)
    for name in ("tails", "sums"):
        got, want = (sorted(map(tuple, getattr(s, name).select(*getattr(whole, name).columns).collect())) for s in (state, whole))
        assert got == want and got
    built = covisit.build_covisitation(df(rows), types=types, top_n=7)
    assert sorted(map(tuple, built.collect())) == sorted(map(tuple, covisit.top_neighbours(state.sums, 7).collect()))


def test_state_of_nothing(spark):
    empty = covisit.covisit_state(spark.createDataFrame([], EVENTS))
    assert empty.sums.count() == 0
    got = covisit.merge_covisitation(empty, spark.createDataFrame([(1, 5, 0, 0), (1, 6, 10, 1)], EVENTS))
    assert sorted(map(tuple, got.sums.collect())) == [(5, 6, 6.0), (6, 5, 1.0)]


def dense(left, right, values, shape):
    u, v = np.zeros((shape[0], len(values))), np.zeros((shape[1], len(values)))
    for m, df in ((u, left), (v, right)):
        for r in df.collect():
            m[r["i"]] = [r[f"v{i}"] for i in range(len(values))]
    return u, v


def test_factors_equal_numpy(spark):
    rng = np.random.default_rng(2)
    a = np.where(rng.random((60, 40)) < 0.2, rng.random((60, 40)) * 5, 0)
    a[:, 3] = a[7] = 0
    entries = [(i, j, float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    entries = [(int(i), int(j), w / 2) for i, j, w in entries] * 2  # halves add up
    values, left, right = factors.sparse_svd(spark.createDataFrame(entries, "i int, j int, w double").repartition(3), 5, iterations=8)
    u, s, vt = np.linalg.svd(a)
    assert np.allclose(values, s[:5], rtol=1e-6)
    x, y = dense(left, right, values, a.shape)
    assert np.allclose(x.T @ x, np.eye(5), atol=1e-9) and np.allclose(y.T @ y, np.eye(5), atol=1e-6) and (x.sum(0) > 0).all()
    assert np.allclose(np.abs((x * u[:, :5]).sum(0)), 1, atol=1e-5)
    assert np.allclose((x * values) @ y.T, (u[:, :5] * s[:5]) @ vt[:5], atol=2e-2)


def test_factors_of_small_rank(spark):
    table = spark.createDataFrame([(1, 5, 2.0), (2, 5, 4.0), (1, 6, 1.0), (2, 6, 2.0)], "aid_x int, aid_y int, wgt double")
    got = {r["aid"]: r["vector"] for r in factors.covisit_factors(table, 3, iterations=2).collect()}
    assert set(got) == {1, 2} and all(len(v) == 1 for v in got.values())
    assert got[2][0] == pytest.approx(2 * got[1][0]) and got[1][0] ** 2 + got[2][0] ** 2 == pytest.approx(5)
    assert factors.covisit_factors(table.limit(0), 3).count() == 0
