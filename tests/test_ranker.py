"""Listwise trees, their metrics and early stopping, balanced folds and p-values, against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sessionloom.functions.exprs import correlation_p_value
from sessionloom.operators import boosting, ranking
from sessionloom.sources.scratch import stored

ROWS = "session long, candidate_aid int, label int, weight double, f array<double>"


def planted(n_sessions=150, seed=1):
    """Sessions whose best rows are a non-linear matter of three features, beside one of the session."""
    rng, rows = np.random.default_rng(seed), []
    for session in range(n_sessions):
        n = int(rng.integers(15, 25))
        x = rng.standard_normal((n, 4))
        x[:, 3] = 3 * rng.standard_normal()
        worth = 1.5 * np.abs(x[:, 0]) - 1.2 * (x[:, 1] * x[:, 2] > 0) + 0.2 * rng.standard_normal(n)
        hits = set(np.argsort(-worth)[: int(rng.integers(1, 4))]) if session % 10 else set()
        rows += [(session, i, int(i in hits), 1.0, [float(v) for v in x[i]]) for i in range(n)]
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    df = spark.createDataFrame(planted(), ROWS).repartition(5)
    return stored(df.select("session", "candidate_aid", "label", "weight", array_to_vector("f").alias("features")), "planted")


@pytest.fixture(scope="module")
def trained(frame):
    """A ranker that its held-out sessions have stopped."""
    return boosting.train_boosted(frame.where("session % 3 <> 0"), rounds=24, depth=3, rate=0.4, validation=frame.where("session % 3 = 0"), look_every=4, patience=8)


def brute_metrics(rows, k):
    ndcg, precision = [], []
    for session in {r[0] for r in rows}:
        own = sorted((-r[3], r[1], r[2]) for r in rows if r[0] == session)
        labels = [x[2] for x in own]
        if not any(labels):
            continue
        dcg = lambda ls: sum((2**lb - 1) / math.log2(i + 2) for i, lb in enumerate(ls[:k]))
        ndcg.append(dcg(labels) / dcg(sorted(labels, reverse=True)))
        hits = [i for i, lb in enumerate(labels[:k]) if lb > 0]
        precision.append(sum((j + 1) / (i + 1) for j, i in enumerate(hits)) / min(k, sum(lb > 0 for lb in labels)))
    return sum(ndcg) / len(ndcg), sum(precision) / len(precision), len(ndcg)


@pytest.mark.parametrize("k", [1, 3, 20])
def test_metrics_brute_force(spark, k):
    rng = np.random.default_rng(k)
    rows = [(int(s), int(a), int(rng.choice([0, 0, 0, 1, 2])), float(rng.integers(0, 5))) for s in range(30) for a in range(rng.integers(1, 30))]
    df = spark.createDataFrame(rows, "session long, candidate_aid int, label int, score double")
    got = boosting.ranking_metrics(df, k).first()
    want = brute_metrics(rows, k)
    assert got["sessions"] == want[2] and abs(got["ndcg"] - want[0]) < 1e-12 and abs(got["map"] - want[1]) < 1e-12


def test_beats_linear_and_pointwise(frame, trained):
    """On planted data that no linear model orders, and held-out sessions."""
    train, held = frame.where("session % 3 <> 0"), frame.where("session % 3 = 0")
    ndcg = lambda model: boosting.ranking_metrics(ranking.score(held, [model], None)).first()["ndcg"]
    ours = ndcg(trained)
    assert ours > 0.75
    assert ours > ndcg(ranking.train_ranker(train, "ranker")) + 0.2
    assert ours > ndcg(ranking.train_ranker(train, "classifier", {"maxIter": 12, "maxDepth": 3}))


def test_early_stopping(frame, trained):
    """Trees after the best round are dropped, and no more rounds are tried than patience allows."""
    best = max(trained.history, key=lambda h: (h["ndcg"], -h["round"]))
    assert len(trained.trees) == best["round"]
    held = ranking.score(frame.where("session % 3 = 0"), [trained], 9)
    assert abs(boosting.ranking_metrics(held).first()["ndcg"] - best["ndcg"]) < 1e-9
    noise = frame.withColumn("label", F.when(F.pmod(F.xxhash64("session", "candidate_aid"), F.lit(9)) == 0, 1).otherwise(0))
    got = boosting.train_boosted(noise.where("session % 3 <> 0"), rounds=40, depth=2, rate=0.8, validation=noise.where("session % 3 = 0"), metric="map", look_every=2, patience=2)
    assert got.history[-1]["round"] < 40 and len(got.trees) <= got.history[-1]["round"] - 2


def test_any_layout_and_long_sessions(frame):
    """Trees depend neither on the layout nor on how sessions are cut into parts."""
    train = lambda df, **x: boosting.train_boosted(df, rounds=3, depth=3, rate=0.4, **x)
    one = train(frame)
    for other in (train(frame.repartition(2, "candidate_aid")), train(frame, part_rows=4)):
        for a, b in zip(one.trees, other.trees, strict=True):
            assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.abs(a.value - b.value).max() < 1e-6


def test_gradient_is_newton(spark):
    """A stump's leaves are the Newton steps of the softmax loss, worked out by hand."""
    rows = [(1, i, int(i == 0), 1.0, [float(i >= 2)]) for i in range(4)]
    df = spark.createDataFrame(rows, ROWS).select("session", "candidate_aid", "label", "weight", array_to_vector("f").alias("features"))
    model = boosting.train_boosted(df, rounds=1, depth=1, rate=1.0, l2=0.5, least_rows=1)
    h = 2 * 0.25 * 0.75
    assert np.allclose(sorted(model.trees[0].value[1:]), [-(0.5) / (h + 0.5), 0.5 / (h + 0.5)], atol=1e-6)


def test_odd_frames(spark, frame):
    empty = boosting.train_boosted(frame.limit(0), rounds=2)
    assert empty.trees == []
    nothing = boosting.train_boosted(frame.withColumn("label", F.lit(0)), rounds=2)
    assert nothing.trees == [] and {r["prediction"] for r in nothing.transform(frame).select("prediction").distinct().collect()} == {0.0}
    rows = [(s, i, int(i == 0), 1.0, [float("nan") if i == 0 else 1.0 * i, 5.0]) for s in range(20) for i in range(5)]
    df = spark.createDataFrame(rows, ROWS).select("session", "candidate_aid", "label", "weight", array_to_vector("f").alias("features"))
    model = boosting.train_boosted(df, rounds=2, depth=2, rate=1.0, least_rows=1)
    best = ranking.top_k(ranking.score(df, [model], None), 1, "orders").collect()
    assert {r["labels"] for r in best} == {"0"} and model.featureImportances.toArray().tolist() == [1.0, 0.0]


def test_balanced_folds(spark):
    rng = np.random.default_rng(6)
    rows = [(int(s), int(a), int(rng.random() < 0.1)) for s in range(303) for a in range(int(rng.integers(1, 30)))]
    got = ranking.balanced_folds(spark.createDataFrame(rows, "session long, candidate_aid int, label int").repartition(3), 5).collect()
    assert len(got) == len(rows)
    fold = {r["session"]: r["fold"] for r in got}
    assert all(fold[r["session"]] == r["fold"] for r in got)
    sessions, positives, size = Counter(fold.values()), Counter(), Counter()
    for s, _, label in rows:
        positives[fold[s]] += label
        size[fold[s]] += 1
    assert max(sessions.values()) - min(sessions.values()) <= 1
    assert max(positives.values()) - min(positives.values()) <= max(Counter(s for s, _, lb in rows if lb).values())
    classes = len(set(Counter(s for s, _, lb in rows if lb).values())) + 1
    assert max(size.values()) - min(size.values()) <= 30 * classes


def test_p_values(spark):
    """Against the density of Student's t, integrated."""
    cases = [(r, n) for n in (3, 4, 5, 10, 37, 1000, 100_000) for r in (1e-6, 0.003, 0.1, -0.3, 0.5, 0.9, 0.999)]
    df = spark.createDataFrame(cases, "r double, n long")
    for row in df.select("r", "n", correlation_p_value(F.col("r"), F.col("n")).alias("p")).collect():
        nu = row["n"] - 2
        t = abs(row["r"]) * math.sqrt(nu / (1 - row["r"] ** 2))
        lo = math.atan(t / math.sqrt(nu))
        node, weight = np.polynomial.legendre.leggauss(80)
        ends = lo + (math.pi / 2 - lo) * np.linspace(0, 1, 4001)
        mid, half = (ends[1:] + ends[:-1])[:, None] / 2, np.diff(ends)[:, None] / 2
        area = (np.cos(mid + half * node) ** (nu - 1) * half * weight).sum()
        want = 2 * math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(math.pi) * area
        assert row["p"] == pytest.approx(want, rel=1e-8, abs=1e-300), row
    odd = spark.createDataFrame([(None, 9), (0.5, 2), (1.0, 9), (-1.0, 9), (0.0, 9), (float("nan"), 9)], "r double, n long")
    assert [r["p"] for r in odd.select(correlation_p_value(F.col("r"), F.col("n")).alias("p")).collect()] == [None, None, 0.0, 0.0, 1.0, None]
