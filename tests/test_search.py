"""Sequential search of blend weights and of a ranker's parameters on planted optima."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sessionloom.functions.parzen import propose
from sessionloom.operators import boosting, ensemble, search
from sessionloom.sources.scratch import stored


def test_proposals_close_in():
    """A planted peak in three dimensions, with fewer trials than a quarter of a 6 x 6 x 6 grid."""
    wins = 0
    for seed in range(5):
        rng, points, values = np.random.default_rng(seed), np.zeros((0, 3)), np.zeros(0)
        worth = lambda p: -((p - np.array([0.3, 0.8, 0.55])) ** 2).sum(1)
        while len(points) < 54:
            new = propose(points, values, 6, 3, rng)
            assert new.shape == (6, 3) and new.min() >= 0 and new.max() <= 1
            points, values = np.concatenate([points, new]), np.append(values, worth(new))
        grid = np.stack(np.meshgrid(*[np.linspace(0, 1, 6)] * 3), -1).reshape(-1, 3)
        wins += values.max() >= worth(grid).max()
    assert wins >= 4


def test_search_finds_the_planted_blend(spark):
    """Model b knows the truth, a misleads: the best trial weighs b over a, and beats even weights."""
    rng = np.random.default_rng(1)
    rows, truth = [], []
    for session in range(40):
        good = {int(x) for x in rng.choice(20, 3, replace=False)}
        truth.append((session, "orders", sorted(good)))
        for aid in range(20):
            b = 0.6 * (aid in good) + 0.5 * rng.random()
            rows += [("a", session, aid, int(aid in good), float(1.4 * rng.random() - 0.5 * (aid in good))), ("b", session, aid, int(aid in good), float(b))]
    scores = spark.createDataFrame(rows, "model string, session long, candidate_aid int, label int, score double")
    known = spark.createDataFrame(truth, "session long, type string, ground_truth array<int>")
    found = ensemble.search_ensemble_weights(scores, known, ["a", "b"], "orders", trials=16, batch=8, k=3).collect()
    best = max(found, key=lambda r: r["recall"])
    even = ensemble.tune_ensemble_weights(scores, known, [({"a": 1.0, "b": 1.0}, 1.0)], "orders", 3).first()["recall"]
    assert len(found) == 16 and best["b"] > best["a"] and best["recall"] > even + 0.1
    assert {tuple(r) for r in found} == {tuple(r) for r in ensemble.search_ensemble_weights(scores, known, ["a", "b"], "orders", trials=16, batch=8, k=3).collect()}
    one = ensemble.tune_ensemble_weights(scores, known, [({"a": best["a"], "b": best["b"]}, best["power"])], "orders", 3).first()["recall"]
    assert abs(one - best["recall"]) < 1e-12


def parity_sessions(spark, n=80, seed=2):
    """Rows are good if two features have one sign: no tree of depth 1 tells, one of depth 2 does."""
    rng, rows = np.random.default_rng(seed), []
    for session in range(n):
        x = rng.uniform(-1, 1, (20, 2))
        worth = (x[:, 0] * x[:, 1] > 0) + 0.3 * rng.standard_normal(20)
        hits = set(np.argsort(-worth)[:4])
        rows += [(session, i, int(i in hits), 1.0, [float(v) for v in x[i]]) for i in range(20)]
    df = spark.createDataFrame(rows, "session long, candidate_aid int, label int, weight double, f array<double>")
    return stored(df.select("session", "candidate_aid", "label", "weight", array_to_vector("f").alias("features")), "parity")


def test_going_on_later_adds_the_same_trees(spark):
    df = parity_sessions(spark)
    ready = boosting.prepare_boosting(df.where("session % 4 <> 0"), df.where("session % 4 = 0"))
    once, later = ready.model(0.3), ready.model(0.3)
    boosting.boost(ready, once, 4, depth=2)
    boosting.boost(ready, later, 1, depth=2)
    boosting.boost(ready, later, 4, depth=2)
    assert len(once.trees) == len(later.trees) == 4
    for a, b in zip(once.trees, later.trees, strict=True):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value, atol=1e-9)


def test_halving_finds_planted_depth_and_step(spark):
    """Depth 1 can't tell, small steps get nowhere in six rounds: the search ends on neither, gives
    most trials two rounds only, and its model beats both corners."""
    df = parity_sessions(spark)
    space = {"rate": (0.001, 0.5, "log"), "depth": (1, 3, "int")}
    found = search.search_model(df, space, trials=9, batch=9, rounds=6, eta=3, k=5)
    assert found.rungs == [2, 6]
    assert sorted(len(t.values) for t in found.trials) == [1] * 6 + [2] * 3
    assert found.params["depth"] >= 2 and len(found.model.trees) <= 6
    best = max(t.values[-1] for t in found.trials)
    assert best > max(t.values[-1] for t in found.trials if t.params["depth"] == 1) + 0.05
    table = found.table(spark).collect()
    assert len(table) == 9 and max(r["value"] for r in table) == best and {r["rounds"] for r in table} == {2, 6}
    again = search.search_model(df.repartition(7), space, trials=9, batch=9, rounds=6, eta=3, k=5)
    assert again.params == found.params and [t.values for t in again.trials] == [t.values for t in found.trials]


def test_nothing_to_search(spark):
    df = parity_sessions(spark, 6)
    for nothing in (df.where("session < 0"), df.withColumn("label", F.lit(0))):
        found = search.search_model(nothing, trials=2, batch=2, rounds=2)
        assert found.model is None and not found.trials and not found.table(spark).count()
