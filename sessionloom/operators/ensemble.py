"""Blends of models and stacking (M10-M16). Long scores: ``model, session, candidate_aid, label, score``."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.exprs import safe_div
from sessionloom.functions.parzen import propose
from sessionloom.functions.ranges import exact_medians
from sessionloom.sources.scratch import stored

from .ranking import group_folds, top_k

PAIR = ("session", "candidate_aid")


def min_max(scores: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Scores scaled to 0..1 per model (a row per model is joined back); a constant model gives 0."""
    ends = scores.groupBy(*by).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return scores.join(ends, list(by)).withColumn("score", safe_div(F.col("score") - F.col("lo"), F.col("hi") - F.col("lo"))).drop("lo", "hi")


def ensemble_weighted(scores: DataFrame, weights: dict[str, float], powers: dict[str, float] | float = 1.0, scale: bool = True) -> DataFrame:
    """M10 (M11: ``scale=False``): sum over models of weight * score^power per (session, aid, label)."""
    powers = powers if isinstance(powers, dict) else dict.fromkeys(weights, powers)
    pick = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in (kv[0], float(kv[1]))))[F.col("model")]
    rows = min_max(scores) if scale else scores
    rows = rows.where(F.col("model").isin(*weights)).withColumn("part", F.pow("score", pick(powers)) * pick(weights))
    return rows.groupBy(*PAIR, "label").agg(F.sum("part").alias("score"))


def ensemble_mean(runs: DataFrame, per_session: int | None = 30) -> DataFrame:
    """Best ``per_session`` of each session and retrieval run (None: all), then the mean per pair."""
    if per_session is not None:
        w = Window.partitionBy("model", "session").orderBy(F.desc("score"), "candidate_aid")
        runs = runs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_session)
    return runs.groupBy(*PAIR).agg(F.max("label").alias("label"), F.avg("score").alias("score"))


def ensemble_vote(submissions: DataFrame, weights: dict[str, float], k: int = 20) -> DataFrame:
    """``session_type, labels`` from ``model, session_type, labels``: votes summed by weight."""
    weight = F.create_map(*(F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))))[F.col("model")]
    votes = submissions.select("session_type", weight.alias("w"), F.explode(F.split("labels", " ")).alias("aid")).groupBy("session_type", F.col("aid").cast("int").alias("candidate_aid")).agg(F.round(F.sum("w"), 9).alias("score"))
    parts = F.split("session_type", "_")
    return top_k(votes.select(parts[0].cast("long").alias("session"), parts[1].alias("event"), "candidate_aid", "score"), k, key=("session", "event"))


def stacking_dataset(scores: DataFrame, models: list[str]) -> DataFrame:
    """One column of scaled scores per model, one row per (session, aid), from one grouping."""
    rows = min_max(scores)
    return rows.groupBy(*PAIR).agg(F.max("label").alias("label"), *(F.max(F.when(F.col("model") == m, F.col("score"))).alias(m) for m in models))


def stack_preprocess(df: DataFrame, cols: list[str], power: float = 4) -> DataFrame:
    """Null to the column's median, then the power."""
    medians = exact_medians(df, cols)
    return df.withColumns({c: F.pow(F.coalesce(F.col(c), F.lit(float(medians[c] or 0.0))), F.lit(float(power))) for c in cols})


def train_stacking(df: DataFrame, cols: list[str], folds: int = 2, seed: int = 0) -> list:
    """A balanced logistic regression per group fold (trained on the other folds)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = group_folds(df, folds, seed)
    pos, n = rows.agg(F.sum("label"), F.count("*")).first()
    balance = F.when(F.col("label") > 0, n / (2.0 * max(pos, 1))).otherwise(n / (2.0 * max(n - pos, 1)))
    rows = rows.withColumn("weight", balance)
    steps = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="stack_features"), LogisticRegression(featuresCol="stack_features", labelCol="label", weightCol="weight", regParam=1e-4)])
    return [steps.fit(rows.where(F.col("fold") != f)) for f in range(folds)]


def score_stacking(df: DataFrame, models: list) -> DataFrame:
    """Mean probability of the folds' models."""
    from pyspark.ml.functions import vector_to_array

    names = []
    for i, m in enumerate(models):
        df = m.transform(df).withColumn(f"p_{i}", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "stack_features")
        names.append(f"p_{i}")
    return df.select(*PAIR, "label", (reduce(lambda a, b: a + b, map(F.col, names)) / len(names)).alias("score"))


def tune_ensemble_weights(scores: DataFrame, truth: DataFrame, grid: list[tuple[dict[str, float], float]], event: str, k: int = 20) -> DataFrame:
    """``point, recall`` of each (weights, power) of the grid, all in one job: the scaled scores
    meet each grid point (a short list, written into the plan) and are grouped by point. Truths are
    sets, of 20 aids at most; a point without a hit has recall 0."""
    models = sorted({m for w, _ in grid for m in w})
    return _recalls(stacking_dataset(scores, models), truth, models, grid, event, k)


def _recalls(wide: DataFrame, truth: DataFrame, models: list[str], grid: list[tuple[dict[str, float], float]], event: str, k: int) -> DataFrame:
    """``point, recall`` of the grid's points on scaled scores, a column for each model."""
    terms = [F.struct(F.lit(i).alias("point"), reduce(lambda a, b: a + b, (F.coalesce(F.pow(F.col(m), F.lit(float(p))), F.lit(0.0)) * float(w.get(m, 0.0)) for m in models)).alias("score")) for i, (w, p) in enumerate(grid)]
    rows = wide.select(*PAIR, F.explode(F.array(*terms)).alias("x")).select(*PAIR, "x.*")
    w = Window.partitionBy("point", "session").orderBy(F.desc(F.round("score", 9)), "candidate_aid")
    best = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    hit = truth.where(F.col("type") == event).select("session", F.explode(F.array_distinct("ground_truth")).alias("candidate_aid"))
    gt = truth.where(F.col("type") == event).agg(F.sum(F.least(F.size(F.array_distinct("ground_truth")), F.lit(20)))).first()[0] or 0
    hits = best.join(hit, list(PAIR), "left_semi").groupBy("point").agg(F.count("*").alias("hits"))
    points = wide.sparkSession.range(len(grid)).select(F.col("id").cast("int").alias("point"))
    return points.join(hits, "point", "left").select("point", (F.coalesce("hits", F.lit(0)) / float(max(gt, 1))).alias("recall"))


def search_ensemble_weights(scores: DataFrame, truth: DataFrame, models: list[str], event: str, trials: int = 64, batch: int = 8, powers: tuple[float, float] = (0.5, 8.0), k: int = 20, seed: int = 0) -> DataFrame:
    """M16, sequentially: ``trial, <a weight for each model>, power, recall`` of ``trials`` points.

    Weights are searched in 0 .. 1 and the power on a log scale between ``powers``. Points come in
    batches from Parzen estimators over the trials before (``functions.parzen``), and a batch is
    one Spark job over scaled scores that are stored once. The same seed gives the same trials;
    without truths every recall is 0.
    """
    wide = stored(stacking_dataset(scores, models), "search-scores")
    rng, dims = np.random.default_rng(seed), len(models) + 1
    points, values = np.zeros((0, dims)), np.zeros(0)
    low, high = np.log(powers[0]), np.log(powers[1])
    while len(points) < trials:
        new = propose(points, values, min(batch, trials - len(points)), dims, rng)
        grid = [(dict(zip(models, map(float, p[:-1]), strict=True)), float(np.exp(low + p[-1] * (high - low)))) for p in new]
        got = {r["point"]: r["recall"] for r in _recalls(wide, truth, models, grid, event, k).collect()}  # a row for each point
        points, values = np.concatenate([points, new]), np.append(values, [got[i] for i in range(len(new))])
    rows = [(i, *map(float, p[:-1]), float(np.exp(low + p[-1] * (high - low))), float(v)) for i, (p, v) in enumerate(zip(points, values, strict=True))]
    return wide.sparkSession.createDataFrame(rows, "trial int, " + ", ".join(f"`{m}` double" for m in models) + ", power double, recall double")
