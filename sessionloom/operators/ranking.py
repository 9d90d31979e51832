"""Training frames, rankers, scores and top-k lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.exprs import stable_hash
from sessionloom.sources.scratch import stored

from .boosting import train_boosted
from .candidates import downsample_negatives

KEYS = ("session", "candidate_aid", "label", "event", "fold", "weight")


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if c not in KEYS and t in ("int", "bigint", "double", "float", "smallint", "tinyint")]


def training_frame(combined: DataFrame, event: str, folds: list[int], pos_weight: float = 10, ratio: float | None = None, seed: int = 0) -> DataFrame:
    """M1: rows of the event and folds with ``weight`` (positives ``pos_weight``) and the feature
    vector; ``ratio`` downsamples negatives (validation)."""
    from pyspark.ml.feature import VectorAssembler

    rows = combined.where((F.col("event") == event) & F.col("fold").isin(folds))
    if ratio is not None:
        rows = downsample_negatives(rows, ratio, seed)
    rows = rows.withColumn("weight", F.when(F.col("label") > 0, float(pos_weight)).otherwise(1.0))
    return VectorAssembler(inputCols=feature_columns(combined), outputCol="features", handleInvalid="keep").transform(rows)


def train_ranker(df: DataFrame, algo: str = "classifier", params: dict | None = None):
    """M2: a model on ``features, label, weight``.

    ``classifier`` and ``regressor``: gradient-boosted trees on single rows. ``ranker``: a pairwise
    objective within sessions (``session_pairs``), a logistic regression on differences of features
    without an intercept, so that its score orders the rows of a session; without a session that has
    both a positive and a negative there is nothing to learn, and it scores 0. ``boosted``: trees
    boosted on a listwise loss of the session (``boosting.train_boosted``), with early stopping on
    NDCG or MAP if ``params`` has a ``validation`` frame. Other names are an error.
    """
    if algo == "boosted":
        return train_boosted(df, **(params or {}))
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.regression import GBTRegressor

    if algo == "ranker":
        model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", fitIntercept=False, **({"maxIter": 50, "regParam": 1e-3} | (params or {})))
        pairs = stored(session_pairs(df), "ranker-pairs")
        return model.fit(_tie(df) if pairs.isEmpty() else pairs)
    kinds = {"classifier": GBTClassifier, "regressor": GBTRegressor}
    if algo not in kinds:
        raise ValueError(f"unknown algo {algo!r}: classifier, regressor, ranker or boosted")
    return kinds[algo](featuresCol="features", labelCol="label", weightCol="weight", **({"maxIter": 20, "maxDepth": 4, "seed": 1} | (params or {}))).fit(df)


def session_pairs(df: DataFrame, seed: int = 0) -> DataFrame:
    """``features`` (differences), ``label``, ``weight`` of pairs of a positive and a negative of one
    session. Each negative meets one positive, dealt by a hash, and each pair stands for itself
    or, turned round, for its opposite: as many pairs as negatives, never all of a session's."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    key = [c for c in ("event", "session") if c in df.columns]
    rows = df.select(*key, "candidate_aid", "label", "weight", vector_to_array("features").alias("x"), stable_hash(*key, "candidate_aid", seed=seed).alias("h"))
    counted = rows.withColumn("positives", F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).over(Window.partitionBy(*key))).where("positives > 0")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("h", "candidate_aid")) - 1
    positive = counted.where("label > 0").withColumn("slot", place).select(*key, "slot", F.col("x").alias("up"), F.col("weight").alias("pair_weight"))
    negative = counted.where("label <= 0").withColumn("slot", F.pmod(F.col("h"), F.col("positives")))
    # Merged: positives are as many as sessions, and Spark would send them to the driver by their compressed size.
    pairs = negative.join(positive.hint("merge"), [*key, "slot"])
    turned = F.pmod(F.shiftright("h", 20), F.lit(2))
    difference = F.zip_with("up", "x", lambda a, b: a - b)
    signed = F.when(turned == 0, difference).otherwise(F.transform(difference, lambda d: -d))
    return pairs.select(array_to_vector(signed).alias("features"), (1 - turned).cast("double").alias("label"), F.col("pair_weight").alias("weight"))


def _tie(df: DataFrame) -> DataFrame:
    """One pair of equal rows, both ways round: all it teaches is coefficients of 0."""
    from pyspark.ml.linalg import Vectors

    dims = df.schema["features"].metadata.get("ml_attr", {}).get("num_attrs")
    if dims is None:
        some = df.select("features").first()
        dims = some["features"].size if some else 1
    return df.sparkSession.createDataFrame([(Vectors.dense([0.0] * dims), label, 1.0) for label in (0.0, 1.0)], ["features", "label", "weight"])


def model_importances(models: list, columns: list[str]) -> list[tuple[str, int, float]]:
    """``(feature, fold, importance)`` of boosted trees, for ``importance_summary``: as many rows as
    features times models."""
    return [(c, i, float(x)) for i, m in enumerate(models) for c, x in zip(columns, m.featureImportances.toArray(), strict=True)]


def group_folds(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """M3: ``fold``: all rows of a session in one; sessions with and without positives are dealt apart."""
    has = F.max("label").over(Window.partitionBy("session"))
    return df.withColumn("fold", F.pmod(stable_hash("session", has.cast("string"), seed=seed), F.lit(k)).cast("int"))


def balanced_folds(df: DataFrame, k: int, seed: int = 0, key: tuple[str, ...] = ("session",)) -> DataFrame:
    """M3: ``fold``, evenly: sessions are ordered by positives, then rows (most first), then a hash,
    and dealt to the folds forth and back, so that folds differ by one session at most, in positives
    by one session's, and in rows by one session's for each number of positives.

    The order is found in two levels: places within (positives, rows, range of the hash), then
    running sums over those classes, so that no task orders all sessions.
    """
    h = stable_hash(*key, seed=seed)
    each = df.groupBy(*key).agg(F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("_p"), F.count("*").alias("_n"))
    each = each.withColumn("_h", h).withColumn("_part", F.shiftright("_h", 50))
    order = [F.desc("_p"), F.desc("_n"), "_part"]
    sizes = each.groupBy("_p", "_n", "_part").agg(F.count("*").alias("_m"))
    # Running sums over (positives, rows) first, a row each; then within each of them.
    classes = sizes.groupBy("_p", "_n").agg(F.sum("_m").alias("_m"))
    earlier = lambda w: F.coalesce(F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = classes.select("_p", "_n", earlier(Window.orderBy(*order[:2])).alias("_before"))
    sizes = sizes.select("_p", "_n", "_part", earlier(Window.partitionBy("_p", "_n").orderBy("_part")).alias("_within")).join(classes, ["_p", "_n"])
    place = F.row_number().over(Window.partitionBy("_p", "_n", "_part").orderBy("_h", *key)) - 1
    turn = F.pmod(F.col("_place") + F.col("_within") + F.col("_before"), F.lit(2 * k))
    folds = each.withColumn("_place", place).join(sizes, ["_p", "_n", "_part"]).select(*key, F.least(turn, F.lit(2 * k - 1) - turn).cast("int").alias("fold"))
    return df.join(folds.hint("merge"), list(key))  # a row for each session: merged, never sent to the driver


def score(df: DataFrame, models: list, decimals: int | None = 3) -> DataFrame:
    """M4: ``session, candidate_aid, label, score``: mean of the models' predictions (of a pairwise
    ranker its margin: a probability of a single row would run into 1 and tie)."""
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.functions import vector_to_array

    names = []
    for i, m in enumerate(models):
        pairwise = isinstance(m, LogisticRegressionModel) and not m.getFitIntercept()
        df = m.transform(df)
        source = "rawPrediction" if pairwise else "probability" if "probability" in df.columns else None
        df = df.withColumn(f"score_{i}", vector_to_array(source)[1] if source else F.col("prediction")).drop("probability", "rawPrediction", "prediction")
        names.append(f"score_{i}")
    mean = reduce(lambda a, b: a + b, map(F.col, names)) / len(names)
    return df.select("session", "candidate_aid", "label", (F.round(mean, decimals) if decimals is not None else mean).alias("score"))


def top_k(scores: DataFrame, k: int = 20, event: str | tuple[str, ...] | None = None, key: tuple[str, ...] = ("session",)) -> DataFrame:
    """M5: ``session_type, labels``: the k best aids, space-joined (ties by aid). Several events share
    a list, which is made once."""
    w = Window.partitionBy(*key).orderBy(F.desc("score"), "candidate_aid")
    best = scores.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    lists = best.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("r", "candidate_aid"))).alias("x"))
    names = (event,) if isinstance(event, str) else event
    name = F.explode(F.array(*map(F.lit, names))) if names else F.col("event")
    lists = lists.select("session", F.array_join(F.transform("x", lambda s: s["candidate_aid"].cast("string")), " ").alias("labels"), name.alias("event"))
    return lists.select(F.concat_ws("_", F.col("session").cast("string"), "event").alias("session_type"), "labels")


def make_submission(*parts: DataFrame) -> DataFrame:
    """M6: union of the events' lists."""
    return reduce(DataFrame.unionByName, parts)


def tune_model(df: DataFrame, param_grid: list[dict], folds: int = 3, seed: int = 0):
    """Cross-validated search over parameters of boosted trees; sessions stay in one fold."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator

    model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", seed=1)
    maps = [{model.getParam(n): v for n, v in p.items()} for p in param_grid]
    cv = CrossValidator(estimator=model, estimatorParamMaps=maps, evaluator=BinaryClassificationEvaluator(), numFolds=folds, foldCol="fold")
    return cv.fit(group_folds(df, folds, seed))


def importance_summary(df: DataFrame) -> DataFrame:
    """Per ``feature`` min, median, max and standard deviation of ``importance``."""
    return df.groupBy("feature").agg(F.min("importance").alias("min"), F.median("importance").alias("median"), F.max("importance").alias("max"), F.stddev_samp("importance").alias("std"))


def active_sessions(rows: DataFrame, min_labels: int = 5) -> DataFrame:
    """Rows of sessions with more than ``min_labels`` positives."""
    return rows.withColumn("hits", F.sum("label").over(Window.partitionBy("session"))).where(F.col("hits") > min_labels).drop("hits")
