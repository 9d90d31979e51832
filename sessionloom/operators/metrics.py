"""Recall, AUC and exploration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.exprs import correlation_p_value
from sessionloom.functions.ranges import with_ranges
from sessionloom.sources.scratch import stored

#: Weights of the target events in the overall recall.
EVENT_WEIGHTS = {"clicks": 0.1, "carts": 0.3, "orders": 0.6}


def recall_at_k(pred: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (20,), cap: int = 20, base: str = "truth") -> DataFrame:
    """M7: ``type, k, hits, gt, recall, mean_recall`` by event and a row ``overall`` for each K.

    ``pred``: ``session_type, labels`` (space-joined); ``truth``: ``session, type, ground_truth``.
    A truth is a set: repeated aids count once, ``cap`` at most for every K. ``base="truth"``: sessions without predictions
    count with 0 hits; ``"pred"``: only sessions in both.
    """
    parts = F.split("session_type", "_")
    lists = pred.select(parts[0].cast("long").alias("session"), parts[1].alias("type"), F.split("labels", " ").cast("array<int>").alias("p"))
    both = truth.join(lists, ["session", "type"], "left" if base == "truth" else "inner").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    hits = F.coalesce(F.size(F.array_intersect(F.slice("p", 1, F.col("k")), "ground_truth")), F.lit(0))
    hits = F.when(F.col("p").isNull(), 0).otherwise(hits)
    rows = both.select("type", "k", hits.alias("h"), F.least(F.size(F.array_distinct("ground_truth")), F.lit(cap)).alias("g"))
    by = rows.groupBy("type", "k").agg(F.sum("h").alias("hits"), F.sum("g").alias("gt"), F.try_divide(F.sum("h"), F.sum("g")).alias("recall"), F.avg(F.try_divide("h", "g")).alias("mean_recall"))
    return _with_overall(by)


def _with_overall(by: DataFrame) -> DataFrame:
    """Rows by event, and the weighted row of all events for each K."""
    weight = F.create_map(*(F.lit(x) for kv in EVENT_WEIGHTS.items() for x in kv))[F.col("type")]
    overall = by.groupBy("k").agg(F.sum("hits").alias("hits"), F.sum("gt").alias("gt"), F.sum(weight * F.col("recall")).alias("recall"), F.sum(weight * F.col("mean_recall")).alias("mean_recall"))
    return by.unionByName(overall.select(F.lit("overall").alias("type"), "k", "hits", "gt", "recall", "mean_recall"))


def candidate_recall(long: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (20, 80, 140, 260), strategy_order: tuple[str, ...] = (), cap: int = 20) -> DataFrame:
    """M8: recall of all strategies' candidates in their order, with the mean and median number of
    distinct candidates up to K over all truths (``n_mean, n_median``; no candidates count as 0).
    Candidates without ``event`` serve all events. Each list meets its truths once; what is left
    after that are counts by event, K and number of candidates."""
    key = [c for c in ("session", "event") if c in long.columns]
    order = F.array_position(F.array(*map(F.lit, strategy_order)), F.col("strategy"))
    at = F.shiftleft(order.cast("long"), 32) + F.col("rank")
    first = long.select(*key, "candidate_aid", at.alias("x")).repartition("session").groupBy(*key, "candidate_aid").agg(F.min("x").alias("x"))
    lists = first.groupBy(*key).agg(F.slice(F.array_sort(F.collect_list(F.struct("x", "candidate_aid"))), 1, max(ks)).alias("x"))
    lists = lists.select(*key, F.transform("x", lambda s: s["candidate_aid"]).alias("p"))
    both = truth.withColumnRenamed("type", "event").join(lists.hint("merge"), key, "left").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    top = F.coalesce(F.slice("p", 1, F.col("k")), F.array().cast(lists.schema["p"].dataType))
    hits, gt = F.size(F.array_intersect(top, "ground_truth")), F.least(F.size(F.array_distinct("ground_truth")), F.lit(cap))
    rows = both.select(F.col("event").alias("type"), "k", hits.alias("h"), gt.alias("g"), F.size(top).alias("m"))
    share = F.try_divide("h", "g")
    counts = stored(rows.groupBy("type", "k", "m").agg(F.sum("h").alias("h"), F.sum("g").alias("g"), F.sum(share).alias("s"), F.count(share).alias("c"), F.count("*").alias("n")), "recall-counts")  # K rows at most for each event and K
    by = counts.groupBy("type", "k").agg(F.sum("h").alias("hits"), F.sum("g").alias("gt"), F.try_divide(F.sum("h"), F.sum("g")).alias("recall"), F.try_divide(F.sum("s"), F.sum("c")).alias("mean_recall"))
    sizes = counts.groupBy("k", "m").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("k").orderBy("m")
    sizes = sizes.withColumns({"upto": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy("k"))})
    middle = lambda at: F.min(F.when(F.col("upto") >= at, F.col("m")))
    half = (middle(F.floor((F.col("total") + 1) / 2)) + middle(F.floor(F.col("total") / 2) + 1)) / 2
    sizes = sizes.groupBy("k").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("n_mean"), half.alias("n_median"))
    return _with_overall(by).join(sizes, "k", "left").select("type", "k", "hits", "gt", "recall", "mean_recall", "n_mean", "n_median")


def auc(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """M9: ``roc_auc, pr_auc`` exactly, from cumulative counts over distinct scores (positives first
    summed per score, so ties count half; PR by average precision)."""
    per = scores.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) > 0, 0).otherwise(1)).alias("n"))
    # Running sums in two levels: within ranges of the score, then over the ranges' totals. The counts
    # are read three times, the scores behind them once.
    per = with_ranges(stored(per, "auc-counts"), "s")
    totals = per.groupBy("part").agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    up = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("tp").over(up), F.lit(0)).alias("p_before"), F.coalesce(F.sum("tn").over(up), F.lit(0)).alias("n_before"))
    w = Window.partitionBy("part").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = per.withColumns({"pc": F.sum("p").over(w), "nc": F.sum("n").over(w)}).join(totals, "part").withColumns({"pc": F.col("pc") + F.col("p_before"), "nc": F.col("nc") + F.col("n_before")})
    p, n = F.sum("p"), F.sum("n")
    area = F.sum(F.col("n") * (F.col("pc") - F.col("p") / 2))
    precision = F.sum(F.col("p") * F.try_divide(F.col("pc"), F.col("pc") + F.col("nc")))
    return run.agg(F.try_divide(area, p * n).alias("roc_auc"), F.try_divide(precision, p).alias("pr_auc"))


def point_biserial(df: DataFrame, label: str = "label", cols: list[str] | None = None) -> DataFrame:
    """``feature, r, t, n, p`` of each numeric column with the 0/1 label, one pass for all; ``p``:
    two-sided p-value of r."""
    cols = cols or [c for c, t in df.dtypes if c != label and t in ("int", "bigint", "double", "float")]
    stats = df.agg(*(F.struct(F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias("r"), F.count_if(F.col(c).isNotNull() & F.col(label).isNotNull()).alias("n")).alias(c) for c in cols))
    long = stats.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`.r").alias("r"), F.col(f"`{c}`.n").alias("n")) for c in cols))).alias("x")).select("x.*")
    t = F.col("r") * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), 1 - F.col("r") * F.col("r")))
    return long.select("feature", "r", t.alias("t"), "n", correlation_p_value(F.col("r"), F.col("n")).alias("p"))


def feature_histograms(df: DataFrame, cols: list[str], by: str = "label", bins: int = 50, log: bool = False) -> DataFrame:
    """``feature, group, bin, n, density``: equal bins between the feature's min and max."""
    value = lambda c: F.log2(0.001 + F.col(c)) if log else F.col(c).cast("double")
    long = df.select(F.col(by).cast("string").alias("group"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), value(c).alias("v")) for c in cols))).alias("x")).select("group", "x.*").where("v is not null")
    ends = long.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.least(F.floor(F.coalesce(F.try_divide((F.col("v") - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    counts = long.join(F.broadcast(ends), "feature").groupBy("feature", "group", place.alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))  # one row per feature
    total = F.sum("n").over(Window.partitionBy("feature", "group"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    return counts.select("feature", "group", "bin", "n", (F.col("n") / total / width).alias("density"))


def embedding_pca(embeddings: DataFrame, k: int = 2) -> DataFrame:
    """``aid, pc`` (array of k)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = embeddings.select("aid", array_to_vector(F.col("vector").cast("array<double>")).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="pc").fit(rows).transform(rows).select("aid", vector_to_array("pc").alias("pc"))
