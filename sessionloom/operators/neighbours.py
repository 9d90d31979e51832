"""Query items and nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.sources.scratch import stored

from .events import TIE, with_position
from .vector_index import BLOCK_ITEMS, BLOCK_QUERIES, ROOM, nearest, prepared, scores, search

#: Blocks of queries that small inputs are cut into, so that they run in parallel.
LEAST_BLOCKS, SMALL_BLOCK = 16, 64


def query_items(prepared: DataFrame, tie: tuple[str, ...] = TIE) -> DataFrame:
    """``session`` and the five aids that stand for it: the last, and those with the largest
    sums of recency, weighted recency, duration and weighted duration (ties: the larger aid)."""
    per = prepared.groupBy("session", "aid").agg(
        F.max("pos").alias("pos"),
        *(F.round(F.sum(c), 9).alias(c) for c in ("log_recency_score", "type_weighted_log_recency_score", "log_duration_second", "type_weighted_log_duration_second")),
    )
    best = lambda c: F.max_by("aid", F.struct(c, "aid"))
    return per.groupBy("session").agg(
        best("pos").alias("last_aid"),
        best("log_recency_score").alias("max_recency_aid"),
        best("type_weighted_log_recency_score").alias("max_weighted_recency_aid"),
        best("log_duration_second").alias("max_duration_aid"),
        best("type_weighted_log_duration_second").alias("max_weighted_duration_aid"),
    )


def _nearest(n: int, metric: str):
    """Per block of items: the n nearest of each query (score: smaller is nearer)."""

    def run(table: pa.Table) -> pa.Table:
        kind = np.asarray(table.column("is_query"))
        ids = np.asarray(table.column("id"))
        vec = prepared(np.stack(table.column("vector").to_numpy(zero_copy_only=False)).astype(np.float64), metric)
        items, queries = np.flatnonzero(~kind), np.flatnonzero(kind)
        out_q, out_a, out_s = [], [], []
        x = vec[items]
        step = max(1, min(256, ROOM // max(1, len(items))))
        for lo in range(0, len(queries), step):
            score = scores(vec[queries[lo : lo + step]], x, metric)
            for i, row in enumerate(score):
                near = nearest(row, ids[items], n)
                out_q.append(np.full(len(near), ids[queries[lo + i]]))
                out_a.append(ids[items[near]])
                out_s.append(row[near])
        cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0, t))
        return pa.table({"query": cat(out_q, np.int64), "aid": cat(out_a, np.int64), "distance": cat(out_s, np.float64)})

    return run


def knn_by_vector(queries: DataFrame, embeddings: DataFrame, n: int, metric: str = "euclidean", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``query, aid, distance, rank``: the exact n nearest items of each row of ``queries (query, vector)``.

    Items that fit a block are compared with all queries, block of queries by block; more items are
    filed in cells, of which a query visits those that may hold one of its n nearest
    (``vector_index``), with the same result. ``metric``: euclidean, or cosine (angular order).
    Ties go by aid; ranks from 0.
    """
    items = embeddings.where("vector is not null").select(F.col("aid").cast("long").alias("id"), F.col("vector").cast("array<double>"))
    asks = stored(queries.where("vector is not null").select(F.col("query").cast("long").alias("id"), F.col("vector").cast("array<double>")), "knn-queries")
    if items.count() > block_items:
        near = search(asks, items, n, metric, block_items=block_items).where("query is not null")
    else:
        asked = asks.count()
        blocks = max(1, -(-asked // BLOCK_QUERIES), min(LEAST_BLOCKS, -(-asked // SMALL_BLOCK)))
        left = items.select("id", "vector", F.lit(False).alias("is_query"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
        right = asks.select("id", "vector", F.lit(True).alias("is_query"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"))
        near = left.unionByName(right).groupBy("b").applyInArrow(_nearest(n, metric), "query long, aid long, distance double")
    w = Window.partitionBy("query").orderBy("distance", "aid")
    return near.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < n)


def knn_by_item(queries: DataFrame, embeddings: DataFrame, n: int, metric: str = "euclidean", drop_self: bool = True) -> DataFrame:
    """``session, candidate_aid, rank`` for ``queries (session, aid)``: neighbours of the
    query's item, without it if ``drop_self``. Distinct items are searched once."""
    wanted = queries.select("aid").distinct().join(embeddings, "aid").select(F.col("aid").alias("query"), "vector")
    near = knn_by_vector(wanted, embeddings, n + int(drop_self), metric)
    if drop_self:
        near = near.where("aid <> query")
    w = Window.partitionBy("query").orderBy("distance", "aid")
    near = near.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < n)
    return queries.select("session", F.col("aid").alias("query")).join(near, "query").select("session", F.col("aid").cast("int").alias("candidate_aid"), "rank")


def last_carted_query(events: DataFrame, tie: tuple[str, ...] = TIE) -> DataFrame:
    """C20: ``session, aid``: the last carted aid, else the last aid."""
    pos = with_position(events, tie)
    return pos.groupBy("session").agg(F.coalesce(F.max_by("aid", F.when(F.col("type") == 1, F.col("pos"))), F.max_by("aid", "pos")).alias("aid"))


def mean_cart_vector(events: DataFrame, embeddings: DataFrame, last: int = 3, tie: tuple[str, ...] = TIE) -> DataFrame:
    """``query`` (the session), ``vector``: mean vector of the last carted aids (``last`` at
    most), else the last aid's. Sessions whose aids have no vector are left out."""
    pos = with_position(events, tie).withColumn("cart", F.col("type") == 1)
    some = pos.withColumn("has_cart", F.max(F.col("cart").cast("int")).over(Window.partitionBy("session")))
    chosen = some.where("cart or (has_cart = 0 and pos = n)")
    w = Window.partitionBy("session").orderBy(F.desc("pos"))
    chosen = chosen.withColumn("r", F.row_number().over(w)).where(F.col("r") <= last)
    # A few vectors of a session are averaged as arrays: exploded, they would be a row for each number.
    got = chosen.join(embeddings, "aid").groupBy("session").agg(F.collect_list("vector").alias("vs"))
    here = lambda i: F.filter(F.transform("vs", lambda v: F.get(v, i).cast("double")), lambda x: x.isNotNull())
    mean = lambda x: F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, b: a + b), F.size(x))
    places = F.array_max(F.transform("vs", F.size))
    return got.where(places > 0).select(F.col("session").alias("query"), F.transform(F.sequence(F.lit(0), places - 1), lambda i: mean(here(i))).alias("vector"))


def knn_budget(events: DataFrame, embeddings: DataFrame, n: int, history_cap: int = 20, metric: str = "euclidean", tie: tuple[str, ...] = TIE) -> DataFrame:
    """Neighbours of the last aid, n less the session's distinct aids (``history_cap`` at most)."""
    last = with_position(events, tie).groupBy("session").agg(F.max_by("aid", "pos").alias("aid"), F.least(F.count_distinct("aid"), F.lit(history_cap)).alias("used"))
    near = knn_by_item(last.select("session", "aid"), embeddings, n, metric)
    return near.join(last.select("session", "used"), "session").where(F.col("rank") < n - F.col("used")).drop("used")


def train_item_embeddings(events: DataFrame, size: int = 32, seed: int = 1, tie: tuple[str, ...] = TIE) -> DataFrame:
    """Item vectors by Word2Vec over the sessions' aid sequences."""
    from pyspark.ml.feature import Word2Vec

    order = F.struct("pos", F.col("aid").cast("string").alias("item"))
    paths = with_position(events, tie).groupBy("session").agg(F.array_sort(F.collect_list(order)).alias("x")).select(F.transform("x", lambda s: s["item"]).alias("path"))
    model = Word2Vec(vectorSize=size, minCount=1, seed=seed, inputCol="path", outputCol="v").fit(paths)
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select(F.col("word").cast("int").alias("aid"), vector_to_array("vector", "float32").alias("vector"))


def train_factors(events: DataFrame, size: int = 32, seed: int = 1) -> DataFrame:
    """Item factors by ALS on event counts."""
    from pyspark.ml.recommendation import ALS

    counts = events.groupBy(F.col("session").cast("int").alias("user"), F.col("aid").cast("int").alias("item")).agg(F.count("*").cast("float").alias("rating"))
    model = ALS(rank=size, implicitPrefs=True, seed=seed, userCol="user", itemCol="item", ratingCol="rating").fit(counts)
    return model.itemFactors.select(F.col("id").alias("aid"), F.col("features").alias("vector"))
