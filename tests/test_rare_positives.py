"""Queries of models on logs whose sessions hardly ever meet a truth, as large item ranges make them."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import ranking, search
from sessionloom.plans.queries import QUERIES

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rare(spark, tmp_path_factory):
    """Order lines that name a new item each, but for one customer, who always names the same."""
    d = tmp_path_factory.mktemp("rare")
    for t in Path(TABLES).iterdir():
        if t.name != "lineitem.parquet":
            os.symlink(t, d / t.name)
    orders = spark.read.parquet(f"{TABLES}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = spark.read.parquet(f"{TABLES}/lineitem.parquet").join(orders, "l_orderkey")
    one = lines.groupBy("o_custkey").count().orderBy(F.desc("count"), "o_custkey").first()["o_custkey"]
    item = F.when(F.col("o_custkey") == one, F.lit(7)).otherwise(100 + F.monotonically_increasing_id())
    lines.withColumn("l_partkey", item.cast("long")).drop("o_custkey").write.parquet(str(d / "lineitem.parquet"))
    return str(d)


def test_ranker_without_pairs_scores_zero(spark, rare):
    """No session of the frame has both a positive and a negative."""
    got = QUERIES["scores_of_ranker"](spark, rare).collect()
    assert sum(r["label"] for r in got) and {r["score"] for r in got} == {0.0}
    assert len(got) == QUERIES["scores_of_listwise"](spark, rare).count()


def test_search_without_trials_has_its_columns(spark, rare):
    got = QUERIES["searched_ranker"](spark, rare)
    assert got.columns == ["trial", "rate", "depth", "rounds", "best_round", "value"] and got.count() == 0


def test_ranker_of_no_rows_has_the_frames_features(spark):
    from pyspark.ml.feature import VectorAssembler

    rows = spark.createDataFrame([(1, i, 0, 1.0, float(i), 2.0) for i in range(3)], "session long, candidate_aid int, label int, weight double, x0 double, x1 double")
    frame = VectorAssembler(inputCols=["x0", "x1"], outputCol="features").transform(rows)
    got = ranking.score(frame, [ranking.train_ranker(frame.where("session = 0"), "ranker")]).collect()
    assert len(got) == 3 and {r["score"] for r in got} == {0.0}
    assert search.search_model(frame.where("session = 0"), {"rate": (0.1, 0.5, "log")}, trials=2, batch=2, rounds=2).table(spark).columns == ["trial", "rate", "rounds", "best_round", "value"]
