"""Hand-made frames and properties of the session operators."""

import pytest
from pyspark.sql import functions as F

from sessionloom.functions.exprs import safe_div, ts_parts
from sessionloom.operators import candidates, covisit, ensemble, events, features, metrics, neighbours, popular, ranking
from sessionloom.sources import tables

EVENT = "session long, aid int, ts long, type int"


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, 10, 100, 0), (2, 10, 0, 0), (2, 11, 90_000, 1), (3, 5, 1, 0), (3, 5, 2, 1), (3, 6, 3, 2)]
    rows += [(4, 100 + i, i, 0) for i in range(20)] + [(5, 100 + i, i, i % 3) for i in range(21)]
    return spark.createDataFrame(rows, EVENT)


def test_prepare_events_worked_example(spark):
    df = spark.createDataFrame([(1, 7, 0, 0), (1, 8, 60, 1), (1, 7, 90_000, 2)], EVENT)
    got = events.prepare_events(df).orderBy("pos").collect()
    assert [r["action_num_reverse_chrono"] for r in got] == [3, 2, 1]
    assert [r["duration_second"] for r in got] == [60, 0, 0]
    assert [r["oneday_session"] for r in got] == [0, 1, 1]
    assert [round(r["log_recency_score"], 4) for r in got] == [0.0718, 0.4641, 1.0]
    assert [round(r["type_weighted_log_recency_score"], 4) for r in got] == [0.0718, 2.7845, 3.0]


def test_single_event_session(small):
    r = events.prepare_events(small).where("session = 1").first()
    assert (r["log_recency_score"], r["duration_second"], r["oneday_session"]) == (1.0, 0, 0)


def test_split_reunites(small):
    a, b = events.random_cutoff_split(small, seed=1)
    assert sorted(a.unionByName(b).collect()) == sorted(small.where("session <> 1").collect())
    assert a.select("session").distinct().count() == b.select("session").distinct().count() == 4
    truth = events.ground_truth(b)
    assert truth.agg(F.sum(F.size("ground_truth"))).first()[0] == b.count()


def test_folds_are_even(spark):
    df = spark.range(500).select(F.col("id").alias("session"), F.lit(1).alias("aid"), F.lit(0).cast("long").alias("ts"), (F.col("id") % 3).cast("int").alias("type"))
    got = events.assign_stratified_folds(df, 5, exact=True)
    counts = [r["count"] for r in got.groupBy("class", "fold").count().collect()]
    assert got.count() == 500 and max(counts) - min(counts) <= 1
    assert {r["fold"] for r in events.assign_stratified_folds(df, 5).collect()} <= set(range(5))


def test_time_shift(spark):
    r = ts_parts(spark.createDataFrame([(79_200,)], "ts long")).first()
    assert (r["hour"], r["weekday"], r["date"], r["datehour"]) == (0, 4, "1970-01-02", "1970-01-02 00:00:00")


def test_thresholds_of_history(small):
    def order(session, **kw):
        return [r["candidate_aid"] for r in covisit.past_aids(small, **kw).where(f"session = {session}").orderBy("rank").collect()]

    recent = [119 - i for i in range(20)]
    assert order(4, inclusive=False) == recent and order(4, type_weights={0: 1.0, 1: 1.0, 2: 1.0}) == recent
    assert order(5, inclusive=False)[0] == 119 and len(order(5)) == 20  # carts weigh most
    assert order(3) == [6, 5]


def test_safe_div(spark):
    got = spark.sql("select cast(1 as double) a, cast(0 as double) b, cast(null as double) c").select(safe_div("a", "b"), safe_div("c", "b"), safe_div("c", "a"), safe_div("a", "a")).first()
    assert list(got) == [0.0, None, None, 1.0]


def test_popular_ranks_all_aids(small):
    got = {r["event"]: r for r in popular.popular(small).collect()}
    assert got["carts"]["ranks"] == list(range(1, 21)) and len(got["carts"]["labels"]) == 20
    assert {r["event"]: r["labels"] for r in popular.attach_popular(small, popular.popular(small)).where("session = 1").collect()} == {e: r["labels"] for e, r in got.items()}


def test_covisit_drops_known_after_the_cut(spark):
    e = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 1, 0)], EVENT)
    table = spark.createDataFrame([(1, 2, 9.0), (1, 3, 5.0), (2, 3, 4.0), (2, 4, 1.0)], "aid_x int, aid_y int, wgt float")
    got = covisit.covisit_clicks(e, table, n=2, with_history=False)
    assert [r["candidate_aid"] for r in got.orderBy("rank").collect()] == [3, 4] or [r["candidate_aid"] for r in got.collect()] == [3]
    full = covisit.covisit_clicks(e, table, n=3)
    assert [r["candidate_aid"] for r in full.orderBy("rank").collect()] == [2, 1, 3, 4]


def test_backfill_has_no_repeats(small):
    t = {k: covisit.build_covisitation(small) for k in ("clicks", "carts_orders", "buy2buy")}
    got = covisit.suggest_with_backfill(small, "carts", t, popular.popular(small), n=25)
    assert got.groupBy("session", "candidate_aid").count().where("count > 1").isEmpty()
    assert got.groupBy("session").count().where("count > 25").isEmpty()


def test_knn_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    emb = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "aid int, vector array<float>")
    q = spark.createDataFrame([(9, 3), (8, 3), (7, 40)], "session long, aid int")
    for metric in ("euclidean", "cosine"):
        got = {}
        for r in neighbours.knn_by_item(q, emb, 5, metric).orderBy("rank").collect():
            got.setdefault(r["session"], []).append(r["candidate_aid"])
        for s, a in ((9, 3), (8, 3), (7, 40)):
            x = v.astype(float)
            d = ((x - x[a]) ** 2).sum(1) if metric == "euclidean" else 1 - x @ x[a] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[a])
            assert got[s] == [i for i in np.argsort(d, kind="stable") if i != a][:5]


def test_rows_default_rank_and_labels(spark):
    long = spark.createDataFrame([(1, "clicks", "a", 7, 0), (1, "clicks", "a", 8, 1), (1, "clicks", "b", 8, 0)], "session long, event string, strategy string, candidate_aid int, rank int")
    truth = spark.createDataFrame([(1, "clicks", [8, 8, 9])], "session long, type string, ground_truth array<int>")
    rows = candidates.label_candidates(candidates.candidate_rows(long, ["a", "b"]), truth)
    got = {r["candidate_aid"]: (r["rank_a"], r["rank_b"], r["retrieval_b"], r["label"]) for r in rows.collect()}
    assert got == {7: (0, 1, 0, 0), 8: (1, 0, 1, 1)}
    extra = candidates.sample_negatives_per_session(rows, 1, include_all_truth=truth)
    assert {(r["candidate_aid"], r["label"]) for r in extra.collect()} == {(7, 0), (8, 1), (9, 1)}


def test_downsampling_is_exact(spark):
    rows = spark.range(1000).select(F.col("id").alias("session"), F.lit(1).alias("candidate_aid"), (F.col("id") < 20).cast("int").alias("label"))
    got = candidates.downsample_negatives(rows, 10, exact=True)
    assert (got.where("label = 1").count(), got.where("label = 0").count()) == (20, 200)


def test_recall_edges(spark):
    truth = spark.createDataFrame([(1, "clicks", [5]), (2, "clicks", list(range(25))), (3, "clicks", [1])], "session long, type string, ground_truth array<int>")
    pred = spark.createDataFrame([("1_clicks", "5 6"), ("2_clicks", " ".join(map(str, range(20)))), ("9_clicks", "1")], "session_type string, labels string")
    got = {r["type"]: r for r in metrics.recall_at_k(pred, truth).collect()}
    assert (got["clicks"]["hits"], got["clicks"]["gt"]) == (21, 22)
    assert {r["type"]: r["gt"] for r in metrics.recall_at_k(pred, truth, base="pred").collect()}["clicks"] == 21


def test_recall_takes_truth_as_a_set(spark):
    truth = spark.createDataFrame([(1, "clicks", [5, 5, 5, 6]), (2, "clicks", [7, 7])], "session long, type string, ground_truth array<int>")
    pred = spark.createDataFrame([("1_clicks", "5 9"), ("2_clicks", "8")], "session_type string, labels string")
    got = {r["type"]: r for r in metrics.recall_at_k(pred, truth).collect()}["clicks"]
    assert (got["hits"], got["gt"], got["recall"], got["mean_recall"]) == (1, 3, 1 / 3, 0.25)
    long = spark.createDataFrame([(1, "clicks", "a", 5, 0), (1, "clicks", "b", 5, 0), (1, "clicks", "b", 9, 1)], "session long, event string, strategy string, candidate_aid int, rank int")
    got = {(r["type"], r["k"]): r for r in metrics.candidate_recall(long, truth, (1, 20), ("a", "b")).collect()}
    assert got["clicks", 20]["gt"] == 3 and (got["clicks", 1]["n_mean"], got["clicks", 20]["n_mean"], got["clicks", 20]["n_median"]) == (0.5, 1.0, 1.0)
    scores = spark.createDataFrame([(m, 1, a, 0, s) for m, a, s in (("a", 5, 1.0), ("a", 9, 0.0), ("b", 5, 0.0), ("b", 9, 1.0))], "model string, session long, candidate_aid int, label int, score double")
    points = ensemble.tune_ensemble_weights(scores, truth, [({"a": 1.0, "b": 0.0}, 1), ({"a": 0.0, "b": 1.0}, 1)], "clicks", 1)
    assert dict(points.collect()) == {0: 1 / 3, 1: 0.0}  # a point without a hit stays


def test_backfill_of_few_and_many(spark):
    few = [(1, 10, 0, 0), (1, 11, 1, 1)]
    many = [(2, 100 + i, i, 1 if i == 3 else 0) for i in range(20)]
    e = spark.createDataFrame(few + many, EVENT)
    table = spark.createDataFrame([(11, 12, 5.0), (10, 12, 5.0), (10, 13, 9.0), (103, 500, 1.0), (100, 501, 1.0)], "aid_x int, aid_y int, wgt float")
    top = spark.createDataFrame([(x, [12, 77]) for x in ("clicks", "carts", "orders")], "event string, labels array<int>")
    tables_ = dict.fromkeys(("clicks", "carts_orders", "buy2buy"), table)

    def listed(event, session, **kw):
        return [r["candidate_aid"] for r in covisit.suggest_with_backfill(e, event, tables_, top, **kw).where(f"session = {session}").orderBy("rank").collect()]

    assert listed("clicks", 1) == [11, 10, 12, 13, 77]
    assert listed("clicks", 1, dedup=False) == [11, 10, 12, 13, 12, 77]
    assert listed("clicks", 1, n=3) == [11, 10, 12]
    assert set(listed("clicks", 2)) == {100 + i for i in range(20)}  # many: no popular aids
    carts = listed("carts", 2)
    assert carts[0] == 103 and set(carts) == {100 + i for i in range(20)} | {500, 501}  # light aids' neighbours join
    assert set(listed("orders", 2)) == {100 + i for i in range(20)} | {500}


def test_exact_medians(spark):
    import statistics

    from sessionloom.functions.ranges import exact_medians

    xs = [(float(i * i % 997), i % 7, None if i % 3 else float(-i)) for i in range(1500)]
    df = spark.createDataFrame(xs, "a double, b int, c double").withColumn("d", F.lit(None).cast("double"))
    want = [statistics.median(x for x in col if x is not None) for col in zip(*xs, strict=True)]
    assert exact_medians(df, ["a", "b", "c", "d"]) == {"a": want[0], "b": want[1], "c": want[2], "d": None}
    assert exact_medians(df.limit(0), ["a"]) == {"a": None}


def test_auc_of_any_scale(spark):
    rows = [(float(i) * 1e6, int(i % 3 == 0)) for i in range(300)] + [(5.0, 1), (5.0, 0)]
    got = metrics.auc(spark.createDataFrame(rows, "score double, label int")).first()
    pos, neg = [s for s, x in rows if x], [s for s, x in rows if not x]
    assert abs(got["roc_auc"] - sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)) < 1e-12


def test_pairwise_ranker(spark):
    from pyspark.ml.feature import VectorAssembler

    rows = [(s, a, int(a == s % 6), 1.0, float(s * 100 + (a == s % 6)), float(a)) for s in range(60) for a in range(6)]  # the level of a session says nothing
    df = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(spark.createDataFrame(rows, "session long, candidate_aid int, label int, weight double, x double, y double"))
    assert ranking.session_pairs(df).count() == 300
    top = ranking.top_k(ranking.score(df, [ranking.train_ranker(df, "ranker")], None), 1, "orders").collect()
    assert {r["session_type"]: r["labels"] for r in top} == {f"{s}_orders": str(s % 6) for s in range(60)}
    with pytest.raises(ValueError, match="unknown algo"):
        ranking.train_ranker(df, "listwise")


def test_importances_of_trees(spark):
    df = spark.range(200).select(F.col("id").alias("session"), F.lit(1).alias("candidate_aid"), (F.col("id") % 4 == 0).cast("int").alias("label"), F.lit("orders").alias("event"), (F.col("id") % 2).cast("int").alias("fold"), (F.col("id") % 4).cast("double").alias("f1"), F.lit(1.0).alias("f2"))
    frame = ranking.training_frame(df, "orders", [0, 1])
    models = [ranking.train_ranker(frame.where(F.col("fold") == f), params={"maxIter": 2}) for f in (0,)]
    rows = spark.createDataFrame(ranking.model_importances(models, ranking.feature_columns(df)), "feature string, fold int, importance double")
    got = {r["feature"]: r["max"] for r in ranking.importance_summary(rows).collect()}
    assert got == {"f1": 1.0, "f2": 0.0}


def test_out_of_fold_encoding(spark):
    df = spark.createDataFrame([("x", 0, 1), ("x", 1, 0), ("x", 1, 1), ("y", 0, 1)], "k string, fold int, label int")
    enc = features.target_encoding(df, "k", "fold")
    got = {(r["k"], r["fold"]): r["encoded"] for r in enc.collect()}
    assert got == {("x", 0): 0.5, ("x", 1): 1.0, ("y", 0): 0.75, ("global_mean", None): 0.75}
    assert features.apply_target_encoding(df, enc, "k", "fold").where("k_te is null").isEmpty()


def test_embedding_without_vector(spark):
    rows = spark.createDataFrame([(1, 2, 3)], "session long, candidate_aid int, last_event_in_session_aid int")
    emb = spark.createDataFrame([(3, [3.0, 4.0])], "aid int, vector array<float>")
    r = features.embedding_distances(rows, emb).first()
    assert r["word2vec_last_event_cosine_distance"] is None and r["word2vec_last_event_euclidean_distance"] == 5.0


def test_models_and_stacking(spark):
    df = spark.range(400).select(
        F.col("id").alias("session"), F.lit(1).alias("candidate_aid"), (F.col("id") % 4 == 0).cast("int").alias("label"), F.lit("orders").alias("event"), (F.col("id") % 2).cast("int").alias("fold"), (F.col("id") % 4).cast("double").alias("f1"), (F.col("id") % 7).cast("double").alias("f2")
    )
    frame = ranking.training_frame(df, "orders", [0, 1])
    models = [ranking.train_ranker(frame, params={"maxIter": 3}), ranking.train_ranker(frame, "regressor", {"maxIter": 3})]
    scores = ranking.score(frame, models)
    assert metrics.auc(scores).first()["roc_auc"] == 1.0
    parts = [scores.select(F.lit(m).alias("model"), "session", "candidate_aid", "label", (F.col("score") * w).alias("score")) for m, w in (("a", 1.0), ("b", 0.5))]
    wide = ensemble.stack_preprocess(ensemble.stacking_dataset(parts[0].unionByName(parts[1]), ["a", "b"]), ["a", "b"])
    out = ensemble.score_stacking(wide, ensemble.train_stacking(wide, ["a", "b"]))
    assert metrics.auc(out).first()["roc_auc"] == 1.0


def test_learned_tables(spark, small):
    assert neighbours.train_item_embeddings(small, 4).count() == small.select("aid").distinct().count()
    assert neighbours.train_factors(small, 4).count() == small.select("aid").distinct().count()
    emb = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], "aid int, vector array<float>")
    assert metrics.embedding_pca(emb, 2).count() == 5


def test_sources(spark, small, tmp_path):
    small.write.parquet(str(tmp_path / "e"))
    assert tables.read_events(spark, str(tmp_path / "e")).count() == small.count()
    got = tables.downcast(spark.createDataFrame([(1, 2.5, 2**40)], "a long, b double, c long"))
    assert got.dtypes == [("a", "int"), ("b", "float"), ("c", "int")] and got.first()["c"] is None
    assert tables.round3(spark.createDataFrame([(1.23456,)], "a double")).first()["a"] == 1.235
    truth = events.ground_truth(small)
    tables.write_labels(truth, str(tmp_path / "l"))
    assert tables.read_labels(spark, str(tmp_path / "l")).count() == truth.count()
    sub = ranking.top_k(covisit.past_aids(small).withColumn("score", -F.col("rank")), 20, "clicks")
    tables.write_submission(sub, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 5
    tables.write_chunks(small.withColumns({"event": F.lit("clicks"), "fold": F.lit(0)}), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == small.count()
    tables.write_metrics(metrics.recall_at_k(sub, truth), str(tmp_path / "m"))


def test_no_cartesian_product(small):
    tables_ = {k: covisit.build_covisitation(small) for k in ("clicks", "carts_orders")}
    plan = covisit.covisit_carts(small, **tables_)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
