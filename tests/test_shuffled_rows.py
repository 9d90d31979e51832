"""What travels between tasks: rows that grow with the input, not with its pairs."""

from collections import Counter

import numpy as np
import pytest

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sessionloom.operators import candidates, covisit, features, metrics, neighbours, ranking


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def hand_made(spark):
    rng = np.random.default_rng(4)
    events = [(s, int(a), t, 0) for s in range(30) for t, a in enumerate(rng.permutation(40)[: 1 + s % 25])]
    table = [(x, int(y), float(20 - i)) for x in range(40) for i, y in enumerate(rng.permutation(60)[:20]) if y != x]
    return events, table, spark.createDataFrame(events, "session long, aid int, ts long, type int"), spark.createDataFrame(table, "aid_x int, aid_y int, wgt float")


def test_hits_are_counted_where_a_session_meets(spark, small_batches):
    """Sessions that run over batches; most hits first, then first encounter."""
    events, table, e, t = hand_made(spark)
    near = {x: [y for a, y, w in sorted(table, key=lambda r: (r[0], -r[2], r[1])) if a == x] for x in range(40)}
    want = set()
    for s in range(30):
        aids = [a for z, a, _, _ in events if z == s][::-1]
        hits, met = Counter(), {}
        for r, x in enumerate(aids):
            for nb, y in enumerate(near[x]):
                hits[y] += 1
                met.setdefault(y, (r, nb))
        best = [y for y in sorted(hits, key=lambda y: (-hits[y], met[y], y))[:15] if y not in aids]
        want |= {(s, y, i) for i, y in enumerate(best)}
    got = covisit.covisit_clicks(e, t, n=15, with_history=False)
    assert {tuple(r) for r in got.collect()} == want


def test_hits_are_not_shuffled(spark):
    """A grouping of hits by a struct sorted and shuffled each of them."""
    _, _, e, t = hand_made(spark)
    for got in (covisit.covisit_clicks(e, t), covisit.covisit_carts(e, t, t), covisit.covisit_orders(e, t, t)):
        assert "SortAggregate" not in plan(got)


LISTS = [(s, "past" if i % 2 else "near", i % 7, i % 5) for s in range(12) for i in range(9)]
EVENTS = ("clicks", "carts", "orders")


def lists_and_truth(spark):
    long = spark.createDataFrame(LISTS, "session long, strategy string, candidate_aid int, rank int")
    truth = [(s, EVENTS[(s + k) % 3], [s % 7, 3, 90 + k]) for s in range(14) for k in range(1 + s % 3)]
    return long, spark.createDataFrame(truth, "session long, type string, ground_truth array<int>")


def named(long):
    return long.withColumn("event", F.explode(F.array(*map(F.lit, EVENTS))))


def test_lists_of_all_events_are_not_repeated(spark):
    """Lists without an event: the rows and the recall of lists that name each event."""
    long, truth = lists_and_truth(spark)
    rows = [candidates.label_candidates(candidates.candidate_rows(x, ["past", "near"]), truth) for x in (long, named(long))]
    cols = sorted(rows[1].columns)
    assert sorted(map(tuple, rows[0].select(cols).collect())) == sorted(map(tuple, rows[1].select(cols).collect()))
    recall = [metrics.candidate_recall(x, truth, (2, 5), ("past", "near")) for x in (long, named(long))]
    got, want = (sorted(map(tuple, r.collect())) for r in recall)
    assert len(got) == 8 and all(a == pytest.approx(b) if isinstance(b, float) else a == b for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


def test_later_steps_find_rows_by_session(spark):
    """Rows were shuffled anew for labels and for each event's windows."""
    long, truth = lists_and_truth(spark)
    rows = candidates.label_candidates(candidates.candidate_rows(long, ["past", "near"]), truth)
    kept = candidates.sample_negatives_per_session(candidates.drop_zero_hit_sessions(rows), 2)
    shuffles = [x for x in plan(kept).split("== Initial Plan ==")[0].splitlines() if "Exchange hashpartitioning" in x]
    assert len(shuffles) == 2 and all("hashpartitioning(session" in x for x in shuffles), shuffles


def test_truth_that_no_strategy_proposed(spark):
    """Also where labels come from elsewhere: a proposed truth is not missed, whatever its label."""
    long, truth = lists_and_truth(spark)
    rows = candidates.label_candidates(candidates.candidate_rows(long, ["past", "near"]), truth).withColumn("label", F.when(F.col("candidate_aid") == 3, 0).otherwise(F.col("label")))
    got = candidates.sample_negatives_per_session(rows, 2, include_all_truth=truth)
    added = {(r["session"], r["event"], r["candidate_aid"]) for r in got.where("retrieval_past is null").collect()}
    proposed = {(r["session"], r["event"], r["candidate_aid"]) for r in rows.collect()}
    true = {(r["session"], r["type"], a) for r in truth.collect() for a in r["ground_truth"]}
    assert added == true - proposed
    plain = candidates.sample_negatives_per_session(rows, 2)
    assert sorted(map(tuple, got.where("retrieval_past is not null").collect())) == sorted(map(tuple, plain.collect()))


def test_candidates_are_never_broadcast(spark):
    """Stored tables are small on disk, so Spark sent millions of their rows to the driver."""
    rows = spark.createDataFrame([(s, a, 1, 2, 3, 4) for s in range(4) for a in range(5)], "session long, candidate_aid int, " + ", ".join(f"{r}_in_session_aid int" for r in features.REPRESENTATIVES))
    vectors = spark.createDataFrame([(a, [1.0 + a, 2.0]) for a in range(6)], "aid int, vector array<float>")
    got = features.embedding_distances(rows, vectors, features.REPRESENTATIVES)
    table = spark.createDataFrame([(1, 2, 3.0, 0)], "aid_x int, aid_y int, wgt float, nb int")
    frame = rows.select("session", "candidate_aid", (F.col("candidate_aid") % 2).alias("label"), F.lit(1.0).alias("weight"), array_to_vector(F.array(F.rand(1), F.rand(2))).alias("features"))
    for df, joins in ((got, 2), (features.covisit_weights(rows, table, table, table), 2), (ranking.session_pairs(frame), 1)):
        assert plan(df).count("SortMergeJoin") >= joins
        assert df.count() >= 0


def test_mean_vectors_are_not_exploded(spark):
    """Means of up to three vectors, with nulls left out as an average does; no row for each number."""
    e = spark.createDataFrame([(1, 10, 1, 1), (1, 11, 2, 1), (1, 12, 3, 1), (1, 13, 4, 0), (2, 11, 1, 0), (3, 99, 1, 1)], "session long, aid int, ts long, type int")
    v = spark.createDataFrame([(10, [1.0, 2.0]), (11, [2.0, None]), (12, [6.0, 4.0]), (13, [9.0, 9.0])], "aid int, vector array<float>")
    got = neighbours.mean_cart_vector(e, v)
    assert "Generate" not in plan(got)
    assert {r["query"]: r["vector"] for r in got.collect()} == {1: [3.0, 3.0], 2: [2.0, None]}


def test_events_share_a_list(spark):
    scores = spark.createDataFrame([(1, a, float(a)) for a in range(4)], "session long, candidate_aid int, score double")
    got = ranking.top_k(scores, 2, EVENTS)
    assert sorted(map(tuple, got.collect())) == sorted((f"1_{e}", "3 2") for e in EVENTS)
    assert "Union" not in plan(got)


def shuffles(df) -> list[str]:
    return [x for x in plan(df).split("== Initial Plan ==")[0].splitlines() if "Exchange" in x]


def test_backfill_meets_in_one_shuffle(spark):
    """Hits, history and popular aids met in shuffles of their own, and both kinds of sessions had a join
    of sources with lists each."""
    _, _, e, t = hand_made(spark)
    top = spark.createDataFrame([(x, [3, 70]) for x in EVENTS], "event string, labels array<int>")
    tables = dict.fromkeys(("clicks", "carts_orders", "buy2buy"), t)
    for event in EVENTS:
        got = covisit.suggest_with_backfill(e, event, tables, top, parts=6)
        text = plan(got).split("== Initial Plan ==")[0]
        assert text.count("MapInArrow") == 1 and text.count("Join") == 1
        assert sum("hashpartitioning(session" in x and ", 6)" in x for x in shuffles(got)) == 2
        assert sum("candidate_aid" in x for x in shuffles(got)) == 0


def test_parts_change_no_result(spark, small_batches):
    """Also sessions of many aids, whose known aids stay among the hits."""
    _, _, e, t = hand_made(spark)
    e = e.withColumn("type", F.pmod(F.col("aid"), F.lit(3)).cast("int"))
    top = spark.createDataFrame([(x, [3, 70]) for x in EVENTS], "event string, labels array<int>")
    tables = dict.fromkeys(("clicks", "carts_orders", "buy2buy"), t)
    for f in (lambda **kw: covisit.suggest_with_backfill(e, "orders", tables, top, **kw), lambda **kw: covisit.covisit_carts(e, t, t, **kw)):
        got = [sorted(map(tuple, f(parts=p).collect())) for p in (None, 1, 5)]
        assert got[0] and got[0] == got[1] == got[2]


def test_one_ranker_reads_rows_once(spark):
    """Each event's rows were made anew, with their windows and joins, in one task."""
    from sessionloom.plans.queries import QUERIES

    long, truth = lists_and_truth(spark)
    truth = truth.where("type <> 'orders' or session % 2 = 0")
    rows = candidates.label_candidates(candidates.candidate_rows(long, ["past", "near"]), truth)
    want = features.one_ranker_dataset(*(rows.where(F.col("event") == e).drop("event") for e in EVENTS))
    got = features.one_ranker_rows(rows)
    assert {r["label"] for r in got.collect()} == {0, 1, 2, 3}
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    query = plan(QUERIES["one_ranker_dataset"](spark, "/root/testdata/sf0.001")).split("== Initial Plan ==")[0]
    assert query.count("MapInArrow") == 1 and query.count("Generate explode(array(struct(event") == 1


def test_split_stays_by_session(spark, monkeypatch):
    """The split log was shuffled by session for each step that read it, and co-visits once more to be ranked."""
    from sessionloom.plans import fixtures, queries

    monkeypatch.setattr(fixtures, "PART_EVENTS", 1500)
    e, truth, parts = fixtures.split_in_parts(spark, "/root/testdata/sf0.001")
    assert parts == 4 and not shuffles(covisit.past_aids(e)) and not shuffles(truth)
    rows = queries._rows(spark, "/root/testdata/sf0.001")[2]
    # Sources with their lists, then co-visits with history; the truths that label them lie there.
    assert sum("hashpartitioning(session" in x for x in shuffles(rows)) == 2
    assert e.count() > 0 and rows.count() > 0


def test_stored_by_keeps_rows(spark):
    """Also rows with a null key, and keys that some parts have none of."""
    from sessionloom.sources import scratch

    rows = [(None, 1), (None, 2), (5, 3), (5, 3), (7, 4)]
    got = scratch.stored_by(spark.createDataFrame(rows, "session long, aid int"), "rows-by-key", "session", 6)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    assert not shuffles(got.groupBy("session").count()) and {r["session"]: r["count"] for r in got.groupBy("session").count().collect()} == {None: 2, 5: 2, 7: 1}
    assert scratch.stored_by(spark.createDataFrame([], "session long, aid int"), "no-rows", "session", 1).count() == 0
