"""Co-visitation tables that are made together, and what sessions get from them."""

from collections import Counter

import numpy as np
import pytest

from sessionloom.operators import covisit, features


@pytest.fixture(scope="module")
def log(spark):
    """Sessions of up to 90 events of all types over three weeks, some events alike."""
    rng = np.random.default_rng(11)
    rows = [(s, int(rng.integers(0, 25)), int(rng.integers(0, 21 * 24) * 3600), int(rng.choice([0, 0, 1, 2]))) for s in range(40) for _ in range(1 + 3 * (s % 31))]
    return spark.createDataFrame(rows + rows[:50], "session long, aid int, ts long, type int")


RULES = {
    "clicks": (covisit.CovisitRules(), 7),
    "carts_orders": (covisit.CovisitRules(types=(1, 2)), 5),
    "buy2buy": (covisit.CovisitRules(types=(1, 2), window_s=14 * 86_400), 4),
}


def apart(log):
    return {t: covisit.build_covisitation(log, r.types, r.window_s, n) for t, (r, n) in RULES.items()}


def test_together_equals_apart(log):
    together = covisit.covisitation_together(log, RULES, 3).cache()
    for t, want in apart(log).items():
        got = covisit.one_of(together, t)
        assert sorted(map(tuple, got.select("aid_x", "aid_y", "wgt", "nb").collect())) == sorted(map(tuple, want.select("aid_x", "aid_y", "wgt", "nb").collect()))


def test_orders_must_agree(log):
    with pytest.raises(ValueError):
        covisit.covisitation_together(log, RULES | {"clicks": (covisit.CovisitRules(tie=("aid",)), 7)})


def shuffled_rows(df) -> int:
    """Rows that the plan's exchanges wrote, once it has run."""
    df.collect()
    plan, total = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        if name == "AdaptiveSparkPlanExec":
            plan.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            plan.append(node.plan())
        else:
            plan += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_hits_of_sessions_are_not_shuffled(spark):
    """Sources travel with lists: as many rows as a session has aids, not as they have neighbours."""
    rng = np.random.default_rng(5)
    events = [(s, int(a), 0, 0) for s in range(60) for a in rng.integers(0, 100, 40)]
    near = {t: [(x, int(y)) for x in range(100) for y in rng.choice(5000, 20, replace=False)] for t in RULES}
    tables = {t: spark.createDataFrame([(*xy, 1.0) for xy in rows], "aid_x int, aid_y int, wgt float") for t, rows in near.items()}
    lead = {t: {x: [y for z, y in near[t] if z == x] for x in range(100)} for t in near}
    want = Counter((s, y, t) for s, a, _, _ in events for t in near for y in lead[t][a])
    got = features.session_covisit_counts(spark.createDataFrame(events, "session long, aid int, ts long, type int"), **tables)
    rows = got.collect()
    assert {(r["session"], r["candidate_aid"], t): r[f"sess_covisit_{t}_count"] for r in rows for t in near if r[f"sess_covisit_{t}_count"]} == dict(want)
    pairs, own = {(s, y) for s, y, _ in want}, len({e[:2] for e in events})
    assert len(pairs) == len(rows)
    assert shuffled_rows(got) <= 4 * own + 2 * sum(map(len, near.values())) < len(pairs)


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["combined_features", "combined_features_new_items"])
def test_rows_travel_twice_for_all_features(spark, name):
    """To their sessions and to their items. Without broadcasts (at size, vectors and few other tables have
    them) the narrow rows that look for vectors travel too; item tables move a row for an event at most."""
    from sessionloom.plans.queries import QUERIES
    from sessionloom.plans.fixtures import split

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = QUERIES[name](spark, SF)
        moved, rows = shuffled_rows(got), got.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    own = split(spark, SF)[0].count()
    assert moved <= 12 * rows + 8 * own, (moved, rows, own)
