"""Registered queries of the session operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.exprs import stable_hash, ts_parts
from sessionloom.operators import boosting, candidates, covisit, ensemble, events, factors, features, metrics, neighbours, popular, ranking, search
from sessionloom.sources import tables
from sessionloom.sources.scratch import new_folder, stored, stored_by

from .fixtures import covisit_tables, covisit_tables_at_once, embeddings, embeddings_sql, events_a, events_b, split, split_in_parts, with_ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SQL_TYPES = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR"}


def register(name: str, schema: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query with its result columns ("a long, b double"): both sides are cast to these
    and doubles are rounded to nine and then six decimals; lists ("list") become comma-joined strings."""
    cols = [c.strip().split(" ") for c in schema.split(", ")]

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            df = f(spark, sf_dir)
            cast = {"double": lambda c: F.round(F.round(F.col(c).cast("double"), 9).cast("decimal(38,9)"), 6).cast("double"), "list": lambda c: F.array_join(F.col(c).cast("array<string>"), ",")}
            return df.select(*(cast.get(t, lambda c, t=t: F.col(c).cast(t))(c).alias(c) for c, t in cols))

        QUERIES[name] = run
        if sql:
            shown = {"double": "CAST(CAST(CAST(CAST({c} AS DOUBLE) AS DECIMAL(38, 9)) AS DECIMAL(38, 6)) AS DOUBLE)", "list": "array_to_string({c}, ',')"} | {k: f"CAST({{c}} AS {v})" for k, v in SQL_TYPES.items()}
            picked = ", ".join(f"{shown[t].format(c=c)} AS {c}" for c, t in cols)
            ORACLE_SQL[name] = with_ctes(f"SELECT {picked} FROM ({sql})")
        return f

    return add


EVENT = "session long, aid int, ts long, type int"
NAME = "CASE type WHEN 0 THEN 'clicks' WHEN 1 THEN 'carts' ELSE 'orders' END"


# Splits, labels, prepared events.


@register("last_days", EVENT, "SELECT * FROM ea WHERE ts > (SELECT max(ts) FROM ea) - 7 * 86400")
def _(spark, d):
    return events.last_days(events_a(spark, d))


@register("sample_sessions", EVENT, "SELECT * FROM eb WHERE CAST(('0x' || substr(md5(session || '_3'), 1, 15)) AS BIGINT) / 1152921504606846976.0 < 0.3")
def _(spark, d):
    return events.sample_sessions(events_b(spark, d), 0.3, seed=3)


@register("cutoff_features", EVENT, "SELECT * FROM ef")
def _(spark, d):
    return events.random_cutoff_split(events_b(spark, d), seed=7)[0]


@register("ground_truth", "session long, type string, ground_truth list", "SELECT * FROM truth")
def _(spark, d):
    return split(spark, d)[1]


@register("stratified_folds", "class string, fold int, sessions long", """
    SELECT class, CAST(h % 30 AS INTEGER) AS fold, count(*) AS sessions FROM (
        SELECT session, CAST(('0x' || substr(md5(session || '_0'), 1, 15)) AS BIGINT) AS h, sum(DISTINCT type) || '_' || count(DISTINCT type) AS class FROM ea GROUP BY session)
    GROUP BY ALL""")
def _(spark, d):
    return events.assign_stratified_folds(events_a(spark, d), 30).groupBy("class", "fold").agg(F.count("*").alias("sessions"))


@register("stratified_folds_exact", "session long, class string, fold int", """
    SELECT session, class, (row_number() OVER (PARTITION BY class ORDER BY h, session) - 1) % 5 AS fold FROM (
        SELECT session, CAST(('0x' || substr(md5(session || '_0'), 1, 15)) AS BIGINT) AS h, sum(DISTINCT type) || '_' || count(DISTINCT type) AS class FROM ea GROUP BY session)""")
def _(spark, d):
    return events.assign_stratified_folds(events_a(spark, d), 5, exact=True)


@register("ts_parts", "session long, ts long, hour int, weekday int, date string, datehour string, datetime string", """
    SELECT session, ts, ((ts + 7200) // 3600) % 24 AS hour, ((ts + 7200) // 86400 + 3) % 7 AS weekday,
        strftime(make_timestamp((ts + 7200) * 1000000), '%Y-%m-%d') AS date, strftime(make_timestamp((ts + 7200) * 1000000), '%Y-%m-%d %H:00:00') AS datehour,
        strftime(make_timestamp((ts + 7200) * 1000000), '%Y-%m-%d %H:%M:%S') AS datetime FROM ea""")
def _(spark, d):
    return ts_parts(events_a(spark, d))


@register("preprocess_ts", "session long, aid int, ts long, type int, hour int, date string, datehour string", """
    SELECT *, ((ts + 7200) // 3600) % 24 AS hour, strftime(make_timestamp((ts + 7200) * 1000000), '%Y-%m-%d') AS date, strftime(make_timestamp((ts + 7200) * 1000000), '%Y-%m-%d %H:00:00') AS datehour FROM ea""")
def _(spark, d):
    return events.preprocess_ts(events_a(spark, d))


@register("click_subsample", "session long, aid int, ts long, event string, fold int", f"""
    SELECT * FROM (SELECT session, aid, ts, {NAME} AS event, CAST(('0x' || substr(md5(session || '_0'), 1, 15)) AS BIGINT) % 30 AS fold FROM ea) WHERE event <> 'clicks' OR fold <= 6""")
def _(spark, d):
    e = events_a(spark, d)
    dealt = e.join(events.assign_stratified_folds(e, 30).select("session", "fold"), "session").withColumn("event", events.type_name())
    return events.click_subsample(dealt)


PREPARED = "session long, aid int, ts long, type int, pos long, action_num_reverse_chrono int, duration_second long, oneday_session int, hour int, weekday int, log_recency_score double, type_weighted_log_recency_score double, log_duration_second double, type_weighted_log_duration_second double"


@register("prepare_events", PREPARED, "SELECT * FROM prepa")
def _(spark, d):
    return events.prepare_events(events_a(spark, d))


@register("prepare_events_segments", PREPARED, "SELECT * FROM prepb")
def _(spark, d):
    """Sessions of more than 80 events are scanned in segments."""
    return events.prepare_events(events_b(spark, d), long_session=80)


@register("prepare_events_orders", PREPARED, "SELECT * FROM prepb")
def _(spark, d):
    return events.prepare_events(events_b(spark, d))


for _mode, _flag in (("reference", "coalesce(lead(ts) OVER w - ts, ts - lag(ts) OVER w)"), ("gap", "ts - lag(ts) OVER w")):
    _real = f"""
        SELECT *, count(*) OVER (PARTITION BY real_session) AS real_session_size FROM (
            SELECT session, aid, ts, session || '_' || sum(opens) OVER (PARTITION BY session ORDER BY ts, type, aid ROWS UNBOUNDED PRECEDING) AS real_session
            FROM (SELECT *, CASE WHEN {_flag} > 7200 THEN 1 ELSE 0 END AS opens FROM ea WINDOW w AS (PARTITION BY session ORDER BY ts, type, aid)))"""

    @register(f"real_sessions_{_mode}", "session long, aid int, ts long, real_session string, real_session_size long", _real)
    def _(spark, d, mode=_mode):
        return events.real_sessions(events_a(spark, d), boundary=mode)

    @register(f"real_sessions_segments_{_mode}", "session long, aid int, ts long, real_session string, real_session_size long", _real)
    def _(spark, d, mode=_mode):
        return events.real_sessions(events_a(spark, d), boundary=mode, long_session=20)


# Popularity.

_KEYS = {None: "", "date": ", strftime(make_timestamp((ts + 7200) * 1000000), '%Y-%m-%d') AS date", "datehour": ", strftime(make_timestamp((ts + 7200) * 1000000), '%Y-%m-%d %H:00:00') AS datehour", "hour": ", ((ts + 7200) // 3600) % 24 AS hour"}


def _popular_sql(key: str | None, src: str = "ea") -> str:
    k = f", {key}" if key else ""
    return f"""
        SELECT event{k}, list(aid ORDER BY r) AS labels, list(r ORDER BY r) AS ranks FROM (
            SELECT *, row_number() OVER (PARTITION BY event{k} ORDER BY cnt DESC, aid) AS r FROM (
                SELECT aid{k}, event, cnt FROM (SELECT aid{k}, count(*) FILTER (type = 0) AS clicks, count(*) FILTER (type = 1) AS carts, count(*) FILTER (type = 2) AS orders FROM (SELECT aid, type{_KEYS[key]} FROM {src}) GROUP BY ALL)
                UNPIVOT (cnt FOR event IN (clicks, carts, orders)))) WHERE r <= 20 GROUP BY ALL"""


for _key in _KEYS:

    @register(f"popular_{_key or 'week'}", f"event string{(f', {_key}' + (' int' if _key == 'hour' else ' string')) if _key else ''}, labels list, ranks list", _popular_sql(_key))
    def _(spark, d, key=_key):
        return popular.popular(events_a(spark, d), key)

    @register(f"attach_popular_{_key or 'week'}", "session long, event string, labels list, ranks list", f"""
        SELECT l.session, v.event, p.labels, p.ranks FROM (SELECT session{_KEYS[_key]} FROM (SELECT session, max(ts) AS ts FROM ea GROUP BY session)) l CROSS JOIN (VALUES ('clicks'), ('carts'), ('orders')) AS v(event)
        LEFT JOIN ({_popular_sql(_key)}) p ON p.event = v.event{f' AND p.{_key} = l.{_key}' if _key else ''}""")
    def _(spark, d, key=_key):
        e = events_a(spark, d)
        return popular.attach_popular(e, popular.popular(e, key), key)


# History and co-visitation.

CAND = "session long, candidate_aid int, rank int"


@register("unique_recent_aids", "session long, aid int, recent_rank int", "SELECT session, aid, recent_rank FROM uniq")
def _(spark, d):
    return covisit.unique_recent_aids(split(spark, d)[0])


@register("past_aids", CAND, "SELECT * FROM past")
def _(spark, d):
    return covisit.past_aids(split(spark, d)[0])


@register("past_aids_rerank", CAND, "SELECT * FROM past_more")
def _(spark, d):
    return covisit.past_aids(split(spark, d)[0], type_weights=events.RERANK_WEIGHTS, inclusive=False)


for _t in ("clicks", "carts_orders", "buy2buy"):

    @register(f"covisitation_{_t}", "aid_x int, aid_y int, wgt double", f"SELECT * FROM cv_{_t}")
    def _(spark, d, t=_t):
        return covisit_tables(split(spark, d)[0])[t]


@register("covisitation_merged", "aid_x int, aid_y int, wgt double", "SELECT * FROM cv_clicks")
def _(spark, d):
    """The same table, from a state that takes the events year by year, the late ones first."""
    e = split(spark, d)[0]
    year = F.year(F.timestamp_seconds("ts"))
    state = covisit.covisit_state(e.where(year >= 2000))
    for rest in (e.where(year < 1997), e.where((year >= 1997) & (year < 2000))):
        state = covisit.merge_covisitation(state, rest)
    return covisit.top_neighbours(state.sums, 20)


def _covisit_sql(parts: list[tuple[str, str]]) -> str:
    hits = " UNION ALL ".join(
        f"SELECT s.session, c.aid_y AS candidate_aid, ({i} * 1000000 + s.recent_rank) * 1000 + c.nb AS met FROM ({src}) s JOIN (SELECT *, row_number() OVER (PARTITION BY aid_x ORDER BY wgt DESC, aid_y) - 1 AS nb FROM cv_{t}) c ON s.aid = c.aid_x" for i, (src, t) in enumerate(parts)
    )
    return f"""
        SELECT session, candidate_aid, row_number() OVER (PARTITION BY session ORDER BY source, place) - 1 AS rank FROM (
            SELECT session, candidate_aid, 0 AS source, rank AS place FROM past_more
            UNION ALL SELECT session, candidate_aid, 1, place FROM (
                SELECT *, row_number() OVER (PARTITION BY session ORDER BY hits DESC, met, candidate_aid) AS place FROM (SELECT session, candidate_aid, count(*) AS hits, min(met) AS met FROM ({hits}) GROUP BY ALL)) p
            WHERE place <= 60 AND NOT EXISTS (SELECT 1 FROM uniq u WHERE u.session = p.session AND u.aid = p.candidate_aid))"""


_LIGHT = "SELECT * FROM (SELECT u.*, count(*) OVER (PARTITION BY u.session) AS m, k.light FROM uniq u JOIN (SELECT session, aid, max(CASE WHEN type IN (0, 1) THEN 1 ELSE 0 END) AS light FROM ef GROUP BY ALL) k USING (session, aid)) WHERE m < 20 OR light = 1"
_BOUGHT = "SELECT * FROM uniq u WHERE EXISTS (SELECT 1 FROM ef WHERE type IN (1, 2) AND ef.session = u.session AND ef.aid = u.aid)"


@register("covisit_clicks", CAND, _covisit_sql([("SELECT * FROM uniq", "clicks")]))
def _(spark, d):
    e, _, parts = split_in_parts(spark, d)
    return covisit.covisit_clicks(e, covisit_tables(e)["clicks"], parts=parts)


@register("covisit_carts", CAND, _covisit_sql([("SELECT * FROM uniq", "clicks"), (_LIGHT, "carts_orders")]))
def _(spark, d):
    e, _, parts = split_in_parts(spark, d)
    t = covisit_tables(e)
    return covisit.covisit_carts(e, t["clicks"], t["carts_orders"], parts=parts)


@register("covisit_orders", CAND, _covisit_sql([("SELECT * FROM uniq", "carts_orders"), (_BOUGHT, "buy2buy")]))
def _(spark, d):
    e, _, parts = split_in_parts(spark, d)
    t = covisit_tables(e)
    return covisit.covisit_orders(e, t["carts_orders"], t["buy2buy"], parts=parts)


def _suggest_sql(event: str, n: int = 100) -> str:
    parts = {"clicks": ["clicks"], "carts": ["clicks", "carts_orders"], "orders": ["carts_orders", "buy2buy"]}[event]
    start, kinds = (0.1, "(-1)") if event == "clicks" else (0.5, "(0, 1)" if event == "carts" else "(1, 2)")
    neighbours_ = lambda t: f"(SELECT *, row_number() OVER (PARTITION BY aid_x ORDER BY wgt DESC, aid_y) - 1 AS nb FROM cv_{t})"
    chosen = f"EXISTS (SELECT 1 FROM ef WHERE type IN {kinds} AND ef.session = s.session AND ef.aid = s.aid)"
    hits = " UNION ALL ".join(f"SELECT s.session, c.aid_y AS aid, ({i} * 1000000 + s.recent_rank) * 1000 + c.nb AS met FROM few s JOIN {neighbours_(t)} c ON s.aid = c.aid_x" + (f" WHERE {chosen}" if t == "buy2buy" else "") for i, t in enumerate(parts))
    return f"""
        WITH um AS (SELECT *, count(*) OVER (PARTITION BY session) AS m FROM uniq), few AS (SELECT * FROM um WHERE m < 20), many AS (SELECT * FROM um WHERE m >= 20),
        listed AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY hits DESC, met, aid) AS place FROM (SELECT session, aid, count(*) AS hits, min(met) AS met FROM ({hits}) GROUP BY ALL)),
        top AS (SELECT aid, row_number() OVER (ORDER BY cnt DESC, aid) AS place FROM (SELECT aid, count(*) FILTER (type = {dict(clicks=0, carts=1, orders=2)[event]}) AS cnt FROM ef GROUP BY aid) QUALIFY place <= 20),
        own AS (SELECT session, aid, sum((pow(2.0, {start} + {1 - start} * (pos - 1) / (n - 1)) - 1) * CASE type WHEN 0 THEN 1.0 WHEN 1 THEN 6.0 ELSE 3.0 END) AS w, min(pos) AS first_pos FROM posf WHERE session IN (SELECT session FROM many) GROUP BY ALL),
        bonus AS (SELECT s.session, c.aid_y AS aid, count(*) * 0.1 AS b, min(s.recent_rank * 1000 + c.nb) AS met FROM many s JOIN {neighbours_(parts[-1])} c ON s.aid = c.aid_x WHERE {chosen} GROUP BY ALL),
        reranked AS (SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY round(coalesce(w, 0) + coalesce(b, 0)::DOUBLE, 9) DESC, first_pos NULLS LAST, met, aid) AS place FROM own FULL JOIN bonus USING (session, aid)),
        rows_ AS (SELECT session, aid, recent_rank AS k FROM few UNION ALL SELECT session, aid, place FROM reranked
            UNION ALL SELECT session, aid, 1000000 + place FROM listed p WHERE place <= {n} AND NOT EXISTS (SELECT 1 FROM uniq u WHERE u.session = p.session AND u.aid = p.aid)
            UNION ALL SELECT session, top.aid, 2000000 + place FROM (SELECT DISTINCT session FROM few) CROSS JOIN top)
        SELECT session, aid AS candidate_aid, rank FROM (SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY min(k), aid) - 1 AS rank FROM rows_ GROUP BY session, aid) WHERE rank < {n}"""


for _e in ("clicks", "carts", "orders"):

    @register(f"suggest_with_backfill_{_e}", CAND, _suggest_sql(_e))
    def _(spark, d, event=_e):
        e, _, parts = split_in_parts(spark, d)
        return covisit.suggest_with_backfill(e, event, covisit_tables(e), popular.popular(e), parts=parts)


# Query items and neighbours.

_BEST = {"last_aid": "pos", "max_recency_aid": "lr", "max_weighted_recency_aid": "wr", "max_duration_aid": "ld", "max_weighted_duration_aid": "wd"}


_ITEMS = f"""
    SELECT session, {', '.join(f'arg_max(aid, row({m}, aid)) AS {c}' for c, m in _BEST.items())} FROM (
        SELECT session, aid, max(pos) AS pos, round(sum(log_recency_score), 9) AS lr, round(sum(type_weighted_log_recency_score), 9) AS wr, round(sum(log_duration_second), 9) AS ld, round(sum(type_weighted_log_duration_second), 9) AS wd
        FROM prepa GROUP BY ALL) GROUP BY session"""


@register("query_items", "session long, " + ", ".join(f"{c} int" for c in _BEST), _ITEMS)
def _(spark, d):
    return neighbours.query_items(events.prepare_events(events_a(spark, d)))


def _near_sql(asked: str, table: str, metric: str, drop_self: bool) -> str:
    """``query, aid, rank`` of all items for ``asked (query, v)``."""
    dist = "list_distance(q.v, e.v)" if metric == "euclidean" else "1 - list_cosine_similarity(q.v, e.v)"
    return f"""SELECT query, aid, row_number() OVER (PARTITION BY query ORDER BY distance, aid) - 1 AS rank FROM (
        SELECT q.query, e.aid, round({dist}, 9) AS distance FROM ({asked}) q, ({embeddings_sql(table)}) e {'WHERE e.aid <> q.query' if drop_self else ''})"""


def _knn_sql(queries: str, n: int, metric: str = "euclidean", table: str = "word2vec", drop_self: bool = True) -> str:
    """``session, candidate_aid, rank`` for ``queries (session, aid)``."""
    asked = f"SELECT aid AS query, v FROM ({embeddings_sql(table)}) WHERE aid IN (SELECT aid FROM ({queries}))"
    return f"SELECT s.session, near.aid AS candidate_aid, near.rank FROM ({queries}) s JOIN ({_near_sql(asked, table, metric, drop_self)}) near ON s.aid = near.query WHERE near.rank < {n}"


for _name, _aid, _n, _metric, _table in (
    ("euclidean", "last_aid", 20, "euclidean", "word2vec"),
    ("cosine", "last_aid", 10, "cosine", "word2vec"),
    ("max_weighted_recency", "max_weighted_recency_aid", 30, "euclidean", "word2vec"),
    ("max_weighted_duration", "max_weighted_duration_aid", 30, "euclidean", "word2vec"),
    ("max_duration", "max_duration_aid", 30, "cosine", "word2vec"),
    ("fasttext", "last_aid", 20, "cosine", "fasttext"),
    ("matrix_fact", "last_aid", 10, "euclidean", "matrix_fact"),
):

    @register(f"knn_{_name}", CAND, _knn_sql(f"SELECT session, {_aid} AS aid FROM ({_ITEMS})", _n, _metric, _table))
    def _(spark, d, aid=_aid, n=_n, metric=_metric, table=_table):
        q = neighbours.query_items(events.prepare_events(events_a(spark, d))).select("session", F.col(aid).alias("aid"))
        return neighbours.knn_by_item(q, embeddings(spark, d, table), n, metric)


@register("knn_last_carted", CAND, _knn_sql("SELECT session, coalesce(arg_max(aid, pos) FILTER (type = 1), arg_max(aid, pos)) AS aid FROM posa GROUP BY session", 20, drop_self=False))
def _(spark, d):
    return neighbours.knn_by_item(neighbours.last_carted_query(events_a(spark, d)), embeddings(spark, d), 20, drop_self=False)


_MEANS = f"""SELECT session AS query, list(x ORDER BY i) AS v FROM (SELECT session, i, avg(v[i]) AS x FROM (SELECT c.session, e.v, unnest(range(1, len(e.v) + 1)) AS i FROM (
        SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY pos DESC) AS r FROM (SELECT *, max(CASE WHEN type = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session) AS has FROM posa) WHERE type = 1 OR (has = 0 AND pos = n)) c
    JOIN ({embeddings_sql()}) e USING (aid) WHERE r <= 3) GROUP BY ALL) GROUP BY session"""


@register("knn_mean_cart_vector", "query long, aid long, rank int", f"SELECT * FROM ({_near_sql(_MEANS, 'word2vec', 'euclidean', False)}) WHERE rank < 20")
def _(spark, d):
    e = embeddings(spark, d)
    return neighbours.knn_by_vector(neighbours.mean_cart_vector(events_a(spark, d), e), e, 20)


@register("knn_budget", CAND, f"SELECT k.* FROM ({_knn_sql('SELECT session, arg_max(aid, pos) AS aid FROM posa GROUP BY session', 40)}) k JOIN (SELECT session, least(count(DISTINCT aid), 20) AS used FROM posa GROUP BY session) USING (session) WHERE rank < 40 - used")
def _(spark, d):
    return neighbours.knn_budget(events_a(spark, d), embeddings(spark, d), 40)


# Candidate rows.


def _long(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(session events, truth, long candidates of history and co-visits, the same for all events, and
    the number of parts that sessions are dealt into)."""
    e, truth, parts = split_in_parts(spark, d)
    return e, truth, _strategies(e, covisit_tables(e), parts), parts


def _strategies(e: DataFrame, tables: dict[str, DataFrame], parts: int) -> DataFrame:
    part = lambda df, s: df.select("session", F.lit(s).alias("strategy"), "candidate_aid", "rank")
    return part(covisit.past_aids(e), "past_aids").unionByName(part(covisit.covisit_clicks(e, tables["clicks"], with_history=False, parts=parts), "covisit"))


def _rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e, truth, long, parts = _long(spark, d)
    rows = candidates.candidate_rows(long, ["past_aids", "covisit"], parts)
    return e, truth, candidates.label_candidates(rows, truth)


_CV = f"""SELECT session, candidate_aid, row_number() OVER (PARTITION BY session ORDER BY rank) - 1 AS rank FROM ({_covisit_sql([('SELECT * FROM uniq', 'clicks')])}) c
    WHERE NOT EXISTS (SELECT 1 FROM uniq u WHERE u.session = c.session AND u.aid = c.candidate_aid)"""
_LONG = f"""SELECT session, event, strategy, candidate_aid, rank FROM (SELECT session, 'past_aids' AS strategy, candidate_aid, rank FROM past UNION ALL SELECT session, 'covisit', candidate_aid, rank FROM ({_CV})) x,
    (VALUES ('clicks'), ('carts'), ('orders')) AS t(event)"""
_ROWS = f"""
    SELECT r.*, CASE WHEN t.session IS NULL THEN 0 ELSE 1 END AS label FROM (
        SELECT event, session, candidate_aid, rp AS retrieval_past_aids, rc AS retrieval_covisit,
            coalesce(kp, sum(rp) OVER (PARTITION BY event, session)) AS rank_past_aids, coalesce(kc, sum(rc) OVER (PARTITION BY event, session)) AS rank_covisit
        FROM (SELECT event, session, candidate_aid, max(CASE WHEN strategy = 'past_aids' THEN 1 ELSE 0 END) AS rp, max(CASE WHEN strategy = 'covisit' THEN 1 ELSE 0 END) AS rc,
                min(rank) FILTER (strategy = 'past_aids') AS kp, min(rank) FILTER (strategy = 'covisit') AS kc FROM ({_LONG}) GROUP BY ALL)) r
    LEFT JOIN (SELECT DISTINCT session, type, unnest(ground_truth) AS aid FROM truth) t ON t.session = r.session AND t.type = r.event AND t.aid = r.candidate_aid"""
ROWS = "event string, session long, candidate_aid int, retrieval_past_aids int, retrieval_covisit int, rank_past_aids int, rank_covisit int, label int"


@register("candidate_rows", ROWS, _ROWS)
def _(spark, d):
    return _rows(spark, d)[2]


@register("training_rows", ROWS, f"SELECT * FROM (SELECT *, max(label) OVER (PARTITION BY event, session) AS any_hit FROM ({_ROWS})) WHERE any_hit = 1")
def _(spark, d):
    _, truth, rows = _rows(spark, d)
    return candidates.drop_zero_hit_sessions(candidates.drop_unlabelled_sessions(rows, truth))


@register("combined_ranks", "event string, session long, candidate_aid int, retrieval_combined int, rank_combined int, label int", f"SELECT event, session, candidate_aid, retrieval_past_aids + retrieval_covisit AS retrieval_combined, least(rank_past_aids, rank_covisit) AS rank_combined, label FROM ({_ROWS})")
def _(spark, d):
    return candidates.combine_ranks(_rows(spark, d)[2], ["past_aids", "covisit"], ["past_aids", "covisit"])


@register("candidates_long", "session long, event string, strategy string, candidate_aid int, rank int", "SELECT session, event, 'past_aids' AS strategy, candidate_aid, rank FROM past, (VALUES ('clicks'), ('carts'), ('orders')) AS t(event)")
def _(spark, d):
    past = covisit.past_aids(split(spark, d)[0]).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate_aid"))).alias("x"))
    past = past.withColumn("event", F.explode(F.array(*map(F.lit, ("clicks", "carts", "orders")))))
    lists = past.select(F.concat_ws("_", F.col("session").cast("string"), "event").alias("session"), F.transform("x", lambda s: s["candidate_aid"]).alias("labels"), F.transform("x", lambda s: s["rank"]).alias("ranks"))
    return candidates.candidates_long(lists, "past_aids")


_HASHED = f"SELECT *, CAST(('0x' || substr(md5(event || '_' || session || '_' || candidate_aid || '_3'), 1, 15)) AS BIGINT) AS h FROM ({_ROWS})"


@register("downsampled_negatives", ROWS, f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, event, session, candidate_aid) AS r, sum(label) OVER () AS p FROM ({_HASHED})) WHERE label = 1 OR r <= 10 * p")
def _(spark, d):
    return candidates.downsample_negatives(_rows(spark, d)[2], ratio=10, seed=3, exact=True)


@register("downsampled_by_hash", ROWS, f"SELECT * FROM (SELECT *, sum(label) OVER () AS p, sum(1 - label) OVER () AS q FROM ({_HASHED})) WHERE label = 1 OR h / 1152921504606846976.0::DOUBLE < 10 * p / greatest(q, 1)::DOUBLE")
def _(spark, d):
    return candidates.downsample_negatives(_rows(spark, d)[2], ratio=10, seed=3)


_PER_SESSION = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event, session, label ORDER BY h, candidate_aid) AS r, sum(label) OVER (PARTITION BY event, session) AS p FROM ({_HASHED})) WHERE label = 1 OR r <= 2 * p"


@register("negatives_per_session", ROWS, _PER_SESSION)
def _(spark, d):
    _, truth, rows = _rows(spark, d)
    return candidates.sample_negatives_per_session(rows, 2, seed=3)


@register("negatives_with_all_truth", "event string, session long, candidate_aid int, rank_past_aids int, label int", f"""
    SELECT event, session, candidate_aid, rank_past_aids, label FROM ({_PER_SESSION}) UNION ALL
    SELECT t.event, t.session, t.aid, -1, 1 FROM (SELECT DISTINCT session, type AS event, unnest(ground_truth) AS aid FROM truth) t WHERE NOT EXISTS (SELECT 1 FROM ({_ROWS}) r WHERE r.event = t.event AND r.session = t.session AND r.candidate_aid = t.aid)""")
def _(spark, d):
    _, truth, rows = _rows(spark, d)
    return candidates.sample_negatives_per_session(rows, 2, seed=3, include_all_truth=truth).fillna(-1, ["rank_past_aids"])


_OVERALL = "SELECT 'overall' AS type, k, sum(hits) AS hits, sum(gt) AS gt, sum(recall * w) AS recall, sum(mean_recall * w) AS mean_recall FROM (SELECT *, CASE type WHEN 'clicks' THEN 0.1 WHEN 'carts' THEN 0.3 ELSE 0.6 END AS w FROM by_event) GROUP BY k"


@register("candidate_recall", "type string, k int, hits long, gt long, recall double, mean_recall double, n_mean double, n_median double", f"""
    WITH firsts AS (SELECT session, event, candidate_aid, min(CASE strategy WHEN 'past_aids' THEN 1 ELSE 2 END * 100000 + rank) AS x FROM ({_LONG}) GROUP BY ALL),
    lists AS (SELECT session, event, list(candidate_aid ORDER BY x, candidate_aid) AS aids FROM firsts GROUP BY ALL),
    hit AS (SELECT t.type, k.k, len(list_intersect(coalesce(l.aids, [])[1:k.k], t.ground_truth)) AS h, least(len(list_distinct(t.ground_truth)), 20) AS g, least(len(coalesce(l.aids, [])), k.k) AS m
        FROM truth t LEFT JOIN lists l ON l.session = t.session AND l.event = t.type CROSS JOIN (VALUES (20), (80), (140), (260)) AS k(k)),
    by_event AS (SELECT type, k, sum(h) AS hits, sum(g) AS gt, sum(h) / sum(g) AS recall, avg(h / g) AS mean_recall FROM hit GROUP BY ALL),
    sizes AS (SELECT k, avg(m) AS n_mean, median(m) AS n_median FROM hit GROUP BY k)
    SELECT * FROM (SELECT * FROM by_event UNION ALL {_OVERALL}) JOIN sizes USING (k)""")
def _(spark, d):
    _, truth, long, _ = _long(spark, d)
    return metrics.candidate_recall(long, truth, strategy_order=("past_aids", "covisit"))


# Recall of the history: the flagship.

_RECALL_ROWS = """SELECT t.type, k.k, len(list_intersect(list_distinct(coalesce(p.aids, [])[1:k.k]), t.ground_truth)) AS h, least(len(list_distinct(t.ground_truth)), 20) AS g
    FROM truth t LEFT JOIN (SELECT session, list(candidate_aid ORDER BY rank) AS aids FROM past GROUP BY session) p USING (session), (VALUES (10), (20)) AS k(k)"""
_BY = f"SELECT type, k, sum(h) AS hits, sum(g) AS gt, sum(h) / sum(g) AS recall, avg(h / g) AS mean_recall FROM ({_RECALL_ROWS}) GROUP BY ALL"


@register("recall_past_aids", "type string, k int, hits long, gt long, recall double, mean_recall double", f"""
    WITH by_event AS ({_BY}) SELECT * FROM by_event UNION ALL {_OVERALL}""")
def _(spark, d):
    e, truth = split(spark, d)
    past = stored(covisit.past_aids(e), "past").withColumn("score", -F.col("rank"))
    pred = ranking.top_k(past, 20, ("clicks", "carts", "orders"))
    return metrics.recall_at_k(pred, truth, (10, 20))


@register("top_k", "session_type string, labels string", "SELECT session || '_orders' AS session_type, string_agg(candidate_aid, ' ' ORDER BY rank) AS labels FROM past GROUP BY session")
def _(spark, d):
    return ranking.top_k(covisit.past_aids(split(spark, d)[0]).withColumn("score", -F.col("rank")), 20, "orders")


# Features.


def _feature_query(name: str, schema: str, table: str, sql: str | None) -> None:
    """A feature table of the prepared order lines."""
    make = {
        "session": features.session_features,
        "session_item": features.session_item_features,
        "item": features.item_features,
        "item_hour": features.item_hour_features,
        "item_weekday": features.item_weekday_features,
    }[table.removesuffix("_wide")]

    @register(name, schema, sql)
    def _(spark, d):
        return make(events.prepare_events(events_a(spark, d)), wide=table.endswith("_wide"))


def _div(x: str, y: str) -> str:
    return f"CASE WHEN {y} = 0 THEN 0 ELSE ({x}) / ({y})::DOUBLE END"


_N = {0: "click", 1: "cart", 2: "order"}
_D = {0: "clicked", 1: "carted", 2: "ordered"}
_CNT = {t: f"count(*) FILTER (type = {t})" for t in _N}
_DST = {t: f"count(DISTINCT aid) FILTER (type = {t})" for t in _N}
_DIFF = lambda c, t: f"coalesce(abs(arg_max({c}, pos) - avg({c}) FILTER (type = {t})), 99)"
_SESSION = {
    "sess_all_events_count": ("long", "count(*)"),
    "sess_cart_count": ("long", _CNT[1]),
    **{f"sess_{_D[t]}_aid_dcount": ("long", _DST[t]) for t in _N},
    "sess_duration_mins": ("double", "(max(ts) - min(ts)) / 60.0"),
    "sess_avg_cart_dur_sec": ("double", "coalesce(avg(duration_second) FILTER (type = 1), 0)"),
    "sess_last_type_in_session": ("int", "arg_max(type, pos)"),
    "sess_hour": ("int", "arg_max(hour, pos)"),
    "sess_weekday": ("int", "arg_max(weekday, pos)"),
    "sess_carted_to_ordered_aid_cvr": ("double", _div(_DST[2], _DST[1])),
    "sess_abs_diff_avg_hour_cart": ("double", _DIFF("hour", 1)),
    "sess_abs_diff_avg_weekday_cart": ("double", _DIFF("weekday", 1)),
    "sess_binned_aid_dcount": ("int", "CASE WHEN count(DISTINCT aid) <= 4 THEN count(DISTINCT aid) WHEN count(DISTINCT aid) <= 8 THEN 5 WHEN count(DISTINCT aid) <= 12 THEN 6 WHEN count(DISTINCT aid) <= 15 THEN 7 WHEN count(DISTINCT aid) <= 20 THEN 8 WHEN count(DISTINCT aid) <= 30 THEN 9 ELSE 10 END"),
}
_SESSION_WIDE = _SESSION | {
    **{f"sess_avg_{a}_dur_sec": ("double", f"coalesce(avg(duration_second) FILTER (type = {t}), 0)") for t, a in _N.items()},
    **{f"sess_fraction_{a}_to_all": ("double", _div(_CNT[t], "count(*)")) for t, a in _N.items()},
    **{f"sess_abs_diff_avg_hour_{a}": ("double", _DIFF("hour", t)) for t, a in _N.items()},
    "sess_num_real_session": ("long", "sum(oneday_session) + 1"),
    "sess_type_dcount": ("long", "count(DISTINCT type)"),
    "sess_click_to_cart_cvr": ("double", _div(_CNT[1], _CNT[0])),
    "sess_clicked_to_carted_aid_cvr": ("double", _div(_DST[1], _DST[0])),
}


def _grouped(key: str, src: str, cols: dict[str, tuple[str, str]]) -> tuple[str, str]:
    return ", ".join([key, *(f"{c} {t}" for c, (t, _) in cols.items())]), f"SELECT {key.split(' ')[0]}, {', '.join(f'{x} AS {c}' for c, (_, x) in cols.items())} FROM {src} GROUP BY {key.split(' ')[0]}"


for _name, _cols in (("session_features", _SESSION), ("session_features_wide", _SESSION_WIDE)):
    _feature_query(_name, *(lambda x: (x[0], _name.removesuffix("_features").replace("session_features", "session"), x[1]))(_grouped("session long", "prepa", _cols)))

_ITEM = {
    "item_all_events_count": ("long", "count(*)"),
    **{f"item_{a}_count": ("long", _CNT[t]) for t, a in _N.items()},
    **{f"item_avg_hour_{a}": ("double", f"avg(hour) FILTER (type = {t})") for t, a in _N.items()},
    **{f"item_avg_weekday_{a}": ("double", f"avg(weekday) FILTER (type = {t})") for t, a in _N.items() if t != 1},
}
_ITEM_WIDE = _ITEM | {"item_avg_weekday_cart": ("double", "avg(weekday) FILTER (type = 1)"), "item_click_to_cart_cvr": ("double", _div(_CNT[1], _CNT[0])), "item_cart_to_order_cvr": ("double", _div(_CNT[2], _CNT[1]))}
_feature_query("item_features", _grouped("aid int", "prepa", _ITEM)[0], "item", _grouped("aid int", "prepa", _ITEM)[1])
_feature_query("item_features_wide", _grouped("aid int", "prepa", _ITEM_WIDE)[0], "item_wide", _grouped("aid int", "prepa", _ITEM_WIDE)[1])

_TIME = "SELECT aid, {k}, count(*) AS all_n, count(*) FILTER (type = 0) AS click, count(*) FILTER (type = 1) AS cart, count(*) FILTER (type = 2) AS ord FROM prepa GROUP BY ALL"
_feature_query("item_hour_features", "aid int, hour int, itemXhour_all_events_count long, itemXhour_click_count long, itemXhour_click_to_cart_cvr double, itemXhour_frac_click_all_click double, itemXhour_frac_click_all_hour_click double", "item_hour", f"""
    SELECT aid, hour, all_n AS itemXhour_all_events_count, click AS itemXhour_click_count, {_div('cart', 'click')} AS itemXhour_click_to_cart_cvr,
        {_div('click', 'sum(click) OVER (PARTITION BY aid)')} AS itemXhour_frac_click_all_click, {_div('click', 'sum(click) OVER (PARTITION BY hour)')} AS itemXhour_frac_click_all_hour_click FROM ({_TIME.format(k='hour')})""")
_feature_query("item_weekday_features", "aid int, weekday int, itemXweekday_all_events_count long, itemXweekday_cart_count long, itemXweekday_order_count long, itemXweekday_click_to_cart_cvr double, itemXweekday_cart_to_order_cvr double, itemXweekday_frac_click_all_click double, itemXweekday_frac_cart_all_cart double, itemXweekday_frac_cart_all_weekday_cart double", "item_weekday", f"""
    SELECT aid, weekday, all_n AS itemXweekday_all_events_count, cart AS itemXweekday_cart_count, ord AS itemXweekday_order_count, {_div('cart', 'click')} AS itemXweekday_click_to_cart_cvr, {_div('ord', 'cart')} AS itemXweekday_cart_to_order_cvr,
        {_div('click', 'sum(click) OVER (PARTITION BY aid)')} AS itemXweekday_frac_click_all_click, {_div('cart', 'sum(cart) OVER (PARTITION BY aid)')} AS itemXweekday_frac_cart_all_cart, {_div('cart', 'sum(cart) OVER (PARTITION BY weekday)')} AS itemXweekday_frac_cart_all_weekday_cart FROM ({_TIME.format(k='weekday')})""")

for _k, _extra in (("hour", ("cart", "order")), ("weekday", ("order",))):
    _sql_name = {"click": "click", "cart": "cart", "order": "ord"}
    _p = f"itemX{_k}"
    _wide = {f"{_p}_all_events_count": ("long", "all_n"), **{f"{_p}_{a}_count": ("long", x) for a, x in _sql_name.items()}, **{f"{_p}_frac_{a}_all_{a}": ("double", _div(_sql_name[a], f"sum({_sql_name[a]}) OVER (PARTITION BY aid)")) for a in ("click", *_extra)}}
    _wide |= {f"{_p}_frac_{a}_all_hour_{a}": ("double", _div(_sql_name[a], f"sum({_sql_name[a]}) OVER (PARTITION BY hour)")) for a in _extra} if _k == "hour" else {}
    _feature_query(f"item_{_k}_features_wide", f"aid int, {_k} int, " + ", ".join(f"{c} {t}" for c, (t, _) in _wide.items()), f"item_{_k}_wide", f"SELECT aid, {_k}, {', '.join(f'{x} AS {c}' for c, (_, x) in _wide.items())} FROM ({_TIME.format(k=_k)})")

_SI = {
    "sesXaid_all_events_count": ("long", "all_n"),
    **{f"sesXaid_{a}_count": ("long", f"n_{a}") for a in _N.values()},
    **{f"sesXaid_sum_{a}_dur_sec": ("long", f"d_{a}") for a in _N.values()},
    "sesXaid_type_dcount": ("long", "types"),
    "sesXaid_log_recency_score": ("double", "lr"),
    "sesXaid_type_weighted_log_recency_score": ("double", "wr"),
    "sesXaid_action_num_reverse_chrono": ("int", "rev"),
    "sesXaid_last_type_in_session": ("int", "last_type"),
    "sesXaid_mins_from_last_event": ("double", "mins"),
    "sesXaid_frac_log_recency_to_all": ("double", _div("lr", "sum(lr) OVER s")),
    "sesXaid_frac_type_weighted_log_recency_to_all": ("double", _div("wr", "sum(wr) OVER s")),
    **{f"sesXaid_frac_{a}_all_{a}": ("double", _div(f"n_{a}", f"sum(n_{a}) OVER s")) for a in ("click", "cart")},
    **{f"sesXaid_frac_{a}_all_{a}_dur_sec_of_all": ("double", _div(f"d_{a}", "sum(d_all) OVER s")) for a in ("click", "cart")},
    **{f"sesXaid_frac_{a}_all_{a}_dur_sec": ("double", _div(f"d_{a}", f"sum(d_{a}) OVER s")) for a in ("click", "cart")},
    **{f"sesXaid_frac_{a}_of_own_events": ("double", _div(f"n_{a}", "all_n")) for a in _N.values()},
}
_SI_WIDE = _SI | {
    "sesXaid_log_duration": ("double", "ldur"),
    "sesXaid_type_weighted_log_duration": ("double", "wdur"),
    "sesXaid_frac_order_all_order": ("double", _div("n_order", "sum(n_order) OVER s")),
    "sesXaid_frac_order_all_order_dur_sec": ("double", _div("d_order", "sum(d_order) OVER s")),
    "sesXaid_frac_log_duration_to_all": ("double", _div("ldur", "sum(ldur) OVER s")),
    "sesXaid_frac_type_weighted_log_duration_to_all": ("double", _div("wdur", "sum(wdur) OVER s")),
}


def _session_item_sql(cols: dict[str, tuple[str, str]], src: str) -> str:
    return f"""
    SELECT session, aid AS candidate_aid, {', '.join(f'{x} AS {c}' for c, (_, x) in cols.items())} FROM (
        SELECT session, aid, count(*) AS all_n, {', '.join(f'count(*) FILTER (type = {t}) AS n_{a}, coalesce(sum(duration_second) FILTER (type = {t}), 0) AS d_{a}' for t, a in _N.items())}, sum(duration_second) AS d_all,
            count(DISTINCT type) AS types, sum(log_recency_score) AS lr, sum(type_weighted_log_recency_score) AS wr, min(action_num_reverse_chrono) AS rev, arg_max(type, pos) AS last_type, avg((last_ts - ts) / 60.0) AS mins,
            log2(1 + sum(log_duration_second)) AS ldur, log2(1 + sum(type_weighted_log_duration_second)) AS wdur
        FROM (SELECT *, max(ts) OVER (PARTITION BY session) AS last_ts FROM {src}) GROUP BY ALL) WINDOW s AS (PARTITION BY session)"""


for _name, _cols in (("session_item", _SI), ("session_item_wide", _SI_WIDE)):
    _feature_query(_name.replace("item", "item_features"), "session long, candidate_aid int, " + ", ".join(f"{c} {t}" for c, (t, _) in _cols.items()), _name, _session_item_sql(_cols, "prepa"))


_F7 = {t: f"coalesce(sum(times) FILTER (tab = '{t}'), 0)" for t in ("clicks", "carts_orders", "buy2buy")}
_TAGGED = " UNION ALL ".join(f"SELECT aid_x, aid_y, CAST(wgt AS DOUBLE) AS wgt, '{t}' AS tab FROM cv_{t}" for t in _F7)


@register("session_covisit_counts", "session long, candidate_aid int, sess_covisit_clicks_count long, sess_covisit_carts_orders_count long, sess_covisit_buy2buy_count long", f"""
    SELECT session, aid_y AS candidate_aid, {', '.join(f'{x} AS sess_covisit_{t}_count' for t, x in _F7.items())}
    FROM (SELECT session, aid, count(*) AS times FROM ef GROUP BY ALL) JOIN ({_TAGGED}) ON aid = aid_x GROUP BY ALL""")
def _(spark, d):
    e, _, parts = split_in_parts(spark, d)
    return features.session_covisit_counts(e, **covisit_tables_at_once(e, parts), parts=parts)


def _history_in_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    """Labelled history candidates, the events they come from, and the number of parts both lie in."""
    e, truth, parts = split_in_parts(spark, d)
    rows = covisit.past_aids(e).select("session", "candidate_aid", F.col("rank").alias("rank_past_aids"))
    return candidates.label_candidates(rows.withColumn("event", F.lit("orders")), truth).drop("event"), e, parts


def _history_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _history_in_parts(spark, d)[:2]


def _prepared_in_parts(e: DataFrame, parts: int) -> DataFrame:
    return stored_by(events.prepare_events(e), "prepared", "session", parts)


def _represented_in_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The same with their sessions' representatives, prepared events and the events themselves, each
    computed once however often it is used."""
    rows, e, parts = _history_in_parts(spark, d)
    prepared = _prepared_in_parts(e, parts)
    return stored_by(features.session_representation(rows, prepared), "represented", "session", parts), prepared, e, parts


def _represented(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """The rows, the prepared events and the co-visitation tables."""
    rows, prepared, e, _ = _represented_in_parts(spark, d)
    return rows, prepared, covisit_tables(e)


_REP_BEST = dict(zip(features.REPRESENTATIVES, ("pos", "lr", "wr", "ds"), strict=True))
_REPS = f"""SELECT session, {', '.join(f'arg_max(aid, row({m}, aid)) AS {r}_in_session_aid' for r, m in _REP_BEST.items())} FROM (
    SELECT session, aid, max(pos) AS pos, round(sum(log_recency_score), 9) AS lr, round(sum(type_weighted_log_recency_score), 9) AS wr, sum(duration_second) AS ds FROM prepf GROUP BY ALL) GROUP BY session"""
_REPRESENTED = f"""SELECT p.session, p.candidate_aid, p.rank AS rank_past_aids, CASE WHEN t.aid IS NULL THEN 0 ELSE 1 END AS label, {', '.join(f'{r}_in_session_aid' for r in _REP_BEST)}
    FROM past p JOIN ({_REPS}) r ON r.session = p.session LEFT JOIN (SELECT DISTINCT session, unnest(ground_truth) AS aid FROM truth WHERE type = 'orders') t ON t.session = p.session AND t.aid = p.candidate_aid"""


@register("session_representation", "session long, candidate_aid int, " + ", ".join(f"{r}_in_session_aid int" for r in _REP_BEST), _REPRESENTED)
def _(spark, d):
    return _represented(spark, d)[0]


_WEIGHTS = [f"{t}_weight_{r}" for r in _REP_BEST for t in _F7]
_WEIGHTED = f"""SELECT p.*, {', '.join(f'{r}.{t} AS {t}_weight_{r}' for r in _REP_BEST for t in _F7)} FROM ({_REPRESENTED}) p {' '.join(f'LEFT JOIN pairs {r} ON {r}.aid_x = p.{r}_in_session_aid AND {r}.aid_y = p.candidate_aid' for r in _REP_BEST)}"""
_PAIR_TABLE = f"WITH pairs AS (SELECT aid_x, aid_y, {', '.join(f'max(wgt) FILTER (tab = {chr(39)}{t}{chr(39)}) AS {t}' for t in _F7)} FROM ({_TAGGED}) GROUP BY ALL)"


@register("covisit_weights", "session long, candidate_aid int, " + ", ".join(f"{c} double" for c in _WEIGHTS), f"{_PAIR_TABLE} {_WEIGHTED}")
def _(spark, d):
    rows, _, tables = _represented(spark, d)
    return features.covisit_weights(rows, **tables)


def _filled(t: str) -> list[str]:
    return [f"coalesce({t}_weight_{r}, 0)" for r in _REP_BEST]


_STATS = {t: {f"{t}_weight_mean": f"({' + '.join(_filled(t))}) / 4", f"{t}_weight_max": f"greatest({', '.join(_filled(t))})", f"{t}_weight_min": f"least({', '.join(_filled(t))})", f"{t}_weight_max_min_diff": f"greatest({', '.join(_filled(t))}) - least({', '.join(_filled(t))})"} for t in _F7}


@register("weight_stats", "session long, candidate_aid int, " + ", ".join(f"{c} double" for t in _STATS.values() for c in t), f"{_PAIR_TABLE} SELECT session, candidate_aid, {', '.join(f'{x} AS {c}' for t in _STATS.values() for c, x in t.items())} FROM ({_WEIGHTED})")
def _(spark, d):
    rows, _, tables = _represented(spark, d)
    rows = features.covisit_weights(rows, **tables)
    for t in tables:
        rows = features.weight_stats(rows, t)
    return rows


def _distance_sql(rows: str, reps: tuple[str, ...], table: str) -> str:
    cols = ", ".join(
        f"CASE WHEN a_{r}.v IS NULL OR b.v IS NULL THEN NULL ELSE round(list_cosine_similarity(a_{r}.v, b.v), 3) END AS {table}_{r}_cosine_distance, "
        f"CASE WHEN a_{r}.v IS NULL AND b.v IS NULL THEN NULL WHEN a_{r}.v IS NULL THEN round(sqrt(list_dot_product(b.v, b.v)), 3) WHEN b.v IS NULL THEN round(sqrt(list_dot_product(a_{r}.v, a_{r}.v)), 3) ELSE round(list_distance(a_{r}.v, b.v), 3) END AS {table}_{r}_euclidean_distance"
        for r in reps
    )
    return f"SELECT p.*, {cols} FROM ({rows}) p LEFT JOIN ({embeddings_sql(table)}) b ON b.aid = p.candidate_aid {' '.join(f'LEFT JOIN ({embeddings_sql(table)}) a_{r} ON a_{r}.aid = p.{r}_in_session_aid' for r in reps)}"


for _name, _table, _reps in (("embedding_distances", "word2vec", ("last_event",)), ("fasttext_distances", "fasttext", tuple(_REP_BEST)), ("matrix_fact_distances", "matrix_fact", tuple(_REP_BEST))):

    @register(_name, "session long, candidate_aid int, " + ", ".join(f"{_table}_{r}_{m}_distance double" for r in _reps for m in ("cosine", "euclidean")), _distance_sql(_REPRESENTED, _reps, _table))
    def _(spark, d, table=_table, reps=_reps):
        return features.embedding_distances(_represented(spark, d)[0], embeddings(spark, d, table), reps, table)


_RANK_SCORE = "CASE WHEN max(rank) OVER w = 1 THEN 1.0 ELSE pow(2.0, 0.1 + 0.9 * CASE WHEN max(rank) OVER w = 1 THEN 0 ELSE (max(rank) OVER w - rank) / (max(rank) OVER w - 1)::DOUBLE END) - 1 END"


@register("rank_score", "session long, candidate_aid int, log_rank_past_aids_score double, frac_log_rank_past_aids_score_to_all double", f"""
    SELECT *, s / sum(s) OVER (PARTITION BY session) AS frac_log_rank_past_aids_score_to_all, s AS log_rank_past_aids_score FROM (SELECT session, candidate_aid, {_RANK_SCORE} AS s FROM past WINDOW w AS (PARTITION BY session))""")
def _(spark, d):
    return features.rank_score(_represented(spark, d)[0], "rank_past_aids")


@register("relative_diff", "session long, candidate_aid int, rank_past_aids_mean_diff double, rank_past_aids_relative_mean_diff double, label_mean_diff double, label_relative_mean_diff double", f"""
    SELECT session, candidate_aid, rank_past_aids - avg(rank_past_aids) OVER s AS rank_past_aids_mean_diff, {_div('rank_past_aids - avg(rank_past_aids) OVER s', 'avg(rank_past_aids) OVER s')} AS rank_past_aids_relative_mean_diff,
        label - avg(label) OVER s AS label_mean_diff, {_div('label - avg(label) OVER s', 'avg(label) OVER s')} AS label_relative_mean_diff FROM ({_REPRESENTED}) WINDOW s AS (PARTITION BY session)""")
def _(spark, d):
    return features.relative_diff(_represented(spark, d)[0], ["rank_past_aids", "label"])


_SESS = f"SELECT session, count(DISTINCT aid) AS sess_aid_dcount, {', '.join(f'{x} AS {c}' for c, (_, x) in _SESSION.items())} FROM prepf GROUP BY session"
_TIME_DIFF = lambda u, a: f"coalesce(CAST(floor(abs(sess_{u} - item_avg_{u}_{a})) AS INTEGER), 99)"
_TIME_DIFFS = {f"sessXitem_abs_diff_{u}_{a}": _TIME_DIFF(u, a) for a in _N.values() for u in ("hour", "weekday")}


@register("session_item_time_diffs", "session long, candidate_aid int, " + ", ".join(f"{c} int" for c in _TIME_DIFFS), f"SELECT session, candidate_aid, {', '.join(f'{x} AS {c}' for c, x in _TIME_DIFFS.items())} FROM past JOIN ({_SESS}) USING (session) LEFT JOIN ({_grouped('aid int', 'prepf', _ITEM_WIDE)[1]}) i ON i.aid = candidate_aid")
def _(spark, d):
    rows, prepared, _ = _represented(spark, d)
    out = rows.join(features.session_features(prepared), "session").join(features.item_features(prepared, wide=True).withColumnRenamed("aid", "candidate_aid"), "candidate_aid", "left")
    return features.session_item_time_diffs(out, wide=True)


@register("past_rank_or_minus_one", "session long, candidate_aid int, rank_past_aids int, rank_past_aids_min_sess_aid_dcount int", f"""
    SELECT r.session, r.candidate_aid, r.rank_past_aids, CASE WHEN r.rank_past_aids < sess_aid_dcount THEN r.rank_past_aids ELSE -1 END AS rank_past_aids_min_sess_aid_dcount FROM ({_ROWS}) r JOIN ({_SESS}) USING (session) WHERE r.event = 'orders'""")
def _(spark, d):
    e, _, rows = _rows(spark, d)
    session = features.session_features(events.prepare_events(e)).select("session", "sess_aid_dcount")
    return features.past_rank_or_minus_one(rows.where("event = 'orders'").join(session, "session"))


#: Column of the combined table -> (type, SQL); the tables' fill rules are part of it.
_COMBINED = {
    "label": ("int", "p.label"),
    "sess_all_events_count": ("long", "s.sess_all_events_count"),
    **{c: ("long", f"coalesce(si.{c}, 0)") for c in ("sesXaid_all_events_count", "sesXaid_cart_count")},
    "sesXaid_action_num_reverse_chrono": ("int", "coalesce(si.sesXaid_action_num_reverse_chrono, 500)"),
    "sesXaid_mins_from_last_event": ("double", "coalesce(si.sesXaid_mins_from_last_event, 9999)"),
    "sesXaid_mins_from_last_event_log1p": ("double", "coalesce(ln(1 + si.sesXaid_mins_from_last_event), 99)"),
    "sesXaid_frac_click_all_click_dur_sec": ("double", "coalesce(si.sesXaid_frac_click_all_click_dur_sec, 99999)"),
    "sesXaid_frac_click_all_click": ("double", "coalesce(si.sesXaid_frac_click_all_click, 0)"),
    "item_all_events_count": ("long", "coalesce(i.item_all_events_count, 0)"),
    "itemXhour_click_count": ("long", "coalesce(h.click, 0)"),
    "itemXweekday_cart_count": ("long", "coalesce(w.cart, 0)"),
    **{c: ("double", x) for c, x in _STATS["clicks"].items()},
    "word2vec_last_event_cosine_distance": ("double", "coalesce(p.word2vec_last_event_cosine_distance, 0)"),
    "sessXitem_abs_diff_hour_order": ("int", _TIME_DIFF("hour", "order")),
    "sessXitem_abs_diff_weekday_order": ("int", _TIME_DIFF("weekday", "order")),
    "rank_past_aids_mean_diff": ("double", "p.rank_past_aids - avg(p.rank_past_aids) OVER (PARTITION BY p.session)"),
    "log_rank_past_aids_score": ("double", _RANK_SCORE.replace("rank", "p.rank_past_aids")),
    "rank_past_aids_min_sess_aid_dcount": ("int", "CASE WHEN p.rank_past_aids < s.sess_aid_dcount THEN p.rank_past_aids ELSE -1 END"),
}


def _combined_sql(represented: str) -> str:
    weighted = f"""SELECT p.*, {', '.join(f'{r}.{t} AS {t}_weight_{r}' for r in _REP_BEST for t in _F7)} FROM ({_distance_sql(represented, ('last_event',), 'word2vec')}) p {' '.join(f'LEFT JOIN pairs {r} ON {r}.aid_x = p.{r}_in_session_aid AND {r}.aid_y = p.candidate_aid' for r in _REP_BEST)}"""
    return f"""{_PAIR_TABLE} SELECT p.session, p.candidate_aid, {', '.join(f'{x} AS {c}' for c, (_, x) in _COMBINED.items())}
        FROM ({weighted}) p JOIN ({_SESS}) s ON s.session = p.session LEFT JOIN ({_session_item_sql(_SI, 'prepf')}) si ON si.session = p.session AND si.candidate_aid = p.candidate_aid
        LEFT JOIN ({_grouped('aid int', 'prepf', _ITEM)[1]}) i ON i.aid = p.candidate_aid
        LEFT JOIN ({_TIME.format(k='hour').replace('prepa', 'prepf')}) h ON h.aid = p.candidate_aid AND h.hour = s.sess_hour LEFT JOIN ({_TIME.format(k='weekday').replace('prepa', 'prepf')}) w ON w.aid = p.candidate_aid AND w.weekday = s.sess_weekday
        WINDOW w AS (PARTITION BY p.session)"""


COMBINED = "session long, candidate_aid int, " + ", ".join(f"{c} {t}" for c, (t, _) in _COMBINED.items())


def _combine(spark: SparkSession, d: str, rows: DataFrame, prepared: DataFrame, tables: dict[str, DataFrame], parts: int) -> DataFrame:
    ranked = lambda df: features.past_rank_or_minus_one(features.rank_score(features.relative_diff(df, ["rank_past_aids"]), "rank_past_aids"))
    return features.combine_features(
        rows,
        features.session_features(prepared),
        features.weight_lists(rows, **tables),
        features.distances_found(rows, embeddings(spark, d), known_only=True),
        features.session_item_features(prepared),
        features.item_features(prepared),
        features.item_hour_features(prepared),
        features.item_weekday_features(prepared),
        parts,
        ranked,
    )


@register("combined_features", COMBINED, _combined_sql(_REPRESENTED))
def _(spark, d):
    rows, prepared, e, parts = _represented_in_parts(spark, d)
    return _combine(spark, d, rows, prepared, covisit_tables_at_once(e, parts), parts)


_REPRESENTED_ROWS = f"SELECT r.*, {', '.join(f'{r}_in_session_aid' for r in _REP_BEST)} FROM ({_ROWS}) r JOIN ({_REPS}) USING (session) WHERE r.event = 'orders'"


@register("combined_features_new_items", COMBINED, _combined_sql(_REPRESENTED_ROWS))
def _(spark, d):
    """Candidates that the session hasn't seen too, so that every fill rule is met."""
    e, truth, parts = split_in_parts(spark, d)
    tables = covisit_tables_at_once(e, parts)
    rows = candidates.candidate_rows(_strategies(e, tables, parts), ["past_aids", "covisit"], parts)
    rows = candidates.label_candidates(rows, truth).where("event = 'orders'").drop("event")
    prepared = _prepared_in_parts(e, parts)
    rows = stored_by(features.session_representation(rows, prepared), "represented", "session", parts)
    return _combine(spark, d, rows, prepared, tables, parts)


def _combos(spark: SparkSession, d: str) -> DataFrame:
    rows, prepared, _ = _represented(spark, d)
    return features.category_combos(rows.withColumnRenamed("rank_past_aids", "rank_combined"), features.session_features(prepared))


_BINS = "CASE WHEN sess_aid_dcount <= 4 THEN CAST(sess_aid_dcount AS VARCHAR) WHEN sess_aid_dcount <= 8 THEN '5_8' WHEN sess_aid_dcount <= 12 THEN '9_12' WHEN sess_aid_dcount <= 15 THEN '13_15' WHEN sess_aid_dcount <= 20 THEN '16_20' WHEN sess_aid_dcount <= 30 THEN '21_30' ELSE '>30' END"
_COMBO = {"rank_x_last_type": "sess_last_type_in_session", "rank_x_hour": "sess_hour", "rank_x_weekday": "sess_weekday", "rank_x_weekday_x_hour": "sess_weekday || '_' || sess_hour", "rank_x_aid_dcount": _BINS}
_COMBOS = f"SELECT session, candidate_aid, label, {', '.join(f'rank_past_aids || {chr(39)}_{chr(39)} || {x} AS {c}' for c, x in _COMBO.items())} FROM ({_REPRESENTED}) JOIN ({_SESS}) USING (session)"


@register("category_combos", "session long, candidate_aid int, label int, " + ", ".join(f"{c} string" for c in _COMBO), _COMBOS)
def _(spark, d):
    return _combos(spark, d)


_FOLDED = "SELECT *, CAST(('0x' || substr(md5(session || '_' || max(label) OVER (PARTITION BY session) || '_0'), 1, 15)) AS BIGINT) % {k} AS fold FROM ({rows})"


@register("group_folds", "session long, candidate_aid int, label int, fold int", _FOLDED.format(k=5, rows=_COMBOS))
def _(spark, d):
    return ranking.group_folds(_combos(spark, d), 5)


@register("balanced_folds", "session long, candidate_aid int, label int, fold int", f"""
    WITH r AS ({_COMBOS}), s AS (SELECT session, sum(label) AS p, count(*) AS n, CAST(('0x' || substr(md5(session || '_0'), 1, 15)) AS BIGINT) AS h FROM r GROUP BY session),
    o AS (SELECT session, (row_number() OVER (ORDER BY p DESC, n DESC, h, session) - 1) % 10 AS turn FROM s)
    SELECT r.session, r.candidate_aid, r.label, least(turn, 9 - turn) AS fold FROM r JOIN o USING (session)""")
def _(spark, d):
    return ranking.balanced_folds(stored(_combos(spark, d), "combos"), 5)


@register("target_encoding", "session long, candidate_aid int, rank_x_last_type_te double", f"""
    WITH r AS ({_FOLDED.format(k=5, rows=_COMBOS)}), f AS (SELECT rank_x_last_type AS key, fold, sum(label) AS s, count(*) AS m FROM r GROUP BY ALL),
    o AS (SELECT key, fold, sum(s) OVER (PARTITION BY key) - s AS s, sum(m) OVER (PARTITION BY key) - m AS m FROM f)
    SELECT r.session, r.candidate_aid, CASE WHEN o.m > 0 THEN o.s / o.m::DOUBLE ELSE (SELECT avg(label) FROM r) END AS rank_x_last_type_te FROM r JOIN o ON o.key = r.rank_x_last_type AND o.fold = r.fold""")
def _(spark, d):
    rows = ranking.group_folds(_combos(spark, d), 5)
    return features.apply_target_encoding(rows, features.target_encoding(rows, "rank_x_last_type", "fold"), "rank_x_last_type", "fold")


@register("target_encoding_unseen", "session long, candidate_aid int, rank_x_hour_te double", f"""
    WITH r AS ({_FOLDED.format(k=2, rows=_COMBOS)}), e AS (SELECT rank_x_hour AS key, (sum(label) + 20 * (SELECT avg(label) FROM r WHERE fold = 0)) / (count(*) + 20)::DOUBLE AS x FROM r WHERE fold = 0 GROUP BY ALL)
    SELECT r.session, r.candidate_aid, coalesce(e.x, (SELECT avg(label) FROM r WHERE fold = 0)) AS rank_x_hour_te FROM r LEFT JOIN e ON e.key = r.rank_x_hour WHERE r.fold = 1""")
def _(spark, d):
    """Learned from one half, with smoothing, and applied to the other."""
    rows = ranking.group_folds(_combos(spark, d), 2)
    return features.apply_target_encoding(rows.where("fold = 1"), features.target_encoding(rows.where("fold = 0"), "rank_x_hour", smoothing=20), "rank_x_hour")


@register("one_ranker_dataset", "session long, candidate_aid int, label int, rank_past_aids int, rank_covisit int, retrieval_covisit int", f"""
    SELECT session, candidate_aid, max(label * CASE event WHEN 'clicks' THEN 1 WHEN 'carts' THEN 2 ELSE 3 END) AS label, max(rank_past_aids) AS rank_past_aids, max(rank_covisit) AS rank_covisit, max(retrieval_covisit) AS retrieval_covisit FROM ({_ROWS}) GROUP BY ALL""")
def _(spark, d):
    return features.one_ranker_rows(_rows(spark, d)[2])


@register("training_frame", "session long, candidate_aid int, label int, weight double, x0 double, x1 double, x2 double, x3 double", f"""
    SELECT session, candidate_aid, label, CASE WHEN label = 1 THEN 10.0 ELSE 1.0 END AS weight, retrieval_past_aids AS x0, retrieval_covisit AS x1, rank_past_aids AS x2, rank_covisit AS x3 FROM (
        SELECT *, sum(label) OVER () AS p, sum(1 - label) OVER () AS q FROM ({_HASHED}) WHERE event = 'orders' AND CAST(('0x' || substr(md5(session || '_0'), 1, 15)) AS BIGINT) % 4 IN (1, 2))
    WHERE label = 1 OR h / 1152921504606846976.0::DOUBLE < 5 * p / greatest(q, 1)::DOUBLE""")
def _(spark, d):
    from pyspark.ml.functions import vector_to_array

    rows = _rows(spark, d)[2].withColumn("fold", F.pmod(stable_hash("session"), F.lit(4)).cast("int"))
    frame = ranking.training_frame(rows, "orders", [1, 2], ratio=5, seed=3).withColumn("x", vector_to_array("features"))
    return frame.select("session", "candidate_aid", "label", "weight", *(F.col("x")[i].alias(f"x{i}") for i in range(4)))


# Scores, blends, exploration.

MODELS = (1, 2, 3)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Three deterministic stand-ins for models' scores of the history candidates."""
    rows, _ = _history_rows(spark, d)
    parts = F.explode(F.array(*map(F.lit, MODELS))).alias("m")
    s = F.pmod(F.col("session") * 31 + F.col("candidate_aid") * 17 * F.col("m") + F.col("label") * 97, F.lit(1000)) / 1000
    return rows.select("session", "candidate_aid", "label", parts).select(F.concat(F.lit("m"), F.col("m").cast("string")).alias("model"), "session", "candidate_aid", "label", s.alias("score"))


_SCORES = """SELECT 'm' || m AS model, p.session, p.candidate_aid, CASE WHEN t.aid IS NULL THEN 0 ELSE 1 END AS label,
        ((p.session * 31 + p.candidate_aid * 17 * m + CASE WHEN t.aid IS NULL THEN 0 ELSE 97 END) % 1000) / 1000.0::DOUBLE AS score
    FROM past p LEFT JOIN (SELECT DISTINCT session, unnest(ground_truth) AS aid FROM truth WHERE type = 'orders') t ON t.session = p.session AND t.aid = p.candidate_aid, (VALUES (1), (2), (3)) AS v(m)"""
_SCALED = f"SELECT s.* REPLACE ((score - lo) / (hi - lo) AS score) FROM ({_SCORES}) s JOIN (SELECT model, min(score) AS lo, max(score) AS hi FROM ({_SCORES}) GROUP BY model) USING (model)"
PAIR = "session long, candidate_aid int, label int, score double"


@register("ensemble_weighted", PAIR, f"SELECT session, candidate_aid, label, sum(pow(score, 2) * CASE model WHEN 'm1' THEN 0.5 WHEN 'm2' THEN 0.3 ELSE 0.2 END) AS score FROM ({_SCALED}) GROUP BY ALL")
def _(spark, d):
    return ensemble.ensemble_weighted(_scores(spark, d), {"m1": 0.5, "m2": 0.3, "m3": 0.2}, 2)


@register("ensemble_raw", PAIR, f"SELECT session, candidate_aid, label, sum(score * CASE model WHEN 'm1' THEN 0.6 ELSE 0.4 END) AS score FROM ({_SCORES}) WHERE model IN ('m1', 'm2') GROUP BY ALL")
def _(spark, d):
    return ensemble.ensemble_weighted(_scores(spark, d), {"m1": 0.6, "m2": 0.4}, scale=False)


@register("ensemble_mean", PAIR, f"SELECT session, candidate_aid, max(label) AS label, avg(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY model, session ORDER BY score DESC, candidate_aid) AS r FROM ({_SCORES})) WHERE r <= 10 GROUP BY ALL")
def _(spark, d):
    return ensemble.ensemble_mean(_scores(spark, d), 10)


_VOTES = "SELECT session, candidate_aid, round(sum(CASE model WHEN 'm1' THEN 1.0 WHEN 'm2' THEN 0.8 ELSE 0.5 END::DOUBLE), 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY model, session ORDER BY score DESC, candidate_aid) AS r FROM (" + _SCORES + ")) WHERE r <= 10 GROUP BY ALL"


@register("ensemble_vote", "session_type string, labels string", f"SELECT session || '_orders' AS session_type, string_agg(candidate_aid, ' ' ORDER BY r) AS labels FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, candidate_aid) AS r FROM ({_VOTES})) WHERE r <= 10 GROUP BY session")
def _(spark, d):
    s = _scores(spark, d)
    subs = [ranking.top_k(s.where(F.col("model") == m), 10, "orders").withColumn("model", F.lit(m)) for m in ("m1", "m2", "m3")]
    return ensemble.ensemble_vote(ranking.make_submission(*subs), {"m1": 1.0, "m2": 0.8, "m3": 0.5}, 10)


_WIDE = f"SELECT session, candidate_aid, max(label) AS label, {', '.join(f'max(score) FILTER (model = {chr(39)}m{i}{chr(39)}) AS m{i}' for i in MODELS)} FROM ({_SCALED}) GROUP BY ALL"


@register("stacking_dataset", "session long, candidate_aid int, label int, m1 double, m2 double, m3 double", f"SELECT session, candidate_aid, max(label) AS label, {', '.join(f'max(score) FILTER (model = {chr(39)}m{i}{chr(39)}) AS m{i}' for i in MODELS)} FROM ({_SCALED}) GROUP BY ALL")
def _(spark, d):
    return ensemble.stacking_dataset(_scores(spark, d), ["m1", "m2", "m3"])


def _some_scores(spark: SparkSession, d: str) -> DataFrame:
    """The scores, of which each model lacks some rows."""
    return _scores(spark, d).where((F.col("session") + F.col("candidate_aid")) % 3 != F.substring("model", 2, 1).cast("int") - 1)


_GAPS = _WIDE.replace(_SCORES, f"SELECT * FROM ({_SCORES}) WHERE (session + candidate_aid) % 3 <> CAST(model[2:] AS INTEGER) - 1")


@register("stack_preprocess", "session long, candidate_aid int, label int, m1 double, m2 double, m3 double", f"WITH wide AS ({_GAPS}) SELECT session, candidate_aid, label, {', '.join(f'pow(coalesce(m{i}, (SELECT median(m{i}) FROM wide)), 4) AS m{i}' for i in MODELS)} FROM wide")
def _(spark, d):
    return ensemble.stack_preprocess(ensemble.stacking_dataset(_some_scores(spark, d), ["m1", "m2", "m3"]), ["m1", "m2", "m3"])


_POINTS = ", ".join(f"({i}, {a}, {p})" for i, (a, p) in enumerate((a, p) for a in (0.25, 0.5, 0.75) for p in (1, 2)))


@register("tune_ensemble_weights", "point int, recall double", f"""
    WITH best AS (SELECT point, session, candidate_aid, row_number() OVER (PARTITION BY point, session ORDER BY score DESC, candidate_aid) AS r FROM (
        SELECT g.point, session, candidate_aid, round(pow(m1, g.p) * g.a + pow(m2, g.p) * (1 - g.a), 9) AS score FROM ({_WIDE.replace(', (VALUES (1), (2), (3)) AS v(m)', ', (VALUES (1), (2)) AS v(m)')}) CROSS JOIN (VALUES {_POINTS}) AS g(point, a, p))),
    t AS (SELECT session, ground_truth FROM truth WHERE type = 'orders'), hit AS (SELECT DISTINCT session, unnest(ground_truth) AS candidate_aid FROM t)
    SELECT point, count(hit.session) / (SELECT sum(least(len(list_distinct(ground_truth)), 20)) FROM t) AS recall FROM best LEFT JOIN hit USING (session, candidate_aid) WHERE r <= 5 GROUP BY point""")
def _(spark, d):
    grid = [({"m1": a, "m2": 1 - a}, p) for a in (0.25, 0.5, 0.75) for p in (1, 2)]
    return ensemble.tune_ensemble_weights(_scores(spark, d).where("model in ('m1', 'm2')"), split(spark, d)[1], grid, "orders", 5)


@register("searched_ensemble_weights", "trial int, m1 double, m2 double, power double, recall double")
def _(spark, d):
    return ensemble.search_ensemble_weights(_scores(spark, d).where("model in ('m1', 'm2')"), split(spark, d)[1], ["m1", "m2"], "orders", trials=12, batch=6, k=5)


@register("auc", "roc_auc double, pr_auc double", f"""
    SELECT sum(n * (pc - p / 2.0)) / (sum(p) * sum(n)) AS roc_auc, sum(p * pc / (pc + nc)::DOUBLE) / sum(p) AS pr_auc FROM (
        SELECT *, sum(p) OVER w AS pc, sum(n) OVER w AS nc FROM (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM ({_SCORES}) WHERE model = 'm1' GROUP BY score) WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))""")
def _(spark, d):
    return metrics.auc(_scores(spark, d).where("model = 'm1'"))


@register("ranking_metrics", "model string, ndcg double, map double, sessions long", f"""
    WITH o AS (SELECT *, row_number() OVER (PARTITION BY model, session ORDER BY score DESC, candidate_aid) AS place, row_number() OVER (PARTITION BY model, session ORDER BY label DESC, candidate_aid) AS best FROM ({_SCORES})),
    c AS (SELECT *, sum(label) OVER (PARTITION BY model, session ORDER BY place) AS found FROM o),
    s AS (SELECT model, session, coalesce(sum(label / log2(place + 1)) FILTER (place <= 20), 0) AS dcg, sum(label / log2(best + 1)) FILTER (best <= 20) AS ideal,
        coalesce(sum(label * found / place::DOUBLE) FILTER (place <= 20), 0) AS precision, least(sum(label), 20) AS hits FROM c GROUP BY ALL HAVING sum(label) > 0)
    SELECT model, avg(dcg / ideal) AS ndcg, avg(precision / hits) AS map, count(*) AS sessions FROM s GROUP BY model""")
def _(spark, d):
    return boosting.ranking_metrics(stored(_scores(spark, d), "scores"), 20, by=("model",))


@register("point_biserial", "feature string, r double, n long", f"SELECT 'm' || i AS feature, CASE i WHEN 1 THEN r1 WHEN 2 THEN r2 ELSE r3 END AS r, n FROM (SELECT corr(m1, label) AS r1, corr(m2, label) AS r2, corr(m3, label) AS r3, count(*) AS n FROM (SELECT session, candidate_aid, max(label) AS label, {', '.join(f'max(score) FILTER (model = {chr(39)}m{i}{chr(39)}) AS m{i}' for i in MODELS)} FROM ({_SCALED}) GROUP BY ALL)), (VALUES (1), (2), (3)) AS v(i)")
def _(spark, d):
    return metrics.point_biserial(ensemble.stacking_dataset(_scores(spark, d), ["m1", "m2", "m3"]), cols=["m1", "m2", "m3"])


@register("point_biserial_test", "feature string, r double, t double, p double", f"""
    WITH r AS (SELECT unnest([{{'feature': 'm1', 'r': corr(m1, label)}}, {{'feature': 'm2', 'r': corr(m2, label)}}, {{'feature': 'm3', 'r': corr(m3, label)}}], recursive := true), count(*) AS n FROM ({_WIDE})),
    t AS (SELECT feature, r, n - 2 AS df, r * sqrt((n - 2) / (1 - r * r)) AS t FROM r),
    -- p: the density of Student's t on both sides, integrated over the angle atan(t / sqrt(df)).
    a AS (SELECT *, atan(abs(t) / sqrt(df)) AS lo, (pi() / 2 - atan(abs(t) / sqrt(df))) / 200000 AS step FROM t)
    SELECT feature, r, t, 2 * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(pi()) * (SELECT sum(pow(cos(lo + (i + 0.5) * step), df - 1)) FROM generate_series(0, 199999) AS g(i)) * step AS p FROM a""")
def _(spark, d):
    return metrics.point_biserial(ensemble.stacking_dataset(_scores(spark, d), ["m1", "m2", "m3"]), cols=["m1", "m2", "m3"])


@register("feature_histograms", "feature string, kind string, bin int, n long, density double", f"""
    WITH v AS (SELECT label, unnest([{{'feature': 'm1', 'v': m1}}, {{'feature': 'm2', 'v': m2}}], recursive := true) FROM ({_WIDE})), e AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM v GROUP BY feature),
    b AS (SELECT feature, CAST(label AS VARCHAR) AS kind, least(CAST(floor((v - lo) * 50 / (hi - lo)) AS INTEGER), 49) AS bin, lo, hi, count(*) AS n FROM v JOIN e USING (feature) GROUP BY ALL)
    SELECT feature, kind, bin, n, n / sum(n) OVER (PARTITION BY feature, kind) / ((hi - lo) / 50) AS density FROM b""")
def _(spark, d):
    return metrics.feature_histograms(ensemble.stacking_dataset(_scores(spark, d), ["m1", "m2", "m3"]), ["m1", "m2"]).withColumnRenamed("group", "kind")


@register("importance_summary", "feature string, min double, median double, max double, std double", f"""
    SELECT feature, min(x) AS min, median(x) AS median, max(x) AS max, stddev_samp(x) AS std FROM (
        SELECT fold, unnest([{{'feature': 'm1', 'x': abs(corr(m1, label))}}, {{'feature': 'm2', 'x': abs(corr(m2, label))}}, {{'feature': 'm3', 'x': abs(corr(m3, label))}}], recursive := true) FROM ({_FOLDED.format(k=5, rows=_WIDE)}) GROUP BY fold) GROUP BY feature""")
def _(spark, d):
    """Importance of a score in each fold: its correlation with the label."""
    folds = ranking.group_folds(ensemble.stacking_dataset(_scores(spark, d), ["m1", "m2", "m3"]), 5)
    parts = [metrics.point_biserial(folds.where(F.col("fold") == i), cols=["m1", "m2", "m3"]) for i in range(5)]
    return ranking.importance_summary(reduce(DataFrame.unionByName, parts).select("feature", F.abs("r").alias("importance")))


@register("active_sessions", "session long, candidate_aid int, label int", "SELECT session, candidate_aid, label FROM (SELECT *, sum(label) OVER (PARTITION BY session) AS h FROM (" + _SCORES + ") WHERE model = 'm1') WHERE h > 1")
def _(spark, d):
    return ranking.active_sessions(_scores(spark, d).where("model = 'm1'"), 1)


# Models: no SQL; tests hold them against known answers.


def _frame(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)[2].withColumn("fold", F.pmod(stable_hash("session"), F.lit(4)).cast("int"))
    return ranking.training_frame(rows, "orders", [0, 1, 2, 3], ratio=5, seed=3)


for _algo, _params in (("classifier", {"maxIter": 3}), ("regressor", {"maxIter": 3}), ("ranker", {})):

    @register(f"scores_of_{_algo}", "session long, candidate_aid int, label int, score double")
    def _(spark, d, algo=_algo, params=_params):
        frame = stored(_frame(spark, d), "frame")
        models = [ranking.train_ranker(frame.where(F.col("fold") % 2 == f), algo, params) for f in (0, 1)]
        return ranking.score(frame, models)


def _fixed_trees(bounds: list[list[float]], *trees: tuple[list[int], list[int], list[float]]) -> boosting.BoostedRanker:
    return boosting.BoostedRanker(bounds, 0.5, [boosting.Tree(np.array(f), np.array(c), np.array(v)) for f, c, v in trees])


@register("scores_of_given_trees", "session long, candidate_aid int, label int, score double", f"""
    SELECT session, candidate_aid, label, round((
        0.5 * CASE WHEN rank_past_aids <= 5 THEN CASE WHEN retrieval_covisit <= 0.5 THEN 0.4 ELSE 0.8 END ELSE -0.6 END
        + 0.5 * (CASE WHEN rank_covisit <= 3 THEN 0.3 ELSE -0.1 END + CASE WHEN retrieval_past_aids <= 0.5 THEN -0.2 ELSE 0.2 END)) / 2, 3)::DOUBLE AS score
    FROM ({_ROWS}) WHERE event = 'orders'""")
def _(spark, d):
    """All candidate rows of orders by the mean of two listwise rankers with trees that are given."""
    frame = ranking.training_frame(_rows(spark, d)[2].withColumn("fold", F.lit(0)), "orders", [0])
    bounds = [[0.5], [0.5], [2.0, 5.0], [3.0]]  # of retrieval_past_aids, retrieval_covisit, rank_past_aids, rank_covisit
    first = _fixed_trees(bounds, ([2, 1, -1, -1, -1, -1, -1], [1, 0, 0, 0, 0, 0, 0], [0, 0, -0.6, 0.4, 0.8, 0, 0]))
    second = _fixed_trees(bounds, ([3, -1, -1], [0, 0, 0], [0, 0.3, -0.1]), ([0, -1, -1], [0, 0, 0], [0, -0.2, 0.2]))
    return ranking.score(frame, [first, second])


def _stopped(spark: SparkSession, d: str) -> list[tuple[boosting.BoostedRanker, DataFrame, DataFrame]]:
    """Listwise rankers of two folds, each stopped early by the other fold, and their two frames."""
    frame = stored(_frame(spark, d), "frame")
    halves = [frame.where(F.col("fold") % 2 == f) for f in (0, 1)]
    params = {"rounds": 4, "depth": 3, "rate": 0.3, "look_every": 2, "patience": 2}
    return [(ranking.train_ranker(own, "boosted", params | {"validation": other}), own, other) for own, other in (halves, halves[::-1])]


@register("scores_of_listwise", "session long, candidate_aid int, label int, score double")
def _(spark, d):
    """Each row is scored by the ranker of the other fold."""
    return reduce(DataFrame.unionByName, (ranking.score(other, [model]) for model, _, other in _stopped(spark, d)))


@register("listwise_importances", "feature string, min double, median double, max double, std double")
def _(spark, d):
    """Importances of the trained rankers over their folds."""
    trained = _stopped(spark, d)
    columns = ranking.feature_columns(trained[0][1].drop("features"))
    rows = ranking.model_importances([m for m, _, _ in trained], columns)
    return ranking.importance_summary(spark.createDataFrame(rows, "feature string, fold int, importance double"))


@register("stacking_scores", "session long, candidate_aid int, label int, score double")
def _(spark, d):
    wide = stored(ensemble.stack_preprocess(ensemble.stacking_dataset(_some_scores(spark, d), ["m1", "m2", "m3"]), ["m1", "m2", "m3"]), "stack")
    return ensemble.score_stacking(wide, ensemble.train_stacking(wide, ["m1", "m2", "m3"]))


@register("tuned_model", "depth int, auc double")
def _(spark, d):
    frame = stored(_frame(spark, d).drop("fold"), "frame")
    depths = [1, 2]
    model = ranking.tune_model(frame, [{"maxDepth": x, "maxIter": 2} for x in depths], folds=2)
    return spark.createDataFrame(list(zip(depths, map(float, model.avgMetrics), strict=True)), "depth int, auc double")


@register("searched_ranker", "trial int, rate double, depth double, rounds int, best_round int, value double")
def _(spark, d):
    """Trials of the listwise ranker's step and depth; the better of every two goes on."""
    frame = stored(_frame(spark, d).drop("fold"), "frame")
    return search.search_model(frame, {"rate": (0.05, 0.5, "log"), "depth": (2, 4, "int")}, trials=4, batch=4, rounds=2, eta=2).table(spark)


@register("embedding_pca", "aid int, pc0 double, pc1 double")
def _(spark, d):
    return metrics.embedding_pca(embeddings(spark, d)).select("aid", F.col("pc")[0].alias("pc0"), F.col("pc")[1].alias("pc1"))


for _name, _train in (("item_embeddings", neighbours.train_item_embeddings), ("item_factors", neighbours.train_factors)):

    @register(_name, "aid int, dims int")
    def _(spark, d, train=_train):
        return train(events_a(spark, d), 8).select("aid", F.size("vector").alias("dims"))


@register("covisit_factors", "aid int, f0 double, f1 double, f2 double, f3 double")
def _(spark, d):
    got = factors.covisit_factors(stored(covisit.build_covisitation(events_a(spark, d)), "covisit"), 4, iterations=2)
    return got.select("aid", *(F.col("vector")[i].alias(f"f{i}") for i in range(4)))


# Sources and sinks: write to the shared folder, read back.


@register("events_reread", EVENT, "SELECT * FROM ea")
def _(spark, d):
    path = new_folder(spark, "events")
    events_a(spark, d).write.parquet(path)
    return tables.read_events(spark, path)


@register("covisitation_shards", "aid_x int, aid_y int, wgt double", "SELECT * FROM cv_clicks")
def _(spark, d):
    table = stored(covisit_tables(split(spark, d)[0])["clicks"], "covisit")
    paths = [new_folder(spark, f"shard{i}") for i in range(2)]
    for i, path in enumerate(paths):
        table.where(F.col("aid_x") % 2 == i).write.parquet(path)
    return tables.read_covisitation(spark, *paths)


@register("embeddings_reread", "aid int, n int, total double", f"SELECT aid, len(v) AS n, list_sum(v) AS total FROM ({embeddings_sql()})")
def _(spark, d):
    path = new_folder(spark, "vectors")
    embeddings(spark, d).write.parquet(path)
    return tables.read_embeddings(spark, path).select("aid", F.size("vector").alias("n"), F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("total"))


@register("chunks_reread", "session long, aid int, event string, fold int", f"SELECT session, aid, {NAME} AS event, CAST(('0x' || substr(md5(session || '_0'), 1, 15)) AS BIGINT) % 30 AS fold FROM ea")
def _(spark, d):
    path = new_folder(spark, "chunks")
    e = events_a(spark, d)
    tables.write_chunks(e.join(events.assign_stratified_folds(e, 30).select("session", "fold"), "session").withColumn("event", events.type_name()), path)
    return spark.read.parquet(path)


@register("submission_reread", "session_type string, labels string", "SELECT session || '_' || event AS session_type, string_agg(candidate_aid, ' ' ORDER BY rank) AS labels FROM past, (VALUES ('clicks'), ('carts'), ('orders')) AS t(event) GROUP BY ALL")
def _(spark, d):
    path = new_folder(spark, "submission")
    past = stored(covisit.past_aids(split(spark, d)[0]), "past").withColumn("score", -F.col("rank"))
    tables.write_submission(ranking.top_k(past, 20, ("clicks", "carts", "orders")), path)
    return spark.read.schema("session_type string, labels string").option("header", True).csv(path)


@register("labels_reread", "session long, type string, ground_truth list", "SELECT * FROM truth")
def _(spark, d):
    path = new_folder(spark, "labels")
    tables.write_labels(split(spark, d)[1], path)
    return tables.read_labels(spark, path)


@register("metrics_reread", "type string, k int, hits long, gt long, recall double", f"SELECT type, k, sum(h) AS hits, sum(g) AS gt, sum(h) / sum(g) AS recall FROM ({_RECALL_ROWS}) GROUP BY ALL")
def _(spark, d):
    path = new_folder(spark, "metrics")
    e, truth = split(spark, d)
    past = stored(covisit.past_aids(e), "past").withColumn("score", -F.col("rank"))
    pred = ranking.top_k(past, 20, ("clicks", "carts", "orders"))
    tables.write_metrics(metrics.recall_at_k(pred, truth, (10, 20)), path)
    return spark.read.schema("type string, k int, hits long, gt long, recall double").json(path).where("type <> 'overall'")


@register("narrowed", "session int, pos int, rounded double, whole int", "SELECT session, pos, CAST(round((ts % 1000) / 7.0::DOUBLE, 3) AS FLOAT) AS rounded, CAST(trunc((ts % 1000) / 7.0::DOUBLE) AS INTEGER) AS whole FROM posa")
def _(spark, d):
    p = events.with_position(events_a(spark, d)).select("session", "pos", (F.col("ts") % 1000 / 7.0).alias("x"))
    rounded, whole = tables.round3(p).withColumnRenamed("x", "rounded"), tables.floats_to_int(p).withColumnRenamed("x", "whole")
    return tables.downcast(rounded.join(whole, ["session", "pos"]))
