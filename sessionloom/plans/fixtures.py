"""Session views over the given tables, in Spark and as SQL, for the registered queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import covisit, events
from sessionloom.sources.scratch import stored_by


def events_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-weeks of the events table."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type <> 'error'")
    ts = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    kind = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 1).otherwise(0)
    week = F.floor((ts - 1_704_067_200) / (7 * 86_400))
    aid = F.get_json_object("props", "$.k").cast("int")
    return e.select((F.col("user_id") * 10 + week).cast("long").alias("session"), aid.alias("aid"), ts.cast("long").alias("ts"), kind.alias("type"))


def events_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' order lines."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_returnflag")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    kind = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "R", 1).otherwise(0)
    ts = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1_000_000)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").cast("long").alias("session"), F.col("l_partkey").cast("int").alias("aid"), ts.cast("long").alias("ts"), kind.alias("type"))


#: Three item tables: the given vectors, and their first and second halves.
SLICES = {"word2vec": (1, 64), "fasttext": (1, 32), "matrix_fact": (33, 64)}


def embeddings(spark: SparkSession, sf_dir: str, table: str = "word2vec") -> DataFrame:
    lo, hi = SLICES[table]
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("aid"), F.slice("embedding", lo, hi - lo + 1).alias("vector"))


def embeddings_sql(table: str = "word2vec") -> str:
    lo, hi = SLICES[table]
    return f"SELECT CAST(vec_id AS INTEGER) AS aid, CAST(embedding[{lo}:{hi}] AS DOUBLE[]) AS v FROM embeddings"


def covisit_tables(e: DataFrame) -> dict[str, DataFrame]:
    """The three co-visitation tables of an event log."""
    return {
        "clicks": covisit.build_covisitation(e, top_n=20),
        "carts_orders": covisit.build_covisitation(e, types=(1, 2), top_n=15),
        "buy2buy": covisit.build_covisitation(e, types=(1, 2), window_s=14 * 86_400, top_n=15),
    }


def covisit_tables_at_once(e: DataFrame, parts: int) -> dict[str, DataFrame]:
    """The same three tables, for jobs that read all of them or one of them often: made together and
    stored by aid_x in ``parts`` parts."""
    day = covisit.CovisitRules(types=(1, 2))
    rules = {"clicks": (covisit.CovisitRules(), 20), "carts_orders": (day, 15), "buy2buy": (replace(day, window_s=14 * 86_400), 15)}
    together = stored_by(covisit.covisitation_together(e, rules, parts), "covisit", "aid_x", parts)
    return {t: covisit.one_of(together, t) for t in rules}


#: Events of the sessions that one task gets: later steps by session find them there.
PART_EVENTS = 100_000


def split_in_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """(features, truth, parts) of ``events_b``: both lie by session in as many parts as the log's length
    asks for, so that a task's memory doesn't grow with the log (Spark would join parts by their
    compressed size). They are stored in these parts, so no later step by session shuffles them."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # as many events, or more
    parts = max(1, -(-lines // PART_EVENTS))
    e = events_b(spark, sf_dir).repartition(parts, "session")
    features, labels = events.random_cutoff_split(e, seed=7, keep=lambda df: stored_by(df, "split", "session", parts))
    return features, events.ground_truth(labels), parts


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return split_in_parts(spark, sf_dir)[:2]


def _prepared(src: str) -> str:
    return f"""
        SELECT session, aid, ts, type, pos, n - pos + 1 AS action_num_reverse_chrono, lrs AS log_recency_score,
            CASE WHEN raw > 86400 THEN 1 ELSE 0 END AS oneday_session, dur AS duration_second,
            tw * lrs AS type_weighted_log_recency_score, ((ts + 7200) // 3600) % 24 AS hour, ((ts + 7200) // 86400 + 3) % 7 AS weekday,
            strftime(make_timestamp((ts + 7200) * 1000000), '%Y-%m-%d') AS date,
            lrs * dur AS log_duration_second, tw * lrs * dur AS type_weighted_log_duration_second
        FROM (SELECT *, CASE WHEN raw > 86400 THEN 0 ELSE coalesce(raw, 0) END AS dur,
                CASE WHEN n = 1 THEN 1.0 ELSE pow(2.0, 0.1 + 0.9 * (pos - 1) / (n - 1)) - 1 END AS lrs,
                CASE type WHEN 0 THEN 1.0 WHEN 1 THEN 6.0 ELSE 3.0 END AS tw
            FROM (SELECT *, coalesce(lead(ts) OVER w - ts, ts - lag(ts) OVER w) AS raw FROM {src} WINDOW w AS (PARTITION BY session ORDER BY ts, type, aid)))
    """


def _covisit(src: str, types: str, window: int, top: int) -> str:
    return f"""
        SELECT aid_x, aid_y, CAST(wgt AS FLOAT) AS wgt FROM (
            SELECT *, row_number() OVER (PARTITION BY aid_x ORDER BY wgt DESC, aid_y) AS nb FROM (
                SELECT aid_x, aid_y, sum(w) AS wgt FROM (
                    SELECT x.session, x.aid AS aid_x, y.aid AS aid_y, max(CASE y.type WHEN 0 THEN 1.0 WHEN 1 THEN 6.0 ELSE 3.0 END) AS w
                    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, type DESC, aid DESC) AS r FROM {src} WHERE type IN {types}) WHERE r <= 30) x
                    JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, type DESC, aid DESC) AS r FROM {src} WHERE type IN {types}) WHERE r <= 30) y
                    ON x.session = y.session AND x.aid <> y.aid AND abs(x.ts - y.ts) <= {window}
                    GROUP BY ALL) GROUP BY ALL)) WHERE nb <= {top}
    """


def _history(weight: str) -> str:
    return f"""
        SELECT session, aid, count(*) OVER (PARTITION BY session) AS m, score, first_pos, last_pos FROM (
            SELECT session, aid, round(sum((CASE WHEN n = 1 THEN 1.0 ELSE pow(2.0, 0.1 + 0.9 * (pos - 1) / (n - 1)) - 1 END) * {weight}), 9) AS score,
                min(pos) AS first_pos, max(pos) AS last_pos FROM posf GROUP BY ALL)
    """


def _hash(text: str) -> str:
    return f"CAST(('0x' || substr(md5({text}), 1, 15)) AS BIGINT)"


#: Common table expressions, in an order in which each uses earlier ones only.
CTES: dict[str, str] = {
    "ea": """
        SELECT CAST(user_id * 10 + (epoch_us(ts) // 1000000 - 1704067200) // 604800 AS BIGINT) AS session, CAST(json_extract_string(props, '$.k') AS INTEGER) AS aid,
            epoch_us(ts) // 1000000 AS ts, CASE event_type WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS type
        FROM events WHERE event_type <> 'error'
    """,
    "eb": """
        SELECT CAST(o_custkey AS BIGINT) AS session, CAST(l_partkey AS INTEGER) AS aid, epoch_us(CAST(o_orderdate AS TIMESTAMP)) // 1000000 AS ts,
            CASE l_returnflag WHEN 'A' THEN 2 WHEN 'R' THEN 1 ELSE 0 END AS type
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
    **{f"pos{v}": f"SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, type, aid) AS pos, count(*) OVER (PARTITION BY session) AS n FROM e{v}" for v in "ab"},
    **{f"prep{v}": _prepared(f"pos{v}") for v in "ab"},
    "cut": f"SELECT *, 1 + {_hash('session || chr(95) || 7')} % (n - 1) AS cutoff FROM posb WHERE n > 1",
    "ef": "SELECT session, aid, ts, type FROM cut WHERE pos <= cutoff",
    "posf": "SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, type, aid) AS pos, count(*) OVER (PARTITION BY session) AS n FROM ef",
    "prepf": _prepared("posf"),
    "truth": "SELECT session, CASE type WHEN 0 THEN 'clicks' WHEN 1 THEN 'carts' ELSE 'orders' END AS type, list(aid ORDER BY pos) AS ground_truth FROM cut WHERE pos > cutoff GROUP BY ALL",
    "uniq": "SELECT *, row_number() OVER (PARTITION BY session ORDER BY last_pos DESC) - 1 AS recent_rank FROM (SELECT session, aid, max(pos) AS last_pos FROM posf GROUP BY ALL)",
    "cv_clicks": _covisit("ef", "(0, 1, 2)", 86_400, 20),
    "cv_carts_orders": _covisit("ef", "(1, 2)", 86_400, 15),
    "cv_buy2buy": _covisit("ef", "(1, 2)", 14 * 86_400, 15),
    "past_all": _history("CASE type WHEN 0 THEN 1.0 WHEN 1 THEN 6.0 ELSE 3.0 END"),
    "past_rerank": _history("CASE type WHEN 1 THEN 9.0 ELSE 0.5 END"),
    "past": """
        SELECT session, aid AS candidate_aid, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY session ORDER BY CASE WHEN m >= 20 THEN -score ELSE -last_pos END, CASE WHEN m >= 20 THEN first_pos ELSE 0 END) - 1 AS rank FROM past_all) WHERE rank < 20
    """,
    "past_more": """
        SELECT session, aid AS candidate_aid, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY session ORDER BY CASE WHEN m > 20 THEN -score ELSE -last_pos END, CASE WHEN m > 20 THEN first_pos ELSE 0 END) - 1 AS rank FROM past_rerank) WHERE rank < 20
    """,
}


def with_ctes(sql: str) -> str:
    """The SQL behind the common table expressions that it needs."""
    import re

    needed: set[str] = set()
    words = [sql]
    while words:
        text = words.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                words.append(CTES[name])
    parts = [f"{name} AS ({body})" for name, body in CTES.items() if name in needed]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
