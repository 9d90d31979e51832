"""Feature tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.exprs import EVENTS, safe_div


NAMES = {0: "click", 1: "cart", 2: "order"}
DONE = {0: "clicked", 1: "carted", 2: "ordered"}
#: Fills for candidates that the session never touched.
MISSING_POSITION, MISSING_MINUTES, MISSING_LOG, MISSING_SHARE, MISSING_DIFF = 500, 9999, 99, 99999, 99
TABLES = ("clicks", "carts_orders", "buy2buy")
REPRESENTATIVES = ("last_event", "max_recency_event", "max_weighted_recency_event", "max_duration_event")


def _of(t: int) -> Column:
    return F.col("type") == t


def _when(t: int, c: str | Column) -> Column:
    return F.when(_of(t), F.col(c) if isinstance(c, str) else c)


def bin_distinct_count(col: str | Column, text: bool = False) -> Column:
    """number of distinct items in bins: to 4 itself, then 5 (5-8) ... 10 (over 30); or as text."""
    c = F.col(col) if isinstance(col, str) else col
    # Upper bounds and names of the bins.
    bins = [(8, 5, "5_8"), (12, 6, "9_12"), (15, 7, "13_15"), (20, 8, "16_20"), (30, 9, "21_30")]
    out = F.lit(">30") if text else F.lit(10)
    for top, number, name in reversed(bins):
        out = F.when(c <= top, F.lit(name) if text else F.lit(number)).otherwise(out)
    return F.when(c <= 4, c.cast("string" if text else "int")).otherwise(out)


def session_features(prepared: DataFrame, wide: bool = False) -> DataFrame:
    """F1 (``wide``: F1b): one row per session, from one grouping."""
    count = {t: F.count_if(_of(t)) for t in NAMES}
    distinct = {t: F.count_distinct(_when(t, "aid")) for t in NAMES}
    last = lambda c: F.max_by(c, "pos")
    diff = lambda c, t: F.coalesce(F.abs(last(c) - F.avg(_when(t, c))), F.lit(float(MISSING_DIFF)))
    aggs = {
        "sess_all_events_count": F.count("*"),
        "sess_cart_count": count[1],
        **{f"sess_{DONE[t]}_aid_dcount": distinct[t] for t in NAMES},
        "sess_aid_dcount": F.count_distinct("aid"),
        "sess_duration_mins": (F.max("ts") - F.min("ts")) / 60,
        "sess_avg_cart_dur_sec": F.coalesce(F.avg(_when(1, "duration_second")), F.lit(0.0)),
        "sess_last_type_in_session": last("type"),
        "sess_hour": last("hour"),
        "sess_weekday": last("weekday"),
        "sess_carted_to_ordered_aid_cvr": safe_div(distinct[2], distinct[1]),
        "sess_abs_diff_avg_hour_cart": diff("hour", 1),
        "sess_abs_diff_avg_weekday_cart": diff("weekday", 1),
    }
    if wide:
        for t, a in NAMES.items():
            aggs |= {f"sess_{a}_count": count[t], f"sess_avg_{a}_dur_sec": F.coalesce(F.avg(_when(t, "duration_second")), F.lit(0.0))}
            aggs |= {f"sess_fraction_{a}_to_all": safe_div(count[t], F.count("*")), f"sess_fraction_{a}_dur_to_all": safe_div(F.sum(F.coalesce(_when(t, "duration_second"), F.lit(0))), F.sum("duration_second"))}
            aggs |= {f"sess_abs_diff_avg_hour_{a}": diff("hour", t), f"sess_abs_diff_avg_weekday_{a}": diff("weekday", t)}
        aggs |= {
            "sess_num_real_session": F.sum("oneday_session") + 1,
            "sess_type_dcount": F.count_distinct("type"),
            "sess_click_to_cart_cvr": safe_div(count[1], count[0]),
            "sess_cart_to_order_cvr": safe_div(count[2], count[1]),
            "sess_clicked_to_carted_aid_cvr": safe_div(distinct[1], distinct[0]),
        }
    out = prepared.groupBy("session").agg(*(c.alias(n) for n, c in aggs.items()))
    return out.withColumn("sess_binned_aid_dcount", bin_distinct_count("sess_aid_dcount"))


def session_item_features(prepared: DataFrame, wide: bool = False) -> DataFrame:
    """F3 (``wide``: F3b): one row per (session, candidate_aid); shares come from session windows."""
    aggs = {"sesXaid_all_events_count": F.count("*")}
    for t, a in NAMES.items():
        aggs[f"sesXaid_{a}_count"] = F.count_if(_of(t))
        aggs[f"sesXaid_avg_{a}_dur_sec"] = F.coalesce(F.avg(_when(t, "duration_second")), F.lit(0.0))
        aggs[f"sesXaid_sum_{a}_dur_sec"] = F.sum(F.coalesce(_when(t, "duration_second"), F.lit(0)))
    last_ts = F.max("ts").over(Window.partitionBy("session"))
    aggs |= {
        "sesXaid_sum_dur_sec": F.sum("duration_second"),
        "sesXaid_type_dcount": F.count_distinct("type"),
        "sesXaid_log_recency_score": F.sum("log_recency_score"),
        "sesXaid_type_weighted_log_recency_score": F.sum("type_weighted_log_recency_score"),
        "sesXaid_action_num_reverse_chrono": F.min("action_num_reverse_chrono"),
        "sesXaid_last_type_in_session": F.max_by("type", "pos"),
        "sesXaid_mins_from_last_event": F.avg((F.col("session_last_ts") - F.col("ts")) / 60),
    }
    if wide:
        aggs |= {"sesXaid_log_duration": F.log2(1 + F.sum("log_duration_second")), "sesXaid_type_weighted_log_duration": F.log2(1 + F.sum("type_weighted_log_duration_second"))}
    out = prepared.withColumn("session_last_ts", last_ts).groupBy("session", "aid").agg(*(c.alias(n) for n, c in aggs.items()))
    w = Window.partitionBy("session")
    share = lambda c, of=None: safe_div(F.col(c), F.sum(of or c).over(w))
    cols = {
        "sesXaid_mins_from_last_event_log1p": F.log1p("sesXaid_mins_from_last_event"),
        "sesXaid_frac_log_recency_to_all": share("sesXaid_log_recency_score"),
        "sesXaid_frac_type_weighted_log_recency_to_all": share("sesXaid_type_weighted_log_recency_score"),
    }
    for t, a in NAMES.items():
        if t < 2 or wide:
            cols[f"sesXaid_frac_{a}_all_{a}"] = share(f"sesXaid_{a}_count")
            cols[f"sesXaid_frac_{a}_all_{a}_dur_sec_of_all"] = share(f"sesXaid_sum_{a}_dur_sec", "sesXaid_sum_dur_sec")
            cols[f"sesXaid_frac_{a}_all_{a}_dur_sec"] = share(f"sesXaid_sum_{a}_dur_sec")
        cols[f"sesXaid_frac_{a}_of_own_events"] = safe_div(f"sesXaid_{a}_count", "sesXaid_all_events_count")
    if wide:
        cols |= {"sesXaid_frac_log_duration_to_all": share("sesXaid_log_duration"), "sesXaid_frac_type_weighted_log_duration_to_all": share("sesXaid_type_weighted_log_duration")}
    return out.withColumns(cols).withColumnRenamed("aid", "candidate_aid")


def item_features(prepared: DataFrame, wide: bool = False) -> DataFrame:
    """counts and mean hour and weekday by type, per aid."""
    aggs = {"item_all_events_count": F.count("*"), **{f"item_{a}_count": F.count_if(_of(t)) for t, a in NAMES.items()}, **{f"item_avg_hour_{a}": F.avg(_when(t, "hour")) for t, a in NAMES.items()}}
    aggs |= {f"item_avg_weekday_{a}": F.avg(_when(t, "weekday")) for t, a in NAMES.items() if t != 1 or wide}
    if wide:
        aggs |= {"item_click_to_cart_cvr": safe_div(F.count_if(_of(1)), F.count_if(_of(0))), "item_cart_to_order_cvr": safe_div(F.count_if(_of(2)), F.count_if(_of(1)))}
    return prepared.groupBy("aid").agg(*(c.alias(n) for n, c in aggs.items()))


def _item_time(prepared: DataFrame, key: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    counts = prepared.groupBy("aid", key).agg(F.count("*").alias(f"{prefix}_all_events_count"), *(F.count_if(_of(t)).alias(f"{prefix}_{a}_count") for t, a in NAMES.items()))
    totals = counts.groupBy(key).agg(*(F.sum(f"{prefix}_{a}_count").alias(f"all_{a}") for a in NAMES.values()))  # 24 or 7 rows
    return counts, counts.join(F.broadcast(totals), key)


def _own_share(prefix: str, a: str) -> Column:
    return safe_div(f"{prefix}_{a}_count", F.sum(f"{prefix}_{a}_count").over(Window.partitionBy("aid")))


def item_hour_features(prepared: DataFrame, wide: bool = False) -> DataFrame:
    """per (aid, hour)."""
    p = "itemXhour"
    cols = {f"{p}_click_to_cart_cvr": safe_div(f"{p}_cart_count", f"{p}_click_count"), f"{p}_frac_click_all_click": _own_share(p, "click"), f"{p}_frac_click_all_hour_click": safe_div(f"{p}_click_count", "all_click")}
    if wide:
        for a in ("cart", "order"):
            cols |= {f"{p}_frac_{a}_all_{a}": _own_share(p, a), f"{p}_frac_{a}_all_hour_{a}": safe_div(f"{p}_{a}_count", f"all_{a}")}
    out = _item_time(prepared, "hour", p)[1].withColumns(cols).drop("all_click", "all_cart", "all_order")
    return out if wide else out.drop(f"{p}_cart_count", f"{p}_order_count")


def item_weekday_features(prepared: DataFrame, wide: bool = False) -> DataFrame:
    """per (aid, weekday)."""
    p = "itemXweekday"
    cols = {
        f"{p}_click_to_cart_cvr": safe_div(f"{p}_cart_count", f"{p}_click_count"),
        f"{p}_cart_to_order_cvr": safe_div(f"{p}_order_count", f"{p}_cart_count"),
        **{f"{p}_frac_{a}_all_{a}": _own_share(p, a) for a in (("click", "cart", "order") if wide else ("click", "cart"))},
        f"{p}_frac_cart_all_weekday_cart": safe_div(f"{p}_cart_count", "all_cart"),
    }
    out = _item_time(prepared, "weekday", p)[1].withColumns(cols).drop("all_click", "all_cart", "all_order")
    return out if wide else out.drop(f"{p}_click_count")


def _tagged(clicks: DataFrame, carts_orders: DataFrame, buy2buy: DataFrame) -> DataFrame:
    parts = [t.select("aid_x", "aid_y", F.col("wgt").cast("double").alias("wgt"), F.lit(n).alias("tab")) for n, t in zip(TABLES, (clicks, carts_orders, buy2buy), strict=True)]
    return reduce(DataFrame.unionByName, parts)


def _near_lists(tables: dict[str, DataFrame], each: Column | str) -> DataFrame:
    """``aid_x, aids`` and a list for each table: the neighbours of each aid_x in any of them, and beside
    each what ``each`` makes of the table's rows (null without any)."""
    parts = [t.select("aid_x", "aid_y", "wgt", F.lit(n).alias("tab")) for n, t in tables.items()]
    pairs = reduce(DataFrame.unionByName, parts).repartition("aid_x").groupBy("aid_x", "aid_y").agg(*(each(F.col("tab") == n).alias(n) for n in tables))
    lists = pairs.groupBy("aid_x").agg(F.collect_list(F.struct("aid_y", *tables)).alias("x"))
    take = lambda c: F.transform("x", lambda s: s[c])
    return lists.select("aid_x", take("aid_y").alias("aids"), *(take(n).alias(n) for n in tables))


def session_covisit_counts(events: DataFrame, clicks: DataFrame, carts_orders: DataFrame, buy2buy: DataFrame, parts: int | None = None) -> DataFrame:
    """events of the session that lead to an aid, in each table; the tables are tagged and
    joined once. Equal events are combined before the join. Events travel to their session (dealt into
    ``parts``) with the lists of their neighbours, which are counted there: hits are never shuffled."""
    times = events.groupBy("session", "aid").agg(F.count("*").alias("times"))
    lists = _near_lists(dict(zip(TABLES, (clicks, carts_orders, buy2buy), strict=True)), lambda here: F.count_if(here).cast("int"))
    met = times.join(lists.hint("merge"), F.col("aid") == F.col("aid_x")).select("session", "times", "aids", *TABLES)
    met = met.repartition(*([parts] if parts else []), "session").select("session", "times", F.explode(F.arrays_zip("aids", *TABLES)).alias("x"))
    counts = (F.sum(F.col("times") * F.col(f"x.{n}")).alias(f"sess_covisit_{n}_count") for n in TABLES)
    return met.groupBy("session", F.col("x.aids").alias("candidate_aid")).agg(*counts)


def session_representation(rows: DataFrame, prepared: DataFrame) -> DataFrame:
    """F8: four representative aids of the session for each candidate row."""
    per = prepared.groupBy("session", "aid").agg(F.max("pos").alias("pos"), *(F.round(F.sum(c), 9).alias(c) for c in ("log_recency_score", "type_weighted_log_recency_score", "duration_second")))
    best = lambda c: F.max_by("aid", F.struct(c, "aid"))
    measures = ("pos", "log_recency_score", "type_weighted_log_recency_score", "duration_second")
    reps = per.groupBy("session").agg(*(best(m).alias(f"{r}_in_session_aid") for m, r in zip(measures, REPRESENTATIVES, strict=True)))
    return rows.join(reps, "session", "left")


def covisit_weights(represented: DataFrame, clicks: DataFrame, carts_orders: DataFrame, buy2buy: DataFrame) -> DataFrame:
    """weight of (representative, candidate) in each table, 12 columns, null if absent. The narrow
    (session, candidate, representative) rows are looked up once in one tagged table; what is found
    comes back by (session, candidate) in a single join."""
    wide = _tagged(clicks, carts_orders, buy2buy).groupBy("aid_x", "aid_y").agg(*(F.max(F.when(F.col("tab") == n, F.col("wgt"))).alias(n) for n in TABLES))
    reps = F.explode(F.array(*(F.struct(F.lit(r).alias("rep"), F.col(f"{r}_in_session_aid").alias("aid_x")) for r in REPRESENTATIVES))).alias("x")
    asked = represented.select("session", F.col("candidate_aid").alias("aid_y"), reps).select("session", "aid_y", "x.*").where("aid_x is not null")
    found = asked.join(wide.hint("merge"), ["aid_x", "aid_y"]).groupBy("session", F.col("aid_y").alias("candidate_aid"))
    weights = found.agg(*(F.max(F.when(F.col("rep") == r, F.col(n))).alias(f"{n}_weight_{r}") for r in REPRESENTATIVES for n in TABLES))
    return represented.join(weights.hint("merge"), ["session", "candidate_aid"], "left")


def weight_lists(represented: DataFrame, clicks: DataFrame, carts_orders: DataFrame, buy2buy: DataFrame) -> DataFrame:
    """What ``covisit_weights`` finds, packed for the way to the sessions: for each of a session's
    representatives ``session``, its neighbours ``aids`` with a list of weights for each table, and by
    ``is_<representative>`` whom it stands for. A session has the same representatives in all rows."""
    names = [f"{r}_in_session_aid" for r in REPRESENTATIVES]
    reps = represented.groupBy("session").agg(*(F.max(c).alias(c) for c in names))
    asked = reps.select("*", F.explode(F.array_distinct(F.array(*names))).alias("rep")).where("rep is not null")
    asked = asked.select("session", "rep", *(F.coalesce(F.col(c) == F.col("rep"), F.lit(False)).alias(f"is_{r}") for r, c in zip(REPRESENTATIVES, names, strict=True)))
    lists = _near_lists(dict(zip(TABLES, (clicks, carts_orders, buy2buy), strict=True)), lambda here: F.max(F.when(here, F.col("wgt"))))
    return asked.join(lists.hint("merge"), F.col("rep") == F.col("aid_x")).select("session", "aids", *TABLES, *(f"is_{r}" for r in REPRESENTATIVES))


def embedding_distances(represented: DataFrame, embeddings: DataFrame, representatives: tuple[str, ...] = ("last_event",), prefix: str = "word2vec") -> DataFrame:
    """Cosine similarity (the column keeps its historical name, *_cosine_distance) and
    euclidean distance of candidate and representative, 3 decimals. An item without a vector is a
    zero vector: cosine null. Distinct pairs get their vectors; the wide rows never carry any.
    (session, candidate_aid) is a key of the rows."""
    return represented.join(distances_found(represented, embeddings, representatives, prefix).hint("merge"), ["session", "candidate_aid"], "left")


def distances_found(represented: DataFrame, embeddings: DataFrame, representatives: tuple[str, ...] = ("last_event",), prefix: str = "word2vec", known_only: bool = False) -> DataFrame:
    """``session, candidate_aid`` and the columns of ``embedding_distances``; ``known_only`` leaves out pairs of
    two items without a vector, whose distances are null, before they travel."""
    reps = [f"{r}_in_session_aid" for r in representatives]
    vec = embeddings.select("aid", F.col("vector").cast("array<double>").alias("v"))
    asked = represented.select("session", "candidate_aid", F.explode(F.array(*(F.struct(F.lit(r).alias("rep"), F.col(c).alias("x")) for r, c in zip(representatives, reps, strict=True)))).alias("q"))
    asked = asked.select("session", F.col("candidate_aid").alias("y"), "q.*").where("x is not null")
    if known_only:
        ids = embeddings.select("aid").distinct()
        known = lambda c: ids.select(F.col("aid").alias(c), F.lit(1).alias(f"_{c}"))
        asked = asked.join(known("x"), "x", "left").join(known("y"), "y", "left").where("_x = 1 or _y = 1").select("session", "y", "rep", "x")
    pairs = asked.select("x", "y").distinct()
    both = pairs.join(vec.select(F.col("aid").alias("x"), F.col("v").alias("vx")), "x", "left").join(vec.select(F.col("aid").alias("y"), F.col("v").alias("vy")), "y", "left")
    zero = lambda a, b: F.coalesce(a, F.transform(b, lambda _: F.lit(0.0)))
    vx, vy = zero(F.col("vx"), F.col("vy")), zero(F.col("vy"), F.col("vx"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    dot = lambda a, b: total(F.zip_with(a, b, lambda p, q: p * q))
    norm = F.sqrt(dot(vx, vx)) * F.sqrt(dot(vy, vy))
    both = both.select("x", "y", F.round(F.try_divide(dot(vx, vy), norm), 3).alias("cos"), F.round(F.sqrt(total(F.zip_with(vx, vy, lambda p, q: (p - q) * (p - q)))), 3).alias("euc"))
    # Distances go back to (session, candidate) in one narrow grouping; the wide rows are joined once.
    # Rows and pairs as many as candidates are merged: a stored table's size on disk says little of
    # them, and Spark would send all of ``asked`` to the driver if it is under the broadcast threshold.
    found = asked.join(both.hint("merge"), ["x", "y"]).groupBy("session", F.col("y").alias("candidate_aid"))
    names = [(r, kind, f"{prefix}_{r}_{name}_distance") for r in representatives for kind, name in (("cos", "cosine"), ("euc", "euclidean"))]
    return found.agg(*(F.max(F.when(F.col("rep") == r, F.col(kind))).alias(name) for r, kind, name in names))


def rank_score(rows: DataFrame, rank_col: str, key: tuple[str, ...] = ("session",)) -> DataFrame:
    """2^(0.1 + 0.9 (max - rank) / (max - 1)) - 1 over the session (max 1: 1), and its share."""
    w = Window.partitionBy(*key)
    top, name = F.max(rank_col).over(w), f"log_{rank_col}_score"
    score = F.when(top == 1, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), 0.1 + 0.9 * safe_div(top - F.col(rank_col), top - 1)) - 1)
    return rows.withColumn(name, score).withColumn(f"frac_{name}_to_all", safe_div(name, F.sum(name).over(w)))


def weight_stats(rows: DataFrame, prefix: str) -> DataFrame:
    """mean, max, min and max - min of the four weights of a table (null: 0)."""
    cols = [F.coalesce(F.col(f"{prefix}_weight_{r}"), F.lit(0.0)) for r in REPRESENTATIVES]
    hi, lo = F.greatest(*cols), F.least(*cols)
    return rows.withColumns({f"{prefix}_weight_mean": reduce(lambda a, b: a + b, cols) / len(cols), f"{prefix}_weight_max": hi, f"{prefix}_weight_min": lo, f"{prefix}_weight_max_min_diff": hi - lo})


def relative_diff(rows: DataFrame, cols: list[str], key: tuple[str, ...] = ("session",)) -> DataFrame:
    """x - mean and (x - mean) / mean over the session; missing: 0."""
    w = Window.partitionBy(*key)
    out = {}
    for c in cols:
        diff = F.col(c) - F.avg(c).over(w)
        out[f"{c}_mean_diff"] = F.coalesce(diff, F.lit(0.0))
        out[f"{c}_relative_mean_diff"] = F.coalesce(safe_div(diff, F.avg(c).over(w)), F.lit(0.0))
    return rows.withColumns(out)


def session_item_time_diffs(df: DataFrame, wide: bool = False) -> DataFrame:
    """F16: whole hours and weekdays between the session and the item's mean (null: 99)."""
    kinds = ("click", "cart", "order") if wide else ("order",)
    cols = {f"sessXitem_abs_diff_{u}_{a}": F.coalesce(F.abs(F.col(f"sess_{u}") - F.col(f"item_avg_{u}_{a}")).cast("int"), F.lit(MISSING_DIFF)) for a in kinds for u in ("hour", "weekday") if f"item_avg_{u}_{a}" in df.columns}
    return df.withColumns(cols)


def past_rank_or_minus_one(df: DataFrame) -> DataFrame:
    """the rank in the history if it is below the session's distinct items, else -1."""
    return df.withColumn("rank_past_aids_min_sess_aid_dcount", F.when(F.col("rank_past_aids") < F.col("sess_aid_dcount"), F.col("rank_past_aids")).otherwise(-1))


def _met_in_session(rows: DataFrame, near: DataFrame, distances: DataFrame, session_item: DataFrame, parts: int | None) -> DataFrame:
    """``rows`` (one for each session and candidate) with what the other tables have of the pair: all
    are dealt by session once, ``near`` as lists (``weight_lists``), and grouped there. Nothing else by
    session is shuffled then."""
    pair = ["session", "candidate_aid"]
    tables = [t.where("session is not null and candidate_aid is not null") for t in (session_item, distances)]
    own = list(dict.fromkeys(c for t in (rows, *tables) for c in t.columns if c not in pair))
    each = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rows.withColumn("_row", F.lit(1)), *tables, near])
    one = F.struct(F.col("candidate_aid").alias("aids"), *(F.lit(None).cast(near.schema[t].dataType.elementType).alias(t) for t in TABLES))
    each = each.repartition(*([parts] if parts else []), "session")
    each = each.withColumn("_x", F.explode(F.when(F.col("aids").isNull(), F.array(one)).otherwise(F.arrays_zip("aids", *TABLES))))
    weights = {f"{t}_weight_{r}": F.when(F.col(f"is_{r}"), F.col(f"_x.{t}").cast("double")) for r in REPRESENTATIVES for t in TABLES}
    each = each.select("session", F.col("_x.aids").alias("candidate_aid"), "_row", *own, *(c.alias(n) for n, c in weights.items()))
    got = each.groupBy(*pair).agg(*(F.max(c).alias(c) for c in ("_row", *own, *weights)))
    return got.where("_row = 1").drop("_row")


def _by_time(item_time: DataFrame, key: str, name: str) -> DataFrame:
    """``candidate_aid`` and a map from hour or weekday to the item's columns there (24 or 7 at most)."""
    columns = F.struct(*(c for c in item_time.columns if c not in ("aid", key)))
    return item_time.groupBy(F.col("aid").alias("candidate_aid")).agg(F.map_from_entries(F.collect_list(F.struct(key, columns))).alias(name))


def combine_features(
    rows: DataFrame, session: DataFrame, near: DataFrame, distances: DataFrame, session_item: DataFrame, item: DataFrame,
    item_hour: DataFrame, item_weekday: DataFrame, parts: int | None = None, ranked: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """candidates with every feature table. What has a session as its key meets there, dealt into
    ``parts``, in one shuffle (``near``: ``weight_lists``, ``distances``: ``distances_found``), and ``ranked`` may add
    columns that need a session's rows. The rows then travel once more, to the items: tables by hour and
    weekday come as maps, so that all of an item's joins have one key."""
    out = _met_in_session(rows, near, distances, session_item, parts)
    out = ranked(out.join(session.hint("merge"), "session", "left"))
    maps = [("sess_hour", "_hour", _by_time(item_hour, "hour", "_hour"), item_hour, "hour"), ("sess_weekday", "_weekday", _by_time(item_weekday, "weekday", "_weekday"), item_weekday, "weekday")]
    out = out.join(item.withColumnRenamed("aid", "candidate_aid").hint("merge"), "candidate_aid", "left")
    for _, _, table, _, _ in maps:
        out = out.join(table.hint("merge"), "candidate_aid", "left")
    for own, name, _, table, key in maps:
        there = F.element_at(F.col(name), F.col(own))
        out = out.withColumns({c: there[c] for c in table.columns if c not in ("aid", key)}).drop(name)
    fills: dict[str, float] = {}
    for c in out.columns:
        if c == "sesXaid_action_num_reverse_chrono":
            fills[c] = MISSING_POSITION
        elif c == "sesXaid_mins_from_last_event":
            fills[c] = MISSING_MINUTES
        elif c == "sesXaid_mins_from_last_event_log1p":
            fills[c] = MISSING_LOG
        elif c.startswith("sesXaid_frac") and "dur" in c:
            fills[c] = MISSING_SHARE
        elif c.startswith(("sesXaid_", "itemX", "item_all", "item_click", "item_cart", "item_order", "word2vec_")) or "_weight_" in c:
            fills[c] = 0
    out = out.fillna(fills)
    for t in TABLES:
        out = weight_stats(out, t)
    return session_item_time_diffs(out)


def category_combos(rows: DataFrame, session: DataFrame) -> DataFrame:
    """``rank_combined`` with last type, hour, weekday, weekday and hour, binned distinct items."""
    joined = rows.select("session", "candidate_aid", "label", "rank_combined").join(session.select("session", "sess_last_type_in_session", "sess_hour", "sess_weekday", "sess_aid_dcount"), "session", "left")
    combo = lambda *c: F.concat_ws("_", F.col("rank_combined").cast("string"), *(x.cast("string") if isinstance(x, Column) else F.col(x).cast("string") for x in c))
    return joined.select(
        "session",
        "candidate_aid",
        "label",
        combo("sess_last_type_in_session").alias("rank_x_last_type"),
        combo("sess_hour").alias("rank_x_hour"),
        combo("sess_weekday").alias("rank_x_weekday"),
        combo("sess_weekday", "sess_hour").alias("rank_x_weekday_x_hour"),
        combo(bin_distinct_count("sess_aid_dcount", text=True)).alias("rank_x_aid_dcount"),
    )


def target_encoding(df: DataFrame, key: str, fold: str | None = None, smoothing: float = 0) -> DataFrame:
    """``key, [fold], encoded`` and a row ``global_mean``: mean label of the key; with a fold
    column that of all other folds, as sums less the fold's own (one grouping by key and fold)."""
    parts = [key] + ([fold] if fold else [])
    sums = df.groupBy(*parts).agg(F.sum("label").alias("s"), F.count("*").alias("m"))
    mean = df.agg(F.avg("label")).first()[0]
    mean = F.lit(mean).cast("double")
    if fold:
        w = Window.partitionBy(key)
        sums = sums.withColumns({"s": F.sum("s").over(w) - F.col("s"), "m": F.sum("m").over(w) - F.col("m")})
    encoded = F.coalesce(F.try_divide(F.col("s") + smoothing * mean, F.col("m") + smoothing), mean)
    out = sums.select(F.col(key).cast("string").alias(key), *([fold] if fold else []), encoded.alias("encoded"))
    spark = df.sparkSession
    whole = spark.range(1).select(F.lit("global_mean").alias(key), *([F.lit(None).cast("int").alias(fold)] if fold else []), mean.alias("encoded"))
    return out.unionByName(whole)


def apply_target_encoding(df: DataFrame, encoding: DataFrame, key: str, fold: str | None = None) -> DataFrame:
    """the key's encoding, else the global mean; the key goes."""
    mean = encoding.where(F.col(key) == "global_mean").first()["encoded"]
    on = [key] + ([fold] if fold else [])
    table = encoding.where(F.col(key) != "global_mean").withColumnRenamed("encoded", f"{key}_te")
    out = df.withColumn(key, F.col(key).cast("string")).join(table, on, "left")
    return out.withColumn(f"{key}_te", F.coalesce(f"{key}_te", F.lit(mean))).drop(key)


def one_ranker_dataset(clicks: DataFrame, carts: DataFrame, orders: DataFrame) -> DataFrame:
    """union with labels x1, x2, x3; per (session, candidate_aid) the maximum of every column."""
    parts = [d.withColumn("label", F.col("label") * m) for d, m in ((clicks, 1), (carts, 2), (orders, 3))]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    key = ["session", "candidate_aid"]
    return both.groupBy(*key).agg(*(F.max(c).alias(c) for c in both.columns if c not in key))


def one_ranker_rows(rows: DataFrame) -> DataFrame:
    """F22 of rows that name their ``event``: the same, but made of one reading of them, so that a task
    doesn't make a session's rows once for each event."""
    key = ["session", "candidate_aid"]
    grade = F.array_position(F.array(*map(F.lit, EVENTS.values())), F.col("event")).cast("int")
    graded = rows.where(F.col("event").isin(*EVENTS.values())).withColumn("label", F.col("label") * grade)
    return graded.groupBy(*key).agg(*(F.max(c).alias(c) for c in rows.columns if c not in (*key, "event")))
