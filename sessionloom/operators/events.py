"""Splits, labels and prepared events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.exprs import EVENTS, hash_fraction, recency_weight, stable_hash, ts_parts, type_weight
from sessionloom.sources.scratch import stored

DAY = 86_400
#: Events of a session that one task may sort; longer sessions are cut into ranges of their order.
LONG_SESSION = 1_000_000
TIE = ("type", "aid")
#: Type weights of prepared events, and of the history rerank inside co-visitation jobs.
PREPARED_WEIGHTS = {0: 1.0, 1: 6.0, 2: 3.0}
RERANK_WEIGHTS = {0: 0.5, 1: 9.0, 2: 0.5}


def session_order(tie: tuple[str, ...] = TIE) -> list[str]:
    """Columns that order a session totally: time, then the tie-break."""
    return ["ts", *tie]


def with_position(events: DataFrame, tie: tuple[str, ...] = TIE) -> DataFrame:
    """Adds ``pos`` (1 = first) and ``n`` (events of the session) in one sort."""
    w = Window.partitionBy("session").orderBy(*session_order(tie))
    return events.withColumns({"pos": F.row_number().over(w), "n": F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})


def _cut_long(events: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Events of ordinary sessions; those of sessions of more than ``limit`` events (None: there are
    none) and their number."""
    long = events.groupBy("session").agg(F.count("*").alias("n")).where((F.col("n") > limit) & F.col("session").isNotNull())
    rows = long.agg(F.sum("n")).first()[0]
    if not rows:
        return events, None, 0
    long = stored(long.select("session"), "long-sessions")
    return events.join(long, "session", "left_anti"), events.join(long, "session", "left_semi"), rows


def _in_place(events: DataFrame, tie: tuple[str, ...]) -> DataFrame:
    """Adds ``pos``, ``n``, and the timestamps before and after each event, ``_back`` and ``_ahead``."""
    w = Window.partitionBy("session").orderBy(*session_order(tie))
    return with_position(events, tie).withColumns({"_back": F.lag("ts").over(w), "_ahead": F.lead("ts").over(w)})


def _in_segments(events: DataFrame, rows: int, limit: int, tie: tuple[str, ...]) -> DataFrame:
    """``_in_place`` for long sessions, by a segmented scan; ``_seg`` names the segments.

    Events are dealt into ranges of (session, order), which cut a session wherever that falls. Each
    (session, range) is numbered by itself; what it hands on, its number of events and first and
    last timestamp, is a row, and running over a session's few such rows completes the numbers.
    """
    order = session_order(tie)
    got = events.repartitionByRange(max(2, -(-2 * rows // limit)), "session", *order).withColumn("_seg", F.spark_partition_id())
    got = stored(got, "segments")
    ends = got.groupBy("session", "_seg").agg(F.count("*").alias("_m"), F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    o = Window.partitionBy("session").orderBy("_seg")
    carry = ends.select(
        "session",
        "_seg",
        F.coalesce(F.sum("_m").over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_m").over(Window.partitionBy("session")).alias("n"),
        F.lag("_last").over(o).alias("_last"),
        F.lead("_first").over(o).alias("_first"),
    )
    w = Window.partitionBy("session", "_seg").orderBy(*order)
    whole = got.join(carry, ["session", "_seg"]).withColumns(
        {
            "pos": (F.row_number().over(w) + F.col("_before")).cast("int"),
            "_back": F.coalesce(F.lag("ts").over(w), "_last"),
            "_ahead": F.coalesce(F.lead("ts").over(w), "_first"),
        }
    )
    return whole.drop("_before", "_last", "_first")


def last_days(events: DataFrame, days: int = 7) -> DataFrame:
    """Events less than ``days`` before the last one (a literal, so the scan can skip the rest)."""
    latest = events.agg(F.max("ts")).first()[0]
    return events.where(F.col("ts") > F.lit(latest) - days * DAY)


def sample_sessions(events: DataFrame, frac: float, seed: int = 0) -> DataFrame:
    """All events of a fraction of the sessions, chosen by hash (no shuffle)."""
    return events.where(hash_fraction("session", seed=seed) < frac)


def random_cutoff_split(events: DataFrame, seed: int = 0, tie: tuple[str, ...] = TIE, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(features, labels): the first 1..n-1 events of each session of n > 1, and the rest.
    ``keep`` may store the positions that both halves are cut from (``scratch.stored``)."""
    cut = with_position(events, tie).where("n > 1").withColumn("cutoff", 1 + F.pmod(stable_hash("session", seed=seed), F.col("n") - 1))
    cut = keep(cut)
    return cut.where("pos <= cutoff").select(*events.columns), cut.where("pos > cutoff").select(*events.columns)


def type_name(type_col: str = "type") -> Column:
    out = F.lit(None).cast("string")
    for t, name in EVENTS.items():
        out = F.when(F.col(type_col) == t, name).otherwise(out)
    return out


def ground_truth(labels: DataFrame, tie: tuple[str, ...] = TIE) -> DataFrame:
    """``session, type, ground_truth`` with all aids in order of occurrence."""
    item = F.struct(*session_order(tie), F.col("aid").alias("item"))
    got = labels.groupBy("session", type_name().alias("type")).agg(F.array_sort(F.collect_list(item)).alias("x"))
    return got.select("session", "type", F.transform("x", lambda s: s["item"]).alias("ground_truth"))


def session_class(events: DataFrame) -> DataFrame:
    """Class of a session: sum and number of its distinct types."""
    return events.groupBy("session").agg(F.concat_ws("_", F.sum_distinct("type"), F.count_distinct("type")).alias("class"))


def assign_stratified_folds(events: DataFrame, n: int, seed: int = 0, exact: bool = False) -> DataFrame:
    """P5: ``session, class, fold``. By default the fold is a hash (even in expectation, no global
    order); ``exact`` deals each class evenly, in two levels so that no task sorts a whole class."""
    got = session_class(events).withColumn("h", stable_hash("session", seed=seed))
    if not exact:
        return got.select("session", "class", F.pmod("h", F.lit(n)).cast("int").alias("fold"))
    parts = got.withColumn("part", F.shiftright("h", 50))  # 1024 ranges of the hash
    counts = parts.groupBy("class", "part").agg(F.count("*").alias("m"))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("class", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("class", "part").orderBy("h", "session")) - 1
    return parts.withColumn("rank", rank).join(counts, ["class", "part"]).select("session", "class", F.pmod(F.col("rank") + F.col("before"), F.lit(n)).cast("int").alias("fold"))


def preprocess_ts(events: DataFrame) -> DataFrame:
    """Adds datehour, hour and date."""
    return ts_parts(events).drop("weekday", "datetime")


def prepare_events(events: DataFrame, type_weights: dict[int, float] = PREPARED_WEIGHTS, tie: tuple[str, ...] = TIE, long_session: int = LONG_SESSION) -> DataFrame:
    """Prepared events; one sort by session serves all window columns.

    The last event of a session takes the duration of the one before it; durations over a day
    set ``oneday_session`` and count as 0, as do missing ones. Sessions of more than
    ``long_session`` events are scanned in segments, with the same result.
    """
    short, long, rows = _cut_long(events, long_session)
    out = _prepared(_in_place(short, tie), type_weights)
    if long is None:
        return out
    return out.unionByName(_prepared(_in_segments(long, rows, long_session, tie).drop("_seg"), type_weights).select(*out.columns))


def _prepared(placed: DataFrame, type_weights: dict[int, float]) -> DataFrame:
    out = placed.withColumn("raw_duration", F.coalesce(F.col("_ahead") - F.col("ts"), F.col("ts") - F.col("_back"))).drop("_ahead", "_back")
    recency, duration = F.col("log_recency_score"), F.col("duration_second")
    weighted = F.col("type_weighted_log_recency_score")
    out = out.withColumns(
        {
            "action_num_reverse_chrono": (F.col("n") - F.col("pos") + 1).cast("int"),
            "log_recency_score": recency_weight("pos", "n"),
            "oneday_session": F.when(F.col("raw_duration") > DAY, 1).otherwise(0),
            "duration_second": F.when(F.col("raw_duration") > DAY, F.lit(0)).otherwise(F.coalesce("raw_duration", F.lit(0))).cast("long"),
        }
    ).withColumn("type_weighted_log_recency_score", type_weight(type_weights) * recency)
    out = ts_parts(out).drop("datehour", "datetime")
    return out.withColumns({"log_duration_second": recency * duration, "type_weighted_log_duration_second": weighted * duration}).drop("raw_duration", "n")


def real_sessions(events: DataFrame, gap: int = 7200, boundary: str = "reference", tie: tuple[str, ...] = TIE, long_session: int = LONG_SESSION) -> DataFrame:
    """``real_session`` ("<session>_<n>") and its number of events.

    ``boundary="reference"``: the event before a gap opens the next real session, and the last
    event inherits the gap before it. ``"gap"``: an event after a gap opens it. Sessions of more
    than ``long_session`` events are scanned in segments, with the same result.
    """
    w = Window.partitionBy("session").orderBy(*session_order(tie))
    upto = (Window.unboundedPreceding, Window.currentRow)

    def opened(placed: DataFrame) -> DataFrame:
        back = F.col("ts") - F.col("_back")
        wide = F.coalesce(F.col("_ahead") - F.col("ts"), back) if boundary == "reference" else back
        return placed.withColumn("opens", F.when(wide > gap, 1).otherwise(0))

    short, long, rows = _cut_long(events, long_session)
    named = opened(_in_place(short, tie)).withColumn("number", F.sum("opens").over(w.rowsBetween(*upto)))
    named = named.withColumn("real_session", F.concat_ws("_", "session", "number"))
    out = named.withColumn("real_session_size", F.count(F.lit(1)).over(Window.partitionBy("session", "real_session"))).select(*events.columns, "real_session", "real_session_size")
    if long is None:
        return out
    flagged = stored(opened(_in_segments(long, rows, long_session, tie)), "segments-opened")
    sums = flagged.groupBy("session", "_seg").agg(F.sum("opens").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("session").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.sum("opens").over(Window.partitionBy("session", "_seg").orderBy("pos").rowsBetween(*upto))
    numbered = flagged.withColumn("inner", inner).join(sums.select("session", "_seg", before.alias("before")), ["session", "_seg"])
    numbered = stored(numbered.withColumn("number", F.col("inner") + F.col("before")).select(*events.columns, "number"), "segments-numbered")
    sizes = numbered.groupBy("session", "number").agg(F.count("*").alias("real_session_size"))
    far = numbered.join(sizes, ["session", "number"]).withColumn("real_session", F.concat_ws("_", "session", "number"))
    return out.unionByName(far.select(*out.columns))


def click_subsample(df: DataFrame, max_fold: int = 6, event: str = "event") -> DataFrame:
    """P10: clicks keep folds 0..max_fold; other events all folds."""
    return df.where((F.col(event) != "clicks") | (F.col("fold") <= max_fold))
