"""Popularity candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.exprs import EVENTS, ts_parts


def popular(events: DataFrame, key: str | None = None, k: int = 20) -> DataFrame:
    """Per event type (and key: date, datehour or hour) the k aids with most events.

    Returns ``event, [key], labels, ranks``, ranks from 1. All aids (of the key) are ranked, those
    without an event of the type too; ties go by aid. Counts are combined before the shuffle; the
    rank is cut to k within salted parts first, so that no task orders all items of a type.
    """
    keys = [key] if key else []
    rows = ts_parts(events) if key in ("date", "datehour", "hour") else events
    counts = rows.groupBy(*keys, "aid").agg(*(F.count_if(F.col("type") == t).alias(name) for t, name in EVENTS.items()))
    long = counts.unpivot([*keys, "aid"], list(EVENTS.values()), "event", "cnt")
    order = [F.col("cnt").desc(), F.col("aid")]
    part = long.withColumn("salt", F.pmod(F.xxhash64("aid"), F.lit(64)))
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("event", *keys, "salt").orderBy(*order))).where(F.col("r") <= k)
    top = part.withColumn("rank", F.row_number().over(Window.partitionBy("event", *keys).orderBy(*order))).where(F.col("rank") <= k)
    lists = top.groupBy("event", *keys).agg(F.array_sort(F.collect_list(F.struct("rank", "aid"))).alias("x"))
    return lists.select("event", *keys, F.transform("x", lambda s: s["aid"]).alias("labels"), F.transform("x", lambda s: s["rank"]).alias("ranks"))


def attach_popular(events: DataFrame, popular_lists: DataFrame, key: str | None = None) -> DataFrame:
    """``session, event, labels, ranks``: each session gets the lists of its last event's key.

    A popularity table has one row per event and key (days, hours): Spark broadcasts it if it is
    small and shuffles it if not.
    """
    last = events.groupBy("session").agg(F.max("ts").alias("ts"))
    keyed = ts_parts(last).select("session", key) if key else last.select("session")
    sessions = keyed.withColumn("event", F.explode(F.array(*map(F.lit, EVENTS.values()))))
    return sessions.join(popular_lists, ["event", *([key] if key else [])], "left").select("session", "event", "labels", "ranks")
