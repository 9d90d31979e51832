"""Sessions longer than a task: the segmented scan against the plain one."""

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import events


@pytest.fixture(scope="module")
def log(spark):
    """A session of 300,000 events among short ones; many share a timestamp, some follow a day later."""
    i = F.col("id")
    long = spark.range(300_000).select(F.lit(7).cast("long").alias("session"), F.pmod(F.xxhash64(i), F.lit(50)).cast("int").alias("aid"), (F.floor(i / 3) * 40 + F.floor(i / 5000) * 90_000).alias("ts"), F.pmod(i, F.lit(3)).cast("int").alias("type"))
    short = spark.range(4000).select(F.when(i % 9 == 0, 8).otherwise(100 + i % 700).cast("long").alias("session"), (i % 40).cast("int").alias("aid"), (i * 977 % 500_000).alias("ts"), (i % 3).cast("int").alias("type"))
    return long.unionByName(short).repartition(4)


def same(a, b):
    assert a.columns == b.columns
    key = lambda df: df.select(F.xxhash64(*df.columns).alias("h")).groupBy("h").count()
    one, two = key(a), key(b)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty() and one.count() > 1000


def test_prepared_events(log):
    same(events.prepare_events(log, long_session=20_000), events.prepare_events(log))


@pytest.mark.parametrize("boundary", ["reference", "gap"])
def test_real_sessions(log, boundary):
    same(events.real_sessions(log, boundary=boundary, long_session=20_000), events.real_sessions(log, boundary=boundary))


def test_a_long_session_is_several_segments(log):
    long = log.where("session = 7")
    parts = events._in_segments(long, 300_000, 20_000, events.TIE).groupBy("_seg").count().collect()
    assert len(parts) >= 15 and max(r["count"] for r in parts) < 40_000


def test_odd_logs(spark, log):
    none = spark.createDataFrame([(None, 1, 5, 0)] * 9, log.schema)
    assert events.prepare_events(log.limit(0), long_session=2).count() == 0 and events.real_sessions(none, long_session=2).count() == 9
