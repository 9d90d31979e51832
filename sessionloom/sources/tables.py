"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = "session long, aid int, ts long, type int"
COVISIT = "aid_x int, aid_y int, wgt float"
EMBEDDINGS = "aid int, vector array<float>"
LABELS = "session long, type string, ground_truth array<int>"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event log."""
    return spark.read.schema(EVENTS).parquet(path)


def read_covisitation(spark: SparkSession, *paths: str) -> DataFrame:
    """A co-visitation table from its shards; other columns aren't read."""
    return spark.read.schema(COVISIT).parquet(*paths)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """S3: item vectors."""
    return spark.read.schema(EMBEDDINGS).parquet(path)


def write_chunks(df: DataFrame, path: str, by: tuple[str, ...] = ("event", "fold")) -> None:
    """Parquet in a folder for each event and fold; rows are dealt by these first, and Spark
    splits those of a large fold over several tasks."""
    df.hint("rebalance", *by).write.partitionBy(*by).mode("overwrite").parquet(path)


def write_submission(df: DataFrame, path: str) -> None:
    """``session_type, labels`` as CSV with a header."""
    df.select("session_type", "labels").write.option("header", True).mode("overwrite").csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth."""
    return spark.read.schema(LABELS).parquet(path)


def write_labels(df: DataFrame, path: str) -> None:
    df.select("session", "type", F.col("ground_truth").cast("array<int>").alias("ground_truth")).write.mode("overwrite").parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Metric rows as JSON."""
    df.write.mode("overwrite").json(path)


def _each(df: DataFrame, kind: type, change) -> DataFrame:
    return df.select(*(change(F.col(f.name)).alias(f.name) if isinstance(f.dataType, kind) else F.col(f.name) for f in df.schema.fields))


def downcast(df: DataFrame) -> DataFrame:
    """Long to int, double to float. A long that doesn't fit becomes null."""
    return _each(_each(df, T.LongType, lambda c: c.try_cast("int")), T.DoubleType, lambda c: c.cast("float"))


def round3(df: DataFrame) -> DataFrame:
    """Doubles and floats to three decimals."""
    return _each(_each(df, T.DoubleType, lambda c: F.round(c, 3)), T.FloatType, lambda c: F.round(c, 3))


def floats_to_int(df: DataFrame) -> DataFrame:
    """Doubles and floats to int (towards zero)."""
    return _each(_each(df, T.DoubleType, lambda c: c.try_cast("int")), T.FloatType, lambda c: c.try_cast("int"))
