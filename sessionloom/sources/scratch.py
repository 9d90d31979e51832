"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a local session (one machine, as in
    tests) gets one of its own; on a cluster that is an error, as executors wouldn't see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = Path(tempfile.mkdtemp(prefix="spark-checkpoints-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders written by ``stored``, by application.
_written: dict[str, list[str]] = {}
#: Names that ``stored_by`` has given in the catalog, by application.
_tables: dict[str, list[str]] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    Results that are not yet written may still read it, so nothing is deleted here: an application
    that goes on calls ``clear_stored`` once its results are written.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """As ``stored``, in ``parts`` buckets by ``key``: steps by the key read it without a shuffle.

    Rows that already lie in these parts (``repartition(parts, key)``) are written where they are, a
    file for each part.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    df.repartition(parts, key).write.format("parquet").bucketBy(parts, key).option("path", path).saveAsTable(table)
    app = spark.sparkContext.applicationId
    _written.setdefault(app, []).append(path)
    _tables.setdefault(app, []).append(table)
    return spark.table(table)


def clear_stored(spark: SparkSession) -> int:
    """Delete the tables that this application has stored so far; results computed lazily from them
    must have been written. Returns how many."""
    for table in _tables.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)
