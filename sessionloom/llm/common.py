"""Helpers shared by the text operators: Arrow batches, word codes, components."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.sources.scratch import new_folder, shared_folder, stored

__all__ = ["new_folder", "shared_folder", "stored"]
WORD = r"[^\x20\x09-\x0D]+"
#: Words kept in a worker's cache; beyond that it starts afresh, so its memory is bounded.
CACHE_WORDS = 250_000
#: Bytes of text that one numpy step handles.
STEP_BYTES = 2_000_000


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id, n: int):
    """crc32 of the id as text, modulo n (null id: the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def crc_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def slices(batches: Iterable[pa.RecordBatch], text: int = 1, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``step`` bytes of text (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.binary_length(b.column(text)).fill_null(0)))
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + step, side="right")))
            yield b.slice(at, to - at)
            at = to


class WordCodes(dict):
    """word bytes -> 64-bit hash, remembered for the words met last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def word_codes(texts: Iterable[str | None], cache: WordCodes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts one after another, and each text's number of words.

    ``bytes.split`` without arguments splits on exactly x20 and x09-x0D; ``bytes.lower``
    changes exactly A-Z.
    """
    parts, sizes = [], []
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass")
        words = (words.lower() if lower else words).split()
        sizes.append(len(words))
        if words:
            parts.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(sizes, np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive codes (positions 0 .. n-k)."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + codes[j : j + n]
    return mixed(out)


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, component`` (its smallest reachable node) for every node of ``edges (a, b)``.

    Alternating large-star and small-star rounds; each joins every edge with the smallest
    neighbour of its node, so hot nodes are split like any skewed join and no group is
    collected. Rounds end when the edges no longer change; each is stored in the shared folder.
    """
    spark = edges.sparkSession
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    was = None
    while True:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), f"{name}-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        e = stored(small.where("a <> b").distinct(), f"{name}-edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == was:
            break
        was = now
    roots = e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def finite_vector(column: str):
    """Whether an array column is neither null nor holds a null or non-finite entry."""
    values = F.col(column).cast("array<double>")
    return F.coalesce(F.forall(values, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))), F.lit(False))


def integer_vector(column: str):
    """floor(256 * c) of each entry, as longs."""
    return F.transform(F.col(column).cast("array<double>"), lambda c: F.floor(c * 256).cast("long"))


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list<long> column, filled up with zeros to ``dims`` entries."""
    sizes = np.asarray(pc.list_value_length(lists))
    flat = lists.flatten().to_numpy()
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), flat.dtype)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out
