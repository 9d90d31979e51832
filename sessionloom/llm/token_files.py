"""Operator 9: token ids in directly addressable codes.

An id is split into chunks of eight bits, lowest first. Level 0 holds the first chunk of every
token of a segment, level 1 the second chunk of those tokens that have one, and so on; a bit per
chunk says whether the token continues, and a rank directory counts the set bits before every
512th. Token i is read by following its chunks: its place on the next level is the rank of its
bit. Nothing before it is decoded.

Files are Parquet tables of segments. A segment holds whole documents: ``part, seq`` (its place
in the order), ``doc_ids``, ``starts`` (each document's first token in the segment, and the end)
and ``codes``, the bytes below (all integers little-endian):
``b"DAC1"``, u32 tokens, u32 levels; per level u32 chunks, chunk bytes, continuation bitmap
(lowest bit first, padded to 8 bytes), u32 ranks.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, shuffle_partitions, slices

MAGIC = b"DAC1"
END_ID = 2
#: Tokens after which a segment is closed (a document is never cut).
SEGMENT_TOKENS = 1 << 18
RANK_BITS = 512
#: Words that a worker remembers; a full cache starts afresh.
CACHE_WORDS = 600_000
# Fixed value: the words of byte-level BPE's pre-tokenizer.
PRE_WORD = regex.compile(r" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

# The same words in ASCII texts, which need no Unicode properties: the standard library cuts these faster.
ASCII_WORD = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


def pre_words(text: str) -> list[str]:
    return (ASCII_WORD if text.isascii() else PRE_WORD).findall(text)


def encode_codes(ids: np.ndarray) -> bytes:
    """The bytes of a segment's ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> np.uint32(8)
        on = more > 0
        bits = np.packbits(on, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)])
        ranks = np.concatenate([[0], np.cumsum(on)])[: max(len(on), 1) : RANK_BITS] if len(on) else np.zeros(0)
        levels.append(struct.pack("<I", len(rest)) + (rest & np.uint32(255)).astype(np.uint8).tobytes() + bits.tobytes() + ranks.astype("<u4").tobytes())
        if not on.any():
            return MAGIC + struct.pack("<II", len(ids), len(levels)) + b"".join(levels)
        rest = more[on]


class Codes:
    """Random access to the ids of a segment."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of token codes")
        self.n, levels = struct.unpack_from("<II", data, 4)
        self.levels, at = [], 12
        for _ in range(levels):
            (n,) = struct.unpack_from("<I", data, at)
            at += 4
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            size = -(-n // 8) + (-(-(-n // 8)) % 8)
            bits = np.frombuffer(data, np.uint8, size, at)
            at += size
            ranks = np.frombuffer(data, "<u4", -(-n // RANK_BITS), at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit i (which may be the end of the level)."""
        chunks, bits, ranks = self.levels[level]
        block = min(i // RANK_BITS, len(ranks) - 1)
        part = np.unpackbits(bits[block * RANK_BITS // 8 : -(-i // 8)], bitorder="little")[: i - block * RANK_BITS]
        return int(ranks[block]) + int(part.sum())

    def __getitem__(self, i: int) -> int:
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
        return value

    def slice(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start+n; only the chunks of these are touched."""
        out = np.zeros(n, np.uint32)
        where = np.arange(n)
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[where] |= chunks[start : start + n].astype(np.uint32) << np.uint32(8 * level)
            on = np.unpackbits(bits[start // 8 : -(-(start + n) // 8)], bitorder="little")[start % 8 : start % 8 + n].astype(bool)
            where = where[on]
            if not len(where):
                break
            start, n = self._rank(level, start), len(where)
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself if it can be seen, else 256 + its rank."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    unseen = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + unseen.index(b)) for b in range(256)]


class _Words(dict):
    """word of the pre-tokenizer -> its ids as little-endian 32-bit bytes; the library encodes new words."""

    def __init__(self, path: str):
        super().__init__()
        self.lib = tokenizer(path)
        self.letters = dict(enumerate(_byte_letters()))

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        shown = word.encode().decode("latin-1").translate(self.letters)
        ids = self[word] = array("I", [t.id for t in self.lib.model.tokenize(shown)]).tobytes()
        return ids


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


@lru_cache(maxsize=2)
def _cut(path: str) -> tuple[bool, tuple[str, ...]]:
    """Whether the tokenizer is plain byte-level BPE, whose merges never cross a word of
    ``PRE_WORD``, and the strings that it would read as special tokens."""
    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    pre, model = conf.get("pre_tokenizer") or {}, conf["model"]
    plain = model["type"] == "BPE" and not conf.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not model.get("dropout")
    return plain, tuple(t["content"] for t in conf.get("added_tokens", []))


def encode_text(text: str, path: str) -> bytes:
    """Ids of a whole text as little-endian 32-bit bytes, the same as one library call gives.

    A byte-level tokenizer encodes each pre-tokenizer word alone, so ids of words met before are
    reused. Other tokenizers, and texts with a special token's string, take one library call.
    """
    plain, special = _cut(path)
    if not plain or any(s in text for s in special):
        return array("I", tokenizer(path).encode(text, add_special_tokens=False).ids).tobytes()
    return b"".join(map(_words(path).__getitem__, pre_words(text)))


def _write(path: str, end_id: int):
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        docs, starts, held = [], [0], []

        def segment():
            ids = np.frombuffer(b"".join(held), "<u4")
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, seq, len(ids), docs, starts, encode_codes(ids)), schema.types, strict=True)], schema=schema)

        for b in slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode_text(text or "", path) + end
                docs.append(doc)
                held.append(ids)
                starts.append(starts[-1] + len(ids) // 4)
                if starts[-1] >= SEGMENT_TOKENS:
                    yield segment()
                    docs, starts, held, seq = [], [0], [], seq + 1
        if docs:
            yield segment()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = END_ID) -> None:
    """Encode every text of ``docs (doc_id, text, ...)`` and write segments in ascending doc_id order.

    Null doc_ids come first; equal ones follow one another in the order of their texts' hash.
    Null text counts as empty: the document is its end id alone. The text is ranged by
    (doc_id, hash), so a repeated id doesn't pile up in one task.
    """
    key = F.xxhash64("text")
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(shuffle_partitions(docs.sparkSession), F.col("doc_id"), key).sortWithinPartitions(F.col("doc_id"), key)
    schema = "part int, seq long, n_tokens long, doc_ids array<long>, starts array<long>, codes binary"
    ranged.mapInArrow(_write(tokenizer_path, end_id), schema).write.option("compression", "none").parquet(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            codes, starts = Codes(row["codes"]), row["starts"]
            crc = [zlib.crc32(codes.slice(a, z - a).astype("<u4").tobytes()) for a, z in zip(starts, starts[1:])]
            n = len(crc)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(crc, pa.int64())],
                names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files, read by random access.

    ``start`` adds up three parts: tokens of earlier parts (one row per file part meets in a
    window), of earlier segments of the part, and of earlier documents of the segment.
    """
    segments = spark.read.parquet(out)
    sizes = segments.select("part", "seq", "n_tokens")
    before = Window.unboundedPreceding, -1
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("all")).select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("part_start"))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*before)), F.lit(0))
    places = sizes.select("part", "seq", within.alias("in_part")).join(parts, "part").select("part", "seq", (F.col("in_part") + F.col("part_start")).alias("first"))
    docs = segments.select("part", "seq", "doc_ids", "starts", "codes").mapInArrow(_read, "part int, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(places, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each row of ``docs (doc_id, text, ...)``, from token
    files that are written to a new folder in the shared place and read back.

    Null and empty texts have the end id alone; texts of any length are encoded whole; rows with a
    null doc_id come first; repeated rows, and rows that share a doc_id, are documents of their own,
    in the order of their texts' hashes; extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    out = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer_path, out, end_id)
    return read_tokens(spark, out)
