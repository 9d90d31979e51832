"""Operator 7: language-model scores by context-tree weighting.

A byte is eight binary decisions, each named by the bits decided before it. Every decision has a
tree over the bytes before: the node of depth d knows the last d bytes. A node's
Krichevsky-Trofimov estimate is weighed against its children's by how well both explain the
training text (log P_w = log(P_e / 2 + prod P_w(children) / 2), bottom-up), and a decision's
probability mixes the estimates of all depths along its context. Texts end with a zero byte and
start after DEPTH zero bytes, so the probabilities of all texts sum to one.

Counts cover all training documents, and the whole tree is used. Grams of the scored texts that
training lacks are in it with a count of 0: they add no evidence, and a decision's mix ends at the
last node with a count. The tree is cut at depth SPLIT: everything below one context of SPLIT
bytes is a subtree of at most 2^24 grams, which a task holds as arrays (a task's subtrees come
one after another); the nodes from SPLIT up are tables, grouped level by level. Bottom-up, the
subtrees give the nodes of depth SPLIT; top-down, each node's mixed probability comes from its
parent's, the subtrees are worked out once more, and eight nodes give the log10 probability of a
byte gram, once for every distinct gram. The most frequent words and grams are broadcast as a
cache of fixed size; the others are looked up by a join, so the size of the cache changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import WordCodes, crc_mod, shuffle_partitions, slices, stored, word_codes

#: Bytes of context, and of the contexts whose subtrees a task holds.
DEPTH, SPLIT = 5, 3
#: Entries of the broadcast caches at most (16 bytes each).
WORDS, GRAMS = 500_000, 1_500_000
#: Bytes of text that one step counts and scores (counting holds less than 60 times as much).
COUNT_BYTES, SCORE_BYTES = 6_000_000, 500_000
CACHE_BITS = 22
WORD_KIND, GRAM_KIND = 0, 1
END_WORD = np.uint64(xxhash.xxh3_64_intdigest(b"", seed=1))


def byte_grams(texts: list[str | None], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, lengths): for each byte of each text and its end, the byte with ``depth``
    bytes before it, as one integer; the places of each text in ``codes``."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    pad = bytes(depth)
    data = np.frombuffer(b"".join(pad + x + b"\0" for x in raw), np.uint8)
    codes = np.zeros(len(data), np.uint64)
    for j in range(depth, -1, -1):  # in place: eight bytes a byte of text, no more
        codes <<= np.uint64(8)
        codes[j:] |= data[: len(data) - j]
    lengths = np.array([len(x) + 1 for x in raw], np.int64)
    starts = np.cumsum(lengths + depth) - lengths
    return codes, starts, lengths


def _real(codes: np.ndarray, starts: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Which places of ``byte_grams`` belong to a text, not to the zeros before it."""
    real = np.ones(len(codes), bool)
    for j in range(1, depth + 1):
        real[starts - j] = False
    return real


def _grams_of(texts: list[str | None]) -> np.ndarray:
    """The grams of all bytes and ends of the texts."""
    codes, starts, _ = byte_grams(texts)
    return codes[_real(codes, starts)]


def _counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, how often each occurs); sorts ``codes`` in place."""
    codes.sort()
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training counts of words, and of the grams of all texts (0 where training lacks one)."""
    cache = WordCodes()
    for b in slices(batches, 0, COUNT_BYTES):
        texts, chosen = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
        train = [t for t, x in zip(texts, chosen, strict=True) if x]
        words, n = np.unique(word_codes(train, cache, True)[0], return_counts=True)
        grams, m = _counts(_grams_of(train))
        if len(train) < len(texts):
            others = _counts(_grams_of([t for t, x in zip(texts, chosen, strict=True) if not x]))[0]
            seen, times, grams = grams, m, np.union1d(grams, others)
            m = np.zeros(len(grams), np.int64)
            m[np.searchsorted(grams, seen)] = times
        ends = [END_WORD] if train else []
        kind = np.concatenate([np.full(len(words) + len(ends), WORD_KIND), np.full(len(grams), GRAM_KIND)]).astype(np.int32)
        code = np.concatenate([words, np.array(ends, np.uint64), grams]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(code), pa.array(np.concatenate([n, [len(train)] * len(ends), m]).astype(np.int64))], names=["kind", "code", "n"])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma by Stirling's series at x + 8."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - sum(np.log(x + i) for i in range(8))


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    a, b = n0.astype(float), n1.astype(float)
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - np.log(np.pi) - _lgamma(a + b + 1)


@F.pandas_udf(DoubleType())
def log_kt(n0: pd.Series, n1: pd.Series) -> pd.Series:
    return pd.Series(_log_kt(n0.to_numpy(), n1.to_numpy()))


def turned(codes: np.ndarray, depth: int) -> np.ndarray:
    """Codes of ``depth`` bytes and a last one with the ``depth`` bytes in the opposite order: the
    byte just before comes first, so that grams which share a context stand together when sorted."""
    codes = codes.astype(np.uint64)
    out = codes & np.uint64(255)
    for j in range(1, depth + 1):
        out |= ((codes >> np.uint64(8 * j)) & np.uint64(255)) << np.uint64(8 * (depth + 1 - j))
    return out


@dataclass
class _Nodes:
    """Nodes of one depth and number of decided bits, by ``key`` = (turned context, decision)."""

    key: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    log_pw: np.ndarray
    log_beta: np.ndarray
    of_row: np.ndarray  # the node of each row of this depth's (context, byte) rows


def _subtree(grams: np.ndarray, n: np.ndarray, depth: int, top: int) -> dict[int, list[_Nodes]]:
    """Nodes of the depths ``top`` .. ``depth``, bottom-up, from sorted turned grams."""
    levels: dict[int, list[_Nodes]] = {}
    rows, counts = grams, n
    for d in range(depth, top - 1, -1):
        if d < depth:  # (context, byte) rows of this depth, sorted again: a byte is left out of the middle
            shorter = (rows >> np.uint64(16) << np.uint64(8)) | (rows & np.uint64(255))
            rows, at = np.unique(shorter, return_inverse=True)
            counts = np.bincount(at, counts, len(rows)).astype(np.int64)
        context, byte = rows >> np.uint64(8) << np.uint64(8), (rows & np.uint64(255)).astype(np.int64)
        level = []
        for i in range(8):
            m, bit = (1 << i) | (byte >> (8 - i)), (byte >> (7 - i)) & 1
            key = context | m.astype(np.uint64)
            new = np.append(True, key[1:] != key[:-1])
            starts = np.flatnonzero(new)
            key = key[starts]
            n0, n1 = np.add.reduceat(counts * (1 - bit), starts), np.add.reduceat(counts * bit, starts)
            log_pe = _log_kt(n0, n1)
            if d == depth:
                log_pw, log_beta = log_pe, np.zeros(len(key))
            else:
                child = levels[d + 1][i]
                parent = (child.key >> np.uint64(16) << np.uint64(8)) | (child.key & np.uint64(255))
                below = np.bincount(np.searchsorted(key, parent), child.log_pw, len(key))
                log_beta = log_pe - below
                log_pw = np.maximum(log_pe, below) + np.log1p(np.exp(-np.abs(log_beta))) - np.log(2.0)
            level.append(_Nodes(key, n0, n1, log_pw, log_beta, np.cumsum(new) - 1))
        levels[d] = level
    return levels


def _descend(nodes: _Nodes, acc: np.ndarray, rest: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the nodes hand to their children (acc, rest) and their mixed probability of a one, from
    what their parents handed to each of them: the sum of the estimates so far, each times its
    weight, the weight that is left, and the parent's mix. The last node with a count gets all that
    is left."""
    known = (nodes.n0 + nodes.n1) > 0
    p1 = (nodes.n1 + 0.5) / (nodes.n0 + nodes.n1 + 1)
    own = 1 / (1 + np.exp(-np.clip(nodes.log_beta, -700, 700)))
    mixed = np.where(known, acc + rest * p1, q)
    return np.where(known, acc + rest * own * p1, q), np.where(known, rest * (1 - own), 0.0), mixed


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole groups (equal first columns, which come sorted), some at a time."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last group may go on in the next batch
        held = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols]
    if held is not None:
        yield held


def _rise(depth: int, split: int):
    """Nodes of depth ``split`` from the grams below each of their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, code, n in _groups(batches):
            rows = turned(code, depth)
            order = np.argsort(rows)
            for x in _subtree(rows[order], n[order], depth, split)[split]:
                ctx = turned(x.key >> np.uint64(8) << np.uint64(8), split) >> np.uint64(8)
                yield pa.RecordBatch.from_arrays([pa.array(ctx.view(np.int64)), pa.array((x.key & np.uint64(255)).astype(np.int32)), pa.array(x.n0), pa.array(x.n1), pa.array(x.log_pw), pa.array(x.log_beta)], names=["ctx", "m", "n0", "n1", "log_pw", "log_beta"])

    return run


def _fall(depth: int, split: int):
    """log10 P of each gram; rows are grams (m null) and, of the same context, its nodes of depth ``split``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for top, m, code, n, acc, rest, q in _groups(batches):
            node = np.isfinite(m)
            gram = ~node
            if not gram.any():
                continue
            rows = turned(code[gram], depth)
            order = np.argsort(rows)
            levels = _subtree(rows[order], n[gram][order].astype(np.int64), depth, split)
            heads = (turned(top[node].astype(np.uint64) << np.uint64(8), split) >> np.uint64(8) << np.uint64(8)) | m[node].astype(np.uint64)
            o = np.argsort(heads)
            total = np.zeros(len(rows))
            for i in range(8):
                key, handed = heads[o], [x[node][o] for x in (acc, rest, q)]
                for d in range(split + 1, depth + 1):
                    x = levels[d][i]
                    parent = np.searchsorted(key, (x.key >> np.uint64(16) << np.uint64(8)) | (x.key & np.uint64(255)))
                    key, handed = x.key, list(_descend(x, *(h[parent] for h in handed)))
                one = handed[2][levels[depth][i].of_row]
                bit = (rows[order] >> np.uint64(7 - i)) & np.uint64(1)
                with np.errstate(divide="ignore"):
                    total += np.log10(np.where(bit == 1, one, 1 - one))
            yield pa.RecordBatch.from_arrays([pa.array(code[gram][order].astype(np.int64)), pa.array(n[gram][order].astype(np.int64)), pa.array(total)], names=["code", "n", "log_p"])

    return run


NODES = "ctx long, m int, n0 long, n1 long, log_pw double, log_beta double"


def _levels(deepest: DataFrame, split: int) -> list[DataFrame]:
    """Node tables by depth, 0 first, from that of depth ``split``, each stored."""
    levels, level = [], deepest
    for d in range(split, -1, -1):
        level = stored(level, f"tree-{d}")
        levels.append(level)
        if d:
            up = level.groupBy(F.col("ctx").bitwiseAND((1 << (8 * (d - 1))) - 1).alias("ctx"), "m").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_pw").alias("below"))
            up = up.withColumn("log_pe", log_kt("n0", "n1")).withColumn("log_beta", F.col("log_pe") - F.col("below"))
            both = F.greatest("log_pe", "below") + F.log1p(F.exp(-F.abs(F.col("log_beta")))) - F.log(F.lit(2.0))
            level = up.withColumn("log_pw", both).select("ctx", "m", "n0", "n1", "log_pw", "log_beta")
    return levels[::-1]


def _handed(levels: list[DataFrame]) -> DataFrame:
    """``ctx, m, acc, rest, q`` of the deepest level: as ``_descend``, by joins from level to level (a
    node has 256 children at most, so no key is hot)."""
    odds = F.greatest(F.least(F.col("log_beta"), F.lit(700.0)), F.lit(-700.0))
    own, left = 1 / (1 + F.exp(-odds)), 1 / (1 + F.exp(odds))
    n = F.col("n0") + F.col("n1")
    p1 = (F.col("n1") + 0.5) / (n + 1)
    above = None
    for d, level in enumerate(levels):
        if above is None:
            level = level.withColumns({"up_acc": F.lit(0.0), "up_rest": F.lit(1.0), "up_q": F.lit(0.5)})
        else:
            level = level.withColumn("up", F.col("ctx").bitwiseAND((1 << (8 * (d - 1))) - 1))
            above = above.select(F.col("ctx").alias("up"), "m", F.col("acc").alias("up_acc"), F.col("rest").alias("up_rest"), F.col("q").alias("up_q"))
            level = level.join(F.broadcast(above) if d <= 2 else above, ["up", "m"])  # 256 x 255 rows at most above depth 2
        known = n > 0
        above = level.select(
            "ctx", "m",
            F.when(known, F.col("up_acc") + F.col("up_rest") * own * p1).otherwise(F.col("up_q")).alias("acc"),
            F.when(known, F.col("up_rest") * left).otherwise(0.0).alias("rest"),
            F.when(known, F.col("up_acc") + F.col("up_rest") * p1).otherwise(F.col("up_q")).alias("q"),
        )
    return above


def gram_table(grams: DataFrame, depth: int = DEPTH, split: int = SPLIT) -> DataFrame:
    """``code, n, log_p``: log10 P(last byte | bytes before) of all grams of ``code, n``."""
    parts = shuffle_partitions(grams.sparkSession)
    rows = grams.select(F.shiftright("code", 8).bitwiseAND((1 << (8 * split)) - 1).alias("top"), "code", "n")
    deepest = rows.repartition(parts, "top").sortWithinPartitions("top").mapInArrow(_rise(depth, split), NODES)
    handed = _handed(_levels(deepest, split)).select(F.col("ctx").alias("top"), F.col("m").cast("double").alias("m"), F.lit(0).cast("long").alias("code"), F.lit(0).cast("long").alias("n"), "acc", "rest", "q")
    nothing = F.lit(None).cast("double")
    both = rows.select("top", nothing.alias("m"), "code", "n", *(nothing.alias(c) for c in ("acc", "rest", "q"))).unionByName(handed)
    return both.repartition(parts, "top").sortWithinPartitions("top").mapInArrow(_fall(depth, split), "code long, n long, log_p double")


def _frequent(df: DataFrame, n: str, most: int) -> int:
    """The least power of two so that at most ``most`` rows have a larger or equal count."""
    powers = range(40)
    got = df.agg(*(F.count_if(F.col(n) >= (1 << p)).alias(f"p{p}") for p in powers)).first()
    return next((1 << p for p in powers if got[p] <= most), 1 << 40)


@dataclass(frozen=True)
class Cache:
    """log10 probabilities of frequent grams: sorted codes and, before them, a table with one slot a
    hash that names a place in them. The driver makes it, workers look into the broadcast arrays and
    keep nothing beside them."""

    codes: np.ndarray
    logs: np.ndarray
    slots: np.ndarray  # -1: no gram has this hash

    @classmethod
    def of(cls, codes: np.ndarray, n: np.ndarray, logs: np.ndarray) -> Cache:
        order = np.argsort(codes)
        codes, logs, n = codes[order], logs[order], n[order]
        slots = np.full(1 << CACHE_BITS, -1, np.int32)
        order = np.argsort(n, kind="stable")  # the most frequent gram of a slot stays
        slots[cls.hashes(codes[order])] = order
        return cls(codes, logs, slots)

    @staticmethod
    def hashes(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)

    def look(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, which codes have one)."""
        if not len(self.codes):
            return np.zeros(len(codes)), np.zeros(len(codes), bool)
        at = self.slots[self.hashes(codes)]
        hit = (self.codes[at] == codes) & (at >= 0)
        # An empty slot means that no gram of the cache has this hash.
        miss = np.flatnonzero(~hit & (at >= 0))
        at[miss] = np.minimum(np.searchsorted(self.codes, codes[miss]), len(self.codes) - 1)
        hit[miss] = self.codes[at[miss]] == codes[miss]
        return np.where(hit, self.logs[at], 0.0), hit


SCORED = "doc_id long, n_tokens long, hits long, log_sum double, score double, bytes long, rare array<long>, rare_grams array<long>"


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCodes()
        known, table, logs = (shared.value[x] for x in ("grams", "words", "logs"))
        for b in slices(batches, step=SCORE_BYTES):
            texts = b.column(1).to_pylist()
            words, sizes = word_codes(texts, cache, True)
            n = sizes + 1
            of = np.repeat(np.arange(len(n)), n)
            tokens = np.full(n.sum(), END_WORD)
            ends = np.cumsum(n) - 1
            inner = np.ones(len(tokens), bool)
            inner[ends] = False
            tokens[inner] = words
            at = np.minimum(np.searchsorted(table, tokens), max(len(table) - 1, 0))
            hit = (table[at] == tokens) if len(table) else np.zeros(len(tokens), bool)
            log_sum = np.bincount(of, np.where(hit, logs[at], 0.0) if len(table) else None, len(n)) if len(table) else np.zeros(len(n))
            hits = np.bincount(of, hit, len(n)).astype(np.int64)
            rare, counts = tokens[~hit].view(np.int64), n - hits
            codes, starts, lengths = byte_grams(texts)
            codes, text = codes[_real(codes, starts)], np.repeat(np.arange(len(lengths)), lengths)
            value, found = known.look(codes)
            score = np.bincount(text, value, len(lengths))
            others, rare_grams = np.bincount(text[~found], minlength=len(lengths)), codes[~found].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(n), pa.array(hits), pa.array(log_sum), pa.array(score), pa.array(lengths - 1), _lists(rare, counts), _lists(rare_grams, others)],
                names=["doc_id", "n_tokens", "hits", "log_sum", "score", "bytes", "rare", "rare_grams"],
            )

    return run


def score_documents(docs: DataFrame, training) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` for each row of ``docs``.

    ``training``: a condition on ``docs``; counts come from the rows for which it is true. Null
    and empty texts have one token, the end; long texts are scored whole; repeated rows give repeated rows; a
    null doc_id stays null, and its row trains if ``training`` is true of it; without training
    rows every decision has probability 1/2; an empty table gives an empty result. Extra columns are
    ignored. ``bits_per_byte`` is the
    code length by the model over the bytes and the end.
    """
    spark = docs.sparkSession
    tally = docs.select("text", F.coalesce(training, F.lit(False)).alias("training")).mapInArrow(_tally, "kind int, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n"))
    tally = stored(tally, "lm-counts")
    words, grams = tally.where(F.col("kind") == WORD_KIND).select("code", "n"), tally.where(F.col("kind") == GRAM_KIND).select("code", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    often = _frequent(words, "n", WORDS)
    top = words.where(F.col("n") >= often).toArrow()  # WORDS rows at most
    table = stored(gram_table(grams), "lm-grams")
    near = table.where(F.col("n") >= _frequent(table, "n", GRAMS)).toArrow()  # GRAMS rows at most
    codes = top["code"].to_numpy().view(np.uint64)
    order = np.argsort(codes)
    known = Cache.of(near["code"].to_numpy().view(np.uint64), near["n"].to_numpy(), near["log_p"].to_numpy())
    shared = spark.sparkContext.broadcast({"words": codes[order], "logs": np.log10(top["n"].to_numpy()[order] + 1.0), "grams": known})
    rows = docs.select("doc_id", "text").mapInArrow(_score(shared), SCORED).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "lm-rows")
    seldom = words.where(F.col("n") < often)
    rare = rows.select("row", F.explode("rare").alias("code")).groupBy("row", "code").agg(F.count("*").alias("times"))
    found = rare.join(seldom, "code").groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_sum"))
    others = rows.select("row", F.explode("rare_grams").alias("code")).groupBy("row", "code").agg(F.count("*").alias("times"))
    rest = others.join(table.select("code", "log_p"), "code").groupBy("row").agg(F.sum(F.col("times") * F.col("log_p")).alias("rest"))
    base = F.col("log_sum") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total["n"] + total["v"] + 1)))
    score = F.col("score") + F.coalesce("rest", F.lit(0.0))
    bits = -score * float(np.log2(10)) / (F.col("bytes") + 1)
    out = rows.drop("rare", "rare_grams").join(found, "row", "left").join(rest, "row", "left")
    return out.select("doc_id", "n_tokens", (F.col("hits") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), bits.alias("bits_per_byte"))


def in_training():
    """The fold rule: crc32(doc_id as text) mod 7 isn't 2."""
    return crc_mod("doc_id", 7) != 2
