"""Operator 12: document quality by attention-based multiple-instance learning.

A document is a bag of passages of 128 words. Each passage becomes a row of measures (pairs of
character classes, word lengths, hashed words, repetition), an encoder turns the row into a vector
h, and a gated attention, softmax over w . (tanh(V h) * sigmoid(U h)), weighs the passages of the
document; a logistic layer scores the weighted mean of their vectors. Only documents have labels;
encoder, gates and logistic layer are learned from these together.

Measures of the training documents are written once. Each training step is a Spark job that adds up
the gradient over all of them; the driver holds nothing but the parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, shuffle_partitions, slices, stored

#: Labelled documents that training looks at (the first by a hash of the doc_id).
TRAIN_ROWS = 8_000
#: Words of a passage. Texts are cut every SEGMENT bytes, wherever that falls, and passages start
#: anew there, so a text of any length takes bounded memory.
PASSAGE, SEGMENT = 128, 4_000_000
ENCODED, GATES = 16, 8
STEPS, RATE, DECAY = 60, 0.05, 1e-3
THRESHOLD = 0.7
SEED = 12

# The classes of bytes.
GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\v\f", ".,;:'-", "!?", "()[]{}\"", "|/\\_<>=+~`^", "#$%&*@")
BEYOND, CONTROL = len(GROUPS), len(GROUPS) + 1
CLASSES = len(GROUPS) + 2
LENGTHS, BUCKETS, EXTRA = 10, 32, 4
MEASURES = CLASSES * CLASSES + LENGTHS + BUCKETS + EXTRA


def _class_table() -> np.ndarray:
    table = np.full(256, CONTROL, np.int64)
    table[128:] = BEYOND
    for i, group in enumerate(GROUPS):
        table[[ord(c) for c in group]] = i
    return table


_CLASS = _class_table()
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\v\f"))
_CODE = np.random.default_rng(SEED).integers(1, 1 << 63, (256, 8), np.int64).view(np.uint64)


def _scaled(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares of each row's sum."""
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


def measures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Measures of the passages of each text one after another, and each text's number of passages.

    A text without words has one passage. No value depends on the other texts.
    """
    n = len(texts)
    raw = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)  # every text ends in a blank
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    blank = _BLANK[raw]
    start = ~blank
    start[1:] &= blank[:-1]
    at = np.flatnonzero(start)
    text_of_word = np.searchsorted(ends, at, side="right")
    words = np.bincount(text_of_word, minlength=n)
    count = np.maximum(-(-words // PASSAGE), 1)
    base = np.cumsum(count) - count
    number = np.arange(len(at)) - (np.cumsum(words) - words)[text_of_word]
    word_passage = base[text_of_word] + number // PASSAGE
    total = int(count.sum())

    # A byte belongs to the passage of the last word begun in its text, or to the text's first one.
    stretch = np.zeros(len(raw), np.int64)
    stretch[0] = base[0] if n else 0
    first = ends[:-1]
    moves = np.concatenate([first, at])
    values = np.concatenate([base[1:], word_passage])
    order = np.argsort(moves, kind="stable")
    moves, values = moves[order], values[order]
    stretch[moves] = values  # a word at a text's first byte comes later and says the same
    begun = np.zeros(len(raw), np.int64)
    begun[moves] = moves
    passage = stretch[np.maximum.accumulate(begun)]

    kind = _CLASS[raw]
    follows = np.append(kind[1:], 4)
    inner = np.ones(len(raw), bool)
    inner[ends - 1] = False  # pairs don't reach into the next text
    pairs = np.bincount(((passage * CLASSES + kind) * CLASSES + follows)[inner], minlength=total * CLASSES * CLASSES).reshape(total, -1)

    stop = np.flatnonzero(np.append(blank[1:], True) & ~blank) + 1
    length = stop - at
    place = (np.arange(len(raw)) - at[np.maximum(np.cumsum(start) - 1, 0)])[~blank] if len(at) else np.zeros(0, np.int64)
    lengths = np.bincount(word_passage * LENGTHS + np.minimum(length, LENGTHS) - 1, minlength=total * LENGTHS).reshape(total, -1)
    codes = _CODE[raw[~blank], place & 7] * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    word = np.add.reduceat(codes, np.cumsum(length) - length) if len(at) else np.zeros(0, np.uint64)
    word = (word ^ (word >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    bucket = (word >> np.uint64(59)).astype(np.int64)
    buckets = np.bincount(word_passage * BUCKETS + bucket, minlength=total * BUCKETS).reshape(total, -1)
    have = np.maximum(np.bincount(word_passage, minlength=total), 1)

    key = (word >> np.uint64(24)) | (word_passage.astype(np.uint64) << np.uint64(40))
    key = np.sort(key)
    distinct = np.bincount((key[np.append(True, key[1:] != key[:-1])] >> np.uint64(40)).astype(np.int64), minlength=total) if len(key) else np.zeros(total, np.int64)
    again = (word[1:] == word[:-1]) & (word_passage[1:] == word_passage[:-1])
    twice = np.bincount(word_passage[1:][again], minlength=total)
    extra = np.stack([distinct / have, twice / have, np.log1p(np.bincount(word_passage, minlength=total)) / 5, np.bincount(word_passage, length, minlength=total) / have / 10], 1)
    return np.concatenate([_scaled(pairs), _scaled(lengths), _scaled(buckets), extra], 1).astype(np.float32), count


def text_measures(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(measures, passages of each piece, text of each piece) of successive pieces of all texts; a
    step has no two pieces of one text."""
    held: list[bytes] = []
    owner: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        for lo in range(0, max(len(raw), 1), SEGMENT):
            held.append(raw[lo : lo + SEGMENT])
            owner.append(i)
            size += len(held[-1])
            if size >= SEGMENT // 4:
                yield *measures(held), np.array(owner)
                held, owner, size = [], [], 0
    if held:
        yield *measures(held), np.array(owner)


class Network:
    """Encoder, gated attention and logistic layer; all parameters in one vector."""

    SHAPES = {"centre": (MEASURES,), "scale": (MEASURES,), "encode": (MEASURES, ENCODED), "shift": (ENCODED,), "v": (ENCODED, GATES), "u": (ENCODED, GATES), "w": (GATES,), "out": (ENCODED,), "bias": (1,)}
    #: centre and scale are measured once, not learned.
    FIXED = 2 * MEASURES

    def __init__(self, values: np.ndarray):
        self.values, lo = values, 0
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, values[lo : lo + size].reshape(shape))
            lo += size

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for s in cls.SHAPES.values())

    @classmethod
    def start(cls, centre: np.ndarray, scale: np.ndarray, rate: float) -> Network:
        rng, net = np.random.default_rng(SEED), cls(np.zeros(cls.size()))
        net.centre[:], net.scale[:] = centre, scale
        net.encode[:] = rng.standard_normal(net.encode.shape) / np.sqrt(MEASURES)
        for part in (net.v, net.u, net.w, net.out):
            part[:] = rng.standard_normal(part.shape) / np.sqrt(len(part))
        net.bias[:] = np.log(rate / (1 - rate))
        return net

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Standardised measures, vectors, both halves of the gate, and attention before softmax."""
        x = np.clip((x - self.centre) * self.scale, -5, 5)
        h = np.tanh(x @ self.encode + self.shift)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        return x, h, t, g, (t * g) @ self.w

    def gradient(self, x: np.ndarray, count: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Log loss and gradient, summed over bags of ``count`` passages with labels ``y``."""
        at = np.cumsum(count) - count
        bag = np.repeat(np.arange(len(count)), count)
        x, h, t, g, e = self.passages(x)
        a = np.exp(e - np.maximum.reduceat(e, at)[bag])
        a /= np.add.reduceat(a, at)[bag]
        z = np.add.reduceat(a[:, None] * h, at)
        s = np.clip(z @ self.out + self.bias, -30, 30)
        p = 1 / (1 + np.exp(-s))
        loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
        back = np.zeros(len(self.values))
        net = Network(back)
        ds = p - y
        net.out[:], net.bias[:] = z.T @ ds, ds.sum()
        dz = (ds[:, None] * self.out)[bag]
        da = (dz * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, at)[bag])
        net.w[:] = (t * g).T @ de
        dgate = de[:, None] * self.w
        dt, dg = dgate * g * (1 - t * t), dgate * t * g * (1 - g)
        net.v[:], net.u[:] = h.T @ dt, h.T @ dg
        dh = (a[:, None] * dz + dt @ self.v.T + dg @ self.u.T) * (1 - h * h)
        net.encode[:], net.shift[:] = x.T @ dh, dh.sum(0)
        return loss, back

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Score and number of passages of each text; softmax runs on over a text's pieces."""
        n = len(texts)
        top, weight, z, passages = np.full(n, -np.inf), np.zeros(n), np.zeros((n, ENCODED)), np.zeros(n, np.int64)
        for x, count, owner in text_measures(texts):
            _, h, _, _, e = self.passages(x)
            at = np.cumsum(count) - count
            bag = np.repeat(np.arange(len(count)), count)
            high = np.maximum.reduceat(e, at)
            a = np.exp(e - high[bag])
            part, sums = np.add.reduceat(a[:, None] * h, at), np.add.reduceat(a, at)
            most = np.maximum(top[owner], high)
            old, new = np.exp(top[owner] - most), np.exp(high - most)
            z[owner] = z[owner] * old[:, None] + part * new[:, None]
            weight[owner], top[owner] = weight[owner] * old + sums * new, most
            passages[owner] += count
        s = np.clip((z / weight[:, None]) @ self.out + self.bias, -30, 30)
        return 1 / (1 + np.exp(-s)), passages


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1, SEGMENT // 4):
        parts: list[list[np.ndarray]] = [[] for _ in range(b.num_rows)]
        for x, count, owner in text_measures(b.column(1).to_pylist()):
            for i, rows in zip(owner, np.split(x, np.cumsum(count)[:-1]), strict=True):
                parts[i].append(rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.concatenate(p).tobytes() for p in parts], pa.binary())], names=["label", "x"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(measures, passages of each document, labels) in steps of bounded size."""
    for b in slices(batches, 1, 8_000_000):
        bags = [np.frombuffer(x, np.float32).reshape(-1, MEASURES) for x in b.column(1).to_pylist()]
        yield np.concatenate(bags).astype(np.float64), np.array([len(x) for x in bags]), b.column(0).to_numpy().astype(np.float64)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(2 + 2 * MEASURES)
    for x, count, y in _bags(batches):
        total += np.concatenate([[count.sum(), 0.0], x.sum(0), (x * x).sum(0)])
    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["g"])


def _slope(values: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, total = Network(values), np.zeros(1 + len(values))
        for x, count, y in _bags(batches):
            loss, back = net.gradient(x, count, y)
            total += np.append(loss, back)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["g"])

    return run


def _added(known: DataFrame, function) -> np.ndarray:
    """Sum of the vectors that the tasks return, one each; as many as partitions of the sample."""
    return sum(np.array(r["g"]) for r in known.mapInArrow(function, "g array<double>").collect())


def fit_network(known: DataFrame, steps: int = STEPS) -> Network | None:
    """A network for ``known (label, text)``; None unless both labels occur."""
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n, good = sum(totals.values()), totals.get(1, 0)
    if not 0 < good < n:
        return None
    bags = stored(known.select("label", "text").mapInArrow(_measure, "label int, x binary"), "quality-bags")
    total = _added(bags, _moments)
    mean = total[2 : 2 + MEASURES] / total[0]
    spread = np.sqrt(np.maximum(total[2 + MEASURES :] / total[0] - mean**2, 0))
    net = Network.start(mean, np.where(spread > 1e-3, 1 / np.maximum(spread, 1e-3), 0), good / n)
    values, m, v = net.values, np.zeros(Network.size()), np.zeros(Network.size())
    for i in range(1, steps + 1):  # Adam on the whole gradient
        g = _added(bags, _slope(values))[1:] / n + DECAY * values
        g[: Network.FIXED] = 0
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        values = values - RATE * (1 - i / (steps + 1)) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return Network(values)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, steps: int = STEPS) -> Network | None:
    """A network learned from at most ``rows`` labelled documents whose crc32(doc_id) mod 4 isn't 2,
    the first by a hash of the doc_id.

    A doc_id labelled more than once is good if no row says otherwise; of rows that share a doc_id
    the least text counts.
    """
    wanted = labels.where("doc_id is not null and quality is not null").where(crc_mod("doc_id", 4) != 2)
    wanted = wanted.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.when(F.col("quality") != 0, 1).otherwise(0)).alias("label"))
    sample = stored(wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "quality-sample")  # at most `rows` small rows: safe to broadcast
    known = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    known = known.repartition(shuffle_partitions(docs.sparkSession), "doc_id")
    return fit_network(known.select(F.col("label").cast("int"), "text"), steps)


def _score(values: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p, n = Network(values).scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array(n)], names=[*b.schema.names, "score", "n_passages"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, held_out, score, predicted, n_passages`` for each row of ``docs``.

    Null and empty texts are a passage without words; texts of any length are read whole; a null
    doc_id counts as the empty id for the fold; repeated rows give repeated rows; extra columns are
    ignored; empty documents give an empty result. Without labels of both kinds every score is 0.5.
    """
    net = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    values = net.values if net else np.zeros(Network.size())
    rows = rows.mapInArrow(_score(values), "doc_id long, text string, score double, n_passages long")
    return rows.select("doc_id", "text", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages")
