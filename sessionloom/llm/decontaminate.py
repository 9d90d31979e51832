"""Operator 2: benchmark decontamination by BM25 with block-max WAND.

The test items are the indexed side: an inverted index of BM25 impacts, each divided by its
item's own full score, so that one threshold holds for all. Every passage of every training
document (overlapping windows of words) is a query that retrieves all items at or above the
threshold. Postings are in blocks of items with the largest impact of each block: sums of these
bounds over a passage, taken for many passages at once, leave few (passage, block) pairs, and
block-max WAND runs in those. Hits are verified: of the item's question and of its answer (its
last sentence), enough five-word shingles must occur in the document.

Passages have a fixed size; an item of more than half a passage is indexed by parts of that size, any
of which retrieves it. Document frequencies and the average length come from the whole benchmark's
parts, counted in Spark. They are broadcast in indexes of about INDEX_ITEMS parts, which bounds what
a task holds; a larger benchmark takes several, one pass over the documents each, with the same
scores and hits as one index would give.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices, stored

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, SHINGLE = 0.65, 0.8, 5
BLOCK_ITEMS = 4
INDEX_ITEMS = 2_000
#: Words of half a passage. A passage is two halves, so it holds any stretch of half its length; an
#: item of more words is retrieved by its parts of so many words at most, and verified whole.
HALF = 64
CACHE = 250_000
_NOT_WORD = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"(?<=[.?!])\s+")


def normal_words(text: str | None) -> list[str]:
    """Lower-case words without signs; what has no letter or digit is left out."""
    return [w for w in (_NOT_WORD.sub("", x) for x in (text or "").lower().split()) if w]


def question_answer(text: str | None) -> tuple[list[str], list[str]]:
    """An item's words before its last sentence, and those of the last sentence (all of them
    count as question if there is one sentence)."""
    parts = [p for p in (normal_words(x) for x in _SENTENCE.split((text or "").strip())) if p]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def word_shingles(words: list[str], k: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def item_parts(text: str | None) -> list[list[str]]:
    """An item's words in parts of HALF words at most, of about equal size."""
    words = normal_words(text)
    n = -(-len(words) // HALF)
    return [words[i * len(words) // n : (i + 1) * len(words) // n] for i in range(n)]


@dataclass
class Stats:
    """Of a benchmark's parts: how many there are, their average length, parts with a word (of the
    words that are asked for)."""

    parts: int
    average: float
    df: dict[str, int]

    @classmethod
    def of(cls, parts: list[list[str]]) -> Stats:
        return cls(len(parts), sum(map(len, parts)) / max(len(parts), 1) or 1.0, Counter(w for ws in parts for w in set(ws)))


@dataclass
class Index:
    """Inverted index of items' parts: for each term, numbers of parts, impacts and block bounds;
    ``owner`` has each part's item."""

    items: list[tuple[int, str]]
    owner: list[int] = field(default_factory=list)
    terms: dict[str, int] = field(default_factory=dict)
    postings: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    block_max: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))

    @classmethod
    def build(cls, items: list[tuple[int, str]], stats: Stats | None = None) -> Index:
        """Index of ``items``; ``stats``: of the benchmark that they belong to (None: they are all of it)."""
        split = [item_parts(t) for _, t in items]
        out, words = cls(items, [i for i, parts in enumerate(split) for _ in parts]), [ws for parts in split for ws in parts]
        stats = stats or Stats.of(words)
        lists: dict[str, list[tuple[int, float]]] = {}
        for i, ws in enumerate(words):
            impact = {}
            for w, tf in Counter(ws).items():
                idf = math.log(1 + (stats.parts - stats.df[w] + 0.5) / (stats.df[w] + 0.5))
                impact[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / stats.average))
            full = sum(impact.values())
            for w, x in impact.items():
                lists.setdefault(w, []).append((i, x / full))
        blocks = -(-len(words) // BLOCK_ITEMS)
        out.block_max = np.zeros((len(lists) + 1, blocks), np.float32)  # the last row: words of no item
        for n, (w, got) in enumerate(lists.items()):
            out.terms[w] = n
            at, x = np.array([g[0] for g in got]), np.array([g[1] for g in got])
            out.postings.append((at, x))
            np.maximum.at(out.block_max[n], at // BLOCK_ITEMS, x.astype(np.float32))
        return out

    def block_max_wand(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """All parts of a block whose score for these distinct terms is at least the threshold."""
        lo, hi = block * BLOCK_ITEMS, (block + 1) * BLOCK_ITEMS
        cursors = []
        for t in terms:
            bound = float(self.block_max[t, block])
            if bound > 0:
                at, x = self.postings[t]
                a, z = np.searchsorted(at, (lo, hi))
                cursors.append([int(at[a]), bound, at[a:z], x[a:z], 0])
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[1]
                if bound >= threshold - 1e-6:
                    pivot = c[0]
                    break
            if pivot is None:
                return found
            if cursors[0][0] == pivot:
                score = sum(float(c[3][c[4]]) for c in cursors if c[0] == pivot)
                if score >= threshold:
                    found.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            for c in cursors:  # move everything before the target up to it
                if c[0] < target:
                    c[4] += int(np.searchsorted(c[2][c[4] :], target))
                    c[0] = int(c[2][c[4]]) if c[4] < len(c[2]) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found


class _Terms(dict):
    """raw word -> number of its term, the last row for words of no item, -1 for none."""

    def __init__(self, index: Index):
        super().__init__()
        self.index = index

    def __missing__(self, raw: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        w = _NOT_WORD.sub("", raw.lower())
        n = self[raw] = self.index.terms.get(w, len(self.index.terms)) if w else -1
        return n


def search(texts: list[str | None], index: Index, terms: _Terms, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
    """(text, item, best passage score of the item or of a part of it) of all hits."""
    none, half = len(index.terms), HALF
    tokens, passages, text_of = [], [], []
    for i, t in enumerate(texts):
        raw = (t or "").split()
        n = np.fromiter(map(terms.__getitem__, raw), np.int64, len(raw))
        n = n[n >= 0]
        at = np.flatnonzero(n != none)
        place = len(text_of) + at // half
        # Passage h is the halves h and h + 1 of its document.
        tokens += [n[at], n[at[at >= half]]]
        passages += [place, place[at >= half] - 1]
        text_of += [i] * -(-len(n) // half)
    if not text_of or not none:
        return []
    pairs = np.unique(np.concatenate(passages) * none + np.concatenate(tokens))
    passage, token = pairs // none, pairs % none
    cuts = np.append(np.flatnonzero(np.append(True, passage[1:] != passage[:-1])), len(pairs)) if len(pairs) else np.zeros(1, np.int64)
    best: dict[tuple[int, int], float] = {}
    step = max(1, 8_000_000 // (2 * half * index.block_max.shape[1]))
    for lo in range(0, len(cuts) - 1, step):
        part = cuts[lo : lo + step + 1]
        bounds = np.add.reduceat(index.block_max[token[part[0] : part[-1]]], part[:-1] - part[0])
        for h, block in zip(*np.nonzero(bounds >= threshold - 1e-3), strict=True):
            own = token[part[h] : part[h + 1]]
            for found, score in index.block_max_wand(own[index.block_max[own, block] > 0].tolist(), int(block), threshold):
                key = (text_of[int(passage[part[h]])], index.owner[found])
                best[key] = max(best.get(key, 0.0), score)
    return [(t, i, s) for (t, i), s in sorted(best.items())]


def overlaps(text: str | None, item: str | None, k: int = SHINGLE) -> tuple[float, float]:
    """Shares of the question's and of the answer's shingles that occur in the text (1 for no answer)."""
    words = normal_words(text)
    has: dict[int, set] = {}

    def share(part: list[str]) -> float:
        n = min(k, len(part))
        if n not in has:
            has[n] = word_shingles(words, n)
        want = word_shingles(part, n)
        return len(want & has[n]) / len(want)

    question, answer = question_answer(item)
    return share(question) if question else 0.0, share(answer) if answer else 1.0


HITS = "row_id long, doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _find(shared, threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        terms = _Terms(index)
        for b in slices(batches, 2):
            texts, rows, docs = b.column(2).to_pylist(), b.column(0).to_pylist(), b.column(1).to_pylist()
            out = []
            for t, i, score in search(texts, index, terms, threshold):
                q, a = overlaps(texts[t], index.items[i][1])
                if q >= overlap and a >= overlap:
                    out.append((rows[t], docs[t], index.items[i][0], score, q, a))
            if out:
                cols = zip(*out, strict=True)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in HITS.split(", ")])

    return run


def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        split = [item_parts(t) for t in b.column(1).to_pylist()]
        cols = [pa.array([len(p) for p in split], pa.int64()), pa.array([sum(map(len, p)) for p in split], pa.int64()), pa.array([[w for ws in p for w in sorted(set(ws))] for p in split], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "parts", "n_words", "words"])


def _indexes(benchmark: DataFrame, index_items: int) -> Iterator[Index]:
    """Indexes of ``index_items`` parts at most (but for the last item's), all with the statistics of
    the whole benchmark."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text")
    items = items.mapInArrow(_with_words, "item_id long, text string, parts long, n_words long, words array<string>").where("n_words > 0")
    items = stored(items.withColumn("item", F.monotonically_increasing_id()), "leak-items")
    n, total = items.agg(F.sum("parts"), F.sum("n_words")).first()
    words = items.select("item", F.explode("words").alias("word"))  # a word once for each part
    counted = words.distinct().join(words.groupBy("word").agg(F.count("*").alias("df")), "word").groupBy("item").agg(F.collect_list(F.struct("word", "df")).alias("counted"))
    ready = stored(items.drop("words").join(counted, "item").select("item_id", "text", "parts", "counted"), "leak-counted")
    held: list[tuple[int, str]] = []
    df: dict[str, int] = {}
    parts = 0
    for r in ready.orderBy("item_id", "text").toLocalIterator():  # an index of items at a time
        held.append((r["item_id"], r["text"]))
        df.update((w, times) for w, times in r["counted"])
        parts += r["parts"]
        if parts >= index_items:
            yield Index.build(held, Stats(n, total / n, df))
            held, df, parts = [], {}, 0
    if held:
        yield Index.build(held, Stats(n, total / n, df))


def _row_key():
    return F.xxhash64("doc_id", "text")


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, index_items: int = INDEX_ITEMS) -> DataFrame:
    """``row_id, doc_id, item_id, score, question_overlap, answer_overlap`` of every verified leak.

    ``row_id`` is xxhash64(doc_id, text). Items without words and rows with null or empty text
    match nothing; long texts are searched whole, passage by passage; a null item_id or doc_id
    stays null in the result; items that occur twice are both reported; repeated document rows give
    repeated results; an empty benchmark or document table gives an empty result. Extra columns are
    ignored.
    """
    spark = docs.sparkSession
    keyed = docs.select(_row_key().alias("row_id"), F.col("doc_id").cast("long"), "text")
    out = spark.createDataFrame([], HITS)
    for index in _indexes(benchmark, index_items):
        shared = spark.sparkContext.broadcast(index)
        out = out.unionByName(keyed.mapInArrow(_find(shared, threshold, overlap), HITS))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a test item: columns, their order and names unchanged,
    whatever these are. Rows with null or empty text stay; equal rows go or stay together."""
    key = free_name(docs, "leak_key")
    leaks = find_leaks(docs, benchmark).select(F.col("row_id").alias(key)).distinct()
    return docs.withColumn(key, _row_key()).join(leaks, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
