"""Operator 4: toxicity by noisy-channel deobfuscation.

A character trigram model is counted over the words of all documents. Tokens that look disguised
(signs or digits among letters, letters repeated three times or more, single letters with
spaces or signs between) become lattices: each sign stands for letters it may replace or for
nothing, a repeated letter for itself or nothing. Viterbi decoding under the model, with a cost
for each channel step, restores the word. Runs of short tokens (single letters, signs, chunks of
up to three) are decoded as one lattice, in which each separator is a word bound or nothing.
Words and their first letters, restored, are weighed
by log-odds learned from labelled documents, and a logistic curve turns a document's evidence
into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, slices, stored

#: Labelled documents that training looks at (the first by a hash): bounds the features too.
TRAIN_ROWS = 20_000
LEAST_DOCS, LEAST_ODDS = 4, 8.0
PREFIXES = (4, 5, 6)
#: Doubled letters with a less likely trigram (log P) about them are decoded.
UNLIKELY = -5.5
CACHE = 250_000

# What a sign may stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
DROPPED = set(".-_*~'`,:;/\\^")
SWAP_COST, DROP_COST, REPEAT_COST = 1.0, 0.5, 0.3
BOUND, OTHER, SIZE = 26, 27, 28
#: Cost of reading a separator as nothing, between single characters and between longer chunks.
JOIN_COST, CHUNK_COST = 0.5, 2.0
_SHORT = r"(?:\w(?:[.\-_*]\w)+|\S{1,3})[.,;:!?\"')\]]*(?!\S)"
#: Two or more short tokens one after another, with any blanks between.
SHORT_RUN = re.compile(rf"(?<!\S){_SHORT}(?:\s+{_SHORT})+")
TRAILING = re.compile(r"(?<=\w)[.,;:!?\"')\]]+$")
DOUBLED, STRETCHED, TWICE = re.compile(r"([^\W\d_])\1"), re.compile(r"(.)\1{2,}"), re.compile(r"(.)\1")
GLUE = re.compile(r"[.\-_*~`,:;/\\^=&?#%]+")


def _codes() -> np.ndarray:
    """Latin-1 byte -> a..z, any other letter, or a word bound."""
    table = np.full(256, BOUND, np.int64)
    for b in range(256):
        c = chr(b).lower()
        if c.isalpha():
            table[b] = ord(c) - 97 if "a" <= c <= "z" else OTHER
    table[ord("?")] = BOUND
    return table


def count_trigrams(texts: list[str | None]) -> np.ndarray:
    """Counts of (letter, letter, letter); letters beyond Latin-1 count as word bounds."""
    raw = "  ".join(t or "" for t in texts).encode("latin-1", "replace")
    c = _codes()[np.frombuffer(b"  " + raw + b"  ", np.uint8)]
    return np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIZE**3, np.int64)
    for b in slices(batches, 0):
        total += count_trigrams(b.column(0).to_pylist())
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) from all documents; the table has SIZE^3 entries whatever the input."""
    counts = np.zeros(SIZE**3)
    for r in docs.select("text").mapInArrow(_count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r["gram"]] = r["n"]
    tri = counts.reshape(SIZE, SIZE, SIZE)
    uni = (tri.sum((0, 1)) + 1) / (tri.sum() + SIZE)
    bi = (tri.sum(0) + 5 * uni) / (tri.sum((0, 2))[:, None] + 5)
    return np.log((tri + 5 * bi[None]) / (tri.sum(2, keepdims=True) + 5))


def _letter(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else OTHER


def viterbi(token: str, lm: np.ndarray) -> str:
    """The likeliest word behind a lower-case token; words, with spaces, where the token has
    separators (a space between single characters, a tab between longer chunks)."""
    # (letter, letter) -> score, number of letters, letters as a chain (its front, the last one)
    states: dict[tuple[int, int], tuple[float, int, tuple | None]] = {(BOUND, BOUND): (0.0, 0, None)}
    before = ""
    for ch in token:
        ways: list[tuple[str, float]] = []
        if ch in " \t":
            ways += [(" ", 0.0), ("", JOIN_COST if ch == " " else CHUNK_COST)]
        elif ch.isalpha():
            ways.append((ch, 0.0))
            if ch == before:
                ways.append(("", REPEAT_COST))
        else:
            ways += [(x, SWAP_COST) for x in SIGNS.get(ch, "")]
            if ch in DROPPED or not ways or ch == before:
                ways.append(("", DROP_COST))
        after: dict[tuple[int, int], tuple[float, int, tuple | None]] = {}
        for (p, q), (score, n, word) in states.items():
            for x, cost in ways:
                if x == " " and q == BOUND:
                    key, value = (p, q), (score, n, word)
                elif x:
                    c = BOUND if x == " " else _letter(x)
                    key, value = (q, c), (score - cost + lm[p][q][c], n + (x != " "), (word, x))
                else:
                    key, value = (p, q), (score - cost, n, word)
                if key not in after or value[0] > after[key][0]:
                    after[key] = value
        states, before = after, ch

    def mean(item) -> float:  # per letter: a short path isn't better for being short
        (p, q), (score, n, _) = item
        return (score + (lm[p][q][BOUND] if q != BOUND else 0.0)) / (n + 1) if n else -math.inf

    out, word = [], max(states.items(), key=mean)[1][2]
    while word:
        word, x = word
        out.append(x)
    return "".join(reversed(out)).strip()


def restore_run(run: str, lm: np.ndarray) -> list[str]:
    """The words behind a run of short tokens."""
    tokens = [TRAILING.sub("", t) for t in run.lower().split()]
    parts = tokens[:1]
    for x, y in zip(tokens, tokens[1:]):
        parts += [" " if len(x) == len(y) == 1 else "\t", y]
    return viterbi("".join(parts), lm).split() if any(c.isalpha() for c in run) else []


def _odd_double(word: str, lm: np.ndarray) -> bool:
    """Whether the model finds the letters about a doubled one unlikely."""
    for m in DOUBLED.finditer(word):
        c = [_letter(x) for x in word[max(m.start() - 2, 0) : m.end() + 2]]
        c = [BOUND] * max(2 - m.start(), 0) + c + [BOUND] * (m.end() >= len(word))
        if any(lm[x][y][z] < UNLIKELY for x, y, z in zip(c, c[1:], c[2:])):
            return True
    return False


def restore_token(token: str, lm: np.ndarray) -> str:
    """The lower-case words behind a token of any length, with spaces between; empty if there are
    none in it. A character more than twice in a row says no more than twice."""
    low = token.lower()
    core = low.strip("\"'.,;:!?()[]{}<>#%&*=|~`$^_-/\\+")
    if core.isalpha() and not TWICE.search(core):
        return core
    short = STRETCHED.sub(r"\1\1", core)
    if core.isalpha() and short == core and not _odd_double(core, lm):
        return core
    whole = STRETCHED.sub(r"\1\1", low).strip("\"',;:?()[]{}<>#%&*=~`^_-/\\.") if not core or not core.isalpha() else short
    if not any(c.isalpha() for c in whole):
        return ""
    return viterbi(GLUE.sub(" ", whole), lm)  # a separator is a word bound or nothing


def restore_text(text: str | None, lm: np.ndarray) -> list[str]:
    """The distinct restored words of a text."""
    return list(_Restorer(lm).words(text))


class _Restorer(dict):
    """token -> restored word, remembered for the tokens met last."""

    def __init__(self, lm: np.ndarray):
        super().__init__()
        self.lm = lm.tolist()  # plain lists: quicker to index
        self.runs: dict[str, list[str]] = {}

    def __missing__(self, token: str) -> str:
        if len(self) >= CACHE:
            self.clear()
        word = self[token] = restore_token(token, self.lm)
        return word

    def words(self, text: str | None) -> set[str]:
        text = text or ""
        found = {w for x in map(self.__getitem__, set(text.split())) for w in x.split()}
        found.update(self.run_words(text))
        found.discard("")
        return found

    def run_words(self, text: str) -> Iterator[str]:
        """Words behind the text's runs of short tokens, remembered for the runs met last."""
        for run in set(SHORT_RUN.findall(text)):
            if run not in self.runs:
                if len(self.runs) >= CACHE:
                    self.runs.clear()
                self.runs[run] = restore_run(run, self.lm)
            yield from self.runs[run]


def features(words: set[str]) -> set[str]:
    """Words, and the first letters of longer ones (with a trailing star)."""
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


def _learn(lm: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = _Restorer(lm)
        for b in slices(batches, 1, 6_000_000):
            seen = (Counter(), Counter())
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[toxic].update(features(restorer.words(text)))
            names = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][x] for x in names], pa.int64()), pa.array([seen[0][x] for x in names], pa.int64())], names=["feature", "toxic", "clean"])

    return run


def evidence(words: set[str], weights: dict[str, float]) -> tuple[float, int]:
    """Sum of the words' best weights, and how many words have one."""
    got = [max(weights.get(w, 0.0), *(weights.get(w[:n] + "*", 0.0) for n in PREFIXES)) for w in words]
    hits = [x for x in got if x > 0]
    return sum(hits), len(hits)


class _Scorer(_Restorer):
    """token -> its restored words that have a weight, with it."""

    def __init__(self, lm: np.ndarray, weights: dict[str, float]):
        super().__init__(lm)
        self.weights = weights
        #: First four letters of the features: no other word has a weight.
        self.heads = {f.rstrip("*")[: PREFIXES[0]] for f in weights}

    def __missing__(self, token: str) -> tuple[tuple[str, float], ...]:
        if len(self) >= CACHE:
            self.clear()
        got = self[token] = self.weighed(restore_token(token, self.lm).split())
        return got

    def weighed(self, words: list[str]) -> tuple[tuple[str, float], ...]:
        heads, n = self.heads, PREFIXES[0]
        return tuple((x, w) for x in words if x[:n] in heads and (w := evidence({x}, self.weights)[0]) > 0)

    def of(self, text: str | None) -> tuple[float, int, int]:
        """Evidence, number of words with evidence, number of distinct tokens."""
        text = text or ""
        tokens = set(text.split())
        best: dict[str, float] = {}  # a word counts once
        for got in map(self.__getitem__, tokens):
            if got:
                best.update(got)
        best.update(self.weighed(list(self.run_words(text))))
        return sum(best.values()), len(best), len(tokens)


def _inputs(total: np.ndarray, hits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.minimum(hits, 10) / 3.0, hits / np.sqrt(tokens + 1.0)], 1)


def _evaluate(lm: np.ndarray, weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(lm, weights)
        for b in slices(batches):
            got = [scorer.of(t) for t in b.column(1).to_pylist()]
            cols = list(zip(*got, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["key", "total", "hits", "tokens"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, dict[str, float], np.ndarray]:
    """(character model, weights of features, logistic weights).

    The character model covers all documents. The classifier sees at most ``rows`` labelled
    documents whose crc32(doc_id) mod 5 isn't 0, the first by a hash of the doc_id; with no such
    rows nothing is toxic. A doc_id labelled more than once is toxic if any row says so; of rows that
    share a doc_id the least text counts.
    """
    lm = language_model(docs)
    wanted = labels.where("doc_id is not null and toxic is not null").where(crc_mod("doc_id", 5) != 0)
    wanted = wanted.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("toxic"))
    sample = stored(wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "toxic-sample")  # at most `rows` small rows: safe to broadcast
    known = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")
    known = stored(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).drop("doc_id"), "toxic-train")
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return lm, {}, np.array([-4.0, 0.0, 0.0, 0.0])
    counts = known.mapInArrow(_learn(lm), "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = (F.col("t") + 0.5) / (n_toxic + 1) / ((F.col("c") + 0.5) / (n_clean + 1))
    top = counts.withColumn("odds", odds).where((F.col("t") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS))
    weights = {r["feature"]: math.log(r["odds"]) for r in top.collect()}
    got = known.select("toxic", "text").mapInArrow(_evaluate(lm, weights), "key long, total double, hits long, tokens long").toPandas().sort_values(["key", "total", "hits", "tokens"])
    x = _inputs(got["total"].to_numpy(float), got["hits"].to_numpy(float), got["tokens"].to_numpy(float))
    return lm, weights, fit_logistic(x, got["key"].to_numpy(float))


def _score(lm: np.ndarray, weights: dict[str, float], logistic: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(lm, weights)
        for b in slices(batches):
            total, hits, tokens = (np.array(c, float) for c in zip(*(scorer.of(t) for t in b.column(1).to_pylist()), strict=True))
            p = 1 / (1 + np.exp(-np.clip(_inputs(total, hits, tokens) @ logistic, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array(hits.astype(np.int64))], names=[*b.schema.names, "score", "n_toxic_words"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, held_out, score, predicted, n_toxic_words`` for each row of ``docs``.

    Null and empty texts get the score of a text without evidence; texts of any length are read
    whole; a null doc_id counts as the
    empty id for the fold; repeated rows give repeated rows; extra columns are ignored; empty
    tables give an empty result.
    """
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(*model), "doc_id long, text string, score double, n_toxic_words long")
    return rows.select("doc_id", "text", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic_words")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more: columns, their order and names unchanged,
    whatever these are. Rows with null or empty text stay, as do all where there are no labels; equal
    rows go or stay together; an empty table stays empty."""
    model = train(docs, labels)
    rows = docs.select("doc_id", "text", *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")))
    return rows.mapInArrow(_keep(*model), rows.schema).select(*(F.col(f"`{c}`") for c in docs.columns))


def _keep(lm: np.ndarray, weights: dict[str, float], logistic: np.ndarray):
    score = _score(lm, weights, logistic)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in score(batches):
            keep = pa.array(b.column(b.num_columns - 2).to_numpy() < 0.5)
            yield pa.RecordBatch.from_arrays(b.columns[:-2], names=b.schema.names[:-2]).filter(keep)

    return run
