"""Operator 3: substring dedup on a De Bruijn graph of words.

Every window of 13 words is an edge from the node of its first 12 words to that of its last 12.
Consecutive edges of a document form one path as long as their smallest 5-gram (their anchor) is
the same one; an unbranched stretch of the graph is cut into the same paths in every document
that runs through it, so a path travels as one record: anchor, source coordinates, and a hash
for each of its edges. Paths meet at their anchor: a shuffle brings all paths with equal anchors
together, equal edges are matched there, and each gets its source, the smallest document with
that edge. Matched paths are compacted by source coordinates: those of a document that follow each
other, in the document and in one source, become one long repeated span (a window over the
document's paths, in the partitions of the join that follows). That join by document brings spans
and texts together and removes the words that the spans cover.

Edges are told apart by 96 bits: the anchor's 64-bit hash and 32 bits of their own. Copies of an
edge within one batch of documents are settled there: only the smallest document's path is sent
on, which bounds what a passage that occurs in very many documents sends to one task. The number
of groups of anchors follows the bytes of the input, so that a group stays of a size.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordCodes, mixed, shuffle_partitions, slices, window_codes, word_codes

WINDOW, ANCHOR = 13, 5
#: Bytes of text whose edges are matched within the task before they are sent on.
BATCH_BYTES = 6_000_000
#: Bytes of text for each group of anchors (a task expands a group to about twenty times as much).
GROUP_BYTES = 8_000_000
SPREAD = np.uint64(0xA0761D6478BD642F)


def smallest_anchor(codes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window: position and hash of its smallest 5-gram (the first of equal ones)."""
    grams = window_codes(codes, anchor)
    n = len(codes) - window + 1
    best, where = grams[:n].copy(), np.arange(n, dtype=np.int32)
    for j in range(1, window - anchor + 1):
        other = grams[j : j + n]
        less = other < best
        best[less] = other[less]
        where[less] = np.flatnonzero(less) + j
    return where, best


def first_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that brings equal keys together, and for each place in it the place where its key starts."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return order, np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))


def runs(follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs; ``follows``: whether a row continues the one before."""
    at = np.flatnonzero(~follows) if len(follows) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(follows)))


def _claims(row: np.ndarray, pos: np.ndarray, src: np.ndarray, src_pos: np.ndarray) -> list[np.ndarray]:
    """Rows (row key, position, edges, source, its position) of runs in step; input sorted by row, pos."""
    f = np.zeros(len(row), bool)
    f[1:] = (row[1:] == row[:-1]) & (pos[1:] == pos[:-1] + 1) & (src[1:] == src[:-1]) & (src_pos[1:] == src_pos[:-1] + 1)
    at, n = runs(f)
    return [row[at].astype(np.int64), pos[at].astype(np.int64), n.astype(np.int64), src[at].astype(np.int64), src_pos[at].astype(np.int64)]


CLAIM = "row long, pos long, n long, src long, src_pos long"
_NAMES = ["row", "pos", "n", "src", "src_pos"]


def _send(groups: int, window: int, anchor: int):
    """Per batch of documents: a packed message for each group of anchors, and one of settled claims."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCodes()
        for b in slices(batches, 2, BATCH_BYTES):
            row, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.argsort(doc, kind="stable")
            texts = b.column(2).to_pylist()
            codes, sizes = word_codes((texts[i] for i in order), cache, False)
            row, doc = row[order], doc[order]
            if len(codes) < window:
                continue
            ends = np.cumsum(sizes)
            of = np.repeat(np.arange(len(doc), dtype=np.int32), sizes)[: len(codes) - window + 1]
            inside = np.arange(len(of)) + window <= ends[of]
            where, low = smallest_anchor(codes, window, anchor)
            edge = window_codes(codes, window)
            at = np.flatnonzero(inside)
            where, low, edge, of = where[at], low[at], edge[at], of[at]
            pos = (at - (ends - sizes)[of]).astype(np.uint32)
            # Equal edges of this batch: documents ascend, so the first is the source of the rest.
            short = edge.astype(np.uint32)
            with np.errstate(over="ignore"):
                o, head = first_of(mixed(low + short.astype(np.uint64) * SPREAD))
            source = np.empty(len(o), np.int64)
            source[o] = o[head]
            older = (doc[of[source]] < doc[of]) & (low[source] == low) & (short[source] == short)
            send = ~older  # a document's own repeats too: a smaller document elsewhere may have the edge
            c = np.flatnonzero(older)
            parts: list[tuple[int, bytes]] = []
            if len(c):
                cl = _claims(row[of[c]], pos[c].astype(np.int64), doc[of[source[c]]], pos[source[c]].astype(np.int64))
                parts.append((int(abs(int(row[0])) % groups), b"C" + np.stack(cl).tobytes()))
            s = np.flatnonzero(send)
            f = np.zeros(len(s), bool)
            f[1:] = (where[s[1:]] == where[s[:-1]]) & (of[s[1:]] == of[s[:-1]]) & (s[1:] == s[:-1] + 1)
            first, n = runs(f)
            p = s[first]
            group = (low[p] % np.uint64(groups)).astype(np.int64)
            o = np.argsort(group, kind="stable")
            present, starts = np.unique(group[o], return_index=True)
            for g, lo, hi in zip(present, starts, np.append(starts[1:], len(o)), strict=True):
                m = o[lo:hi]
                pm, nm = p[m], n[m]
                docs, of_doc = np.unique(of[pm], return_index=True)
                per_doc = np.diff(np.append(of_doc, len(pm))).astype(np.uint32)
                edges = short[np.repeat(pm - np.cumsum(nm) + nm, nm) + np.arange(nm.sum())]
                parts.append((int(g), b"P" + struct.pack("<II", len(docs), len(pm)) + row[docs].tobytes() + doc[docs].tobytes() + per_doc.tobytes() + low[pm].tobytes() + pos[pm].tobytes() + nm.astype(np.uint8).tobytes() + edges.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in parts], pa.int32()), pa.array([x[1] for x in parts], pa.binary())], names=["bucket", "message"])

    return run


def _unpack(m: bytes):
    n_docs, n = struct.unpack_from("<II", m, 1)
    at = 9

    def take(count: int, kind: str) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(m, kind, count, at)
        at += out.nbytes
        return out

    row, doc, per = take(n_docs, "<i8"), take(n_docs, "<i8"), take(n_docs, "<u4")
    low, pos, edges = take(n, "<u8"), take(n, "<u4"), take(n, "u1")
    return np.repeat(row, per), np.repeat(doc, per), low, pos, edges, take(int(edges.sum()), "<u4")


def _match(table: pa.Table) -> pa.Table:
    """One group of anchors: the claims of every edge that a smaller document also has."""
    done, got = [], []
    for m in table.column("message"):
        m = m.as_py()
        if m[:1] == b"C":
            done.append(np.frombuffer(m, np.int64, -1, 1).reshape(5, -1))
        else:
            got.append(_unpack(m))
    if got:
        row, doc, low, pos, n, edge = (np.concatenate(x) for x in zip(*got, strict=True))
        first = np.cumsum(n, dtype=np.int64) - n
        o = np.argsort(doc, kind="stable")  # paths by document: the first of equal edges is the source
        n = n[o].astype(np.int64)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        edge = edge[np.repeat(first[o], n) + step]
        row, doc, low, pos = (np.repeat(x[o], n) for x in (row, doc, low, pos))
        pos = pos.astype(np.int64) + step
        with np.errstate(over="ignore"):
            o, head = first_of(mixed(low + edge.astype(np.uint64) * SPREAD))
        source = np.empty(len(o), np.int64)
        source[o] = o[head]
        c = np.flatnonzero((doc[source] < doc) & (low[source] == low) & (edge[source] == edge))
        done.append(np.stack(_claims(row[c], pos[c], doc[source[c]], pos[source[c]])))
    cols = np.concatenate(done, axis=1)
    return pa.table([pa.array(x) for x in cols], names=_NAMES)


def repeated_runs(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``row, pos, n, src, src_pos``: n windows from word ``pos`` of the document with key ``row``
    (xxhash64 of its doc_id and text) equal those from word ``src_pos`` of document ``src``, whose
    doc_id is smaller: matched paths, none overlapping another, that cover every such window."""
    keyed = docs.where("doc_id is not null and text is not null").select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long"), "text")
    size = keyed.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups = max(shuffle_partitions(docs.sparkSession), -(-size // GROUP_BYTES))
    sent = keyed.mapInArrow(_send(groups, window, anchor), "bucket int, message binary")
    return sent.groupBy("bucket").applyInArrow(_match, CLAIM)


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The same as long spans: paths that follow each other in the document and in the source are one."""
    path = Window.partitionBy("row").orderBy("pos")
    end, src_end = F.lag(F.col("pos") + F.col("n")).over(path), F.lag(F.col("src_pos") + F.col("n")).over(path)
    follows = (end == F.col("pos")) & (src_end == F.col("src_pos")) & (F.lag("src").over(path) == F.col("src"))
    cut = repeated_runs(docs, window, anchor).withColumn("starts", F.when(follows, 0).otherwise(1))
    spans = cut.withColumn("span", F.sum("starts").over(path)).groupBy("row", "span")
    return spans.agg(F.min("pos").alias("pos"), F.sum("n").alias("n"), F.min("src").alias("src"), F.min("src_pos").alias("src_pos")).drop("span")


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for text, pos, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = (text or "").encode().split()
                removed, spans = 0, []
                kept = words
                if pos:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, pos, 1)
                    np.add.at(change, np.asarray(pos) + np.asarray(n) + window - 1, -1)
                    keep = np.cumsum(change[:-1]) == 0
                    removed = int((~keep).sum())
                    kept = list(compress(words, keep))
                    edge = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]).astype(np.int8)))
                    spans = edge.tolist()
                whole = b" ".join(kept)
                for col, v in zip(out, (len(words), removed, hashlib.sha256(whole).hexdigest(), whole.decode(), spans), strict=True):
                    col.append(v)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept, spans`` for each row of ``docs (doc_id, text, ...)``.

    A word goes if a window of ``window`` words over it also starts in a document with a smaller
    doc_id; windows are judged on the input. ``kept``: the other words joined by one space;
    ``spans``: word offsets start, end, start, end, ... of what went (``repeated_spans`` has the
    sources). Null and empty texts have no words; texts of any length are judged whole. A row with a
    null doc_id keeps all its words and is no source. Rows that share a doc_id don't count for each
    other. Empty tables and extra columns are fine.
    """
    claims = repeated_spans(docs, window, anchor).groupBy("row").agg(F.collect_list("pos").alias("pos"), F.collect_list("n").alias("n"))
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("row"))
    joined = keyed.join(claims, "row", "left").select("doc_id", "text", "pos", "n")
    return joined.mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<long>")
