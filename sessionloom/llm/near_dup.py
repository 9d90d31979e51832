"""Operator 6: near-duplicate documents by HyperMinHash.

A document's set of word shingles becomes 512 registers of one byte: the hash's first 9 bits
choose the register, and of the smallest remaining hash the register keeps the number of leading
zeros (4 bits) and the 4 bits after the leading one. Bands of six registers are the search keys:
at a similarity of 0.8 a pair shares none of 42 bands with probability (1 - 0.8^6)^42 < 3e-6.

Equal sets collapse into classes first; only their representatives go on. Within a key,
documents are compared with a hub (the member that shares most keys with others),
and a later pair is only compared while its two documents are in different components, so that groups
of thousands of copies cost a few comparisons for each document. Small keys compare all pairs.
What then is in other components than most of its key is compared with all of these, in blocks
of signatures: a task estimates the pairs of two blocks and returns only likely ones.
Pairs pass the collision-corrected estimate of the similarity, then the exact test on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import WordCodes, components, discard, free_name, slices, stored, window_codes, word_codes

REGISTERS, BAND, BANDS = 512, 6, 42
EMPTY = 0xFF
ZEROS, MANTISSA = 15, 16  # most leading zeros that are told apart, values of the mantissa
#: Keys with at most so many classes compare all their pairs at once.
SMALL_KEY = 6
#: Estimates below the wanted similarity by this much are dropped: 4.5 standard deviations at 512 registers.
SLACK = 0.08
#: Classes of a key that one task compares with as many others.
BLOCK = 512


def shingles(codes: np.ndarray, sizes: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    windows, at = window_codes(codes, k), 0
    for n in sizes:
        if n >= k:
            yield np.unique(windows[at : at + n - k + 1])
        else:  # the whole sequence as one; none without words
            yield window_codes(codes[at : at + n], int(n)) if n else np.zeros(0, np.uint64)
        at += n


def registers(hashes: np.ndarray) -> np.ndarray:
    """Registers of sorted distinct hashes."""
    bounds = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(55)
    first = np.searchsorted(hashes, bounds)
    end = np.append(first[1:], len(hashes))
    rest = hashes[np.minimum(first, len(hashes) - 1)] << np.uint64(9)
    mantissa, exponent = np.frexp(np.maximum(rest.astype(np.float64), 1.0))
    value = np.minimum(64 - exponent, ZEROS) * MANTISSA + np.minimum((mantissa * 2 - 1) * MANTISSA, MANTISSA - 1).astype(np.int64)
    return np.where(first < end, np.minimum(value, EMPTY - 1), EMPTY).astype(np.uint8)


#: Where an empty register looks for a value, one row of places after another.
LOOK = np.random.default_rng(5).integers(0, REGISTERS, (256, REGISTERS))


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers with the empty ones filled from others, each along its own fixed random places,
    so that every register of a short document is a sample of its set as well."""
    out, empty = regs.copy(), np.flatnonzero(regs == EMPTY)
    for look in LOOK:
        if not len(empty):
            return out
        out[empty] = regs[look[empty]]
        empty = empty[out[empty] == EMPTY]
    out[empty] = regs[regs != EMPTY].min()
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    bands = filled(regs)[: BANDS * BAND].reshape(BANDS, BAND)
    return np.array([xxhash.xxh3_64_intdigest(b.tobytes(), seed=i) for i, b in enumerate(bands)], np.uint64).view(np.int64)


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCodes()
        for b in slices(batches):
            n_sh, digest, sig = [], [], []
            for s in shingles(*word_codes(b.column(1).to_pylist(), cache, True), k):
                n_sh.append(len(s))
                digest.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                sig.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n_sh, pa.int64()), pa.array(digest, pa.string()), pa.array(sig, pa.binary())], names=["doc_id", "row_key", "n_shingles", "digest", "sig"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCodes()
        for b in slices(batches):
            sets = [s.view(np.int64) for s in shingles(*word_codes(b.column(1).to_pylist(), cache, True), k)]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            digests = [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["digest", "shingles"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [band_keys(np.frombuffer(s, np.uint8)) for s in b.column(2).to_pylist()]
        if keys:
            n = BANDS
            cls, size = (np.repeat(b.column(i).to_numpy(zero_copy_only=False), n) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(size), pa.array(np.concatenate(keys))], names=["cls", "size", "key"])


def collision_rate(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Chance that a register of two disjoint sets of these sizes agrees by accident."""
    la, lb = n_a[:, None] / REGISTERS, n_b[:, None] / REGISTERS
    z = np.arange(ZEROS + 1)[None, :]

    def level(lam):  # P(the smallest hash has z leading zeros, or at least the most told apart)
        below = np.where(z < ZEROS, np.exp(-lam * 2.0 ** -(z + 1)), 1.0)
        return below - np.exp(-lam * 2.0**-z)

    return (level(la) * level(lb)).sum(1) / MANTISSA


def estimate(sig_a: np.ndarray, sig_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimate from registers (a row of registers each)."""
    used = ((sig_a != EMPTY) | (sig_b != EMPTY)).sum(1)
    same = ((sig_a == sig_b) & (sig_a != EMPTY)).sum(1)
    by_chance = collision_rate(n_a, n_b) * used
    return np.clip((same - by_chance) / np.maximum(used - by_chance, 1e-9), 0, 1)


@F.pandas_udf(DoubleType())
def _estimate(sig_a: pd.Series, sig_b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    a, b = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, REGISTERS) for x in (sig_a, sig_b))
    return pd.Series(estimate(a, b, n_a.to_numpy(float), n_b.to_numpy(float)))


def near_duplicates(docs: DataFrame, k: int = 4, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs (doc_id, text, ...)``.

    Words are lower-cased in A-Z. Two documents are linked if ``similarity[1] * |A and B| >=
    similarity[0] * |A or B|`` for their sets of k-word shingles (fewer words: the whole
    sequence as one). Documents without words or text, and rows with a null doc_id, are linked
    with nothing (component_id = doc_id). Texts of any length are compared whole; repeated rows give
    repeated rows. Rows that share a doc_id are judged each by its own text. An empty table gives an empty result; extra columns are ignored.
    """
    judged = _judged(docs, k, similarity)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id"))
    return judged.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def _judged(docs: DataFrame, k: int, similarity: tuple[int, int]) -> DataFrame:
    """``doc_id, row_key, n_shingles, component, of_class`` of each row: its key (xxhash64 of doc_id
    and text), its component (null: linked with nothing) and the component's smallest doc_id."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("row_key"))
    sketch = stored(docs.mapInArrow(_sketch(k), "doc_id long, row_key long, n_shingles long, digest string, sig binary"), "near-sketch")
    known = sketch.where("digest is not null and doc_id is not null")
    classes = known.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "near-classes")
    links = _search(docs.drop("row_key"), classes, k, similarity)
    parts = components(links, "near").withColumnRenamed("node", "cls")
    of = classes.select("digest", "cls", "rep").join(parts, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = of.groupBy("component").agg(F.min("rep").alias("of_class"))
    of = stored(of.join(least, "component").select("digest", "component", "of_class"), "near-of")
    rows = sketch.select("doc_id", "row_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    return rows.join(of, "digest", "left").drop("digest")


def _ordered(x: str, y: str) -> tuple:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _search(docs: DataFrame, classes: DataFrame, k: int, similarity: tuple[int, int]) -> DataFrame:
    """Links between classes that give the right components: of each class to its component after
    the hub comparisons, and the verified links that join such components."""
    bands = stored(classes.select("cls", "n_shingles", "sig").mapInArrow(_bands, "cls long, size long, key long"), "near-bands")
    counts = bands.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    was, bands = bands, stored(bands.join(counts, "key"), "near-shared")
    discard(was)
    small = bands.where(F.col("members") <= SMALL_KEY)
    large = bands.where(F.col("members") > SMALL_KEY)
    scores = large.groupBy("cls").agg(F.sum("members").alias("score"))
    large = stored(large.join(scores, "cls"), "near-large")
    hubs = large.groupBy("key").agg(F.max_by(F.struct(F.col("cls").alias("hub"), F.col("size").alias("hub_size")), F.struct("score", "cls")).alias("h")).select("key", "h.*")
    star = large.join(hubs, "key").where((F.col("cls") != F.col("hub")) & _sizes("size", "hub_size", similarity)).select(*_ordered("cls", "hub"))
    every = small.select("key", F.col("cls").alias("a"), "size").join(small.select("key", F.col("cls").alias("b"), F.col("size").alias("size_b")), "key")
    every = every.where((F.col("a") < F.col("b")) & _sizes("size", "size_b", similarity)).select("a", "b")
    fresh = stored(every.unionByName(star).distinct(), "near-pairs")
    discard(bands)
    tested, links = fresh, stored(_verified(docs, fresh, classes, k, similarity), "near-links")
    part = stored(components(links, "near-first"), "near-parts")
    now = large.join(part.select(F.col("node").alias("cls"), F.col("component").alias("comp")), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    # All likely pairs between components: one round is enough, as components only merge afterwards.
    fresh = stored(_next_pairs(stored(now, "near-now"), classes, similarity).join(tested, ["a", "b"], "left_anti"), "near-pairs")
    stars = part.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return stars.unionByName(stored(_exact(docs, fresh, classes, k, similarity), "near-links"))


def _sizes(x: str, y: str, similarity: tuple[int, int]):
    """Whether sets of these sizes can be similar: |A and B| <= the smaller, |A or B| >= the larger."""
    return F.least(x, y) * similarity[1] >= F.greatest(x, y) * similarity[0]


def _compare(similarity: tuple[int, int]):
    """Likely pairs of two blocks of one key that are in different components."""
    num, den = similarity

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cls, comp, size, side = (pdf[c].to_numpy() for c in ("cls", "comp", "size", "side"))
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(-1, REGISTERS)
        differ = (comp[:, None] != comp[None, :]) & (cls[:, None] < cls[None, :])
        if pdf["lo"].iloc[0] != pdf["hi"].iloc[0]:  # two blocks: pairs within one are another task's
            differ &= side[:, None] != side[None, :]
        differ &= np.minimum(size[:, None], size[None, :]) * den >= np.maximum(size[:, None], size[None, :]) * num
        a, b = np.nonzero(differ)
        keep = []
        for i in range(0, len(a), 20_000):
            x, y = a[i : i + 20_000], b[i : i + 20_000]
            keep.append(estimate(sig[x], sig[y], size[x].astype(float), size[y].astype(float)) >= num / den - SLACK)
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        a, b = a[keep], b[keep]
        if len(a):  # the pair is another key's if an earlier band is common
            bands = np.stack([filled(r)[: BANDS * BAND] for r in sig]).reshape(-1, BANDS, BAND)
            own = pdf["key"].iloc[0]
            first = (bands[a] == bands[b]).all(2).argmax(1)
            mine = np.array([band_keys(sig[i])[f] == own for i, f in zip(a, first, strict=True)], bool)
            a, b = a[mine], b[mine]
        return pd.DataFrame({"a": cls[a], "b": cls[b], "n_a": size[a], "n_b": size[b]})

    return run


def _next_pairs(now: DataFrame, classes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Likely pairs of one key that are in different components.

    Members of a key's largest component (major) are never compared with each other: blocks of the
    others meet each other (hi from 0) and the major's blocks (hi from -1 down), so a large group
    that is one component already costs only its leftovers times its members.
    """
    comps = now.groupBy("key", "comp").agg(F.count("*").alias("n"))
    parts = comps.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("comp", F.struct("n", "comp")).alias("major"), F.max("n").alias("n_major")).where("n > n_major")
    blocks = {"few": F.ceil((F.col("n") - F.col("n_major")) / BLOCK), "many": F.ceil(F.col("n_major") / BLOCK)}
    rows = now.join(parts, "key").withColumns({k: b.cast("int") for k, b in blocks.items()})
    mine = lambda c: F.pmod(F.xxhash64("cls"), c).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    place = lambda df, lo, hi, side: df.select("key", lo.alias("lo"), hi.alias("hi"), side.alias("side"), "cls", "size", "comp")
    few = rows.where("comp <> major").withColumn("mine", mine("few"))
    many = rows.where("comp = major").withColumn("mine", mine("many"))
    among = place(few.withColumn("other", upto("few")), F.least("mine", "other"), F.greatest("mine", "other"), F.col("mine"))
    hosts = place(few.withColumn("other", upto("many")), F.col("mine"), -1 - F.col("other"), F.lit(0))
    guests = place(many.withColumn("other", upto("few")), F.col("other"), -1 - F.col("mine"), F.lit(1))
    dealt = among.unionByName(hosts).unionByName(guests)
    return dealt.join(classes.select("cls", "sig"), "cls").groupBy("key", "lo", "hi").applyInPandas(_compare(similarity), "a long, b long, n_a long, n_b long").distinct()


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, similarity: tuple[int, int]) -> DataFrame:
    """Pairs that pass the estimate, then the exact test."""
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    wide = pairs.join(side("a"), "a").join(side("b"), "b")
    likely = wide.withColumn("j", _estimate("sig_a", "sig_b", "n_a", "n_b")).where(F.col("j") >= similarity[0] / similarity[1] - SLACK)
    return _exact(docs, stored(likely.select("a", "b", "n_a", "n_b"), "near-likely"), classes, k, similarity)


def _exact(docs: DataFrame, likely: DataFrame, classes: DataFrame, k: int, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (with their set sizes) that pass the exact test on full sets."""
    num, den = similarity
    nodes = likely.select(F.col("a").alias("cls")).union(likely.select("b")).distinct()
    wanted = classes.join(nodes, "cls").select("cls", "rep", "digest")
    texts = docs.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets(k), "digest string, shingles array<long>").join(wanted, "digest").dropDuplicates(["cls"]).select("cls", "shingles")
    sets = stored(sets, "near-sets")
    both = likely.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("s_a")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("s_b")), "b")
    inter = F.size(F.array_intersect("s_a", "s_b"))
    return both.where(inter * den >= (F.col("n_a") + F.col("n_b") - inter) * num).select("a", "b")


def keep_one(docs: DataFrame, k: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest doc_id (of
    rows that share it, the one with the least hash of its text; of equal rows, one). Columns, their
    order and names unchanged, whatever these are. Rows without words or text, and rows with a null
    doc_id, all stay; long texts are compared whole; an empty table stays empty."""
    key = free_name(docs, "near_key")
    judged = stored(_judged(docs, k, similarity).where("component is not null").select("doc_id", "row_key", "component"), "near-judged")
    first = judged.groupBy("component").agg(F.min(F.struct("doc_id", "row_key")).alias("x")).select("component", F.col("x.row_key").alias("first_key"))
    rows = judged.groupBy("component", "row_key").agg(F.count("*").alias("n"))
    rows = stored(rows.join(first, "component").select(F.col("row_key").alias(key), (F.col("row_key") == F.col("first_key")).alias("first"), "n"), "near-keys")
    again = free_name(docs, "near_again")
    # One join by key decides on all rows; only keys of equal rows are grouped after it.
    decided = rows.where("not first or n > 1").select(key, F.when(F.col("first"), 1).otherwise(0).alias(again))
    judged_docs = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(decided, key, "left")
    out = judged_docs.where(F.col(again).isNull()).unionByName(judged_docs.where(F.col(again) == 1).dropDuplicates([key]))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
