"""Listwise boosted trees for ranking within sessions, with early stopping (M2).

Loss of a session: cross entropy between the softmax of its rows' margins and their shares of gain,
weight * (2^label - 1). A row's gradient is softmax - share, its curvature softmax * (1 - softmax);
a round grows one tree on these, level by level, and a leaf takes the Newton step -G / (H + l2).

Rows are binned once and packed: a packed row holds the rows of a session, or of a part of one for
sessions of more than PART_ROWS rows. Each level of a tree is one pass over the packed table that
adds up gradients by (node, feature, bin). A session in one part needs nothing but its own rows;
the parts of longer ones meet in two sums a session (and nothing else of them does). Gradients are
added as whole numbers, so trees don't depend on how the table is laid out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.exprs import hash_fraction, stable_hash
from sessionloom.sources.scratch import stored

#: Rows of a session that one packed row holds at most.
PART_ROWS = 4096
BINS = 32
#: Rows that bounds of bins are taken from.
SAMPLE_ROWS, SEED = 50_000, 7
#: Rounds after which margins are written, so that a pass never runs through more trees than these.
WRITE_EVERY = 16
#: Gradients are whole multiples of 2^-ONE, sums of softmax terms of 2^-TERM.
ONE, TERM = 24, 32


@dataclass
class Tree:
    """A binary tree in heap order; ``feature`` is -1 in a leaf. Rows of bins up to ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def leaf(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while (inner := self.feature[at] >= 0).any():
            right = bins[rows, np.maximum(self.feature[at], 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at


@dataclass
class BoostedRanker:
    """Trees over binned features. ``history``: a dict of metrics for each round looked at;
    ``gains``: the loss that each feature's splits took away."""

    bounds: list[list[float]]
    rate: float
    trees: list[Tree] = field(default_factory=list)
    gains: np.ndarray | None = None
    history: list[dict] = field(default_factory=list)

    def bin(self, x: np.ndarray) -> np.ndarray:
        """Numbers of bins, a byte each; missing values are in the lowest."""
        out = np.zeros(x.shape, np.uint8)
        for j, cuts in enumerate(self.bounds):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(cuts, x[:, j], side="left"))
        return out

    def margins(self, bins: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        out = np.zeros(len(bins))
        for t in self.trees[first:last]:
            out += self.rate * t.value[t.nodes(bins)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``, the margin of the vector column ``features``."""
        from pyspark.ml.functions import vector_to_array

        @F.pandas_udf("double")
        def margin(x):
            import pandas as pd

            return pd.Series(self.margins(self.bin(np.stack(x.to_numpy()).astype(np.float64))) if len(x) else np.zeros(0))

        return df.withColumn("prediction", margin(vector_to_array("features")))

    @property
    def featureImportances(self):  # noqa: N802 - as Spark's tree models call it
        from pyspark.ml.linalg import Vectors

        total = self.gains.sum()
        return Vectors.dense(self.gains / total if total > 0 else self.gains)


def ranking_metrics(scores: DataFrame, k: int = 20, keys: tuple[str, ...] = ("session",), by: tuple[str, ...] = ()) -> DataFrame:
    """``ndcg, map, sessions`` (for each ``by``): means over the sessions that have a positive row.

    NDCG@k with gains 2^label - 1 and discounts log2(place + 1) against the best order of all the
    session's rows; MAP@k with precision at each hit of the first k over the lesser of k and the
    session's hits. Order is by score, then candidate_aid. Sessions are cut to their first k rows,
    and to k positives for the best order, before these meet.
    """
    key = [*by, *keys]
    gain = F.pow(F.lit(2.0), F.col("label")) - 1
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "candidate_aid"))
    upto = Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = scores.select(*key, "label", "score", "candidate_aid").withColumn("place", place).where(F.col("place") <= k)
    first = first.withColumn("found", F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).over(upto))
    got = first.groupBy(*key).agg(
        F.sum(gain / F.log2(F.col("place") + 1.0)).alias("dcg"),
        F.sum(F.when(F.col("label") > 0, F.col("found") / F.col("place")).otherwise(0.0)).alias("precision"),
    )
    positive = scores.where("label > 0").select(*key, "label", "candidate_aid")
    order = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("label"), "candidate_aid"))
    best = positive.withColumn("place", order).where(F.col("place") <= k)
    best = best.groupBy(*key).agg(F.sum(gain / F.log2(F.col("place") + 1.0)).alias("ideal"), F.count("*").alias("hits"))
    each = got.join(best, key)
    return each.groupBy(*by).agg(F.avg(F.col("dcg") / F.col("ideal")).alias("ndcg"), F.avg(F.col("precision") / F.col("hits")).alias("map"), F.count("*").alias("sessions"))


def feature_bounds(rows: DataFrame, bins: int = BINS, sample_rows: int = SAMPLE_ROWS) -> list[list[float]]:
    """Up to ``bins`` - 1 cuts of each entry of the array column ``x``: exact quantiles of about
    ``sample_rows`` rows, those with the smallest hashes, so that the layout doesn't matter."""
    n, dims = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n or not dims:
        return []
    some = rows.where(hash_fraction(*(c for c in rows.columns if c not in ("x", "weight", "label")), seed=SEED) < sample_rows / n)
    wanted = [i / bins for i in range(1, bins)]
    values = [F.when(~F.isnan(F.get("x", F.lit(j))), F.get("x", F.lit(j))) for j in range(dims)]
    got = some.agg(*(F.percentile(v, wanted).alias(f"q{j}") for j, v in enumerate(values))).first()
    return [sorted(set(q or [])) for q in got]


def _binned(model: BoostedRanker):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(b.num_columns - 1)
            x = x.flatten().to_numpy().reshape(b.num_rows, len(model.bounds)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([r.tobytes() for r in model.bin(x)], pa.binary())], names=[*b.schema.names[:-1], "bins"])

    return run


def pack(rows: DataFrame, model: BoostedRanker, keys: tuple[str, ...], part_rows: int = PART_ROWS) -> DataFrame:
    """``key, part, parts, aids, gains, bins, margins`` from ``keys..., candidate_aid, label, weight,
    x``: a row for each session, or part of one. Sessions without a positive row or with a single
    row teach nothing and are left out."""
    gain = (F.col("weight") * (F.pow(F.lit(2.0), F.col("label")) - 1)).alias("gain")
    flat = rows.select(F.to_json(F.struct(*keys)).alias("key"), F.col("candidate_aid").cast("long"), gain, "x")
    flat = stored(flat.mapInArrow(_binned(model), "key string, candidate_aid long, gain double, bins binary"), "boost-bins")
    sizes = flat.groupBy("key").agg(F.count("*").alias("n"), F.sum("gain").alias("all")).where("n > 1 and all > 0")
    dealt = flat.join(sizes.select("key", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"), "all"), "key")
    dealt = dealt.withColumn("part", F.pmod(stable_hash("candidate_aid"), F.col("parts")).cast("int"))
    got = dealt.groupBy("key", "part", "parts", "all").agg(F.array_sort(F.collect_list(F.struct("candidate_aid", "gain", "bins"))).alias("r"))
    take = lambda c: F.transform("r", lambda s: s[c])
    none = F.transform("r", lambda s: F.lit(0.0))
    return got.select("key", "part", "parts", take("candidate_aid").alias("aids"), F.transform("r", lambda s: s["gain"] / F.col("all")).alias("shares"), take("bins").alias("bins"), none.alias("margins"))


_PACKED = "key string, part int, parts int, aids array<bigint>, shares array<double>, bins array<binary>, margins array<double>"


def _groups(b: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shares, bins and margins of all rows of a batch of packed rows, and where each packed row begins."""
    col = {n: b.column(n) for n in b.schema.names}
    sizes = np.diff(col["shares"].offsets.to_numpy())
    bins = np.frombuffer(b"".join(col["bins"].flatten().to_pylist()), np.uint8).reshape(-1, dims)
    return col["shares"].flatten().to_numpy(), bins, col["margins"].flatten().to_numpy(), np.cumsum(sizes) - sizes


def _with_margins(model: BoostedRanker, since: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, bins, margins, _ = _groups(b, len(model.bounds))
                at = b.schema.get_field_index("margins")
                new = pa.ListArray.from_arrays(b.column("margins").offsets, pa.array(margins + model.margins(bins, since)))
                yield pa.RecordBatch.from_arrays([*b.columns[:at], new, *b.columns[at + 1 :]], names=b.schema.names)

    return run


def _terms(model: BoostedRanker, since: int):
    """Of parts of split sessions: largest margin and sum of exp(margin - largest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, bins, margins, at = _groups(b, len(model.bounds))
                s = margins + model.margins(bins, since)
                top = np.maximum.reduceat(s, at)
                size = np.diff(np.append(at, len(s)))
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(top), pa.array(np.add.reduceat(np.exp(s - np.repeat(top, size)), at))], names=["key", "top", "terms"])

    return run


def _histogram(model: BoostedRanker, since: int, tree: Tree):
    """Sums of gradient, curvature and rows of each (open node, feature, bin)."""
    dims = len(model.bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(tree.feature)
        total = np.zeros((3, n * dims * 256), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            shares, bins, margins, at = _groups(b, dims)
            s = margins + model.margins(bins, since)
            size = np.diff(np.append(at, len(s)))
            top, terms = np.maximum.reduceat(s, at), None
            if (split := b.column("top").is_valid().to_numpy(zero_copy_only=False)).any():
                top = np.where(split, b.column("top").fill_null(0).to_numpy(), top)
            e = np.exp(s - np.repeat(top, size))
            terms = np.where(split, b.column("terms").fill_null(0).to_numpy(), np.add.reduceat(e, at))
            p = e / np.repeat(terms, size)
            g = np.rint((p - shares) * 2.0**ONE).astype(np.int64)
            h = np.rint(p * (1 - p) * 2.0**ONE).astype(np.int64)
            base = tree.nodes(bins) * dims
            for j in range(dims):
                cell = (base + j) * 256 + bins[:, j]
                for row, value in zip(total, (g, h, np.ones(len(g), np.int64)), strict=True):
                    np.add.at(row, cell, value)
        at = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(t[at]) for t in total)], names=["cell", "g", "h", "n"])

    return run


def _grow(packed: DataFrame, model: BoostedRanker, since: int, depth: int, l2: float, least_rows: int, split_sessions: bool) -> Tree:
    """One tree on the gradients at the model's margins. The driver sees sums by (node, feature, bin)."""
    dims, ready = len(model.bounds), packed
    if split_sessions:
        each = packed.where("parts > 1").mapInArrow(_terms(model, since), "key string, top double, terms double")
        tops = each.groupBy("key").agg(F.max("top").alias("top"))
        whole = F.round(F.col("terms") * F.exp(F.col("part_top") - F.col("top")) * 2.0**TERM).cast("decimal(38,0)")
        sums = each.withColumnRenamed("top", "part_top").join(tops, "key").groupBy("key", "top").agg((F.sum(whole).cast("double") / 2.0**TERM).alias("terms"))
        sums = stored(sums, "boost-terms")
        long = packed.where("parts > 1").join(sums, "key")
        ready = packed.where("parts = 1").withColumns({"top": F.lit(None).cast("double"), "terms": F.lit(None).cast("double")}).unionByName(long)
    else:
        ready = packed.withColumns({"top": F.lit(None).cast("double"), "terms": F.lit(None).cast("double")})
    tree, open_nodes = Tree.leaf(depth), [0]
    while open_nodes:
        sums = ready.mapInArrow(_histogram(model, since, tree), "cell long, g long, h long, n long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
        total = np.zeros((3, len(tree.feature) * dims * 256))
        for r in sums.collect():  # nodes * features * bins rows at most, whatever the input
            total[:, r["cell"]] = r["g"] / 2.0**ONE, r["h"] / 2.0**ONE, r["n"]
        total = total.reshape(3, len(tree.feature), dims, 256)
        after = []
        for node in open_nodes:
            g, h, n = total[:, node]
            whole = g[0].sum(), h[0].sum(), n[0].sum()
            if not node:
                tree.value[0] = -whole[0] / (whole[1] + l2)
            gl, hl, nl = (np.cumsum(v, 1) for v in (g, h, n))
            gain = (gl**2 / (hl + l2) + (whole[0] - gl) ** 2 / (whole[1] - hl + l2) - whole[0] ** 2 / (whole[1] + l2)) / 2
            gain[(nl < least_rows) | (whole[2] - nl < least_rows)] = 0
            j, cut = np.unravel_index(np.argmax(np.round(gain, 9)), gain.shape)
            if gain[j, cut] > 1e-9:
                tree.feature[node], tree.cut[node] = j, cut
                model.gains[j] += gain[j, cut]
                left = gl[j, cut], hl[j, cut]
                for child, g_child, h_child in ((2 * node + 1, *left), (2 * node + 2, whole[0] - left[0], whole[1] - left[1])):
                    tree.value[child] = -g_child / (h_child + l2)
                    if 2 * child + 2 < len(tree.feature):
                        after.append(child)
        open_nodes = after
    return tree


def _prefix_scores(model: BoostedRanker, first: int, rounds: list[int]):
    """``round, key, candidate_aid, label, score`` after each of ``rounds``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(-1, len(model.bounds))
                s, done = model.margins(bins, 0, first), first
                for r in rounds:
                    s, done = s + model.margins(bins, done, r), r
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, r, np.int32)), b.column("key"), b.column("candidate_aid"), b.column("label"), pa.array(s)], names=["round", "key", "candidate_aid", "label", "score"])

    return run


@dataclass
class Prepared:
    """Training rows, packed, and held-out rows, binned, that any number of models may be trained on."""

    bounds: list[list[float]]
    packed: DataFrame
    held: DataFrame | None
    empty: bool
    split_sessions: bool

    def model(self, rate: float) -> BoostedRanker:
        return BoostedRanker(self.bounds, rate, gains=np.zeros(len(self.bounds)))


def prepare_boosting(df: DataFrame, validation: DataFrame | None = None, bins: int = BINS, part_rows: int = PART_ROWS, keys: tuple[str, ...] | None = None) -> Prepared:
    """Bins and packs ``session, candidate_aid, label, weight, features`` once, for ``boost``."""
    from pyspark.ml.functions import vector_to_array

    keys = keys or tuple(c for c in ("event", "session") if c in df.columns)
    flat = lambda d: d.select(*keys, "candidate_aid", F.col("label").cast("double").alias("label"), (F.col("weight") if "weight" in d.columns else F.lit(1.0)).cast("double").alias("weight"), vector_to_array("features").alias("x"))
    rows = flat(df)
    model = BoostedRanker(feature_bounds(rows, bins), 1.0)
    packed = stored(pack(rows, model, keys, part_rows), "boost-packed")
    if packed.isEmpty():
        return Prepared(model.bounds, packed, None, True, False)
    held = None
    if validation is not None:
        held = flat(validation).select(F.to_json(F.struct(*keys)).alias("key"), F.col("candidate_aid").cast("long"), "label", "x")
        held = stored(held.mapInArrow(_binned(model), "key string, candidate_aid long, label double, bins binary"), "boost-held")
    return Prepared(model.bounds, packed, held, False, not packed.where("parts > 1").isEmpty())


def boost(
    ready: Prepared, model: BoostedRanker, rounds: int, depth: int = 4, l2: float = 1.0, least_rows: int = 20,
    metric: str = "ndcg", k: int = 20, patience: int = 10, look_every: int = 5,
) -> tuple[float, int]:
    """Adds trees to ``model`` until it has ``rounds``, or its metric hasn't risen for ``patience``
    rounds. Going on later adds the trees that going on at once adds. Returns the best value so far
    and its number of trees (-inf and 0 without held-out rows)."""
    best = max([(-np.inf, 0), *((x[metric], -x["round"]) for x in model.history)])
    if ready.empty or (model.history and len(model.trees) + best[1] >= patience):
        return best[0], -best[1]
    packed, since = ready.packed, len(model.trees)
    if since:
        packed = stored(packed.mapInArrow(_with_margins(model, 0), _PACKED), "boost-packed")
    looked = since
    for r in range(since + 1, rounds + 1):
        if r - 1 - since == WRITE_EVERY:
            packed = stored(packed.mapInArrow(_with_margins(model, since), _PACKED), "boost-packed")
            since = r - 1
        tree = _grow(packed, model, since, depth, l2, least_rows, ready.split_sessions)
        model.trees.append(tree)
        if ready.held is not None and (r - looked == look_every or r == rounds):
            wanted = list(range(looked + 1, r + 1))
            scores = ready.held.mapInArrow(_prefix_scores(model, looked, wanted), "round int, key string, candidate_aid long, label double, score double")
            got = ranking_metrics(scores.withColumn("score", F.round("score", 9)), k, ("key",), ("round",)).orderBy("round").collect()
            model.history += [{"round": x["round"], "ndcg": x["ndcg"], "map": x["map"]} for x in got]
            looked = r
            best = max([best, *((x[metric], -x["round"]) for x in got)])
            if got and r + best[1] >= patience:
                break
        if tree.feature[0] < 0 and not tree.value.any():
            break
    return best[0], -best[1]


def train_boosted(
    df: DataFrame, rounds: int = 50, depth: int = 4, rate: float = 0.1, l2: float = 1.0, least_rows: int = 20, bins: int = BINS,
    validation: DataFrame | None = None, metric: str = "ndcg", k: int = 20, patience: int = 10, look_every: int = 5,
    part_rows: int = PART_ROWS, keys: tuple[str, ...] | None = None,
) -> BoostedRanker:
    """M2: a listwise ranker from ``session, candidate_aid, label, weight, features``.

    With ``validation`` (same columns) both metrics are taken every ``look_every`` rounds, for all
    rounds since in one job; training ends when ``metric`` (ndcg or map, at ``k``) hasn't risen for
    ``patience`` rounds, and the trees after its best round are dropped. Sessions without positives
    teach nothing; without any, or without rows, the model has no trees and scores 0. Null
    candidate_aids and features are an error of the caller; NaN features go to the lowest bin.
    """
    ready = prepare_boosting(df, validation, bins, part_rows, keys)
    model = ready.model(rate)
    _, n = boost(ready, model, rounds, depth, l2, least_rows, metric, k, patience, look_every)
    if model.history:
        model.trees = model.trees[:n]
    return model
