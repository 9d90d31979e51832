"""Operator 10: mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same number of copies r = target / source size,
which is cut into whole copies and a fraction. Fractions are paired: mass, counted in words,
moves at random from one side to the other until one is whole; a pair's words stay the same and
each document's expected copies stay r. Within a block a document's partner is all smaller
documents together, so that the large ones, which a single partner could not settle, become whole
first; what they cannot take is paired one by one. What is left of a block is one small fraction;
the blocks' residuals meet in further blocks, level by level, until one is left per source. It is
rounded at random, so that a source misses its target by less than one document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.ranges import with_ranges

from .common import WORD, free_name, stored

#: Documents or residuals that one task rounds together.
BLOCK = 1024
#: Row numbers that one row spells out.
STEP = 10_000
MOST_COPIES = 3
#: The repeating weights of the sources.
WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, target, n_docs`` from ``source, size``.

    Resharing an excess by weight until no target is above its cap ends at
    target = min(cap, level * weight) with one level for all. Weights repeat along the sources in
    order, null last: their ranks are those within the sort's partitions and the partitions'
    offsets. The level is found in two steps, by ranges of cap / weight (some 200 rows) and within
    the one range that it falls in, so that no task holds all sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    per = stored(per.orderBy(F.col("source").asc_nulls_last()).withColumn("id", F.monotonically_increasing_id()), "mix-sources")
    part, within = F.shiftright("id", 33).alias("of"), F.col("id").bitwiseAND((1 << 33) - 1)
    counts = per.groupBy(part).agg(F.count("*").alias("m"))  # a row for each of the sort's partitions
    counts = counts.select("of", F.coalesce(F.sum("m").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    per = per.withColumn("of", F.shiftright("id", 33)).join(F.broadcast(counts), "of")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("before") + within) % len(weights) + 1).cast("int")).cast("double")
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    per = stored(with_ranges(per, "ratio").select("source", "source_size", "n_docs", "weight", "cap", "ratio", "part"), "mix-weights")
    level = _level(per)
    return per.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"), "n_docs")


def _level(per: DataFrame) -> float:
    """The level at which the sum of min(cap, level * weight) is the sum of all sizes. Sources with a
    ratio up to it are full; the rest share what is left by weight."""
    ranges = per.groupBy("part").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight"), F.max("ratio").alias("most"), F.sum("source_size").alias("size")).orderBy("part").collect()
    total, full, free = float(sum(r["size"] for r in ranges)), 0.0, sum(r["weight"] for r in ranges)
    for r in ranges:
        if full + r["cap"] + r["most"] * (free - r["weight"]) >= total:
            w = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
            rows = per.where(F.col("part") == r["part"])
            before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0.0))
            rows = rows.withColumn("level", (F.lit(total - full) - before("cap")) / (F.lit(free) - before("weight")))
            # The first source that isn't full fixes the level; later rows, where full caps were taken off in vain, give less.
            found = rows.where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.max("level")).first()[0]
            return found if found is not None else r["most"]
        full, free = full + r["cap"], free - r["weight"]
    return max((r["most"] for r in ranges), default=0.0)


def _uniform(seed: np.ndarray) -> np.ndarray:
    x = seed.astype(np.uint64)
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


def pivot(mass: list[float], size: list[float], draws: list[float]) -> tuple[list[float], int]:
    """Round fractions ``mass`` in (0, 1) of documents of ``size`` words; returns the masses and
    the index of the one that may still be fractional (-1: none)."""
    out, keep = list(mass), -1
    for i, u in enumerate(draws):
        if not 1e-12 < out[i] < 1 - 1e-12:
            out[i] = float(round(out[i]))
            continue
        if keep < 0:
            keep = i
            continue
        a, b, sa, sb = out[keep], out[i], size[keep], size[i]
        up, down = min((1 - a) * sa, b * sb), min(a * sa, (1 - b) * sb)  # words that can move to keep, or from it
        words = up if u * (up + down) < down else -down
        a, b = a + words / sa, b - words / sb
        out[keep], out[i] = a, b
        whole_a, whole_b = not 1e-12 < a < 1 - 1e-12, not 1e-12 < b < 1 - 1e-12
        if whole_a:
            out[keep] = float(round(a))
        if whole_b:
            out[i] = float(round(b))
        keep = -1 if whole_a and whole_b else i if whole_a else keep
    return out, keep


def settle(mass: np.ndarray, size: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Pair each document (sizes descend) with all after it together: it becomes whole, and they
    take or give its words evenly, if they can; if not, it keeps its mass. Returns the masses.

    What was taken from or given to the later ones is scale * mass + shift for each of them.
    """
    out, scale, shift = np.empty(len(mass)), 1.0, 0.0
    later = (size.sum() - np.cumsum(size)).tolist()
    later_mass = ((size * mass).sum() - np.cumsum(size * mass)).tolist()
    for i, (m, s, x) in enumerate(zip(mass.tolist(), size.tolist(), u.tolist(), strict=True)):
        out[i] = a = scale * m + shift
        down = scale * later_mass[i] + shift * later[i]
        up = later[i] - down
        if i == len(mass) - 1 or not 1e-12 < a < 1 - 1e-12 or a * s > up or (1 - a) * s > down:
            continue
        if x < a:
            out[i], part = 1.0, 1 - (1 - a) * s / down
            scale, shift = scale * part, shift * part
        else:
            out[i], part = 0.0, a * s / up
            scale, shift = scale * (1 - part), shift * (1 - part) + part
    return np.clip(out, 0.0, 1.0)


def _round_block(pdf: pd.DataFrame) -> pd.DataFrame:
    # Of two documents the smaller one is mostly settled; going from large to small, what stays is small.
    pdf = pdf.sort_values(["size", "draw", "doc", "row"], ascending=[False, True, True, True], kind="stable", na_position="last", ignore_index=True)
    seeds = pdf["draw"].to_numpy(np.int64).view(np.uint64) + pdf["row"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    u = _uniform(seeds + np.uint64(pdf["level"].iloc[0]) * np.uint64(0xD1B54A32D192ED03))
    size = pdf["size"].to_numpy(np.float64)
    start = settle(pdf["mass"].to_numpy(np.float64), size, u)
    mass, keep = pivot(start.tolist(), size.tolist(), _uniform(seeds + np.uint64(1)).tolist())
    if keep >= 0 and pdf["n_blocks"].iloc[0] == 1:  # the last residual of its source
        mass[keep] = float(u[0] < mass[keep])
        keep = -1
    pdf["mass"] = mass
    pdf["open"] = np.arange(len(pdf)) == keep
    return pdf[COLUMNS + ["open"]]


COLUMNS = ["source", "doc", "size", "source_size", "target", "whole", "row", "draw", "mass"]
SCHEMA = "source string, doc string, size long, source_size long, target double, whole long, row long, draw long, mass double, open boolean"


def _size():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _draw(seed: int):
    """The random number of a row, which stands for its doc_id, source and text as well."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "source", "text")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """``doc_id, source, size, row, draw, source_size, target, copies, taken`` for each row of ``docs``.

    Null and empty texts have size 0; a document without words takes 0 words and no copies beyond
    the whole part of its rate; a null source is a source of its own, the last in order; long texts
    are one document like others; an empty table gives an empty result. Rows alike in doc_id,
    source and text are numbered 0, 1, ... in ``row`` (which of them gets which number doesn't
    matter: they are equal here), so reruns agree whatever the partitions are. Extra columns are
    ignored.
    """
    alike = docs.select(F.col("doc_id").cast("string").alias("doc"), "source", _size().alias("size"), _draw(seed).alias("draw")).groupBy("doc", "source", "size", "draw").agg(F.count("*").alias("n"))
    # Numbers of rows alike come in steps of STEP, so that no row holds an array of all of them.
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    steps = alike.withColumn("step", upto(F.ceil(F.col("n") / STEP))).withColumn("before", F.col("step") * STEP)
    rows = steps.withColumn("i", upto(F.least(F.col("n") - F.col("before"), F.lit(STEP)))).withColumn("row", F.col("before") + F.col("i"))
    sizes = stored(rows.select("doc", "source", "size", "draw", "row"), "mix-sizes")
    targets = stored(source_targets(sizes, weights), "mix-targets").withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sizes.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("whole", F.least(F.floor(rate + 1e-12), F.lit(MOST_COPIES)).cast("long")).withColumn("mass", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    pairs = (F.col("size") > 0) & (F.col("mass") > 1e-12)
    done = rows.where(~pairs).select(*COLUMNS[:-1], F.lit(0.0).alias("mass"))
    todo, level = rows.where(pairs), 0
    while True:
        step = todo.withColumn("n_blocks", F.ceil(F.col("n_docs") / F.lit(block)).cast("long")).withColumn("level", F.lit(level).cast("long"))
        step = step.withColumn("block", F.pmod(F.xxhash64("draw", "row", "level"), F.col("n_blocks")))
        rounded = stored(step.groupBy("source", "block").applyInPandas(_round_block, SCHEMA), f"mix-level{level}")
        done = done.unionByName(rounded.where("not open").select(*COLUMNS))
        left = rounded.where("open").select(*COLUMNS)
        if left.isEmpty():
            break
        counts = stored(left.groupBy("source").agg(F.count("*").alias("n_docs")), "mix-left").withColumnRenamed("source", "of")
        todo, level = left.join(counts, F.col("source").eqNullSafe(F.col("of"))).drop("of"), level + 1
    copies = F.col("whole") + F.col("mass").cast("long")
    return done.select(F.col("doc").cast("long").alias("doc_id"), "source", "size", "row", "draw", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """``docs`` with each row as often as the mix takes it: columns, their order and names unchanged,
    whatever these are. Of rows alike in doc_id, source and text, any may be the one that is taken
    more often. Rows without words stay as often as the whole part of their source's rate says."""
    draw, row, times, copy = (free_name(docs, f"mix_{x}") for x in ("draw", "row", "copies", "copy"))
    mix = stored(mix_sources(docs, weights, seed), "mix").select(F.col("draw").alias(draw), F.col("row").cast("int").alias(row), F.col("copies").alias(times))
    # Only rows alike need numbers; the others meet their copies in one join by ``draw``.
    alike = mix.where(F.col(row) > 0).select(draw).distinct()
    keyed = docs.withColumn(draw, _draw(seed))
    one = keyed.join(mix.join(alike, draw, "left_anti").where(F.col(times) > 0).select(draw, times), draw)
    some = keyed.join(alike, draw, "left_semi").withColumn(row, F.row_number().over(Window.partitionBy(draw).orderBy(draw)) - 1)
    some = some.join(mix.join(alike, draw, "left_semi").where(F.col(times) > 0), [draw, row])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = one.select(*columns, times).unionByName(some.select(*columns, times))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*columns)
