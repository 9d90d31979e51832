"""Ranges of about equal size of a column's values, for ranks and running sums in two levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.sources.scratch import stored

#: Ranges, and the accuracy of their bounds (any bounds give right results; these give even ranges).
PARTS, ACCURACY = 200, 10_000
WANTED = [i / PARTS for i in range(1, PARTS)]


def _cuts(bounds: list[float] | None) -> Column:
    return F.array(*map(F.lit, sorted(set(bounds)))) if bounds else F.array().cast("array<double>")


def with_ranges(df: DataFrame, value: str) -> DataFrame:
    """Adds ``part``, the number of the range of ``value``; equal values share one. The bounds are
    approximate quantiles, found in one pass, whatever the values' scale."""
    bounds = df.agg(F.percentile_approx(value, WANTED, ACCURACY)).first()[0]
    return df.withColumn("part", F.size(F.filter(_cuts(bounds), lambda b: b < F.col(value))))


def exact_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact medians of numeric columns: counts of distinct values, then ranks in two levels, so that
    no task holds all values of a column. None for a column of nulls."""
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols))).alias("x")
    counts = df.select(values).select("x.*").where("v is not null").groupBy("col", "v").agg(F.count("*").alias("n"))
    counts = stored(counts, "median-counts")
    bounds = {r["col"]: r["b"] for r in counts.groupBy("col").agg(F.percentile_approx("v", WANTED, ACCURACY).alias("b")).collect()}  # a row for each column
    cuts = F.create_map(*(x for c, b in bounds.items() for x in (F.lit(c), _cuts(b))))[F.col("col")] if bounds else _cuts(None)
    counts = counts.withColumn("part", F.size(F.filter(cuts, lambda b: b < F.col("v"))))
    parts: dict[str, list] = {c: [] for c in cols}
    for r in counts.groupBy("col", "part").agg(F.sum("n").alias("n")).orderBy("col", "part").collect():  # PARTS rows for each column at most
        parts[r["col"]].append((r["part"], r["n"]))
    wanted = []  # (column, part, rank within the part) of the one or two middle values
    for c, got in parts.items():
        total, before = sum(n for _, n in got), 0
        for part, n in got:
            wanted += [(c, part, r - before) for r in {(total + 1) // 2, total // 2 + 1} if before < r <= before + n]
            before += n
    if not wanted:
        return dict.fromkeys(cols)
    here = counts.where(reduce(lambda a, b: a | b, ((F.col("col") == c) & (F.col("part") == p) for c, p, _ in wanted)))
    here = here.withColumn("upto", F.sum("n").over(Window.partitionBy("col", "part").orderBy("v")))
    found = here.agg(*(F.min(F.when((F.col("col") == c) & (F.col("part") == p) & (F.col("upto") >= r), F.col("v"))).alias(f"m{i}") for i, (c, p, r) in enumerate(wanted))).first()
    middle: dict[str, list[float]] = {c: [found[i] for i, x in enumerate(wanted) if x[0] == c] for c in cols}
    return {c: sum(m) / len(m) if m else None for c, m in middle.items()}
