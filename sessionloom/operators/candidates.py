"""Candidate rows (R1-R8). Long candidates: ``session, event, strategy, candidate_aid, rank``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.exprs import EVENTS, hash_fraction, stable_hash
from sessionloom.sources.scratch import stored


def candidates_long(lists: DataFrame, strategy: str) -> DataFrame:
    """List form (``session "<id>_<event>", labels, ranks``) to long rows."""
    parts = F.split("session", "_")
    zipped = lists.select(parts[0].cast("long").alias("session"), parts[1].alias("event"), F.explode(F.arrays_zip("labels", "ranks")).alias("x"))
    return zipped.select("session", "event", F.lit(strategy).alias("strategy"), F.col("x.labels").alias("candidate_aid"), F.col("x.ranks").alias("rank"))


def candidate_rows(long: DataFrame, strategies: list[str], parts: int | None = None) -> DataFrame:
    """R2: one row per (event, session, aid) with ``retrieval_<s>`` and ``rank_<s>``: the smallest
    rank in s, else the length of the session's list of s. Lists without ``event`` serve all events;
    ``label_candidates`` gives them a row for each. Rows are dealt by session once (into ``parts``, by
    default as many as Spark chooses), and later steps by session find them there."""
    key = [c for c in ("event", "session") if c in long.columns]
    flags = [F.max(F.when(F.col("strategy") == s, 1).otherwise(0)).alias(f"retrieval_{s}") for s in strategies]
    ranks = [F.min(F.when(F.col("strategy") == s, F.col("rank"))).alias(f"rank_{s}") for s in strategies]
    rows = long.repartition(*([parts] if parts else []), "session").groupBy(*key, "candidate_aid").agg(*flags, *ranks, *(F.count_if(F.col("strategy") == s).alias(f"m_{s}") for s in strategies))
    w = Window.partitionBy(*key)
    fill = {f"rank_{s}": F.coalesce(f"rank_{s}", F.sum(f"m_{s}").over(w)).cast("int") for s in strategies}
    return rows.withColumns(fill).drop(*(f"m_{s}" for s in strategies))


def _with_truths(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """The rows with their session's truths, a list ``_<event>`` for each event: joined by session
    alone, so that rows which lie by session aren't shuffled for it."""
    of = lambda e: F.flatten(F.collect_list(F.when(F.col("type") == e, F.col("ground_truth"))))
    lists = truth.groupBy("session").agg(*(of(e).alias(f"_{e}") for e in EVENTS.values()))
    return rows.join(lists.hint("merge"), "session", "left")


def _is_true(event: str) -> Column:
    return F.coalesce(F.array_contains(f"_{event}", F.col("candidate_aid")), F.lit(False)).cast("int")


def _is_true_of_own() -> Column:
    """For rows that name their event."""
    out = F.lit(0)
    for e in EVENTS.values():
        out = F.when(F.col("event") == e, _is_true(e)).otherwise(out)
    return out


def label_candidates(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """``label`` 1 if the aid is in the truth of (session, event). Rows without ``event`` are
    labelled for all events in one join and then get a row for each."""
    wide = _with_truths(rows, truth)
    if "event" in rows.columns:
        return wide.select(*rows.columns, _is_true_of_own().alias("label"))
    each = F.explode(F.array(*(F.struct(F.lit(e).alias("event"), _is_true(e).alias("label")) for e in EVENTS.values()))).alias("_x")
    return wide.select(*rows.columns, each).select("_x.event", *rows.columns, "_x.label")


def drop_unlabelled_sessions(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """Sessions with truth for the event."""
    has = truth.groupBy(F.col("session").alias("_session")).agg(F.collect_set("type").alias("_types"))
    return rows.join(has.hint("merge"), (F.col("session") == F.col("_session")) & F.array_contains("_types", F.col("event")), "left_semi")


def drop_zero_hit_sessions(rows: DataFrame) -> DataFrame:
    """Sessions with a hit for the event."""
    return rows.withColumn("any", F.max("label").over(Window.partitionBy("event", "session"))).where("any = 1").drop("any")


def downsample_negatives(rows: DataFrame, ratio: float = 10, seed: int = 0, exact: bool = False) -> DataFrame:
    """All positives and ``ratio`` negatives for each: by default by a hash threshold (right in
    expectation); ``exact`` takes the first by hash, found in two levels. The rows are written once
    and read for the counts and the choice."""
    rows = stored(rows, "rows-to-sample")
    key = ["event", "session", "candidate_aid"] if "event" in rows.columns else ["session", "candidate_aid"]
    pos, neg = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not exact:
        return rows.where((F.col("label") == 1) | (hash_fraction(*key, seed=seed) < ratio * pos / max(neg, 1)))
    want = int(ratio * pos)
    h = stable_hash(*key, seed=seed)
    buckets = rows.where("label = 0").groupBy(F.shiftright(h, 50).alias("bucket")).agg(F.count("*").alias("m"))  # 1024 rows at most
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("m").over(w), F.lit(0)))
    part = rows.where("label = 0").withColumn("h", h).withColumn("bucket", F.shiftright("h", 50)).join(F.broadcast(buckets), "bucket").where(F.col("before") < want)
    r = F.row_number().over(Window.partitionBy("bucket").orderBy("h", *key))
    chosen = part.withColumn("r", r + F.col("before")).where(F.col("r") <= want).select(*rows.columns)
    return rows.where("label = 1").unionByName(chosen)


def combine_ranks(rows: DataFrame, sum_strategies: list[str], min_strategies: list[str], keep: tuple[str, ...] = ("covisit", "word2vec")) -> DataFrame:
    """``retrieval_combined`` (sum of flags), ``rank_combined`` (smallest rank); the columns of
    strategies outside ``keep`` go."""
    total = sum((F.col(f"retrieval_{s}") for s in sum_strategies[1:]), F.col(f"retrieval_{sum_strategies[0]}"))
    least = F.least(*(F.col(f"rank_{s}") for s in min_strategies)) if len(min_strategies) > 1 else F.col(f"rank_{min_strategies[0]}")
    gone = [f"{p}_{s}" for s in {*sum_strategies, *min_strategies} - set(keep) for p in ("retrieval", "rank")]
    return rows.withColumns({"retrieval_combined": total, "rank_combined": least}).drop(*gone)


def sample_negatives_per_session(rows: DataFrame, ratio: int, seed: int = 0, include_all_truth: DataFrame | None = None) -> DataFrame:
    """Per session ``ratio`` negatives for each positive; ``include_all_truth`` adds truths that
    no strategy proposed, with label 1 and nulls elsewhere."""
    key = [c for c in ("event", "session") if c in rows.columns]
    w = Window.partitionBy(*key)
    marked = rows.withColumn("positives", F.sum("label").over(w)).withColumn("r", F.row_number().over(Window.partitionBy(*key, "label").orderBy(stable_hash(*key, "candidate_aid", seed=seed), "candidate_aid")))
    out = marked.where((F.col("label") == 1) | (F.col("r") <= ratio * F.col("positives"))).select(*rows.columns)
    if include_all_truth is None:
        return out
    # One pass marks the rows of the truth; what it chooses and marks is few rows, written once.
    if "event" in key:
        marked = _with_truths(marked, include_all_truth).withColumn("_true", _is_true_of_own())
    else:
        marked = _with_truths(marked, include_all_truth).withColumn("_true", F.greatest(*map(_is_true, EVENTS.values())))
    marked = marked.withColumn("_in", (F.col("label") == 1) | (F.col("r") <= ratio * F.col("positives"))).where("_in or _true = 1")
    few = stored(marked.select(*rows.columns, "_in", "_true"), "rows-chosen")
    true = include_all_truth.select("session", F.col("type").alias("event"), F.explode("ground_truth").alias("candidate_aid")).distinct()
    missed = true.join(few.where("_true = 1").hint("merge"), [*key, "candidate_aid"], "left_anti").withColumn("label", F.lit(1))
    return few.where("_in").select(*rows.columns).unionByName(missed.select(*(c for c in rows.columns if c in missed.columns)), allowMissingColumns=True)
