"""Session history and co-visitation candidates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.exprs import recency_weight, type_weight

from sessionloom.sources.scratch import stored

from .events import PREPARED_WEIGHTS, RERANK_WEIGHTS, TIE, session_order, with_position


def unique_recent_aids(events: DataFrame, tie: tuple[str, ...] = TIE) -> DataFrame:
    """``session, aid, last_pos, recent_rank``: distinct aids, most recent first (rank from 0)."""
    last = with_position(events, tie).groupBy("session", "aid").agg(F.max("pos").alias("last_pos"))
    return last.withColumn("recent_rank", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("last_pos"))) - 1)


def past_aids(events: DataFrame, n: int = 20, type_weights: dict[int, float] = PREPARED_WEIGHTS, threshold: int = 20, inclusive: bool = True, tie: tuple[str, ...] = TIE) -> DataFrame:
    """``session, candidate_aid, rank``, ranks from 0, n at most.

    Sessions of ``threshold`` distinct aids or more (``inclusive=False``: of more) rank them by
    the sum of recency times type weight, then by first position; others by recency. The defaults
    are those of history as a strategy of its own; co-visitation jobs rank it by RERANK_WEIGHTS.
    """
    pos = with_position(events, tie).withColumn("w", recency_weight("pos", "n") * type_weight(type_weights))
    per = pos.groupBy("session", "aid").agg(F.round(F.sum("w"), 9).alias("score"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    per = per.withColumn("unique_aids", F.count(F.lit(1)).over(Window.partitionBy("session")))
    many = F.col("unique_aids") >= threshold if inclusive else F.col("unique_aids") > threshold
    key = F.when(many, F.struct((-F.col("score")).alias("a"), F.col("first_pos").alias("b"))).otherwise(F.struct((-F.col("last_pos")).cast("double").alias("a"), F.lit(0).alias("b")))
    per = per.withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy(key)) - 1)
    return per.where(F.col("rank") < n).select("session", F.col("aid").alias("candidate_aid"), "rank")


def numbered(table: DataFrame) -> DataFrame:
    """A co-visitation table with ``nb``, the place of aid_y among the neighbours of aid_x (from 0);
    tables of ``build_covisitation`` have it already."""
    if "nb" in table.columns:
        return table.select("aid_x", "aid_y", "wgt", "nb")
    w = Window.partitionBy("aid_x").orderBy(F.desc("wgt"), "aid_y")
    return table.select("aid_x", "aid_y", "wgt", (F.row_number().over(w) - 1).alias("nb"))


def neighbour_lists(table: DataFrame) -> DataFrame:
    """``aid_x, near``: the neighbours of each aid_x in one list, the first place first."""
    lists = numbered(table).groupBy("aid_x").agg(F.array_sort(F.collect_list(F.struct("nb", "aid_y"))).alias("x"))
    return lists.select("aid_x", F.transform("x", lambda s: s["aid_y"]).alias("near"))


#: Parts of rows that name a known aid: it is counted in the cut to n and left out after it, or it stays.
KNOWN, KEPT = -1, -2


def _count_hits(t: pa.Table, n: int) -> pa.RecordBatch:
    """Hits of whole sessions: rows with a list are sources, those without name an aid that is known."""
    session, part, key = (np.asarray(t.column(c).combine_chunks().fill_null(0)) for c in ("session", "part", "key"))
    gap = np.asarray(t.column("session").combine_chunks().is_null())
    near = t.column("near").combine_chunks()
    lens = np.asarray(pc.fill_null(pc.list_value_length(near), 0)).astype(np.int64)
    change = np.append(False, (session[1:] != session[:-1]) | (gap[1:] != gap[:-1]))
    row = np.cumsum(change)
    source, own = np.repeat(np.arange(len(lens)), lens), np.flatnonzero(part < 0)
    place = np.arange(len(source)) - np.repeat(np.cumsum(lens) - lens, lens)
    # First encounter: part, recency rank of the source, neighbour's place; -1 marks a known aid.
    met = (part[source].astype(np.int64) << 52) + (key[source] << 20) + place
    met = np.append(met, np.full(len(own), -1))
    aid = np.append(np.asarray(near.flatten()).astype(np.int64), key[own])
    row, at = np.append(row[source], row[own]), np.append(source, own)
    order = np.lexsort((met, aid, row))
    row, aid, met, at = row[order], aid[order], met[order], at[order]
    start = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (aid[1:] != aid[:-1]))) if len(row) else np.zeros(0, int)
    known = met[start] < 0
    hits = np.diff(np.append(start, len(row))) - known
    start, known, hits = start[hits > 0], known[hits > 0], hits[hits > 0]
    row, aid, met, at = row[start], aid[start], met[np.minimum(start + known, max(len(met) - 1, 0))], at[start]
    stays = known & (part[at] == KEPT)
    order = np.lexsort((aid, met, -hits, stays, row))
    row, aid, met, at, known, stays, hits = (x[order] for x in (row, aid, met, at, known, stays, hits))
    first = np.searchsorted(row, row, side="left")
    place = np.arange(len(row)) - first + 1
    keep = np.flatnonzero(stays | ((place <= n) & ~known))
    names = t.column("session").combine_chunks().take(pa.array(at[keep]))
    rank = np.arange(len(keep)) - np.searchsorted(row[keep], row[keep], side="left")
    columns = [names, pa.array(aid[keep]), pa.array(hits[keep], pa.int64()), pa.array(met[keep]), pa.array(place[keep], pa.int32()), pa.array(rank, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["session", "candidate_aid", "hits", "met", "place", "rank"])


def _found(n: int):
    """``_count_hits`` over batches that are sorted by session; a session is never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            session = b.column(0)
            last = session[-1].as_py()
            if held and held[-1].column(0)[-1].as_py() == last and session[0].as_py() == last:
                held.append(b)
                continue
            same = np.asarray(pc.fill_null(pc.equal(session, last), False) if last is not None else session.is_null())
            cut = int(np.argmax(same))
            yield _count_hits(pa.Table.from_batches([*held, b.slice(0, cut)]), n)
            held = [b.slice(cut)]
        if held:
            yield _count_hits(pa.Table.from_batches(held), n)

    return run


def _lists_of(tables: list[DataFrame]) -> DataFrame:
    """``aid_x, lists``: the neighbours of each aid_x in each table, as (part, near)."""
    lists = [neighbour_lists(t).select("aid_x", F.lit(i).alias("part"), "near") for i, t in enumerate(tables)]
    if len(lists) == 1:
        return lists[0].select("aid_x", F.array(F.struct("part", "near")).alias("lists"))
    return reduce(DataFrame.unionByName, lists).groupBy("aid_x").agg(F.collect_list(F.struct("part", "near")).alias("lists"))


def _by_session(rows: DataFrame, parts: int | None) -> DataFrame:
    """Rows dealt by session: into ``parts``, so that a task's rows don't grow with the log, or as Spark chooses."""
    return rows.repartition(*([parts] if parts else []), "session")


def _hits(sources: DataFrame, tables: list[DataFrame], seen: DataFrame, n: int, parts: int | None = None) -> DataFrame:
    """``session, candidate_aid, hits, met, place, rank`` of the neighbours of the sources, most hits first;
    ties by first encounter (``met``: table, recency rank of the source, neighbour's place), then aid.
    ``place`` is that before known aids leave (from 1), ``rank`` that among a session's rows here (from 0).

    ``sources``: ``session, aid, recent_rank, parts`` (the numbers of the tables that count for it).
    ``seen``: ``session, aid, known``: KNOWN aids are counted in the cut to n and left out after it, KEPT
    ones all stay and take no place.

    Sources travel to their session with the lists of their neighbours, so hits, as many as sources
    times neighbours, are never shuffled: they are counted where a session's rows meet. All tables
    meet the sources in one join.
    """
    met = sources.where(F.size("parts") > 0).join(_lists_of(tables), F.col("aid") == F.col("aid_x"))
    met = met.select("session", "recent_rank", F.explode(F.filter("lists", lambda x: F.array_contains("parts", x["part"]))).alias("x"))
    rows = met.select("session", "x.part", F.col("recent_rank").cast("long").alias("key"), "x.near")
    known = seen.where("session is not null and aid is not null")
    rows = rows.unionByName(known.select("session", F.col("known").cast("int").alias("part"), F.col("aid").cast("long").alias("key"), F.lit(None).cast(rows.schema["near"].dataType).alias("near")))
    kinds = {f.name: f.dataType.simpleString() for f in [seen.schema["session"], tables[0].schema["aid_y"]]}
    schema = f"session {kinds['session']}, candidate_aid long, hits long, met long, place int, rank int"
    got = _by_session(rows, parts).sortWithinPartitions("session").mapInArrow(_found(n), schema)
    return got.withColumn("candidate_aid", F.col("candidate_aid").cast(kinds["aid_y"]))


def _parts(*when: Column) -> Column:
    """The numbers of the tables whose condition is true."""
    return F.filter(F.array(*(F.when(c, F.lit(i)) for i, c in enumerate(when))), lambda x: x.isNotNull())


def _with_chosen(events: DataFrame, types: tuple[int, ...], tie: tuple[str, ...], start: float = 0.1) -> DataFrame:
    """``unique_recent_aids`` with ``chosen`` (an event of one of the types names the aid), its first
    position, the sum ``w`` of recency times type weight, and ``m``, the session's distinct aids: all of
    one grouping, so that events are shuffled for it once."""
    pos = with_position(events, tie).withColumn("w", recency_weight("pos", "n", start) * type_weight(PREPARED_WEIGHTS))
    chosen = F.max(F.col("type").isin(*types)) if types else F.lit(False)
    own = pos.groupBy("session", "aid").agg(F.max("pos").alias("last_pos"), F.min("pos").alias("first_pos"), F.sum("w").alias("w"), chosen.alias("chosen"))
    w = Window.partitionBy("session")
    return own.withColumns({"recent_rank": F.row_number().over(w.orderBy(F.desc("last_pos"))) - 1, "m": F.count(F.lit(1)).over(w)})


def _expand(sources: DataFrame, tables: list[DataFrame], n: int, parts: int | None, *when: Column) -> DataFrame:
    """Neighbours of the sources in each table whose condition holds, most hits first; the sources' aids
    leave after the cut to n."""
    return _hits(sources.withColumn("parts", _parts(*when)), tables, sources.withColumn("known", F.lit(KNOWN)), n, parts)


def _with_history(events: DataFrame, found: DataFrame, with_history: bool, tie: tuple[str, ...], parts: int | None) -> DataFrame:
    if not with_history:  # ranked where a session met, so nothing is shuffled for it
        return found.select("session", "candidate_aid", "rank")
    rows = found.select("session", "candidate_aid", F.lit(1).alias("source"), "place")
    past = past_aids(events, type_weights=RERANK_WEIGHTS, threshold=20, inclusive=False, tie=tie)
    rows = rows.unionByName(past.select("session", "candidate_aid", F.lit(0).alias("source"), F.col("rank").alias("place")))
    w = Window.partitionBy("session").orderBy("source", "place")
    return _by_session(rows, parts).withColumn("rank", F.row_number().over(w) - 1).select("session", "candidate_aid", "rank")


def covisit_clicks(events: DataFrame, clicks: DataFrame, n: int = 60, with_history: bool = True, tie: tuple[str, ...] = TIE, parts: int | None = None) -> DataFrame:
    """C8 (C12 without history): neighbours of all distinct aids in the clicks table."""
    u = unique_recent_aids(events, tie)
    return _with_history(events, _expand(u, [clicks], n, parts, F.lit(True)), with_history, tie, parts)


def covisit_carts(events: DataFrame, clicks: DataFrame, carts_orders: DataFrame, n: int = 60, with_history: bool = True, tie: tuple[str, ...] = TIE, parts: int | None = None) -> DataFrame:
    """The clicks table for all aids, and carts_orders: in sessions of 20 distinct aids or
    more for clicked or carted aids only."""
    u = _with_chosen(events, (0, 1), tie)
    return _with_history(events, _expand(u, [clicks, carts_orders], n, parts, F.lit(True), F.expr("m < 20 or chosen")), with_history, tie, parts)


def covisit_orders(events: DataFrame, carts_orders: DataFrame, buy2buy: DataFrame, n: int = 60, with_history: bool = True, tie: tuple[str, ...] = TIE, parts: int | None = None) -> DataFrame:
    """carts_orders for all aids, and buy2buy for carted or ordered ones."""
    u = _with_chosen(events, (1, 2), tie)
    return _with_history(events, _expand(u, [carts_orders, buy2buy], n, parts, F.lit(True), F.col("chosen")), with_history, tie, parts)


def suggest_with_backfill(events: DataFrame, event: str, tables: dict[str, DataFrame], popular: DataFrame, n: int = 100, dedup: bool = True, tie: tuple[str, ...] = TIE, parts: int | None = None) -> DataFrame:
    """C11: one-shot suggestions of a target event, n at most for a session.

    Sessions of 20 distinct aids or more rank aids by the sum of recency times type weight; for
    carts and orders each co-visit hit of a light (clicked or carted) or bought (carted or ordered)
    aid adds 0.1, also to aids that the session hasn't seen. Other sessions list their history, the
    most recent first, then co-visits, then the event's popular aids (from ``popular()``);
    ``dedup=False`` lets popular aids repeat listed ones.
    """
    kinds = {"clicks": (), "carts": (0, 1), "orders": (1, 2)}[event]
    names = {"clicks": ["clicks"], "carts": ["clicks", "carts_orders"], "orders": ["carts_orders", "buy2buy"]}[event]
    start = 0.1 if event == "clicks" else 0.5
    own = _with_chosen(events, kinds, tie, start)
    few, chosen = F.col("m") < 20, F.col("chosen")
    own = own.where(few | F.col("session").isNotNull() & F.col("aid").isNotNull())
    # Few distinct aids: the tables' lists. Many: a bonus for hits of chosen aids; aids the session
    # hasn't seen have no score but the bonus, so its first n are enough of them.
    when = [few & chosen if p == "buy2buy" else few for p in names]
    when[-1] = when[-1] | (~few & chosen)
    sources = own.withColumns({"parts": _parts(*when), "known": F.when(few, KNOWN).otherwise(KEPT)})
    found = _hits(sources, [tables[p] for p in names], sources, n, parts)
    # All rows of a session meet in one shuffle: its aids, hits and, made there, the popular aids.
    rows = own.select("session", F.col("aid").alias("candidate_aid"), F.lit(0).alias("source"), F.col("recent_rank").cast("long").alias("place"), "m", "w", "first_pos", F.lit(None).cast("double").alias("bonus"), F.lit(None).cast("long").alias("met"))
    rows = rows.unionByName(found.select("session", "candidate_aid", F.lit(1).alias("source"), F.col("place").cast("long"), (F.col("hits") * 0.1).alias("bonus"), "met"), allowMissingColumns=True)
    rows = _by_session(rows, parts)
    top = popular.where(F.col("event") == event).select("labels").first()  # one list of k aids
    if top:
        this = F.struct("candidate_aid", "source", "place", "m", "w", "first_pos", "bonus", "met")
        kind = rows.schema["candidate_aid"].dataType
        none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("m", "w", "first_pos", "bonus", "met")]
        fill = [F.struct(F.lit(a).cast(kind).alias("candidate_aid"), F.lit(2).alias("source"), F.lit(i).cast("long").alias("place"), *none) for i, a in enumerate(top["labels"])]
        last = (F.col("source") == 0) & (F.col("place") == 0) & few
        rows = rows.select("session", F.explode(F.when(last, F.array(this, *fill)).otherwise(F.array(this))).alias("x")).select("session", "x.*")
    key = ["session", "candidate_aid"] if dedup else ["session", "candidate_aid", F.col("source") == 2]
    first = F.min(F.shiftleft(F.col("source").cast("long"), 40) + F.col("place"))
    each = rows.groupBy(*key).agg(first.alias("x"), *(F.max(c).alias(c) for c in ("m", "w", "first_pos", "bonus", "met"))).select("session", "candidate_aid", "x", "m", "w", "first_pos", "bonus", "met")
    each = each.withColumn("many", F.max("m").over(Window.partitionBy("session")) >= 20)
    many = lambda c: F.when(F.col("many"), c)
    score = F.round(F.coalesce("w", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0)), 9)
    order = [F.when(~F.col("many"), F.col("x")), many(score).desc(), many(F.col("first_pos")).asc_nulls_last(), many(F.col("met")), F.col("candidate_aid")]
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy(*order)) - 1)
    return ranked.where(F.col("rank") < n).select("session", "candidate_aid", "rank")


@dataclass(frozen=True)
class CovisitRules:
    """What makes a co-visit: types of events, distance in time, events of a session that count,
    weights of aid_y's type, and the order of a session's events."""

    types: tuple[int, ...] = (0, 1, 2)
    window_s: int = 86_400
    last: int = 30
    weights: tuple[tuple[int, float], ...] = ((0, 1.0), (1, 6.0), (2, 3.0))
    tie: tuple[str, ...] = TIE


def session_tails(events: DataFrame, rules: CovisitRules) -> DataFrame:
    """The last events of each session that count (columns of the order, ``session`` and ``aid``)."""
    order = session_order(rules.tie)
    w = Window.partitionBy("session").orderBy(*map(F.desc, order))
    recent = events.where(F.col("type").isin(*rules.types)).withColumn("r", F.row_number().over(w)).where(F.col("r") <= rules.last)
    return recent.select("session", *dict.fromkeys(["aid", "type", *order]))


def pair_sums(tails: DataFrame, rules: CovisitRules) -> DataFrame:
    """``aid_x, aid_y, wgt`` of all pairs of the tails: once per session, with the weight of aid_y's type."""
    x = tails.select("session", F.col("aid").alias("aid_x"), F.col("ts").alias("ts_x"))
    y = tails.select("session", F.col("aid").alias("aid_y"), F.col("ts").alias("ts_y"), type_weight(dict(rules.weights)).alias("w"))
    pairs = x.join(y, "session").where((F.col("aid_x") != F.col("aid_y")) & (F.abs(F.col("ts_x") - F.col("ts_y")) <= rules.window_s))
    once = pairs.groupBy("session", "aid_x", "aid_y").agg(F.max("w").alias("w"))
    return once.groupBy("aid_x", "aid_y").agg(F.sum("w").alias("wgt"))


def top_neighbours(sums: DataFrame, top_n: int) -> DataFrame:
    """Each aid_x's ``top_n`` aids by weight, numbered from 0 in ``nb``."""
    return numbered(sums).where(F.col("nb") < top_n).select("aid_x", "aid_y", F.col("wgt").cast("float").alias("wgt"), "nb")


@dataclass(frozen=True)
class CovisitState:
    """What a table of co-visits keeps to take new events: session tails and pair sums, both stored
    tables. Weights are whole numbers in doubles, so adding and taking off is exact."""

    tails: DataFrame
    sums: DataFrame
    rules: CovisitRules


def covisit_state(events: DataFrame, rules: CovisitRules = CovisitRules()) -> CovisitState:
    tails = stored(session_tails(events, rules), "covisit-tails")
    return CovisitState(tails, stored(pair_sums(tails, rules), "covisit-sums"), rules)


def merge_covisitation(state: CovisitState, events: DataFrame) -> CovisitState:
    """U1, day by day: the state with new ``events``, equal to the one built from all events at once.

    Only sessions with new events are paired again: the pairs of their old tails are taken off the
    sums, those of their new tails added. New events may be older than known ones. Events that come
    twice count twice; a day without events changes nothing.
    """
    rules = state.rules
    new = events.where(F.col("type").isin(*rules.types)).select(*state.tails.columns)
    changed = new.select("session").distinct()
    before = stored(state.tails.join(changed, "session", "left_semi"), "covisit-before")
    after = stored(session_tails(before.unionByName(new), rules), "covisit-after")
    delta = pair_sums(after, rules).unionByName(pair_sums(before, rules).withColumn("wgt", -F.col("wgt")))
    sums = state.sums.unionByName(delta.select(*state.sums.columns)).groupBy("aid_x", "aid_y").agg(F.sum("wgt").alias("wgt")).where("wgt <> 0")
    tails = state.tails.join(changed, "session", "left_anti").unionByName(after)
    return CovisitState(stored(tails, "covisit-tails"), stored(sums, "covisit-sums"), rules)


def build_covisitation(events: DataFrame, types: tuple[int, ...] = (0, 1, 2), window_s: int = 86_400, top_n: int = 20, weights: dict[int, float] | None = None, last: int = 30, tie: tuple[str, ...] = TIE) -> DataFrame:
    """``aid_x, aid_y, wgt, nb``: aids within ``window_s`` of each other among a session's last
    events (``last`` of them, so a session adds at most last^2 pairs); a pair counts once per session
    with the type weight of aid_y, and each aid_x keeps its ``top_n``, numbered from 0 in ``nb``."""
    rules = CovisitRules(types, window_s, last, tuple((weights or {0: 1.0, 1: 6.0, 2: 3.0}).items()), tie)
    return top_neighbours(pair_sums(session_tails(events, rules), rules), top_n)


def covisitation_together(events: DataFrame, tables: dict[str, tuple[CovisitRules, int]], parts: int | None = None) -> DataFrame:
    """U1 of several tables at once: ``aid_x, aid_y`` and ``<table>, <table>_nb`` (weight and place, null
    outside the table) for ``tables: name -> (rules, top_n)``. Sessions are paired once for all tables, and
    a pair travels once for them. Rules share their order of events. ``parts``: the result lies by aid_x in
    as many parts. ``one_of`` reads a table out of it."""
    ties = {r.tie for r, _ in tables.values()}
    if len(ties) != 1:
        raise ValueError("tables that are made together need one order of events")
    order = session_order(*ties)
    upto = Window.partitionBy("session").orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = {t: F.col("type").isin(*r.types) & (F.count_if(F.col("type").isin(*r.types)).over(upto) <= r.last) for t, (r, _) in tables.items()}
    tails = events.select("session", "aid", "type", "ts", *(c.alias(f"in_{t}") for t, c in inside.items())).where(reduce(lambda a, b: a | b, (F.col(f"in_{t}") for t in tables)))
    side = lambda s, *more: tails.select("session", F.col("aid").alias(f"aid_{s}"), F.col("ts").alias(f"ts_{s}"), *(F.col(f"in_{t}").alias(f"in_{t}_{s}") for t in tables), *more)
    met = side("x").join(side("y", *(type_weight(dict(r.weights)).alias(f"w_{t}") for t, (r, _) in tables.items())), "session").where(F.col("aid_x") != F.col("aid_y"))
    hit = {t: F.when(F.col(f"in_{t}_x") & F.col(f"in_{t}_y") & (F.abs(F.col("ts_x") - F.col("ts_y")) <= r.window_s), F.col(f"w_{t}")) for t, (r, _) in tables.items()}
    some = met.select("session", "aid_x", "aid_y", *(c.alias(t) for t, c in hit.items())).where(F.coalesce(*map(F.col, tables)).isNotNull())
    once = some.groupBy("session", "aid_x", "aid_y").agg(*(F.max(t).alias(t) for t in tables))
    sums = once.groupBy("aid_x", "aid_y").agg(*(F.sum(t).alias(t) for t in tables))
    placed = sums.repartition(*([parts] if parts else []), "aid_x")
    for t, (_, n) in tables.items():
        nb = F.row_number().over(Window.partitionBy("aid_x").orderBy(F.desc_nulls_last(t), "aid_y")) - 1
        placed = placed.withColumn(f"{t}_nb", F.when(F.col(t).isNotNull() & (nb < n), nb))
    placed = placed.where(F.coalesce(*(F.col(f"{t}_nb") for t in tables)).isNotNull())
    return placed.select("aid_x", "aid_y", *(c for t in tables for c in (F.when(F.col(f"{t}_nb").isNotNull(), F.col(t)).cast("float").alias(t), F.col(f"{t}_nb"))))


def one_of(together: DataFrame, table: str) -> DataFrame:
    """``aid_x, aid_y, wgt, nb`` of one of the tables of ``covisitation_together``."""
    return together.where(F.col(f"{table}_nb").isNotNull()).select("aid_x", "aid_y", F.col(table).alias("wgt"), F.col(f"{table}_nb").alias("nb"))
