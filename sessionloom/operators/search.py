"""Search of the listwise ranker's parameters by Parzen proposals and successive halving."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from sessionloom.functions.parzen import propose

from .boosting import BoostedRanker, boost, prepare_boosting
from .ranking import balanced_folds

#: Name of a parameter: least value, largest value, scale (``int``, ``float`` or ``log``).
SPACE: dict[str, tuple[float, float, str]] = {"rate": (0.02, 0.5, "log"), "depth": (2, 6, "int"), "l2": (0.1, 10.0, "log"), "least_rows": (5, 200, "log")}


@dataclass
class Trial:
    params: dict[str, float]
    point: np.ndarray
    model: BoostedRanker
    #: Best value of the metric within the rounds of each rung reached.
    values: list[float] = field(default_factory=list)
    #: Number of trees at which the best value was.
    best_round: int = 0


@dataclass
class Search:
    """Outcome: the best trial's model, cut to its best round, its parameters and every trial;
    ``names``: the parameters searched, also if there is no trial."""

    model: BoostedRanker | None
    params: dict[str, float]
    trials: list[Trial]
    rungs: list[int]
    names: list[str]

    def table(self, spark: SparkSession) -> DataFrame:
        """``trial, <a column for each parameter>, rounds, best_round, value``: a row for each trial,
        ``rounds`` those of the last rung it reached."""
        rows = [(i, *(float(t.params[n]) for n in self.names), self.rungs[len(t.values) - 1], t.best_round, float(t.values[-1])) for i, t in enumerate(self.trials)]
        return spark.createDataFrame(rows, "trial int, " + "".join(f"`{n}` double, " for n in self.names) + "rounds int, best_round int, value double")


def _value(low: float, high: float, scale: str, u: float) -> float:
    if scale == "int":
        return int(min(high, low + np.floor(u * (high - low + 1))))
    return float(np.exp(np.log(low) + u * (np.log(high) - np.log(low)))) if scale == "log" else float(low + u * (high - low))


def _seen(trials: list[Trial], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and values for the next proposals: of the highest rung that enough trials reached."""
    reached = max((len(t.values) for t in trials), default=0)
    for rung in range(reached - 1, -1, -1):
        there = [t for t in trials if len(t.values) > rung]
        if len(there) >= dims + 2 or not rung:
            return np.array([t.point for t in there]), np.array([t.values[rung] for t in there])
    return np.zeros((0, dims)), np.zeros(0)


def search_model(
    df: DataFrame, space: dict[str, tuple[float, float, str]] | None = None, trials: int = 18, batch: int = 9, rounds: int = 45,
    eta: int = 3, folds: int = 5, metric: str = "ndcg", k: int = 20, patience: int = 10, seed: int = 0,
) -> Search:
    """``trials`` rankers on sessions outside one of ``folds`` balanced folds, held against it.

    Trials come in batches. A batch starts with ``rounds`` / eta^j rounds; the best one of every
    ``eta`` goes on to ``eta`` times as many, with the trees it has, until the last has ``rounds``.
    Points of a batch are proposed from the trials before it (Parzen estimators over the highest
    rung that enough trials reached). Rows are binned and packed once for all trials, and the trees
    don't depend on the layout, so the same seed gives the same trials.

    ``space`` holds parameters of ``boost`` and ``rate``. Without training sessions, or without
    held-out sessions with a positive row, nothing can be compared: no model and no trials.
    """
    space = SPACE if space is None else space
    dealt = balanced_folds(df.drop("fold"), folds, seed, tuple(c for c in ("event", "session") if c in df.columns))
    ready = prepare_boosting(dealt.where("fold <> 0"), dealt.where("fold = 0"))
    rungs = [rounds]
    while rungs[0] // eta and eta ** len(rungs) <= min(batch, trials):
        rungs.insert(0, rungs[0] // eta)
    if ready.empty or ready.held is None or ready.held.where("label > 0").isEmpty():
        return Search(None, {}, [], rungs, list(space))
    rng, done = np.random.default_rng(seed), []
    while len(done) < trials:
        points = propose(*_seen(done, len(space)), min(batch, trials - len(done)), len(space), rng)
        running = []
        for p in points:
            params = {n: _value(*space[n], u) for n, u in zip(space, p, strict=True)}
            if "least_rows" in params:
                params["least_rows"] = round(params["least_rows"])
            running.append(Trial(params, p, ready.model(params.get("rate", 0.1))))
        done += running
        for at, upto in enumerate(rungs):
            for t in running:
                value, t.best_round = boost(ready, t.model, upto, metric=metric, k=k, patience=patience, **{n: v for n, v in t.params.items() if n != "rate"})
                t.values.append(value)
            if at + 1 < len(rungs):
                running = sorted(running, key=lambda t: -t.values[-1])[: max(1, len(running) // eta)]
    best = max(done, key=lambda t: (t.values[-1], len(t.values)))
    best.model.trees = best.model.trees[: best.best_round]
    return Search(best.model, best.params, done, rungs, list(space))
