"""Proposals of points by tree-structured Parzen estimators, for searches whose trials run in batches."""

from __future__ import annotations

import numpy as np

#: Share of the trials that count as good, candidates for each proposal, and least width of a kernel.
GOOD, CANDIDATES, WIDTH = 0.2, 32, 0.06


def _density(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Mean of normal kernels about the centres (one dimension), and an even share of 1 in all."""
    width = max(WIDTH, 1.0 / (1 + len(centres)))
    kernels = np.exp(-(((x[:, None] - centres[None, :]) / width) ** 2) / 2) / (width * np.sqrt(2 * np.pi))
    return (kernels.sum(1) + 1.0) / (len(centres) + 1)


def propose(points: np.ndarray, values: np.ndarray, n: int, dims: int, rng: np.random.Generator) -> np.ndarray:
    """``n`` points of the unit cube, given tried ``points`` and their ``values`` (larger is better).

    Without trials they are even random ones. Else each is the one of CANDIDATES drawn near good
    trials that is likeliest among good trials against the others, dimension by dimension; points
    proposed before it in the batch count as others, so that a batch spreads.
    """
    if not len(points):
        return rng.random((n, dims))
    order = np.argsort(-values, kind="stable")
    cut = max(1, int(np.ceil(GOOD * len(order))))
    good, rest = points[order[:cut]], points[order[cut:]]
    width, out = max(WIDTH, 1.0 / (1 + len(good))), []
    for _ in range(n):
        drawn = good[rng.integers(0, len(good), (CANDIDATES, dims)), np.arange(dims)] + width * rng.standard_normal((CANDIDATES, dims))
        drawn = np.clip(np.where(rng.random((CANDIDATES, dims)) < 1 / (1 + len(good)), rng.random((CANDIDATES, dims)), drawn), 0, 1)
        ratio = sum(np.log(_density(drawn[:, d], good[:, d])) - np.log(_density(drawn[:, d], rest[:, d])) for d in range(dims))
        out.append(drawn[int(np.argmax(ratio))])
        rest = np.concatenate([rest, out[-1:]])
    return np.array(out)
