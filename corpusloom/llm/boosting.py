"""Gradient boosting over counts of binary feature vectors, scored as SQL expressions.

The rows to learn from are folded to counts of (bits, label) by a DataFrame
aggregate; there are at most 2**features of each, whatever the corpus. Trees of
depth two are grown on those counts by second-order (Newton) gains.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = tuple[int, tuple[int, float, float], tuple[int, float, float]]


def _best(g: np.ndarray, h: np.ndarray) -> tuple[float, int, float, float]:
    """The best (gain, feature, leaf where it is 0, leaf where it is 1); g, h: sums of gradients by feature and value."""
    gains = (g * g / h).sum(1)
    f = int(np.flatnonzero(gains >= gains.max() - 1e-12)[0])
    return float(gains[f]), f, float(g[f, 0] / h[f, 0]), float(g[f, 1] / h[f, 1])


def boosted(counts: list[tuple[int, int, int]], features: int, rounds: int = 30, rate: float = 0.3, floor: float = 1.0) -> tuple[float, list[Tree]]:
    """counts: (bits, label, n). The start score and the trees (root feature, its 0 side, its 1 side)."""
    bits, y, n = (np.array(x, np.float64) for x in zip(*sorted(counts), strict=True)) if counts else (np.zeros(0),) * 3
    on = (bits.astype(np.int64)[:, None] >> np.arange(features) & 1).astype(np.float64)
    yes, every = float(n[y > 0].sum()), float(n.sum())
    start = math.log((yes + 0.5) / (every - yes + 0.5))
    trees: list[Tree] = []
    scores = np.full(len(bits), start)
    for _ in range(rounds if every else 0):
        p = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
        # Sums of the rows that have both features, of those that have one, and of all.
        found = []
        for own in (n * (y - p), n * p * (1 - p)):
            both, one, total = on.T @ (on * own[:, None]), on.T @ own, own.sum()
            have = np.stack([one[:, None] - both, both], 2)  # root 1: child 0, child 1
            lack = np.stack([total - one[:, None] - one[None, :] + both, one[None, :] - both], 2)  # root 0
            found.append((lack, have))
        sides = [[_best(found[0][v][r], found[1][v][r] + floor) for v in (0, 1)] for r in range(features)]
        root = max(range(features), key=lambda r: sides[r][0][0] + sides[r][1][0])
        zero, one = ((f, rate * a, rate * b) for _, f, a, b in sides[root])
        trees.append((root, zero, one))
        leaf = lambda s: np.where(on[:, s[0]] > 0, s[2], s[1])
        scores += np.where(on[:, root] > 0, leaf(one), leaf(zero))
    return start, trees


def score(bits: Column, start: float, trees: list[Tree]) -> Column:
    """The log odds of an int column of bits."""
    on = lambda f: bits.bitwiseAND(F.lit(1 << f)) != 0
    leaf = lambda s: F.when(on(s[0]), F.lit(s[2])).otherwise(F.lit(s[1]))
    out = F.lit(start)
    for root, zero, one in trees:
        out = out + F.when(on(root), leaf(one)).otherwise(leaf(zero))
    return out


def score_of(bits: int, start: float, trees: list[Tree]) -> float:
    for root, zero, one in trees:
        f, no, yes = one if bits >> root & 1 else zero
        start += yes if bits >> f & 1 else no
    return start


def threshold(counts: list[tuple[int, int, int]], start: float, trees: list[Tree], precision: float) -> float:
    """From this score on, at least that share of counts is labelled 1: midway between the least such score and the next below; infinite where there is none."""
    by: dict[float, list[int]] = {}
    for b, y, n in counts:
        at = by.setdefault(score_of(b, start, trees), [0, 0])
        at[y] += n
    best, no, yes, order = math.inf, 0, 0, sorted(by, reverse=True)
    for s, below in zip(order, [*order[1:], None], strict=True):
        no, yes = no + by[s][0], yes + by[s][1]
        if yes >= precision * (yes + no):
            best = s if below is None else (s + below) / 2
    return best
