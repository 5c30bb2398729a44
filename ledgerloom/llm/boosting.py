"""Gradient-boosted trees over counted feature vectors, fitted on the driver and applied as a SQL expression.

The training input is a table of distinct feature vectors with positive and negative counts. Every feature has a fixed
small range, so the table is bounded whatever the corpus holds.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column
from pyspark.sql import functions as F

Row = tuple[tuple[int, ...], float, float]  # features, positives, negatives


def _best_split(rows, grads, hess, size: int):
    """Feature and threshold that reduce the loss most, over the rows of one node."""
    total_g, total_h = sum(grads), sum(hess)
    best = (1e-9, None, None)
    for f in range(size):
        by_value: dict[int, list[float]] = {}
        for (x, _, _), g, h in zip(rows, grads, hess, strict=True):
            cell = by_value.setdefault(x[f], [0.0, 0.0])
            cell[0] += g
            cell[1] += h
        left_g = left_h = 0.0
        for value in sorted(by_value)[:-1]:
            left_g += by_value[value][0]
            left_h += by_value[value][1]
            gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
            if gain > best[0]:
                best = (gain, f, value)
    return best[1], best[2]


def _grow(rows, grads, hess, size: int, depth: int, rate: float):
    """A tree as nested (feature, threshold, left, right), leaves as numbers."""
    f, value = _best_split(rows, grads, hess, size) if depth else (None, None)
    if f is None:
        return rate * sum(grads) / (sum(hess) + 1)
    sides = []
    for keep in (lambda x: x[f] <= value, lambda x: x[f] > value):
        at = [i for i, (x, _, _) in enumerate(rows) if keep(x)]
        sides.append(_grow([rows[i] for i in at], [grads[i] for i in at], [hess[i] for i in at], size, depth - 1, rate))
    return f, value, sides[0], sides[1]


def leaf(tree, x: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        f, value, low, high = tree
        tree = low if x[f] <= value else high
    return tree


def fit(rows: list[Row], rounds: int = 24, depth: int = 3, rate: float = 0.4) -> tuple[float, list]:
    """Start value and trees of a logistic boosted model; no rows give a model that scores everything low."""
    pos, neg = sum(r[1] for r in rows), sum(r[2] for r in rows)
    start = log((pos + 0.5) / (neg + 0.5)) if rows and pos else -10.0
    trees: list = []
    if not rows or not pos or not neg:
        return start, trees
    scores = [start] * len(rows)
    size = len(rows[0][0])
    for _ in range(rounds):
        probs = [1 / (1 + exp(-s)) for s in scores]
        grads = [p - (p + n) * q for (_, p, n), q in zip(rows, probs, strict=True)]
        hess = [(p + n) * q * (1 - q) for (_, p, n), q in zip(rows, probs, strict=True)]
        tree = _grow(rows, grads, hess, size, depth, rate)
        trees.append(tree)
        scores = [s + leaf(tree, x) for s, (x, _, _) in zip(scores, rows, strict=True)]
    return start, trees


def score(model: tuple[float, list], x: tuple[int, ...]) -> float:
    start, trees = model
    return start + sum(leaf(t, x) for t in trees)


def as_column(model: tuple[float, list], features: list[Column]) -> Column:
    """The model's score as one expression of the feature columns."""

    def branch(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        f, value, low, high = tree
        return F.when(features[f] <= value, branch(low)).otherwise(branch(high))

    start, trees = model
    total = F.lit(float(start))
    for tree in trees:
        total = total + branch(tree)
    return total


def threshold(model: tuple[float, list], held_out: list[Row], precision: float) -> float:
    """Smallest score from which on all higher scores together reach ``precision`` on rows that were not fitted."""
    ranked = sorted(((score(model, x), p, n) for x, p, n in held_out), reverse=True)
    pos = neg = 0.0
    best = float("inf")
    for k, (s, p, n) in enumerate(ranked):
        pos, neg = pos + p, neg + n
        last_of_tie = k + 1 == len(ranked) or ranked[k + 1][0] < s
        if last_of_tie and pos and pos >= precision * (pos + neg):
            best = s
    return best
