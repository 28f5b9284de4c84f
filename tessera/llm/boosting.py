"""Small gradient-boosted trees: fitted on the driver from a bounded labelled set, applied as a column expression."""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Split:
    """Goes left where the feature is at most ``at``; a side is a Split or a leaf's score."""

    feature: int
    at: float
    left: Split | float
    right: Split | float


def _leaf(g: list[float], h: list[float], rate: float) -> float:
    return rate * sum(g) / (sum(h) + 1.0)


def _grow(rows: list[tuple[int, ...]], g: list[float], h: list[float], depth: int, rate: float) -> Split | float:
    if not depth or len(rows) < 8:
        return _leaf(g, h, rate)
    gain = lambda a, b: a * a / (b + 1.0)
    all_g, all_h = sum(g), sum(h)
    best = (1e-9, None)
    for f in range(len(rows[0])):
        sums: dict[int, tuple[float, float]] = {}
        for r, x, y in zip(rows, g, h):
            a, b = sums.get(r[f], (0.0, 0.0))
            sums[r[f]] = a + x, b + y
        left_g = left_h = 0.0
        values = sorted(sums)
        for low, high in zip(values, values[1:]):
            left_g, left_h = left_g + sums[low][0], left_h + sums[low][1]
            won = gain(left_g, left_h) + gain(all_g - left_g, all_h - left_h) - gain(all_g, all_h)
            if won > best[0]:
                best = won, (f, (low + high) / 2)
    if best[1] is None:
        return _leaf(g, h, rate)
    f, at = best[1]
    side = [r[f] <= at for r in rows]

    def part(left: bool):
        keep = [i for i, s in enumerate(side) if s is left]
        return [rows[i] for i in keep], [g[i] for i in keep], [h[i] for i in keep]

    return Split(f, at, _grow(*part(True), depth - 1, rate), _grow(*part(False), depth - 1, rate))


def walk(tree: Split | float, row: tuple[int, ...]) -> float:
    while isinstance(tree, Split):
        tree = tree.left if row[tree.feature] <= tree.at else tree.right
    return tree


@dataclass(frozen=True)
class Model:
    base: float
    trees: tuple[Split | float, ...]

    def score(self, row: tuple[int, ...]) -> float:
        return self.base + sum(walk(t, row) for t in self.trees)

    def column(self, features: list[Column]) -> Column:
        """The log-odds as a column expression."""

        def of(tree: Split | float) -> Column:
            return F.when(features[tree.feature] <= tree.at, of(tree.left)).otherwise(of(tree.right)) if isinstance(tree, Split) else F.lit(float(tree))

        out = F.lit(float(self.base))
        for t in self.trees:
            out = out + of(t)
        return out


def fit(rows: list[tuple[int, ...]], labels: list[bool], rounds: int = 30, depth: int = 3, rate: float = 0.3) -> Model:
    """Logistic loss, Newton leaves; the order of rows decides nothing."""
    share = (sum(labels) + 1) / (len(labels) + 2)
    base = log(share / (1 - share))
    at, trees = [base] * len(rows), []
    for _ in range(rounds):
        p = [1 / (1 + exp(-x)) for x in at]
        tree = _grow(rows, [y - q for y, q in zip(labels, p)], [q * (1 - q) for q in p], depth, rate)
        trees.append(tree)
        at = [x + walk(tree, r) for x, r in zip(at, rows)]
    return Model(base, tuple(trees))


def calibrated(scores: list[float], labels: list[bool], precision: float) -> float:
    """The lowest threshold above which at least ``precision`` of held-out candidates are right, midway to the next lower score; infinity if there is none."""
    ranked = sorted(zip(scores, labels), reverse=True)
    best, right = float("inf"), 0
    for n, (s, y) in enumerate(ranked, 1):
        right += y
        below = ranked[n][0] if n < len(ranked) else s
        if (n == len(ranked) or below < s) and right >= precision * n:
            best = (s + below) / 2
    return best
