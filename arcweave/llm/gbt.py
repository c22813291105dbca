"""Gradient-boosted trees with a logistic loss, held in flat node arrays.

Trees are grown on binned features with optional monotone constraints; a
fitted model scores numpy matrices (all rows move down one level at a time)
or becomes a Spark SQL expression.  Fitting takes a table in memory; of bins, a byte a feature.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Trees:
    """Node arrays of all trees: a leaf has feature -1; roots lists each tree's first node."""

    base: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.empty(0))
    left: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.empty(0))
    roots: tuple[int, ...] = ()
    depth: int = 0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root, np.int32)
            for _ in range(self.depth):
                f = self.feature[node]
                low = x[rows, np.maximum(f, 0)] <= self.threshold[node]
                node = np.where(f < 0, node, np.where(low, self.left[node], self.right[node]))
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))

    def sql_margin(self, columns: list[Column]) -> Column:
        """The same log-odds as nested CASE expressions over the feature columns."""

        def at(node: int) -> Column:
            if self.feature[node] < 0:
                return F.lit(float(self.value[node]))
            test = columns[self.feature[node]] <= F.lit(float(self.threshold[node]))
            return F.when(test, at(self.left[node])).otherwise(at(self.right[node]))

        out = F.lit(float(self.base))
        for root in self.roots:
            out = out + at(root)
        return out


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 40, depth: int = 3, rate: float = 0.2, l2: float = 1.0, bins: int = 64, least: float = 5.0, monotone: tuple[int, ...] = (), cuts: list[np.ndarray] | None = None) -> Trees:
    """Fit to labels 0/1.  monotone: per feature +1 (never falls), -1 (never rises) or 0.

    A constrained split is kept only if its children's values are in order,
    and their middle bounds all leaves below.  One class or no rows: a constant.
    cuts: x holds bin numbers already, by these limits (a value equal to one is below it).
    """
    n, k = x.shape
    mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if n else 0.5
    base = float(np.log(mean / (1 - mean)))
    if n < 2 or y.min() == y.max():
        return Trees(base)
    monotone = monotone or (0,) * k
    if cuts is None:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(k)], axis=1)
    else:
        binned = x
    feature, threshold, split, left, right, value, roots = [], [], [], [], [], [], []
    margin = np.full(n, base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)

        def leaf(rows: np.ndarray, low: float, high: float) -> float:
            return float(np.clip(g[rows].sum() / (h[rows].sum() + l2), low, high))

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            node = len(feature)
            v = leaf(rows, low, high)
            for a, b in ((feature, -1), (threshold, 0.0), (split, 0), (left, -1), (right, -1), (value, rate * v)):
                a.append(b)
            best = None
            if level < depth and h[rows].sum() >= 2 * least * 0.05:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for j in range(k):
                    m = len(cuts[j])
                    if not m:
                        continue
                    gs = np.cumsum(np.bincount(binned[rows, j], g[rows], m + 1))[:-1]
                    hs = np.cumsum(np.bincount(binned[rows, j], h[rows], m + 1))[:-1]
                    ns = np.cumsum(np.bincount(binned[rows, j], minlength=m + 1))[:-1]
                    vl = np.clip(gs / (hs + l2), low, high)
                    vr = np.clip((total_g - gs) / (total_h - hs + l2), low, high)
                    gain = gs**2 / (hs + l2) + (total_g - gs) ** 2 / (total_h - hs + l2) - total_g**2 / (total_h + l2)
                    ok = (ns >= least) & (len(rows) - ns >= least)
                    if monotone[j]:
                        ok &= (vr - vl) * monotone[j] >= 0
                    gain = np.where(ok, gain, -1)
                    i = int(gain.argmax())
                    if gain[i] > 1e-6 and (best is None or gain[i] > best[0]):
                        best = (gain[i], j, i, vl[i], vr[i])
            if best:
                _, j, i, vl, vr = best
                middle = (vl + vr) / 2
                bound = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[j]]
                low_side = binned[rows, j] <= i
                feature[node], threshold[node], split[node] = j, float(cuts[j][i]), i
                left[node] = grow(rows[low_side], level + 1, *bound[0])
                right[node] = grow(rows[~low_side], level + 1, *bound[1])
            return node

        root = grow(np.arange(n), 0, -4.0, 4.0)
        roots.append(root)
        limits = np.array(split, float) if binned is x else np.array(threshold)
        one = Trees(0.0, np.array(feature, np.int32), limits, np.array(left, np.int32), np.array(right, np.int32), np.array(value), (root,), depth)
        margin = margin + one.margin(x)
    return Trees(base, np.array(feature, np.int32), np.array(threshold), np.array(left, np.int32), np.array(right, np.int32), np.array(value), tuple(roots), depth)


def calibrated(margin: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Platt's a and b, so that 1 / (1 + exp(-(a * margin + b))) fits held-out labels; a stays positive."""
    a, b = 1.0, 0.0
    if len(y) < 10 or y.min() == y.max():
        return a, b
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        d, w = target - p, np.maximum(p * (1 - p), 1e-9)
        s0, s1, s2 = w.sum() + 1e-3, (w * margin).sum(), (w * margin * margin).sum() + 1e-3
        g0, g1 = d.sum(), (d * margin).sum() - 1e-3 * (a - 1)
        det = s0 * s2 - s1 * s1
        da, db = (s0 * g1 - s1 * g0) / det, (s2 * g0 - s1 * g1) / det
        a, b = max(1e-3, a + 0.5 * da), b + 0.5 * db
        if abs(da) + abs(db) < 1e-7:
            break
    return float(a), float(b)
