"""Histogram gradient-boosted trees in numpy: logistic loss, optional monotonic constraints.

A fitted model is five flat arrays; scoring walks all rows of a batch down a tree at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees, one after the other. A leaf points to itself; ``roots`` are the trees' first nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                down = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(down, self.left[node], self.right[node])
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def constant(labels: np.ndarray) -> Forest:
    """The model of labels that are none or all alike: their smoothed mean everywhere."""
    p = (float(np.sum(labels)) + 1.0) / (len(labels) + 2.0)
    none = np.zeros(0, np.int64)
    return Forest(none, np.zeros(0), none, none, np.zeros(0), none, float(np.log(p / (1 - p))), 0)


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def fit(
    x: np.ndarray,
    labels: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    min_rows: int = 10,
    ridge: float = 1.0,
    monotone: dict[int, int] | None = None,
) -> Forest:
    """Fit on (x, labels in 0/1). ``monotone`` maps a feature to 1 (score must not fall with it) or -1.

    A split on a constrained feature is taken only if its children's values stand in the demanded
    order, and the midpoint then bounds all values below either child.
    """
    labels = np.asarray(labels, float)
    if len(labels) == 0 or labels.min() == labels.max():
        return constant(labels)
    sign = np.zeros(x.shape[1])
    for f, s in (monotone or {}).items():
        sign[f] = s
    edges = [_edges(x[:, f], bins) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    p = labels.mean()
    base = float(np.log(p / (1 - p)))
    margin = np.full(len(x), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        at = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(at), right.append(at), value.append(rate * v)
        return at

    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = labels - q, q * (1 - q)

        def best(rows: np.ndarray, low: float, high: float, g=g, h=h):
            found = None
            all_g, all_h = g[rows].sum(), h[rows].sum()
            whole = all_g**2 / (all_h + ridge)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, f]
                n = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                gr, hr = all_g - gl, all_h - hl
                vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
                gain = 2 * (gl * vl + gr * vr) - (hl + ridge) * vl**2 - (hr + ridge) * vr**2 - whole
                gain[(n < min_rows) | (len(rows) - n < min_rows) | (sign[f] * (vr - vl) < 0)] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > 1e-6 and (found is None or gain[k] > found[0]):
                    found = (gain[k], f, k, vl[k], vr[k])
            return found

        root = node(0.0)
        roots.append(root)
        todo = [(root, np.arange(len(x)), 0, -np.inf, np.inf)]
        while todo:
            at, rows, level, low, high = todo.pop()
            found = best(rows, low, high) if level < depth and len(rows) >= 2 * min_rows else None
            if found is None:
                margin[rows] += value[at]
                continue
            _, f, k, vl, vr = found
            mid = (vl + vr) / 2
            feature[at], threshold[at] = f, float(edges[f][k])
            left[at], right[at] = node(vl), node(vr)
            down = binned[rows, f] <= k
            bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}.get(int(sign[f]), ((low, high), (low, high)))
            todo += [(left[at], rows[down], level + 1, *bounds[0]), (right[at], rows[~down], level + 1, *bounds[1])]
    as_array = np.asarray
    return Forest(
        as_array(feature), as_array(threshold, float), as_array(left), as_array(right), as_array(value, float), as_array(roots), base, depth
    )
