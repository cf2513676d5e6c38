"""Histogram gradient boosting with a logistic loss, its trees flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees in arrays; a leaf points at itself. Row goes left where x <= threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row of x reaches, all trees at once."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), self.base)
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(goes_left, self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    places = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(x[:, f], places)) for f in range(x.shape[1])]


def fit(
    x: np.ndarray,
    y: np.ndarray,
    weight: np.ndarray | None = None,
    rounds: int = 80,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 48,
    ridge: float = 1.0,
    least: float = 5.0,
) -> Trees:
    """Fit on rows x, labels y in 0..1; with no rows or one class only, a constant."""
    weight = np.ones(len(y)) if weight is None else weight
    total = weight.sum()
    share = float((y * weight).sum() + 0.5) / float(total + 1) if total else 0.5
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    base = float(np.log(share / (1 - share)))

    def leaf(value: float) -> int:
        at = len(nodes["value"])
        for name, v in (("feature", 0), ("threshold", 0.0), ("left", at), ("right", at), ("value", value)):
            nodes[name].append(v)
        return at

    one_class = not total or min((y * weight).sum(), ((1 - y) * weight).sum()) <= 0
    if not one_class:
        edges = bin_edges(x, bins)
        codes = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), base)

        def grow(rows: np.ndarray, level: int, slope: np.ndarray, curve: np.ndarray) -> int:
            g, h = slope[rows].sum(), curve[rows].sum()
            best = (1e-6, -1, -1)
            for f, e in enumerate(edges) if level < depth else ():
                if not len(e):
                    continue
                gs = np.cumsum(np.bincount(codes[rows, f], slope[rows], len(e) + 1))[:-1]
                hs = np.cumsum(np.bincount(codes[rows, f], curve[rows], len(e) + 1))[:-1]
                ns = np.cumsum(np.bincount(codes[rows, f], weight[rows], len(e) + 1))
                gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                gain[(ns[:-1] < least) | (ns[-1] - ns[:-1] < least)] = 0
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), f, k))
            if best[1] < 0:
                value = -rate * g / (h + ridge)
                margin[rows] += value
                return leaf(float(value))
            _, f, k = best
            at = leaf(0.0)
            goes_left = codes[rows, f] <= k
            nodes["feature"][at], nodes["threshold"][at] = f, float(edges[f][k])
            nodes["left"][at] = grow(rows[goes_left], level + 1, slope, curve)
            nodes["right"][at] = grow(rows[~goes_left], level + 1, slope, curve)
            return at

        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            roots.append(grow(np.arange(len(y)), 0, weight * (p - y), weight * p * (1 - p)))
    return Trees(
        np.array(nodes["feature"], np.int32),
        np.array(nodes["threshold"], np.float64),
        np.array(nodes["left"], np.int32),
        np.array(nodes["right"], np.int32),
        np.array(nodes["value"], np.float64),
        np.array(roots, np.int32),
        depth,
        base,
    )
