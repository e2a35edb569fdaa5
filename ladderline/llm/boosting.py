"""Gradient-boosted trees over a few dense features, and isotonic calibration; fitted on bounded samples in the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Forest:
    """Trees of a logistic model. A tree is nested: a leaf's value, or (feature, threshold, left, right); left is value <= threshold."""

    start: float
    trees: list = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            self._add(tree, x, np.arange(len(x)), out)
        return out

    def _add(self, tree, x, rows, out) -> None:
        if not isinstance(tree, tuple):
            out[rows] += tree
            return
        left = x[rows, tree[0]] <= tree[1]
        self._add(tree[2], x, rows[left], out)
        self._add(tree[3], x, rows[~left], out)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))

    def sql(self, names: list[str]) -> str:
        """The raw score as a SQL expression over these names."""

        def node(t) -> str:
            return f"CASE WHEN {names[t[0]]} <= {float(t[1])!r}D THEN {node(t[2])} ELSE {node(t[3])} END" if isinstance(t, tuple) else f"{float(t)!r}D"

        return " + ".join([f"{self.start!r}D", *(f"({node(t)})" for t in self.trees)])


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 5.0) -> Forest:
    """Histogram boosting with the second-order gain; deterministic."""
    n, d = x.shape
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    forest = Forest(float(np.log(mean / (1 - mean))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(d)]
    codes = [np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]  # code k: value <= cuts[k]
    score = np.full(n, forest.start)

    def grow(rows, g, h, level):
        gs, hs = g[rows].sum(), h[rows].sum()
        value = -rate * gs / (hs + 1)
        if level == depth or len(rows) < 2 * least:
            return float(value)
        best = (1e-6, None, None)
        for j in range(d):
            if not len(cuts[j]):
                continue
            size = len(cuts[j]) + 1
            c = codes[j][rows]
            cg, ch, cn = (np.cumsum(np.bincount(c, w, size))[:-1] for w in (g[rows], h[rows], None))
            ok = (cn >= least) & (len(rows) - cn >= least)
            if not ok.any():
                continue
            gain = np.where(ok, cg**2 / (ch + 1) + (gs - cg) ** 2 / (hs - ch + 1) - gs**2 / (hs + 1), -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        if best[1] is None:
            return float(value)
        left = codes[best[1]][rows] <= best[2]
        return (best[1], float(cuts[best[1]][best[2]]), grow(rows[left], g, h, level + 1), grow(rows[~left], g, h, level + 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(n), p - y, p * (1 - p) + 1e-6, 0)
        forest.trees.append(tree)
        forest._add(tree, x, np.arange(n), score)
    return forest


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone function nearest to the labels (pool adjacent violators), for np.interp."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, least and greatest score
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(s), float(s)])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + top[0], blocks[-1][1] + top[1], blocks[-1][2], top[3]]
    xs = [v for b in blocks for v in (b[2], b[3])]
    ys = [b[0] / b[1] for b in blocks for _ in range(2)]
    return np.array(xs), np.array(ys)
