"""Palettes by splitting, merging, cutting and annealing, one group's histogram at a time.

Every method works on distinct weighted points, so a group holds at most 2^24 rows however many pixels it stands
for; merging, cutting and annealing first reduce it to at most `cap` bins. Ties go to the earlier point in the
order of (r, g, b) and to the earlier box or cluster. A group with no more points than entries is its own palette.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merging import Sets

#: Annealing starts and ends at these temperatures (fixed values).
HOT, COLD = 0.02, 2e-5


def binned(p: np.ndarray, w: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted means of the finest cells, 0 to 6 bits coarser, of which there are at most cap."""
    for shift in range(7):
        _, cell = np.unique(p.astype(np.int64) >> shift, axis=0, return_inverse=True)
        cell = cell.ravel()
        if cell.max() < cap or shift == 6:
            break
    return _means(p, w, cell)


def _means(p: np.ndarray, w: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.bincount(group, w)
    return np.stack([np.bincount(group, w * p[:, c]) / total for c in range(p.shape[1])], 1), total


def _half(w: np.ndarray, half: float) -> int:
    """Points up to the one whose running weight reaches half; neither side is empty."""
    return min(max(int(np.searchsorted(np.cumsum(w), half)) + 1, 1), len(w) - 1)


def _boxes(p: np.ndarray, w: np.ndarray, n: int, weigh: Callable, cut: Callable) -> list[np.ndarray]:
    """Splits the heaviest box that holds two points or more until there are n."""
    boxes = [np.arange(len(p))]
    score = [weigh(p, w)]
    while len(boxes) < n:
        best = max((i for i, b in enumerate(boxes) if len(b) > 1), key=lambda i: (score[i], -i), default=None)
        if best is None:
            break
        b = boxes[best]
        order, at = cut(p[b], w[b])
        sides = b[order[:at]], b[order[at:]]
        boxes[best] = sides[0]
        boxes.append(sides[1])
        score[best], more = (weigh(p[s], w[s]) for s in sides)
        score.append(more)
    return boxes


def median_cut(p: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Splits the most populous box at the median of its longest channel; means in whole numbers."""

    def cut(p, w):
        order = np.argsort(p[:, int(np.argmax(np.ptp(p, axis=0)))], kind="stable")
        return order, _half(w[order], w.sum() // 2)

    return np.array([np.floor(w[b] @ p[b] / w[b].sum()) for b in _boxes(p, w, n, lambda p, w: w.sum(), cut)])


def _error(p: np.ndarray, w: np.ndarray) -> float:
    return float(w @ ((p - w @ p / w.sum()) ** 2).sum(1))


def principal_axis(p: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The direction of greatest spread, by 32 power steps from (1, 1, 1)."""
    d = p - w @ p / w.sum()
    cov, v = (d * w[:, None]).T @ d / w.sum(), np.ones(p.shape[1])
    for _ in range(32):
        v = cov @ v
        norm = np.linalg.norm(v)
        if norm == 0:
            return np.eye(p.shape[1])[0]
        v = v / norm
    return v


def divisive(p: np.ndarray, w: np.ndarray, n: int, principal: bool = True) -> np.ndarray:
    """Splits the box of largest squared error at the median along its principal or its longest axis."""

    def cut(p, w):
        axis = principal_axis(p, w) if principal else np.eye(p.shape[1])[int(np.argmax(np.ptp(p, axis=0)))]
        order = np.argsort((p - w @ p / w.sum()) @ axis, kind="stable")
        return order, _half(w[order], w.sum() / 2)

    return np.array([w[b] @ p[b] / w[b].sum() for b in _boxes(p, w, n, _error, cut)])


def ward(p: np.ndarray, w: np.ndarray, n: int, cap: int = 2000) -> np.ndarray:
    """Merges the pair of clusters that adds the least squared error until n are left."""
    p, w = binned(p, w, cap)
    p, w = p.copy(), w.copy()
    cost = w[:, None] * w[None, :] / (w[:, None] + w[None, :]) * ((p[:, None] - p[None]) ** 2).sum(2)
    np.fill_diagonal(cost, np.inf)
    least, near, alive = cost.min(1), cost.argmin(1), np.ones(len(p), bool)
    for _ in range(len(p) - n):
        a = int(np.argmin(least))
        b = int(near[a])
        p[a] = (w[a] * p[a] + w[b] * p[b]) / (w[a] + w[b])
        w[a] += w[b]
        alive[b], least[b] = False, np.inf
        cost[b, :] = cost[:, b] = np.inf
        row = np.where(alive, w[a] * w / (w[a] + w) * ((p - p[a]) ** 2).sum(1), np.inf)
        row[a] = np.inf
        cost[a, :] = cost[:, a] = row
        again = np.flatnonzero(alive & ((near == a) | (near == b) | (row < least)))
        for i in {a, *again.tolist()}:
            near[i] = int(np.argmin(cost[i]))
            least[i] = cost[i, near[i]]
    return p[alive]


def tree_cut(p: np.ndarray, w: np.ndarray, n: int, cap: int = 1500) -> np.ndarray:
    """Cuts the n - 1 longest edges of a least spanning tree; the means of what is left connected."""
    p, w = binned(p, w, cap)
    best, source = ((p - p[0]) ** 2).sum(1), np.zeros(len(p), int)
    best[0] = np.inf
    edges = []
    outside = np.ones(len(p), bool)
    outside[0] = False
    for _ in range(len(p) - 1):
        v = int(np.argmin(np.where(outside, best, np.inf)))
        edges.append((float(best[v]), len(edges), int(source[v]), v))
        outside[v] = False
        d = ((p - p[v]) ** 2).sum(1)
        closer = outside & (d < best)
        best[closer], source[closer] = d[closer], v
    sets = Sets(len(p))
    for _, _, a, b in sorted(edges)[: max(0, len(edges) - (n - 1))]:
        sets.unite(a, b)
    _, group = np.unique([sets.find(i) for i in range(len(p))], return_inverse=True)
    return _means(p, w, group)[0]


def anneal(p: np.ndarray, w: np.ndarray, n: int, steps: int = 40, cap: int = 1500, scale: float = 255.0) -> np.ndarray:
    """Soft assignment at geometrically falling temperature, from the median-cut palette; distances over `scale`."""
    centres = median_cut(p, w, n) / scale
    p, w = binned(p, w, cap)
    p = p / scale
    for t in HOT * (COLD / HOT) ** (np.arange(steps) / steps):
        d = ((p[:, None] - centres[None]) ** 2).sum(2)
        soft = np.exp(-d / t)
        total = soft.sum(1)
        soft = np.where(total[:, None] > 0, soft / np.where(total > 0, total, 1)[:, None], 0) * w[:, None]
        mass = soft.sum(0)
        centres = np.where(mass[:, None] > 0, soft.T @ p / np.where(mass > 0, mass, 1)[:, None], centres)
    return centres * scale


def palettes(hist: DataFrame, by: list[str], n: int, method: Callable = median_cut) -> DataFrame:
    """palette(by..., idx, r, g, b) from a histogram(by..., r, g, b, cnt): at most n entries a group."""
    types = dict(hist.dtypes)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["r", "g", "b"])
        p, w = rows[["r", "g", "b"]].to_numpy(float), rows.cnt.to_numpy(float)
        got = p if len(p) <= n else method(p, w, n)
        out = pd.DataFrame(got, columns=["r", "g", "b"])
        out.insert(0, "idx", range(len(out)))
        for k in reversed(by):
            out.insert(0, k, rows[k].iloc[0])
        return out

    schema = ", ".join([f"{k} {types[k]}" for k in by] + ["idx int", "r double", "g double", "b double"])
    return hist.select(*by, "r", "g", "b", F.col("cnt")).groupBy(*by).applyInPandas(one, schema)
