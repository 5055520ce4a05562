"""Weighted k-means over a group's histogram, with several seedings, restarts and a HyAB variant.

Functions take points (m x 3), weights (m) and the number of centres, as quantizers.palettes calls them: one task a
group, bounded by its distinct colours. Draws come from a hash of (seed, draw), so reruns and retried tasks agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np

#: Distances are worked out for this many points at a time.
BLOCK = 65_536


def draw(seed: int, number: int) -> float:
    """A number from 0 up to 1, the same in every run."""
    return int.from_bytes(hashlib.blake2b(f"{seed}:{number}".encode(), digest_size=7).digest(), "big") / 2**56


def squared(p: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((p[:, None] - centres[None]) ** 2).sum(2)


def hyab(p: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = p[:, None] - centres[None]
    return np.abs(d[..., 0]) + np.hypot(d[..., 1], d[..., 2])


def nearest(p: np.ndarray, centres: np.ndarray, distance: Callable = squared) -> tuple[np.ndarray, np.ndarray]:
    """Place and distance of the nearest centre of each point; ties go to the first."""
    at, far = np.empty(len(p), np.int64), np.empty(len(p))
    for i in range(0, len(p), BLOCK):
        d = distance(p[i : i + BLOCK], centres)
        at[i : i + BLOCK] = d.argmin(1)
        far[i : i + BLOCK] = d.min(1)
    return at, far


def random_seeds(p: np.ndarray, w: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """n different points, all equally likely, whatever they weigh."""
    order = sorted(range(len(p)), key=lambda i: (draw(seed, i), i))
    return p[order[:n]].astype(float)


def spread_seeds(p: np.ndarray, w: np.ndarray, n: int, seed: int | None = None) -> np.ndarray:
    """Each next point drawn by weight times squared distance to those chosen. The first is the heaviest, or with a seed
    any point. Fewer than n if no point is left apart from them."""
    first = int(np.argmax(w)) if seed is None else int(draw(seed, 0) * len(p))
    chosen, far = [first], ((p - p[first]) ** 2).sum(1).astype(float)
    while len(chosen) < n:
        upto = np.cumsum(far * w)
        if upto[-1] <= 0:
            break
        pick = min(int(np.searchsorted(upto, draw(1 if seed is None else seed, len(chosen)) * upto[-1])), len(p) - 1)
        chosen.append(pick)
        far = np.minimum(far, ((p - p[pick]) ** 2).sum(1))
    return p[chosen].astype(float)


def farthest_seeds(p: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """The heaviest point, then each time the one farthest from all chosen; the first wins ties."""
    chosen = [int(np.argmax(w))]
    far = ((p - p[chosen[0]]) ** 2).sum(1).astype(float)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((p - p[chosen[-1]]) ** 2).sum(1))
    return p[chosen].astype(float)


def _pulls(w: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Weights times a half plus each distance over the weighted mean distance (over 1 where all distances are 0)."""
    d = np.sqrt(far)
    return w * (0.5 + d / ((d * w).sum() / w.sum() or 1.0))


def lloyd(p: np.ndarray, w: np.ndarray, centres: np.ndarray, rounds: int = 10, by_error: bool = False) -> np.ndarray:
    """Moves centres to the weighted means of their points; one without points stays. By error, points that are served
    badly pull harder."""
    for _ in range(rounds):
        at, far = nearest(p, centres)
        pull = _pulls(w, far) if by_error else w
        total = np.bincount(at, pull, len(centres))
        sums = np.stack([np.bincount(at, pull * p[:, c], len(centres)) for c in range(p.shape[1])], 1)
        centres = np.where(total[:, None] > 0, sums / np.where(total > 0, total, 1)[:, None], centres)
    return centres


def error(p: np.ndarray, w: np.ndarray, centres: np.ndarray) -> float:
    return float((nearest(p, centres)[1] * w).sum())


def kmeans(p: np.ndarray, w: np.ndarray, n: int, seeds: Callable = farthest_seeds, rounds: int = 10, by_error: bool = False) -> np.ndarray:
    return lloyd(p, w, seeds(p, w, n), rounds, by_error)


def restarted(p: np.ndarray, w: np.ndarray, n: int, restarts: int = 4, rounds: int = 10) -> np.ndarray:
    """The result with the least error of several spread seedings, numbered from 1; the first wins ties."""
    runs = [lloyd(p, w, spread_seeds(p, w, n, k + 1), rounds) for k in range(restarts)]
    return min(runs, key=lambda c: error(p, w, c))


def weighted_median(v: np.ndarray, w: np.ndarray) -> float:
    """The first value, in order, at which the running weight reaches half."""
    order = np.argsort(v, kind="stable")
    upto = np.cumsum(w[order])
    return float(v[order][np.searchsorted(upto, upto[-1] / 2)])


def hyab_kmeans(p: np.ndarray, w: np.ndarray, n: int, seeds: Callable = farthest_seeds, rounds: int = 10) -> np.ndarray:
    """Under |d0| + hypot(d1, d2), on points whose first axis is lightness: median of it, mean of the others."""
    centres = seeds(p, w, n)
    for _ in range(rounds):
        at, _ = nearest(p, centres, hyab)
        for j in np.unique(at):
            own, weight = p[at == j], w[at == j]
            centres[j] = [weighted_median(own[:, 0], weight), *((own[:, 1:] * weight[:, None]).sum(0) / weight.sum())]
    return centres
