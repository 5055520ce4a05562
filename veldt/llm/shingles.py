"""Word shingles of whole texts as sorted 64-bit hashes, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .tokens import _BASE, _CODE, powers, text_bytes

BLOCK = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _words(raw: np.ndarray, bounds: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, number of words of each text; A-Z count as a-z."""
    n = len(raw)
    solid = ~_SPACE[raw]
    first = np.zeros(n + 1, bool)
    first[bounds[:-1]] = True
    first = first[:n]
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first))
    stop = np.flatnonzero(before & (~solid | first))
    ends = np.append(stop, n) if len(stop) < len(starts) else stop
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_CODE[_LOWER[raw]] * up[:n], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, bounds))


def sets(column, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """column: an Arrow string array. Yields (index of the first text, flat shingle hashes, set sizes); the hashes
    of a text are distinct and ascend. A text with fewer words than width has one shingle, its whole sequence;
    a text without words has none."""
    raw, offsets = text_bytes(column)
    i, n = 0, len(offsets) - 1
    up = down = np.empty(0, np.uint64)
    while i < n:
        j = min(max(int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1, i + 1), n)
        own, bounds = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if len(own) > len(up):
            up, down = powers(_BASE, len(own)), powers(pow(_BASE, -1, 1 << 64), len(own))
        words, counts = _words(own, bounds, up, down)
        begin = np.concatenate([[0], np.cumsum(counts)])
        size = np.where(counts == 0, 0, np.maximum(1, counts - width + 1))
        owner = np.repeat(np.arange(j - i), size)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + begin[owner]
        here = np.minimum(counts[owner], width)
        with np.errstate(over="ignore"):
            value = here.astype(np.uint64)
            for k in range(width):
                word = words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else words
                value = np.where(k < here, mix(value * _MULT + word), value)
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        keep = np.ones(len(value), bool)
        keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        yield i, value[keep], np.bincount(owner[keep], minlength=j - i)
        i = j
