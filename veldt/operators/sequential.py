"""Models whose every step depends on the one before: in-place relaxation of labels, logistic mixing, sizes under
general compressors. One task an image, chain or item set; such a unit is the most that one task holds."""

from __future__ import annotations

import bz2
import gzip
import lzma
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZES: dict[str, Callable[[bytes], int]] = {
    "gzip": lambda b: len(gzip.compress(b, 9, mtime=0)),
    "bz2": lambda b: len(bz2.compress(b, 9)),
    "xz": lambda b: len(lzma.compress(b, preset=9)),
    "zstd": lambda b: len(zstandard.ZstdCompressor(level=19).compress(b)),
}


def _touching(labels: np.ndarray, y: int, x: int) -> list[int]:
    h, w = labels.shape
    return [int(labels[v, u]) for v, u in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)) if 0 <= v < h and 0 <= u < w]


def relaxed(labels: np.ndarray, colours: np.ndarray, price: float, sweeps: int) -> np.ndarray:
    """Labels (h, w) after sweeps in raster order: a pixel goes to the neighbouring region that lowers squared error plus
    price times boundary most, by more than 1e-9 (smallest label on ties); means follow each move, a region keeps its
    last pixel, and a sweep without moves is the last."""
    labels = labels.copy()
    area: dict[int, float] = {}
    total: dict[int, np.ndarray] = {}
    for lab, c in zip(labels.ravel().tolist(), colours.reshape(-1, colours.shape[-1]).astype(float), strict=True):
        area[lab] = area.get(lab, 0) + 1
        total[lab] = total.get(lab, 0) + c

    def misfit(pixel: np.ndarray, lab: int) -> float:
        d = pixel - total[lab] / area[lab]
        return float(d @ d)

    for _ in range(sweeps):
        moved = False
        for y, x in np.ndindex(labels.shape):
            own, near, pixel = int(labels[y, x]), _touching(labels, y, x), colours[y, x].astype(float)
            others = sorted(set(near) - {own})
            if area[own] <= 1 or not others:
                continue
            leave = -area[own] / (area[own] - 1) * misfit(pixel, own) + price * near.count(own)
            gain, best = min((leave + area[r] / (area[r] + 1) * misfit(pixel, r) - price * near.count(r), r) for r in others)
            if gain < -1e-9:
                labels[y, x], moved = best, True
                for lab, sign in ((own, -1), (best, 1)):
                    area[lab] += sign
                    total[lab] = total[lab] + sign * pixel
        if not moved:
            break
    return labels


def relax(px: DataFrame, price: float, sweeps: int = 8) -> DataFrame:
    """px(image, x, y, r, g, b, lab), whole rectangles -> image, x, y, lab; components of the result are the regions."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x"])
        shape = rows.y.nunique(), rows.x.nunique()
        if shape[0] * shape[1] != len(rows):
            raise ValueError("the image is not a whole rectangle")
        got = relaxed(rows.lab.to_numpy().reshape(shape), rows[["r", "g", "b"]].to_numpy().reshape(*shape, 3), price, sweeps)
        return pd.DataFrame({"image": rows.image, "x": rows.x, "y": rows.y, "lab": got.ravel()})

    types = dict(px.dtypes)
    return px.select("image", "x", "y", "r", "g", "b", "lab").groupBy("image").applyInPandas(one, ", ".join(f"{c} {types[c]}" for c in ("image", "x", "y", "lab")))


#: Fixed values of the mixing coder: first weight, floor of a model's rate, visits that halve its trust.
FIRST_WEIGHT, LEAST_RATE, TRUST = 0.3, 0.02, 4.0


def mixed_bits(symbols: list[int], contexts: list[list], rate: float, width: int) -> float:
    """Bits of symbols of `width` bits, high bit first: each context's chance of a one is stretched, weighed by trust and
    by weights learned for each node of the symbol's tree, and squashed; then all are updated. contexts[i][t] is the
    context of model i at symbol t."""
    chance: list[dict] = [{} for _ in contexts]
    weights = {node: [FIRST_WEIGHT] * len(contexts) for node in range(1, 1 << width)}
    bits = 0.0
    for t, symbol in enumerate(symbols):
        node = 1
        for place in reversed(range(width)):
            one = symbol >> place & 1
            seen = [m.setdefault((c[t], node), [0.5, 0]) for m, c in zip(chance, contexts, strict=True)]
            pulls = []
            for p, n in seen:
                q = min(max(p, 1e-6), 1 - 1e-6)
                pulls.append(math.log(q / (1 - q)) * n / (n + TRUST))
            own = weights[node]
            dot = sum(a * b for a, b in zip(own, pulls, strict=True))
            p = min(max(1 / (1 + math.exp(-dot)), 1e-6), 1 - 1e-6)
            bits -= math.log2(p if one else 1 - p)
            weights[node] = [a + rate * (one - p) * b for a, b in zip(own, pulls, strict=True)]
            for s in seen:
                s[0] += (one - s[0]) * max(1 / (s[1] + 1.5), LEAST_RATE)
                s[1] += 1
            node = 2 * node + one
    return bits


def mixing_bits(rows: DataFrame, by: list[str], order: list[str], symbol: str, contexts: list[str], rate: float = 0.02, width: int = 4) -> DataFrame:
    """by..., bits, n of a mixing coder over each group's rows in order."""
    types = dict(rows.dtypes)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        bits = mixed_bits(part[symbol].tolist(), [part[c].tolist() for c in contexts], rate, width)
        return pd.DataFrame([[*part[by].iloc[0], bits, len(part)]], columns=[*by, "bits", "n"])

    kept = list(dict.fromkeys([*by, *order, symbol, *contexts]))
    return rows.select(*kept).groupBy(*by).applyInPandas(one, ", ".join(f"{c} {types[c]}" for c in by) + ", bits double, n long")


def compressed_sizes(rows: DataFrame, by: list[str], order: list[str], value: str, bytes_each: int = 2) -> DataFrame:
    """Size of each group's values, in order, as little-endian integers: raw and under every general compressor."""
    types = dict(rows.dtypes)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        data = part[value].to_numpy().astype(f"<u{bytes_each}").tobytes()
        return pd.DataFrame([[*part[by].iloc[0], len(data), *[f(data) for f in SIZES.values()]]], columns=[*by, "raw", *SIZES])

    schema = ", ".join(f"{c} {types[c]}" for c in by) + ", raw long, " + ", ".join(f"{n} long" for n in SIZES)
    return rows.select(*by, *order, value).groupBy(*by).applyInPandas(one, schema)


def leave_one_out(items: DataFrame, by: list[str], item: str, data: str, level: int = 19, limit: int = 256 << 20) -> DataFrame:
    """by..., item, solo, with_others: an item's size alone, and with all others of its group as a dictionary (zstd).
    Every item of a group is compressed against all others, so a group's bytes are checked against a limit."""
    types = dict(items.dtypes)
    sized = items.groupBy(*by).agg(F.sum(F.octet_length(data)).alias("n")).agg(F.max("n")).first()[0]
    if sized is not None and sized > limit:
        raise ValueError(f"a group of {sized} bytes is beyond {limit}")

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(item)
        blobs = [bytes(b) if isinstance(b, (bytes, bytearray)) else (b or "").encode() for b in part[data]]
        plain, out = zstandard.ZstdCompressor(level=level), []
        for i, (name, b) in enumerate(zip(part[item], blobs, strict=True)):
            others = b"".join(blobs[:i] + blobs[i + 1 :])
            helped = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(others, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) if len(others) >= 8 else plain
            out.append([*part[by].iloc[0], name, len(plain.compress(b)), len(helped.compress(b))])
        return pd.DataFrame(out, columns=[*by, item, "solo", "with_others"])

    schema = ", ".join(f"{c} {types[c]}" for c in [*by, item]) + ", solo long, with_others long"
    return items.select(*by, item, data).groupBy(*by).applyInPandas(one, schema)
