"""Sequential work on one image's region graph: greedy merges and graph segmentation, one task an image.

Images are the unit of distribution. A group holds the regions (or cells) and edges of one image, whose size the
raster bounds; no group spans images.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Sets:
    """Disjoint sets over 0..n-1; the smaller set joins the larger one."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))
        self.size = [1] * n

    def find(self, a: int) -> int:
        root = a
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[a] != root:
            self.parent[a], a = root, self.parent[a]
        return root

    def unite(self, a: int, b: int) -> int:
        a, b = self.find(a), self.find(b)
        if a != b:
            if self.size[a] < self.size[b]:
                a, b = b, a
            self.parent[b] = a
            self.size[a] += self.size[b]
        return a


def potts_key(cost: float, length: float) -> float:
    """Added squared error for each unit of removed boundary."""
    return cost / length


def rate_key(cost: float, length: float) -> float:
    """Added squared error for each bit saved: 1.73 a boundary unit, 25 a region (fixed values)."""
    return cost / (1.73 * length + 25)


def greedy(area: np.ndarray, sums: np.ndarray, edges: list[tuple[int, int, float]], stops: list[int], key: Callable = potts_key):
    """Merges the cheapest touching pair until each count of regions in `stops` is met; ties to smaller indexes.

    Yields (stop, root of every region, total added squared error). Entries of the heap carry the versions of both
    ends and are void once either has changed, so the least entry is always priced as things stand.
    """
    area, sums = area.astype(float), sums.astype(float)
    near: list[dict[int, float]] = [{} for _ in area]
    for a, b, length in edges:
        near[a][b] = near[a].get(b, 0.0) + length
        near[b][a] = near[a][b]
    version, sets, left, error = [0] * len(area), Sets(len(area)), len(area), 0.0

    def cost(a: int, b: int) -> float:
        gap = sums[a] / area[a] - sums[b] / area[b]
        return area[a] * area[b] / (area[a] + area[b]) * float(gap @ gap)

    def entry(a: int, b: int) -> tuple:
        a, b = min(a, b), max(a, b)
        return key(cost(a, b), near[a][b]), a, b, version[a], version[b]

    heap = [entry(a, b) for a in range(len(area)) for b in near[a] if a < b]
    heapq.heapify(heap)
    for stop in sorted(set(stops), reverse=True):
        while left > stop and heap:
            _, a, b, va, vb = heapq.heappop(heap)
            if version[a] != va or version[b] != vb:
                continue
            error += cost(a, b)
            keep = sets.unite(a, b)
            gone = b if keep == a else a
            area[keep] += area[gone]
            sums[keep] += sums[gone]
            version[keep] += 1
            version[gone] += 1
            near[keep].pop(gone)
            for other, length in near[gone].items():
                if other != keep:
                    del near[other][gone]
                    near[keep][other] = near[keep].get(other, 0.0) + length
                    near[other][keep] = near[keep][other]
            near[gone] = {}
            left -= 1
            for other in near[keep]:
                heapq.heappush(heap, entry(keep, other))
        yield stop, [sets.find(i) for i in range(len(area))], error


def merge_regions(regions: DataFrame, rag: DataFrame, stops: list[int], channels: tuple[str, ...] = ("r", "g", "b"), key: Callable = potts_key) -> DataFrame:
    """merged(image, mark, region, root, error) from regions(image, lab, area, channel sums) and rag(image, a, b, len).

    One snapshot for each region count in `stops`; root is the smallest region of its merged set.
    """
    sums = F.array(*[F.col(c).cast("double") for c in channels])
    nodes = regions.select("image", F.col("lab").cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.col("area").cast("double").alias("len"), sums.alias("sums"))
    links = rag.filter("a < b").select("image", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("len").cast("double").alias("len"), F.lit(None).cast("array<double>").alias("sums"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows.b < 0].sort_values("a")
        place = {r: i for i, r in enumerate(own.a)}
        ends = rows[rows.b >= 0].sort_values(["a", "b"])
        edges = [(place[a], place[b], n) for a, b, n in zip(ends.a, ends.b, ends.len)]
        out = []
        names = own.a.to_numpy()
        for stop, roots, error in greedy(own.len.to_numpy(), np.stack(own.sums.tolist()), edges, stops, key):
            least: dict[int, int] = {}
            for name, root in zip(names, roots):
                least.setdefault(root, int(name))
            out.append(pd.DataFrame({"image": rows.image.iloc[0], "mark": stop, "region": names, "root": [least[r] for r in roots], "error": error}))
        return pd.concat(out)

    schema = f"image {dict(regions.dtypes)['image']}, mark int, region long, root long, error double"
    return nodes.union(links).groupBy("image").applyInPandas(one, schema)


def segment(edges: DataFrame, k: float, min_size: int) -> DataFrame:
    """Graph segmentation: segments(image, node, segment) from edges(image, a, b, weight).

    Edges come by weight (ties: a, b). Two segments join if the weight is at most each one's largest inner weight
    plus k over its size; then segments smaller than min_size join across their lightest edge. A segment is named
    by its smallest node. A null image is a group of its own.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["weight", "a", "b"])
        names = np.unique(np.concatenate([rows.a, rows.b]))
        a, b = np.searchsorted(names, rows.a).tolist(), np.searchsorted(names, rows.b).tolist()
        sets, inner = Sets(len(names)), [0.0] * len(names)
        for p, q, w in zip(a, b, rows.weight.tolist()):
            p, q = sets.find(p), sets.find(q)
            if p != q and w <= min(inner[p] + k / sets.size[p], inner[q] + k / sets.size[q]):
                inner[sets.unite(p, q)] = w
        for p, q in zip(a, b):
            p, q = sets.find(p), sets.find(q)
            if p != q and min(sets.size[p], sets.size[q]) < min_size:
                sets.unite(p, q)
        roots = [sets.find(i) for i in range(len(names))]
        least: dict[int, int] = {}
        for name, root in zip(names.tolist(), roots):
            least.setdefault(root, name)
        return pd.DataFrame({"image": rows.image.iloc[0], "node": names, "segment": [least[r] for r in roots]})

    flat = edges.select("image", F.col("a").cast("long"), F.col("b").cast("long"), F.col("weight").cast("double"))
    return flat.groupBy("image").applyInPandas(one, f"image {dict(edges.dtypes)['image']}, node long, segment long")
