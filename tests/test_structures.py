from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.operators import merging, points, pricing, quantizers, raster


def _points(n: int, seed: int = 1):
    rng = np.random.default_rng(seed)
    p = np.unique(rng.integers(0, 256, (n, 3)), axis=0).astype(float)
    return p, rng.integers(1, 9, len(p)).astype(float)


def _error(p, w, centres):
    return float(w @ ((p[:, None] - centres[None]) ** 2).sum(2).min(1))


@pytest.mark.parametrize("method", [quantizers.median_cut, quantizers.divisive, quantizers.ward, quantizers.tree_cut, quantizers.anneal])
def test_palettes_have_n_entries_and_beat_the_mean(method):
    p, w = _points(300)
    got = method(p, w, 8)
    assert got.shape == (8, 3)
    assert _error(p, w, got) < _error(p, w, (w @ p / w.sum())[None])


def test_median_cut_by_hand():
    p = np.array([[0, 0, 0], [10, 0, 0], [200, 0, 0], [250, 0, 0]], float)
    got = quantizers.median_cut(p, np.array([1.0, 1, 1, 1]), 2)
    assert got.tolist() == [[5, 0, 0], [225, 0, 0]]


def test_ward_equals_brute_force():
    p, w = _points(40, 2)
    groups = [([i], p[i], w[i]) for i in range(len(p))]
    while len(groups) > 6:
        cost = {(i, j): a[2] * b[2] / (a[2] + b[2]) * ((a[1] - b[1]) ** 2).sum() for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j}
        i, j = min(cost, key=cost.get)
        a, b = groups[i], groups[j]
        groups[i] = (a[0] + b[0], (a[1] * a[2] + b[1] * b[2]) / (a[2] + b[2]), a[2] + b[2])
        del groups[j]
    want = sorted(tuple(g[1].round(6)) for g in groups)
    assert sorted(tuple(r.round(6)) for r in quantizers.ward(p, w, 6)) == want


def test_tree_cut_separates_far_groups():
    p = np.concatenate([np.arange(5)[:, None] + c for c in (0, 100, 200)]).astype(float) * np.ones(3)
    got = quantizers.tree_cut(p, np.ones(len(p)), 3)
    assert sorted(got[:, 0].tolist()) == [2, 102, 202]


def test_bins_stay_under_the_cap():
    p, w = _points(3000, 3)
    q, v = quantizers.binned(p, w, 500)
    assert len(q) <= 500 and v.sum() == w.sum()


def test_few_points_are_the_palette(spark):
    rows = spark.createDataFrame([("a", 1, 2, 3, 5), (None, 7, 7, 7, 1)], "image string, r int, g int, b int, cnt long")
    got = sorted((str(r.image), r.idx, r.r, r.g, r.b) for r in quantizers.palettes(rows, ["image"], 4).collect())
    assert got == [("None", 0, 7, 7, 7), ("a", 0, 1, 2, 3)]
    assert quantizers.palettes(rows.limit(0), ["image"], 4).count() == 0


def test_greedy_merge_equals_brute_force():
    rng = random.Random(4)
    n = 12
    area, sums = [rng.randint(1, 9) for _ in range(n)], [[rng.randint(0, 99) * 1.0] for _ in range(n)]
    edges = [(i, i + 1, rng.randint(1, 5) * 1.0) for i in range(n - 1)] + [(i, i + 4, 2.0) for i in range(n - 4)]
    groups = [{i} for i in range(n)]

    def price(a, b):
        length = sum(e[2] for e in edges if (e[0] in a and e[1] in b) or (e[0] in b and e[1] in a))
        if not length:
            return math.inf
        (wa, sa), (wb, sb) = ((sum(area[i] for i in g), sum(sums[i][0] for i in g)) for g in (a, b))
        return wa * wb / (wa + wb) * (sa / wa - sb / wb) ** 2 / length

    while len(groups) > 4:
        a, b = min(((a, b) for i, a in enumerate(groups) for b in groups[i + 1 :]), key=lambda ab: price(*ab))
        groups = [g for g in groups if g not in (a, b)] + [a | b]
    (stop, roots, _) = next(merging.greedy(np.array(area), np.array(sums), edges, [4]))
    got = {frozenset(i for i in range(n) if roots[i] == r) for r in roots}
    assert stop == 4 and got == {frozenset(g) for g in groups}


def test_segmentation(spark):
    edges = spark.createDataFrame([(0, 0, 1, 0.0), (0, 1, 2, 9.0), (0, 2, 3, 0.0), (0, 3, 4, 8.0)], "image int, a long, b long, weight double")
    got = {r.node: r.segment for r in merging.segment(edges, 1.0, 1).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    got = {r.node: r.segment for r in merging.segment(edges, 1.0, 2).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2}


def test_cells_are_exact(spark):
    rng = random.Random(5)
    pal = spark.createDataFrame([(i, *(rng.randrange(256) for _ in range(3))) for i in range(9)] + [(9, 40, 40, 40), (10, 40, 40, 40)], "idx long, r int, g int, b int")
    pts = spark.createDataFrame([(i, *(rng.randrange(256) for _ in range(3))) for i in range(400)] + [(400, 40, 41, 40)], "key int, r int, g int, b int")
    centres = {r.idx: (r.r, r.g, r.b) for r in pal.collect()}
    want = {r.key: min((sum((a - b) ** 2 for a, b in zip((r.r, r.g, r.b), c)), i) for i, c in centres.items()) for r in pts.collect()}
    assert {r.key: (r.d, r.idx) for r in points.nearest_by_cells(pts, pal, 4, ["key"]).collect()} == want


def test_exclusion_and_hierarchy_equal_sequential(spark):
    rng = random.Random(6)
    stream = [(i, rng.randrange(3), rng.randrange(4)) for i in range(200)]
    stream = [(i, c, s, sorted({s, rng.randrange(4), rng.randrange(4)})) for i, c, s in stream]
    seen, bits, nested = {}, 0.0, 0.0
    flat = [0] * 4
    for _, c, s, allowed in stream:
        counts = seen.setdefault(c, [0] * 4)
        bits -= math.log2((counts[s] + 0.5) / sum(counts[k] + 0.5 for k in allowed))
        p = (flat[s] + 3 * 0.25) / (sum(flat) + 3)
        nested -= math.log2((counts[s] + 3 * p) / (sum(counts) + 3))
        counts[s] += 1
        flat[s] += 1
    rows = spark.createDataFrame(stream, "i int, c int, s int, allowed array<int>").withColumn("g", F.lit(1))
    got = pricing.exclusion_bits(rows, ["g"], ["c"], ["i"], "s", "allowed", 4, 0.5).first()
    assert abs(got.bits - bits) < 1e-8 and got.n == 200
    assert abs(pricing.hierarchy_bits(rows, ["g"], [[], ["c"]], ["i"], "s", 4, 3.0).first().bits - nested) < 1e-8
    barred = rows.withColumn("allowed", F.array(F.lit(9)))
    assert math.isinf(pricing.exclusion_bits(barred, ["g"], ["c"], ["i"], "s", "allowed", 4).first().bits)


@pytest.mark.parametrize("chance", [0.0, 0.001, 0.5, 0.97, 1.0])
@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_range_coder_round_trip(n, chance):
    rng = random.Random(n)
    bits = [int(rng.random() < chance) for _ in range(n)]
    blob = pricing.range_encode(bits)
    assert pricing.range_decode(blob, n) == bits
    if n == 5000 and chance in (0.001, 1.0):
        assert len(blob) < 60


def test_coded_blocks(spark):
    rows = spark.range(700).select((F.col("id") % 2).alias("chain"), "id", (F.col("id") % 3 == 0).cast("int").alias("bit"))
    back = pricing.decoded_blocks(pricing.coded_blocks(rows, ["chain"], ["id"], "bit", 100)).collect()
    assert len(back) == 8
    for chain in (0, 1):
        bits = [b for r in sorted((r for r in back if r.chain == chain), key=lambda r: r.block) for b in r.bits]
        assert bits == [int(i % 3 == 0) for i in range(700) if i % 2 == chain]


def test_components_of_a_tall_serpentine(spark):
    high, wide = 60, 7
    path = lambda x, y: x % 2 == 0 or y == (high - 1 if x % 4 == 1 else 0)
    cells = [(1, x, y, int(path(x, y))) for x in range(wide) for y in range(high)]
    got = raster.components(spark.createDataFrame(cells, "image int, x int, y int, lab int"))
    regions = {(r.lab, r.component, r.n) for r in got.groupBy("lab", "component").agg(F.count("*").alias("n")).collect()}
    assert regions == {(1, 0, 4 * high + 3), (0, 1, high - 1), (0, 3, high - 1), (0, 2, high - 1)}


def test_components_raise_when_not_settled(spark):
    cells = [(1, x, y, int(x != 1 or y == 9)) for x in range(3) for y in range(10)]
    with pytest.raises(RuntimeError):
        raster.components(spark.createDataFrame(cells, "image int, x int, y int, lab int"), rounds=1)
