"""k-means variants, relaxation, mixing, compressors and readers on small fixtures, against plain versions."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
import zstandard

from veldt.operators import kmeans, sequential
from veldt.sources import views


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    middles = np.array([[20, 20, 20], [200, 30, 40], [60, 210, 90], [120, 120, 230]])
    p = np.unique(np.concatenate([m + rng.integers(-9, 9, (60, 3)) for m in middles]), axis=0).astype(float)
    return p, rng.integers(1, 9, len(p)).astype(float)


@pytest.mark.parametrize("seeds", [kmeans.farthest_seeds, kmeans.spread_seeds, kmeans.random_seeds])
def test_seeds_are_different_points(points, seeds):
    p, w = points
    got = seeds(p, w, 9)
    assert len({tuple(c) for c in got}) == 9 and {tuple(c) for c in got} <= {tuple(c) for c in p}
    assert (got == seeds(p, w, 9)).all()
    assert len(seeds(p[:2], w[:2], 9)) == 2


def test_farthest_seeds_by_hand(points):
    p, w = points
    chosen = [max(range(len(p)), key=lambda i: (w[i], -i))]
    while len(chosen) < 6:
        chosen.append(max(range(len(p)), key=lambda i: (min(sum((p[i][c] - p[j][c]) ** 2 for c in range(3)) for j in chosen), -i)))
    assert (kmeans.farthest_seeds(p, w, 6) == p[chosen]).all()


@pytest.mark.parametrize("by_error", [False, True])
def test_lloyd_by_hand(points, by_error):
    p, w = points
    centres = [list(c) for c in p[:5]]
    for _ in range(10):
        far = [[math.dist(a, c) for c in centres] for a in p]
        at = [d.index(min(d)) for d in far]
        mean = sum(min(d) * k for d, k in zip(far, w, strict=True)) / sum(w)
        pull = [k * (0.5 + min(d) / mean) if by_error else k for d, k in zip(far, w, strict=True)]
        groups = [[i for i in range(len(p)) if at[i] == j] for j in range(5)]
        centres = [[sum(pull[i] * p[i][c] for i in g) / sum(pull[i] for i in g) for c in range(3)] if g else centres[j] for j, g in enumerate(groups)]
    assert kmeans.lloyd(p, w, p[:5].copy(), by_error=by_error) == pytest.approx(np.array(centres))


def test_an_empty_centre_stays():
    p = np.array([[0.0, 0, 0], [1, 0, 0]])
    assert kmeans.lloyd(p, np.ones(2), np.array([[0.5, 0, 0], [900, 0, 0]])).tolist() == [[0.5, 0, 0], [900, 0, 0]]


def test_restarts_keep_the_least_error(points):
    p, w = points
    runs = [kmeans.error(p, w, kmeans.lloyd(p, w, kmeans.spread_seeds(p, w, 4, k))) for k in (1, 2, 3, 4)]
    assert kmeans.error(p, w, kmeans.restarted(p, w, 4)) == min(runs)


def test_hyab_kmeans_by_hand(points):
    p, w = points
    centres = [list(c) for c in kmeans.farthest_seeds(p, w, 3)]
    for _ in range(10):
        groups = [[] for _ in centres]
        for i, a in enumerate(p):
            groups[min(range(3), key=lambda j: (abs(a[0] - centres[j][0]) + math.hypot(a[1] - centres[j][1], a[2] - centres[j][2]), j))].append(i)
        for j, g in enumerate(groups):
            if g:
                half, upto = sum(w[i] for i in g) / 2, 0.0
                for i in sorted(g, key=lambda i: p[i][0]):
                    upto += w[i]
                    if upto >= half:
                        centres[j][0] = p[i][0]
                        break
                for c in (1, 2):
                    centres[j][c] = sum(w[i] * p[i][c] for i in g) / sum(w[i] for i in g)
    assert kmeans.hyab_kmeans(p, w, 3) == pytest.approx(np.array(centres))


def energy(labels, colours, price):
    regions = [colours[labels == v] for v in np.unique(labels)]
    walls = (labels[:, 1:] != labels[:, :-1]).sum() + (labels[1:] != labels[:-1]).sum()
    return sum(((r - r.mean(0)) ** 2).sum() for r in regions) + price * walls


def test_relaxation_lowers_energy_until_nothing_moves(spark):
    rng = np.random.default_rng(1)
    colours = np.where(np.arange(12)[None, :, None] < 6, 40, 180) + rng.integers(-20, 20, (9, 12, 3))
    labels = (np.arange(12)[None] + rng.integers(-2, 3, (9, 12)) >= 6).astype(int)
    got = sequential.relaxed(labels, colours, 300.0, 50)
    assert energy(got, colours, 300.0) < energy(labels, colours, 300.0)
    assert (sequential.relaxed(got, colours, 300.0, 1) == got).all()
    for y, x in np.ndindex(got.shape):
        for other in {0, 1} - {got[y, x]}:
            tried = got.copy()
            tried[y, x] = other
            if other in sequential._touching(got, y, x) and (got == got[y, x]).sum() > 1:
                assert energy(tried, colours, 300.0) >= energy(got, colours, 300.0) - 1e-6
    rows = [(0, x, y, *map(int, colours[y, x]), int(labels[y, x])) for y in range(9) for x in range(12)]
    found = sequential.relax(spark.createDataFrame(rows, "image int, x int, y int, r int, g int, b int, lab int"), 300.0, 50)
    assert {(r.x, r.y): r.lab for r in found.collect()} == {(x, y): got[y, x] for y in range(9) for x in range(12)}


def test_mixing(spark):
    """One model whose weight stays: the bits of its own chances. A foreseeable stream costs less than a random one."""
    symbols, bits, p, n = [1, 0, 1, 1, 0, 1], 0.0, 0.5, 0
    for s in symbols:
        one = 1 / (1 + math.exp(-0.3 * math.log(p / (1 - p)) * n / (n + 4)))
        bits -= math.log2(one if s else 1 - one)
        p, n = p + (s - p) * max(1 / (n + 1.5), 0.02), n + 1
    assert sequential.mixed_bits(symbols, [[0] * 6], 0.0, 1) == pytest.approx(bits)
    pick = random.Random(4)
    rows = [(c, i, i % 4 if c else pick.randrange(4)) for c in (0, 1) for i in range(400)]
    df = spark.createDataFrame([(c, i, s, (i - 1) % 4) for c, i, s in rows], "chain int, i int, sym int, last int")
    found = {r.chain: r for r in sequential.mixing_bits(df, ["chain"], ["i"], "sym", ["last"], width=2).collect()}
    assert found[1].bits < 300 < 700 < found[0].bits and found[0].n == 400


def test_compressed_sizes(spark):
    df = spark.createDataFrame([(0, i, i % 7) for i in range(5000)], "image int, i int, v int")
    row = sequential.compressed_sizes(df, ["image"], ["i"], "v").first()
    data = np.array([i % 7 for i in range(5000)], "<u2").tobytes()
    assert row.raw == 10000 and all(row[n] == f(data) < 1000 for n, f in sequential.SIZES.items())


def test_leave_one_out(spark):
    texts = [f"alpha beta gamma {i % 3} " * 40 for i in range(5)] + [None, "x"]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "s int, item int, text string")
    found = sequential.leave_one_out(df, ["s"], "item", "text").collect()
    assert [r.item for r in found] == list(range(7))
    assert all(r.solo == len(zstandard.ZstdCompressor(level=19).compress((t or "").encode())) for r, t in zip(found, texts, strict=True))
    assert all(r.with_others < r.solo for r in found[:5])
    with pytest.raises(ValueError):
        sequential.leave_one_out(df, ["s"], "item", "text", limit=100)


def test_readers(spark, tmp_path):
    (tmp_path / "steps.tsv").write_text("1\ta\t30.5\n1\tb\t99.0\n2\ta\t31.5\n")
    rows = views.tab_rows(spark, str(tmp_path / "steps.tsv"), "step int, who string, psnr double")
    assert [tuple(r) for r in rows.orderBy("step", "who").collect()] == [(1, "a", 30.5), (1, "b", 99.0), (2, "a", 31.5)]
    keys = rows.select("step").distinct()
    assert views.complete(rows, keys, ["a"], "who").count() == 3
    with pytest.raises(ValueError):
        views.complete(rows, keys, ["a", "b"], "who")
    assert [df.count() for df in views.lossless_and_lossy(rows)] == [1, 2]
    (tmp_path / "t.json").write_text(json.dumps({"results": [{"times": [0.5, 0.25]}, {"times": [9.0]}]}, indent=1))
    assert [tuple(r) for r in views.run_times(spark, str(tmp_path / "t.json")).collect()] == [(0, 0.5), (1, 0.25)]
    views.write_json(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
