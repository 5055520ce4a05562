"""Geometry and pricing ladders against versions written cell by cell."""

from __future__ import annotations

import math
import random

import pytest

from veldt.operators import geometry, points, pricing, raster

W, H = 13, 9


@pytest.fixture(scope="module")
def cells():
    pick = random.Random(5)
    return {(x, y): (x // 5 + y // 4 * 3 if pick.random() < 0.85 else 9) for x in range(W) for y in range(H)}


@pytest.fixture(scope="module")
def grid(spark, cells):
    return spark.createDataFrame([(0, x, y, v) for (x, y), v in cells.items()], "image int, x int, y int, lab int")


def test_quadtree(grid, cells):
    nodes, leaves, todo = 0, 0, [(0, 0, W, H)]
    while todo:
        left, top, w, h = todo.pop()
        if w <= 0 or h <= 0:
            continue
        nodes += 1
        if len({cells[x, y] for x in range(left, left + w) for y in range(top, top + h)}) == 1:
            leaves += 1
            continue
        mx, my = (w + 1) // 2, (h + 1) // 2
        todo += [(left, top, mx, my), (left + mx, top, w - mx, my), (left, top + my, mx, h - my), (left + mx, top + my, w - mx, h - my)]
    assert tuple(geometry.quadtree(grid, "lab", W, H).first()) == (0, nodes, leaves, math.ceil((nodes + 8 * leaves) / 8))


def test_quadtree_of_one_value(spark):
    grid = spark.createDataFrame([(0, x, 0, 4) for x in range(3)], "image int, x int, y int, lab int")
    assert tuple(geometry.quadtree(grid, "lab", 3, 1).first()) == (0, 1, 1, 2)


def test_crack_vertices(grid, cells):
    degree = {}
    for (x, y), v in cells.items():
        for other, ends in (((x + 1, y), ((x + 1, y), (x + 1, y + 1))), ((x, y + 1), ((x, y + 1), (x + 1, y + 1)))):
            if other in cells and cells[other] != v:
                for e in ends:
                    degree[e] = degree.get(e, 0) + 1
    found = {(r.vx, r.vy): r for r in geometry.crack_vertices(grid).collect()}
    assert {k: r.degree for k, r in found.items()} == degree
    assert all(r.frame == (x in (0, W) or y in (0, H)) for (x, y), r in found.items())


def test_jump_flood(spark, cells):
    seeds = [(2, 0), (11, 1), (6, 4), (0, 8), (12, 8), (7, 4)]
    rows = [(0, x, y, 1 if (x, y) in seeds else None) for x, y in cells]
    found = {(r.x, r.y): r.site for r in geometry.jump_flood(spark.createDataFrame(rows, "image int, x int, y int, seed int"), W, H).collect()}
    at = sorted(seeds, key=lambda p: (p[1], p[0]))
    now, step = {p: at.index(p) if p in at else None for p in cells}, 16
    far = lambda p, s: (p[0] - at[s][0]) ** 2 + (p[1] - at[s][1]) ** 2
    while step:
        then = dict(now)
        for x, y in cells:
            for dy in (-step, 0, step):
                for dx in (-step, 0, step):
                    s = now.get((x + dx, y + dy))
                    if s is not None and (then[x, y] is None or far((x, y), s) < far((x, y), then[x, y])):
                        then[x, y] = s
        now, step = then, step // 2
    assert found == now


def test_jump_flood_without_seeds(spark):
    rows = spark.createDataFrame([(0, x, 0, None) for x in range(3)], "image int, x int, y int, seed int")
    assert [r.site for r in geometry.jump_flood(rows, 3, 1).collect()] == [None] * 3


def test_sidecar_and_runs(grid, cells):
    side = {(r.x, r.y): r for r in geometry.sidecar(grid).collect()}
    for (x, y), v in cells.items():
        assert side[x, y].delta == (v - cells.get((x - 1, y), 0)) % 65536
        assert side[x, y].edge == (cells.get((x + 1, y), v) != v) + 2 * (cells.get((x, y + 1), v) != v)
    runs = sum(1 for (x, y), v in cells.items() if cells.get((x - 1, y)) != v)
    assert geometry.run_code_bytes(geometry.runs_by_row(grid, "lab")).first().bytes == 2 * runs


def test_ladder_is_the_adaptive_coder(grid, cells):
    rows = raster.neighbours(grid)
    found = {r.model: r for r in pricing.model_ladder(rows, ["image"], {"none": [], "left": ["left"]}, "lab", 16).collect()}
    for model, context in (("none", lambda x, y: 0), ("left", lambda x, y: cells.get((x - 1, y), 0))):
        counts, totals, bits = {}, {}, 0.0
        for y in range(H):
            for x in range(W):
                c, v = context(x, y), cells[x, y]
                bits -= math.log2((counts.get((c, v), 0) + 1) / (totals.get(c, 0) + 16))
                counts[c, v], totals[c] = counts.get((c, v), 0) + 1, totals.get(c, 0) + 1
        assert found[model].adaptive == pytest.approx(bits)
        assert found[model].static == pytest.approx(-sum(k * math.log2(k / totals[c]) for (c, _), k in counts.items()))


def test_greedy_taps_takes_the_cheapest(spark):
    """Bits follow t2, but for those where t1 and t2 are both set; t3 is noise."""
    pick = random.Random(2)
    rows = [(a := pick.randrange(2), b := pick.randrange(2), pick.randrange(2), b & (1 - a), 0) for _ in range(800)]
    df = spark.createDataFrame(rows, "t1 int, t2 int, t3 int, v int, base int")
    got = pricing.greedy_taps(df, "v", "base", ["t1", "t2", "t3"], 3)
    singles = {r.model: r.adaptive for r in pricing.model_ladder(df, ["base"], {c: [c] for c in ("t1", "t2", "t3")}, "v", 2).collect()}
    assert got[0][0] == min(singles, key=singles.get) and {c for c, _ in got[:2]} == {"t1", "t2"} and got[2][0] == "t3"
    assert got[0][1] == pytest.approx(min(singles.values()), abs=1e-5) and got[1][1] < 40


def test_nearest_by_rings(spark):
    """Clusters and far points, ties by lowest index; more references than a broadcast would take are not needed here."""
    pick = random.Random(9)
    refs = [(i, pick.randrange(0, 40) * 3, pick.randrange(0, 40)) for i in range(60)] + [(60, 900, -700), (61, 900, -700)]
    pts = [(i, pick.randrange(-500, 1000), pick.randrange(-800, 100)) for i in range(150)] + [(150, 900, -700)]
    got = points.nearest_by_rings(spark.createDataFrame(pts, "id int, x int, y int"), spark.createDataFrame(refs, "idx int, rx int, ry int"), [("x", "rx"), ("y", "ry")], ["id"], 2.0)
    want = {i: min(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in refs) for i, x, y in pts}
    rows = got.collect()
    assert len(rows) == len(pts) and {r.id: (r.d, r.idx) for r in rows} == want
    none = spark.createDataFrame([], "idx int, rx int, ry int")
    assert points.nearest_by_rings(spark.createDataFrame(pts, "id int, x int, y int"), none, [("x", "rx"), ("y", "ry")], ["id"], 2.0).count() == 0
