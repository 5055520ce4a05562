"""Image operators, log-gamma code lengths, order statistics, skylines and the entry module on small fixtures."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veldt import catalog
from veldt.operators import entropy, images, raster, stats
from veldt.plans import image_queries

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
@pytest.mark.parametrize("name", ["p13_p14_p41_distances", "m20_a20_de_scores", "p15_m21_ciede2000", "a21_a22_plane_fits", "j8_m26_u3_agreement", "e5_crack_edges", "g16_parity", "w3_stratified", "m27_window_fidelity", "g11_crack_vertices", "g14_quadtree", "j16_jump_flood", "w11_previous_residual", "a28_pinned_gain", "j12_nearest_by_rings", "e21_seed_map", "e22_model_ladder"])
def test_parity(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = catalog.QUERIES[name](spark, DATA)
    rel = con.sql(catalog.ORACLE_SQL[name])
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {f.name: kinds[f.dataType.simpleString()] for f in found.schema.fields} == dict(zip(rel.columns, map(str, rel.types)))
    rows = lambda df: sorted(tuple(r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(found.toPandas()) == rows(rel.df())


def test_crop_checks_bounds(spark):
    px = spark.range(12).selectExpr("0 image", "cast(id % 4 as int) x", "cast(id div 4 as int) y", "1 r", "2 g", "3 b")
    assert images.crop(px, 1, 1, 3, 2).count() == 6
    for window in ((-1, 0, 2, 2), (2, 0, 3, 1), (0, 0, 0, 1), (0, 2, 1, 2)):
        with pytest.raises(ValueError):
            images.crop(px, *window)


def test_templates_of_blocks(spark):
    """On a 61 x 47 partition of blocks, the contexts of a template are those read cell by cell."""
    cells = [(0, x, y, x // 7 * 8 + y // 5) for x in range(61) for y in range(47)]
    cracks = raster.cracks(spark.createDataFrame(cells, "image int, x int, y int, lab int"))
    got = {(r.x, r.y): r.context for r in images.template_context(cracks.select("image", "x", "y", "v", "h"), image_queries.V_TAPS).collect()}
    lab = {(x, y): n for _, x, y, n in cells}
    v = {(x, y): int((x + 1, y) in lab and lab[x + 1, y] != n) for (x, y), n in lab.items()}
    assert got == {(x, y): sum(v.get((x + dx, y + dy), 0) << i for i, (_, dx, dy) in enumerate(image_queries.V_TAPS)) for x, y in lab}


def test_later_rectangles_cover_earlier_ones(spark):
    rects = spark.createDataFrame([(0, 1, 0, 0, 3, 2, 7), (0, 2, 1, 1, 3, 1, 9)], "image int, seq int, x int, y int, w int, h int, lab int")
    assert {(r.x, r.y): r.lab for r in images.cover(rects).collect()} == {(0, 0): 7, (1, 0): 7, (2, 0): 7, (0, 1): 7, (1, 1): 9, (2, 1): 9, (3, 1): 9}


@pytest.mark.parametrize("x", [1e-3, 0.2, 0.5, 1.0, 7.5, 1e4, 3e9])
def test_log_gamma(spark, x):
    got = spark.range(1).select(entropy.log_gamma(F.lit(x)).alias("g")).first().g
    assert abs(got - math.lgamma(x)) <= 1e-10 * max(1, abs(math.lgamma(x)))


def test_code_length_of_three_thousand_million_symbols(spark):
    got = spark.range(1).select(entropy.rising_bits(1.0, F.lit(3_000_000_000)).alias("b")).first().b
    assert abs(got - math.lgamma(3e9 + 1) / math.log(2)) < 1e-3


def test_human_rounds_halves_to_even(spark):
    rows = spark.createDataFrame([(0,), (1023,), (1280,), (1331,), (1024 * 1024,), (5 << 20,)], "n long")
    assert [r[0] for r in rows.select(entropy.human(F.col("n"))).collect()] == ["0 B", "1023 B", "1.2 KB", "1.3 KB", "1.00 MB", "5.00 MB"]


def test_order_statistics_equal_sorting(spark):
    values = [(k % 3, float((k * k) % 97) - 40) for k in range(500)] + [(9, 5.0)] + [(8, None)]
    rows = spark.createDataFrame(values, "g int, v double")
    got = {r.g: (r.a, r.b, r.c) for r in stats.order_statistics(rows, "v", ["g"], {"a": lambda n: F.lit(0), "b": lambda n: F.floor(n / 2), "c": lambda n: n - 1}).collect()}
    for g in (0, 1, 2, 9):
        own = sorted(v for k, v in values if k == g)
        assert got[g] == (own[0], own[len(own) // 2], own[-1])


def test_undominated_equals_pairs(spark):
    rows = [(i, float(i * 37 % 23), float(i * 53 % 19), i % 4) for i in range(150)] + [(900, None, 0.0, 0)]
    got = {r.i for r in stats.undominated(spark.createDataFrame(rows, "i int, a double, b double, c int"), ["a", "b", "c"]).collect()}
    beats = lambda p, q: all(x <= y for x, y in zip(p[1:], q[1:])) and p[1:] != q[1:]
    assert got == {q[0] for q in rows[:-1] if not any(beats(p, q) for p in rows[:-1])} | {900}


def test_components_of_a_spiral(spark):
    """A spiral of 241 x 241 cells is one region and what lies between its arms another."""
    n = 241
    lab = [[0] * n for _ in range(n)]
    x, y, dx, dy = 0, 0, 1, 0
    lab[0][0] = 1
    while True:
        ahead = lambda k: (x + k * dx, y + k * dy)
        inside = lambda p: 0 <= p[0] < n and 0 <= p[1] < n
        if not inside(ahead(1)) or (inside(ahead(2)) and lab[ahead(2)[1]][ahead(2)[0]]):
            dx, dy = -dy, dx
            if not inside(ahead(1)) or (inside(ahead(2)) and lab[ahead(2)[1]][ahead(2)[0]]):
                break
        x, y = ahead(1)
        lab[y][x] = 1
    grid = spark.createDataFrame([(0, i, j, lab[j][i]) for j in range(n) for i in range(n)], "image int, x int, y int, lab int")
    got = raster.components(grid).groupBy("lab").agg(F.countDistinct("component").alias("c")).collect()
    assert {r.lab: r.c for r in got} == {0: 1, 1: 1}


@pytest.mark.parametrize("gone", [("veldt/llm", "tests/llm"), ("veldt/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_llm(tmp_path, gone):
    for name in ("veldt", "corpus_pipeline.py", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    for name in gone:
        shutil.rmtree(tmp_path / name, ignore_errors=True)
        if name.endswith(".py"):
            (tmp_path / name).unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
