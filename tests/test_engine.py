from __future__ import annotations

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from veldt import catalog
from veldt.functions import colour
from veldt.operators import entropy, points, stats

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ("q0_palette_scoring", "a7_weighted_median", "w1_median_split", "w2_c11_space_curve", "j5_interpolation", "e1_order2", "g1_w10_components", "m2_p95_nearest_rank", "m4_hashed_bootstrap")

# Three of the published CIEDE2000 test pairs (Sharma, Wu, Dalal 2005).
PAIRS = [((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425), ((50.0, 0.0, 0.0), (50.0, -1.0, 2.0), 2.3669), ((50.0, 2.5, 0.0), (73.0, 25.0, -18.0), 27.1492)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
@pytest.mark.parametrize("name", SOME)
def test_parity(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(catalog.ORACLE_SQL[name]).df()
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    shape = lambda df: sorted(tuple("%.8g" % v if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert shape(got) == shape(want)


def test_ciede2000(spark):
    rows = spark.createDataFrame([(*a, *b, w) for a, b, w in PAIRS], "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, w double")
    de = colour.ciede2000(tuple(F.col(c) for c in ("l1", "a1", "b1")), tuple(F.col(c) for c in ("l2", "a2", "b2")))
    for r in rows.select("w", de.alias("de")).collect():
        assert abs(r.w - r.de) < 1e-4


@pytest.mark.parametrize("n", [19, 20, 21, 40, 100, 101])
def test_percentiles_differ(spark, n):
    rows = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("v"))
    assert stats.percentile_floor(rows, "v", ["g"]).first().p == min(n - 1, math.floor(0.95 * n))
    assert stats.percentile_nearest_rank(rows, "v", ["g"]).first().p == round(0.95 * (n - 1))


def test_adaptive_bits_equals_sequential(spark):
    stream = [(i * 7919 % 5, i * 104729 % 3) for i in range(300)]
    bits, seen = 0.0, {}
    for c, s in stream:
        counts = seen.setdefault(c, {})
        bits -= math.log2((counts.get(s, 0) + 1) / (sum(counts.values()) + 3))
        counts[s] = counts.get(s, 0) + 1
    got = entropy.adaptive_bits(spark.createDataFrame(stream, "c int, s int"), [], ["c"], "s", 3).first().bits
    assert abs(got - bits) < 1e-8


def test_segments_cut_at_most_once_a_row(spark):
    rows = spark.createDataFrame([(0, 100), (1, 1), (2, 1), (3, 1)], "k int, cnt int")
    got = [r.segment for r in points.segments(rows, ["k"], 4).orderBy("k").collect()]
    assert got == [0, 1, 2, 3]


def test_nearest_ties_go_to_the_lowest_index(spark):
    pts = spark.createDataFrame([(1, 5)], "key int, v int")
    refs = spark.createDataFrame([(0, 0), (1, 10), (2, 0)], "idx int, w int")
    assert points.nearest(pts, refs, F.abs(F.col("v") - F.col("w")), ["key"]).first().idx == 0


def test_bootstrap_bounds():
    assert stats.bootstrap_bounds([]) == (0.0, 0.0)
    low, high = stats.bootstrap_bounds([-1.0, -2.0, -3.0], 500)
    assert -3 <= low <= high <= -1


@pytest.mark.parametrize("name", ["c4_lloyd", "c4_kmeans_maximin", "m4_hashed_bootstrap_10000"])
def test_whole_rounds_parity(spark, name):
    test_parity(spark, name)


def test_registered_bootstrap_takes_all_resamples(spark):
    from veldt.plans.curve_queries import _deltas

    got = catalog.QUERIES["m4_m5_bootstrap"](spark, DATA).first()
    rows = sorted(_deltas(spark, DATA).collect(), key=lambda r: r["item"])
    for want, suffix in (([r.delta for r in rows], ""), ([r.delta / r.baseline * 100.0 for r in rows], "_pct")):
        rng = random.Random(0xC0FFEE)
        means = sorted(sum(want[rng.randrange(len(want))] for _ in want) / len(want) for _ in range(10_000))
        assert got["ci_low" + suffix] == pytest.approx(means[250], rel=1e-12) and got["ci_high" + suffix] == pytest.approx(means[9750], rel=1e-12)


def test_pair_scores_are_whole(spark):
    from veldt.plans.point_queries import _near

    lab = lambda cols: colour.rgb_to_lab(*(F.col(c) for c in cols))
    rows = _near(spark, DATA).withColumn("de", colour.ciede2000(lab("rgb"), lab(("pr", "pg", "pb")))).collect()
    de = sorted(r.de for r in rows for _ in range(r.cnt))
    err = [abs(a - b) for r in rows for a, b in ((r.r, r.pr), (r.g, r.pg), (r.b, r.pb)) for _ in range(r.cnt)]
    mse = sum(e * e for e in err) / len(err)
    psnr = 10 * math.log10(255 * 255 / mse)
    want = (mse, psnr, sum(de) / len(de), de[min(len(de) - 1, int(len(de) * 0.95))])
    assert tuple(catalog.QUERIES["m21_pair_score"](spark, DATA).first()) == pytest.approx(want, abs=2e-6)
    over = [100 * sum(e > t for e in err) / len(err) for t in (1, 2, 4, 8)]
    assert tuple(catalog.QUERIES["m24_error_stats"](spark, DATA).first()) == pytest.approx((psnr, sum(err) / len(err), max(err), *over), abs=2e-6)
