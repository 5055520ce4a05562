"""Queries over weighted points: histograms, palettes, nearest references, error metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import colour
from ..operators import points, stats
from ..sources.views import pixels, table

PX = """px AS (SELECT l_returnflag AS image, l_orderkey, l_linenumber,
  CAST(CAST(round(l_quantity) AS INT) * 255 // 50 AS INT) AS r, CAST(CAST(round(l_discount * 100) AS INT) * 255 // 10 AS INT) AS g,
  CAST(CAST(round(l_tax * 100) AS INT) * 255 // 8 AS INT) AS b FROM lineitem)"""
HIST = PX + """, hist AS (SELECT r * 65536 + g * 256 + b AS key, r, g, b, count(*) AS cnt FROM px GROUP BY ALL)"""
HISTI = PX + """, hist AS (SELECT image, r * 65536 + g * 256 + b AS key, r, g, b, count(*) AS cnt FROM px GROUP BY ALL)"""
PAL = HIST + """, pal AS (SELECT row_number() OVER (ORDER BY cnt DESC, key) - 1 AS idx, r AS pr, g AS pg, b AS pb FROM hist ORDER BY cnt DESC, key LIMIT 16),
near AS (SELECT key, r, g, b, cnt, min({'d': d, 'idx': idx, 'pr': pr, 'pg': pg, 'pb': pb}) AS m FROM (
  SELECT h.*, p.idx, pr, pg, pb, CAST((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb) AS BIGINT) AS d FROM hist h CROSS JOIN pal p) GROUP BY ALL)"""


def _hist(spark, d, group=None):
    return points.histogram(pixels(spark, d), group)


def _near(spark, d, n=16):
    """Distinct points with their nearest of the n most popular colours."""
    hist = _hist(spark, d)
    pal = points.popularity(hist, n).select("idx", F.col("r").alias("pr"), F.col("g").alias("pg"), F.col("b").alias("pb"))
    dist = colour.dist2(tuple(F.col(c) for c in "rgb"), tuple(F.col(f"p{c}") for c in "rgb")).cast("long")
    return points.nearest(hist, pal, dist, ["key", "r", "g", "b", "cnt"], carry=("pr", "pg", "pb"))


def q0(spark, d):
    """Histogram, popular palette, nearest reference, error metrics for each image."""
    near = _near(spark, d).select("key", "d")
    px = pixels(spark, d).withColumn("key", colour.pack(*(F.col(c) for c in "rgb")))
    rows = px.groupBy("image", "key").agg(F.count("*").alias("cnt")).join(near, "key")
    w = Window.partitionBy("image").orderBy("d", "key")
    n = F.sum("cnt").over(Window.partitionBy("image"))
    at = F.least(n - 1, F.floor(F.lit(0.95) * n))
    rows = rows.withColumn("_c", F.sum("cnt").over(w)).withColumn("_at", at)
    out = rows.groupBy("image").agg(F.sum("cnt").alias("n"), F.sum(F.col("d") * F.col("cnt")).alias("sse"), F.min(F.when(F.col("_c") > F.col("_at"), F.col("d"))).alias("p95"))
    return out.select("image", "n", "sse", "p95", F.round(F.col("sse") / (3 * F.col("n")), 6).alias("mse"), F.round(colour.psnr_inf(F.col("sse") / (3 * F.col("n"))), 6).alias("psnr"))


Q0 = PAL + """, k AS (SELECT image, r * 65536 + g * 256 + b AS key, count(*) AS cnt FROM px GROUP BY ALL),
e AS (SELECT k.image, near.m.d AS d FROM px JOIN near ON near.key = px.r * 65536 + px.g * 256 + px.b JOIN (SELECT DISTINCT image FROM k) k ON k.image = px.image),
s AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY image) AS n FROM e)
SELECT image, count(*) AS n, CAST(sum(d) AS BIGINT) AS sse, max(CASE WHEN i = least(n - 1, floor(0.95 * n)) THEN d END) AS p95,
  round(sum(d) / (3.0 * count(*)), 6) AS mse, round(10 * log10(65025.0 / (sum(d) / (3.0 * count(*)))), 6) AS psnr FROM s GROUP BY image"""

GRID = "CAST(r // 32 * 64 + g // 32 * 8 + b // 32 AS INT)"


def m21(spark, d):
    """The reference's pair score: MSE, PSNR, mean and 95th percentile of CIEDE2000 (sorted[min(n - 1, floor(0.95 n))])."""
    lab = lambda cols: colour.rgb_to_lab(*(F.col(c) for c in cols))
    rows = _near(spark, d).withColumn("de", colour.ciede2000(lab(("r", "g", "b")), lab(("pr", "pg", "pb"))))
    run = rows.withColumn("_c", F.sum("cnt").over(Window.partitionBy(F.lit(0)).orderBy("de", "key"))).withColumn("_n", F.sum("cnt").over(Window.partitionBy(F.lit(0))))
    p95 = F.min(F.when(F.col("_c") > F.least(F.col("_n") - 1, F.floor(F.lit(0.95) * F.col("_n"))), F.col("de")))
    out = run.agg((F.sum(F.col("d") * F.col("cnt")) / (3 * F.sum("cnt"))).alias("mse"), (F.sum(F.col("de") * F.col("cnt")) / F.sum("cnt")).alias("mean_de"), p95.alias("p95_de"))
    return out.select(F.round("mse", 6).alias("mse"), F.round(colour.psnr_inf(F.col("mse")), 6).alias("psnr"), F.round("mean_de", 6).alias("mean_de"), F.round("p95_de", 6).alias("p95_de"))


def m24(spark, d):
    """The reference's error statistics over all channel values: PSNR (99 if equal), MAE, largest, per cent over 1, 2, 4 and 8."""
    near = _near(spark, d)
    err = near.select("cnt", F.explode(F.array(*[F.abs(F.col(c) - F.col(f"p{c}")) for c in "rgb"])).alias("e"))
    n = F.sum("cnt")
    over = [F.round(100 * F.sum(F.when(F.col("e") > t, F.col("cnt")).otherwise(0)) / n, 6).alias(f"pct_over{t}") for t in (1, 2, 4, 8)]
    psnr = colour.psnr_99(F.sum(F.col("e") * F.col("e") * F.col("cnt")), n / 3)
    return err.agg(F.round(psnr, 6).alias("psnr"), F.round(F.sum(F.col("e") * F.col("cnt")) / n, 6).alias("mae"), F.max("e").alias("worst"), *over)


def _two(spark, d):
    return _hist(spark, d, ["image"])


def a2(spark, d):
    out = points.bin_histogram(_hist(spark, d), 500)
    return out.select("shift", F.col("bin").alias("bin"), "cnt", *[F.round(c, 6).alias(c) for c in "rgb"])


A2 = HIST + ", n AS (SELECT s, count(DISTINCT (r >> s) * 65536 + (g >> s) * 256 + (b >> s)) AS k FROM hist, range(7) t(s) GROUP BY s), c AS (SELECT CAST(coalesce(min(s) FILTER (k <= 500), 6) AS INT) AS shift FROM n) SELECT shift, CAST((r >> shift) * 65536 + (g >> shift) * 256 + (b >> shift) AS INT) AS bin, CAST(sum(cnt) AS BIGINT) AS cnt, round(sum(r * cnt) / sum(cnt), 6) AS r, round(sum(g * cnt) / sum(cnt), 6) AS g, round(sum(b * cnt) / sum(cnt), 6) AS b FROM hist, c GROUP BY ALL"


def a5(spark, d):
    out = points.moments(_two(spark, d), ["r", "g", "b"], ["image"])
    return out.select("image", "w", *[F.round(c, 5).alias(c) for c in out.columns[2:]])


_COV = ", ".join(f"round(sum(cnt * {a} * {b}) / sum(cnt) - sum(cnt * {a}) / sum(cnt) * sum(cnt * {b}) / sum(cnt), 5) AS cov_{a}{b}" for a, b in ("rr", "rg", "rb", "gg", "gb", "bb"))
_SSE = " + ".join(f"sum(cnt * {a} * {a}) / sum(cnt) - sum(cnt * {a}) / sum(cnt) * sum(cnt * {a}) / sum(cnt)" for a in "rgb")
_HD = ", hist2 AS (SELECT image, key, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b, cnt FROM hist)"


def c11(spark, d):
    """Space-curve palette: Z-order, equal-weight cuts, centroids."""
    rows = _two(spark, d).withColumn("z", colour.morton3(*(F.col(c) for c in "rgb")))
    cut = points.segments(rows, ["z"], 8, by=["image"])
    return points.centroid(cut, ["image", "segment"], ["r", "g", "b"]).select("image", "segment", "w", *[F.round(c, 6).alias(c) for c in "rgb"])


_Z = " + ".join(f"(((({c}) >> {bit}) & 1) << {3 * bit + k})" for bit in range(8) for k, c in enumerate("rgb"))
C11 = HISTI + f""", z AS (SELECT *, {_Z} AS z FROM hist),
c AS (SELECT *, row_number() OVER w AS i, floor(sum(cnt) OVER w * 8.0 / sum(cnt) OVER (PARTITION BY image)) AS f FROM z WINDOW w AS (PARTITION BY image ORDER BY z ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, least(i, min(f - i) OVER w + i, 7) AS cuts FROM c WINDOW w AS (PARTITION BY image ORDER BY z ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CAST(coalesce(lag(cuts) OVER (PARTITION BY image ORDER BY z), 0) AS INT) AS segment FROM m)
SELECT image, segment, CAST(sum(cnt) AS BIGINT) AS w, round(sum(r * cnt) / sum(cnt), 6) AS r, round(sum(g * cnt) / sum(cnt), 6) AS g, round(sum(b * cnt) / sum(cnt), 6) AS b FROM s GROUP BY ALL"""


def _lloyd(hist, pal, rounds):
    """Lloyd steps of a palette(idx, pr, pg, pb); an empty cluster keeps its centre."""
    dist = colour.dist2(tuple(F.col(c) for c in "rgb"), tuple(F.col(f"p{c}") for c in "rgb"))
    for _ in range(rounds):
        near = points.nearest(hist, pal, dist, ["key", "r", "g", "b", "cnt"])
        means = near.groupBy("idx").agg(*[(F.sum(F.col(c) * F.col("cnt")) / F.sum("cnt")).alias(f"m{c}") for c in "rgb"])
        pal = pal.join(means, "idx", "left").select("idx", *[F.coalesce(f"m{c}", f"p{c}").alias(f"p{c}") for c in "rgb"]).checkpoint()
    return pal.select(F.col("idx").cast("long").alias("idx"), *[F.round(f"p{c}", 6).alias(f"p{c}") for c in "rgb"])


def c4(spark, d, rounds=2, n=8):
    """Lloyd steps from the popular palette: the two steps of its SQL. c4_kmeans_maximin has the reference's ten."""
    hist = _hist(spark, d)
    return _lloyd(hist, points.popularity(hist, n).select("idx", *[F.col(c).cast("double").alias(f"p{c}") for c in "rgb"]), rounds)


def c4_maximin(spark, d, rounds=10, n=8):
    """Ten Lloyd steps from farthest points: the heaviest colour first, then the one farthest from all chosen (ties: smaller key)."""
    hist = _hist(spark, d).checkpoint()
    chosen = [tuple(hist.orderBy(F.desc("cnt"), "key").select("r", "g", "b").first() or ())]
    while chosen[0] and len(chosen) < n:
        d2 = [colour.dist2(tuple(F.col(c) for c in "rgb"), tuple(F.lit(v) for v in p)) for p in chosen]
        far = hist.withColumn("_far", F.least(*d2) if len(d2) > 1 else d2[0]).filter("_far > 0").orderBy(F.desc("_far"), "key").select("r", "g", "b").first()
        if far is None:
            break
        chosen.append(tuple(far))
    rows = [(i, *map(float, p)) for i, p in enumerate(chosen) if p]
    return _lloyd(hist, spark.createDataFrame(rows, "idx int, pr double, pg double, pb double"), rounds)


def _step(prev: str, name: str) -> str:
    return f""", {name} AS (SELECT p.idx, coalesce(m.r, p.pr) AS pr, coalesce(m.g, p.pg) AS pg, coalesce(m.b, p.pb) AS pb FROM {prev} p LEFT JOIN (
  SELECT idx, sum(r * cnt) / sum(cnt) AS r, sum(g * cnt) / sum(cnt) AS g, sum(b * cnt) / sum(cnt) AS b FROM (
    SELECT key, r, g, b, cnt, min({{'d': (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb), 'idx': idx}}).idx AS idx FROM hist CROSS JOIN {prev} GROUP BY ALL) GROUP BY idx) m USING (idx))"""


C4 = HIST + ", p0 AS (SELECT row_number() OVER (ORDER BY cnt DESC, key) - 1 AS idx, CAST(r AS DOUBLE) AS pr, CAST(g AS DOUBLE) AS pg, CAST(b AS DOUBLE) AS pb FROM hist ORDER BY cnt DESC, key LIMIT 8)" + _step("p0", "p1") + _step("p1", "p2") + " SELECT idx, round(pr, 6) AS pr, round(pg, 6) AS pg, round(pb, 6) AS pb FROM p2"


def _maximin(k: int) -> str:
    return f""", c{k} AS MATERIALIZED (SELECT * FROM c{k - 1} UNION ALL (SELECT {k} AS idx, r, g, b FROM (SELECT h.key, h.r, h.g, h.b,
  min((h.r - c.r) * (h.r - c.r) + (h.g - c.g) * (h.g - c.g) + (h.b - c.b) * (h.b - c.b)) AS far FROM hist h CROSS JOIN c{k - 1} c GROUP BY ALL) WHERE far > 0 ORDER BY far DESC, key LIMIT 1))"""


C4_MAXIMIN = HIST.replace("hist AS (", "hist AS MATERIALIZED (") + ", c0 AS MATERIALIZED (SELECT 0 AS idx, r, g, b FROM hist ORDER BY cnt DESC, key LIMIT 1)" + "".join(_maximin(k) for k in range(1, 8))
C4_MAXIMIN += ", p0 AS MATERIALIZED (SELECT CAST(idx AS BIGINT) AS idx, CAST(r AS DOUBLE) AS pr, CAST(g AS DOUBLE) AS pg, CAST(b AS DOUBLE) AS pb FROM c7)"
C4_MAXIMIN += "".join(_step(f"p{k}", f"p{k + 1}").replace(" AS (", " AS MATERIALIZED (", 1) for k in range(10)) + " SELECT idx, round(pr, 6) AS pr, round(pg, 6) AS pg, round(pb, 6) AS pb FROM p10"


def j15(spark, d):
    marks = table(spark, d, "part").select(F.col("p_size").alias("mark")).distinct()
    want = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 3 + 1).alias("want"))
    pairs = want.join(F.broadcast(marks))
    return pairs.groupBy("n_nationkey").agg(F.min(F.struct(F.abs(F.col("mark") - F.col("want")).alias("d"), "mark")).alias("m")).select("n_nationkey", F.col("m.mark").alias("mark"))


def vec(spark, d):
    """Nearest label centroid of each vector (64 dimensions), lowest label on ties."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    axes = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    cent = axes.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c")).withColumnRenamed("label", "idx")
    near = points.nearest(rows.select("vec_id", "v"), cent, F.round(colour.dist2_arrays(F.col("v"), F.col("c")), 9), ["vec_id"])
    return near.select("vec_id", "idx", F.round("d", 6).alias("d"))


VEC = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT label, i, avg(v[i]) AS m FROM e, range(1, 65) t(i) GROUP BY ALL), c AS (SELECT label AS idx, list(m ORDER BY i) AS c FROM u GROUP BY label),
p AS (SELECT vec_id, min({'d': round(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9), 'idx': idx}) AS m FROM e CROSS JOIN c GROUP BY vec_id)
SELECT vec_id, m.idx AS idx, round(m.d, 6) AS d FROM p"""

QUERIES = {
    "q0_palette_scoring": q0,
    "a1_histogram": lambda s, d: _hist(s, d),
    "a2_bin_histogram": a2,
    "a3_centroid": lambda s, d: points.centroid(_two(s, d), ["image"], ["r", "g", "b"]).select("image", "w", *[F.round(c, 6).alias(c) for c in "rgb"]),
    "a4_a5_moments": a5,
    "a6_extent": lambda s, d: points.extent(_two(s, d), ["image"]),
    "a7_weighted_median": lambda s, d: points.weighted_median(_two(s, d), "r", ["image"]),
    "a8_mean_trunc": lambda s, d: points.mean_trunc(_two(s, d), ["image"]),
    "a10_distinct_colours": lambda s, d: _two(s, d).groupBy("image").agg(F.countDistinct("key").alias("colours")),
    "o1_c1_popularity": lambda s, d: points.popularity(_two(s, d), 8, ["image"]).select("image", "idx", "key", "cnt"),
    "j1_nearest_reference": lambda s, d: _near(s, d).select("key", "d", F.col("idx").cast("long").alias("idx")),
    "j2_emit": lambda s, d: pixels(s, d).withColumn("key", colour.pack(*(F.col(c) for c in "rgb"))).join(_near(s, d).select("key", "pr", "pg", "pb"), "key").select("l_orderkey", "l_linenumber", "key", "pr", "pg", "pb"),
    "j6_m21_pair_error": lambda s, d: _near(s, d).agg(F.sum(F.col("d") * F.col("cnt")).alias("sse"), F.max("d").alias("worst"), F.round(F.sum((F.abs(F.col("r") - F.col("pr")) + F.abs(F.col("g") - F.col("pg")) + F.abs(F.col("b") - F.col("pb"))) * F.col("cnt")) / (3 * F.sum("cnt")), 6).alias("mae")),
    "j15_nearest_mark": j15,
    "j1_vectors": vec,
    "w1_median_split": lambda s, d: points.median_split(_two(s, d), "r", ["image"]).groupBy("image", "side").agg(F.sum("cnt").alias("w"), F.min("r").alias("lo"), F.max("r").alias("hi")),
    "w2_c11_space_curve": c11,
    "c4_lloyd": c4,
    "c4_kmeans_maximin": c4_maximin,
    "m21_pair_score": m21,
    "m24_error_stats": m24,
}

ORACLE_SQL = {
    "q0_palette_scoring": "WITH " + Q0,
    "a1_histogram": "WITH " + HIST + " SELECT * FROM hist",
    "a2_bin_histogram": "WITH " + A2,
    "a3_centroid": "WITH " + HISTI + " SELECT image, CAST(sum(cnt) AS BIGINT) AS w, round(sum(r * cnt) / sum(cnt), 6) AS r, round(sum(g * cnt) / sum(cnt), 6) AS g, round(sum(b * cnt) / sum(cnt), 6) AS b FROM hist GROUP BY image",
    "a4_a5_moments": "WITH " + HISTI + _HD + f" SELECT image, CAST(sum(cnt) AS BIGINT) AS w, round(sum(cnt * r) / sum(cnt), 5) AS mean_r, round(sum(cnt * g) / sum(cnt), 5) AS mean_g, round(sum(cnt * b) / sum(cnt), 5) AS mean_b, {_COV}, round(sum(cnt) * ({_SSE}), 5) AS sse FROM hist2 GROUP BY image",
    "a6_extent": "WITH " + HISTI + ", x AS (SELECT image, max(r) - min(r) AS range_r, max(g) - min(g) AS range_g, max(b) - min(b) AS range_b FROM hist GROUP BY image) SELECT *, CASE WHEN range_r >= range_g AND range_r >= range_b THEN 'r' WHEN range_g >= range_b THEN 'g' ELSE 'b' END AS axis FROM x",
    "a7_weighted_median": "WITH " + PX + ", o AS (SELECT image, r, row_number() OVER (PARTITION BY image ORDER BY r) AS i, count(*) OVER (PARTITION BY image) AS n FROM px) SELECT image, min(r) AS median FROM o WHERE 2 * i >= n GROUP BY image",
    "a8_mean_trunc": "WITH " + PX + " SELECT image, CAST(sum(r) // count(*) AS BIGINT) AS r, CAST(sum(g) // count(*) AS BIGINT) AS g, CAST(sum(b) // count(*) AS BIGINT) AS b, count(*) AS cnt FROM px GROUP BY image",
    "a10_distinct_colours": "WITH " + PX + " SELECT image, count(DISTINCT r * 65536 + g * 256 + b) AS colours FROM px GROUP BY image",
    "o1_c1_popularity": "WITH " + HISTI + ", o AS (SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY cnt DESC, key) - 1 AS INT) AS idx, key, cnt FROM hist) SELECT * FROM o WHERE idx < 8",
    "j1_nearest_reference": "WITH " + PAL + " SELECT key, m.d AS d, m.idx AS idx FROM near",
    "j2_emit": "WITH " + PAL + " SELECT l_orderkey, l_linenumber, near.key, m.pr AS pr, m.pg AS pg, m.pb AS pb FROM px JOIN near ON near.key = px.r * 65536 + px.g * 256 + px.b",
    "j6_m21_pair_error": "WITH " + PAL + " SELECT CAST(sum(m.d * cnt) AS BIGINT) AS sse, max(m.d) AS worst, round(sum((abs(r - m.pr) + abs(g - m.pg) + abs(b - m.pb)) * cnt) / (3.0 * sum(cnt)), 6) AS mae FROM near",
    "j15_nearest_mark": "SELECT n_nationkey, min({'d': abs(p_size - (n_nationkey * 3 + 1)), 'mark': p_size}).mark AS mark FROM nation CROSS JOIN (SELECT DISTINCT p_size FROM part) GROUP BY n_nationkey",
    "j1_vectors": VEC,
    "w1_median_split": "WITH " + HISTI + ", o AS (SELECT *, row_number() OVER w AS i, sum(cnt) OVER w AS c, count(*) OVER (PARTITION BY image) AS n, sum(cnt) OVER (PARTITION BY image) AS t FROM hist WINDOW w AS (PARTITION BY image ORDER BY r, key ROWS UNBOUNDED PRECEDING)), a AS (SELECT image, greatest(1, least(min(i) FILTER (2 * c >= t), max(n) - 1)) AS split FROM o GROUP BY image) SELECT o.image, CAST(CASE WHEN i <= split THEN 0 ELSE 1 END AS INT) AS side, CAST(sum(cnt) AS BIGINT) AS w, min(r) AS lo, max(r) AS hi FROM o JOIN a USING (image) GROUP BY ALL",
    "w2_c11_space_curve": "WITH " + C11,
    "c4_lloyd": "WITH " + C4,
    "c4_kmeans_maximin": "WITH " + C4_MAXIMIN,
}
