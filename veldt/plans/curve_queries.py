"""Queries over measurements: percentiles, scores, bootstrap intervals, rate-distortion curves, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from ..sources.views import table


def _samples(spark, d):
    return table(spark, d, "events").select("event_type", "value")


def _runs(spark, d):
    """Two runs over part brands: items with a score each."""
    rows = table(spark, d, "part")
    base = rows.groupBy(F.col("p_brand").alias("item")).agg(F.sum("p_retailprice").alias("score"))
    cand = rows.filter("p_size > 3").groupBy(F.col("p_brand").alias("item")).agg(F.sum(F.col("p_retailprice") * 0.97).alias("score"))
    return base, cand


RUNS = """WITH base AS (SELECT p_brand AS item, sum(p_retailprice) AS score FROM part GROUP BY 1),
cand AS (SELECT p_brand AS item, sum(p_retailprice * 0.97) AS score FROM part WHERE p_size > 3 GROUP BY 1),
d AS (SELECT item, base.score AS baseline, cand.score AS candidate, cand.score - base.score AS delta, 100 * (cand.score - base.score) / base.score AS pct FROM base JOIN cand USING (item))"""


def _deltas(spark, d):
    return stats.deltas(*_runs(spark, d)).withColumn("exp", F.lit(1))


def _curve(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.sum("l_extendedprice").alias("p"))
    return rows.select(F.col("l_returnflag").alias("codec"), F.col("l_quantity").alias("x"), F.col("p").alias("y"))


CURVE = """WITH c AS (SELECT l_returnflag AS codec, l_quantity AS x, sum(l_extendedprice) AS y FROM lineitem GROUP BY ALL),
w AS (SELECT * FROM (SELECT DISTINCT codec FROM c) CROSS JOIN (SELECT CAST(v AS DOUBLE) AS "at" FROM (VALUES (0.5), (1), (7.25), (49.5), (51)) t(v))),
s AS (SELECT codec, x AS x0, y AS y0, lead(x) OVER o AS x1, lead(y) OVER o AS y1 FROM c WINDOW o AS (PARTITION BY codec ORDER BY x))"""


def j5(spark, d):
    curve = _curve(spark, d)
    at = F.explode(F.array(*[F.lit(v) for v in (0.5, 1.0, 7.25, 49.5, 51.0)]))
    wanted = curve.select("codec").distinct().select("codec", at.alias("at"))
    return stats.interpolate(curve, wanted, ["codec"]).select("codec", "at", F.round("value", 4).alias("value"))


def _r(df, cols, n=6):
    return df.select(*[F.round(c, n).alias(c) if c in cols else c for c in df.columns])


QUERIES = {
    "m1_p95_floor": lambda s, d: stats.percentile_floor(_samples(s, d), "value", ["event_type"]),
    "m2_p95_nearest_rank": lambda s, d: stats.percentile_nearest_rank(_samples(s, d), "value", ["event_type"]),
    "m3_percentiles": lambda s, d: _r(stats.percentile_linear(_samples(s, d), "value", ["event_type"]), ("p50", "p95", "p99")),
    "j3_f2_u1_deltas": lambda s, d: _r(stats.deltas(*_runs(s, d)), ("baseline", "candidate", "delta", "pct"), 4),
    "m6_m7_a26_summary": lambda s, d: _r(stats.summary(_deltas(s, d), ["exp"]), ("mean_delta", "median_delta", "pct_of_totals", "mean_pct"), 5),
    "m4_m5_bootstrap": lambda s, d: stats.bootstrap(_deltas(s, d), ["exp"]),
    "m4_hashed_bootstrap": lambda s, d: _r(stats.hashed_bootstrap(_deltas(s, d), ["exp"], "item", 200), ("ci_low", "ci_high"), 5),
    "m4_hashed_bootstrap_10000": lambda s, d: _r(stats.hashed_bootstrap(_deltas(s, d), ["exp"], "item", 10_000), ("ci_low", "ci_high"), 5),
    "j5_interpolation": j5,
    "m11_undominated": lambda s, d: stats.undominated(table(s, d, "supplier").select("s_suppkey", "s_nationkey", F.abs("s_acctbal").alias("bal"), (F.col("s_suppkey") % 7).alias("k")), ["s_nationkey", "bal", "k"]).select("s_suppkey"),
    "f3_u2_excluded": lambda s, d: table(s, d, "orders").select("o_orderkey").join(table(s, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti"),
    "a30_corpus_stats": lambda s, d: table(s, d, "part").agg(F.round(F.avg("p_retailprice"), 5).alias("mean"), F.round(F.expr("percentile(p_retailprice, 0.5)"), 5).alias("median"), F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"), F.count_if(F.col("p_size") > 25).alias("wins"), F.round(F.corr("p_size", "p_retailprice"), 6).alias("r")),
    "s18_histogram": lambda s, d: table(s, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(200),
    "f9_m24_thresholds": lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(*[F.count_if(F.col("l_quantity") > t).alias(f"over{t}") for t in (1, 2, 4, 8)]),
    "o9_target": lambda s, d: _curve(s, d).groupBy("codec").agg(F.min(F.struct(F.abs(F.col("y") - 1_000_000).alias("e"), "x")).alias("m")).select("codec", F.col("m.x").alias("x")),
}

ORACLE_SQL = {
    "m1_p95_floor": "WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, value AS p FROM o WHERE i = least(n - 1, floor(0.95 * n))",
    "m2_p95_nearest_rank": "WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, value AS p FROM o WHERE i = round_even(0.95 * (n - 1), 0)",
    "m3_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type",
    "j3_f2_u1_deltas": RUNS + " SELECT item, round(baseline, 4) AS baseline, round(candidate, 4) AS candidate, round(delta, 4) AS delta, round(pct, 4) AS pct FROM d",
    "m6_m7_a26_summary": RUNS + " SELECT CAST(1 AS INT) AS exp, count(*) AS n, round(avg(delta), 5) AS mean_delta, round(quantile_cont(delta, 0.5), 5) AS median_delta, round(100 * sum(delta) / sum(baseline), 5) AS pct_of_totals, round(avg(pct), 5) AS mean_pct FROM d",
    "m4_hashed_bootstrap": RUNS + ", o AS (SELECT delta, row_number() OVER (ORDER BY item) - 1 AS i, count(*) OVER () AS n FROM d), m AS (SELECT k, avg(p.delta) AS m FROM o JOIN range(200) t(k) ON true JOIN o p ON p.i = ((k * 1009 + o.i) * 1664525 + 1013904223) % 4294967296 % o.n GROUP BY k), z AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS r FROM m) SELECT CAST(1 AS INT) AS exp, round(max(m) FILTER (r = 5), 5) AS ci_low, round(max(m) FILTER (r = 195), 5) AS ci_high FROM z",
    "j5_interpolation": CURVE + ', h AS (SELECT w.codec, w."at", min({\'x\': x0, \'v\': y0 + (y1 - y0) * ("at" - x0) / (x1 - x0)}).v AS v FROM w JOIN s ON s.codec = w.codec AND x1 IS NOT NULL AND "at" BETWEEN x0 AND x1 GROUP BY ALL) SELECT w.codec, w."at", round(h.v, 4) AS value FROM w LEFT JOIN h ON h.codec = w.codec AND h."at" = w."at"',
    "m11_undominated": "WITH s AS (SELECT s_suppkey, s_nationkey AS e, abs(s_acctbal) AS b, s_suppkey % 7 AS k FROM supplier) SELECT s_suppkey FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.e <= s.e AND o.b <= s.b AND o.k <= s.k AND (o.e < s.e OR o.b < s.b OR o.k < s.k))",
    "f3_u2_excluded": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)",
    "a30_corpus_stats": "SELECT round(avg(p_retailprice), 5) AS mean, round(quantile_cont(p_retailprice, 0.5), 5) AS median, min(p_retailprice) AS lo, max(p_retailprice) AS hi, count(*) FILTER (p_size > 25) AS wins, round(corr(p_size, p_retailprice), 6) AS r FROM part",
    "s18_histogram": "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 200",
    "f9_m24_thresholds": "SELECT l_returnflag, count(*) FILTER (l_quantity > 1) AS over1, count(*) FILTER (l_quantity > 2) AS over2, count(*) FILTER (l_quantity > 4) AS over4, count(*) FILTER (l_quantity > 8) AS over8 FROM lineitem GROUP BY 1",
    "o9_target": CURVE + " SELECT codec, min({'e': abs(y - 1000000), 'x': x}).x AS x FROM c GROUP BY codec",
}

ORACLE_SQL["m4_hashed_bootstrap_10000"] = ORACLE_SQL["m4_hashed_bootstrap"].replace("range(200)", "range(10000)").replace("r = 5)", "r = 250)").replace("r = 195)", "r = 9750)")
