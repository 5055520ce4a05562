"""Queries over rasters, region graphs and symbol streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import entropy, raster
from ..sources.views import raster as grid
from ..sources.views import symbols

GRID = """WITH RECURSIVE c AS (SELECT CAST(day(ts) AS INT) AS y, CAST(hour(ts) AS INT) AS x, event_type, count(*) AS n FROM events GROUP BY ALL),
grid AS (SELECT x, y, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], min({'n': -n, 'e': event_type}).e) - 1 AS INT) AS lab FROM c GROUP BY x, y)"""
TAPS = GRID + """, taps AS (SELECT *, lag(lab, 1, 0) OVER (PARTITION BY y ORDER BY x) AS l, lag(lab, 1, 0) OVER (PARTITION BY x ORDER BY y) AS u FROM grid),
taps2 AS (SELECT *, lag(u, 1, 0) OVER (PARTITION BY y ORDER BY x) AS ul FROM taps)"""
CRACK = GRID + """, k AS (SELECT *, coalesce(CAST(lead(lab) OVER (PARTITION BY y ORDER BY x) <> lab AS INT), 0) AS v, coalesce(CAST(lead(lab) OVER (PARTITION BY x ORDER BY y) <> lab AS INT), 0) AS h FROM grid)"""
RAG = GRID + """, p AS (SELECT lab AS a, lead(lab) OVER (PARTITION BY y ORDER BY x) AS b FROM grid UNION ALL SELECT lab, lead(lab) OVER (PARTITION BY x ORDER BY y) FROM grid),
rag AS (SELECT a, b, count(*) AS len FROM (SELECT a, b FROM p WHERE a <> b UNION ALL SELECT b, a FROM p WHERE a <> b) GROUP BY ALL)"""
STREAM = """WITH s AS (SELECT user_id % 16 AS chain, ts, event_id, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS sym FROM events),
t AS (SELECT chain, sym, lag(sym, 1, 0) OVER w AS p1, lag(sym, 2, 0) OVER w AS p2 FROM s WINDOW w AS (PARTITION BY chain ORDER BY ts, event_id))"""


def closed_form(source: str, context: str, symbol: str, n: int, alpha: float) -> str:
    """Adaptive code length by gamma functions, an independent derivation."""
    a = f"CAST({alpha} AS DOUBLE)"
    return f"""SELECT round(sum(b), 5) AS bits FROM (SELECT (lgamma(sum(k) + {n} * {a}) - lgamma({n} * {a}) - sum(lgamma(k + {a}) - lgamma({a}))) / ln(2) AS b
FROM (SELECT {context}, {symbol}, count(*) AS k FROM {source} GROUP BY ALL) GROUP BY {context})"""


def _bits(df):
    return df.select(F.round("bits", 5).alias("bits"))


def _turns(spark, d):
    w = Window.partitionBy("chain").orderBy("ts", "event_id")
    return symbols(spark, d).withColumn("p1", F.lag("sym", 1, 0).over(w)).withColumn("p2", F.lag("sym", 2, 0).over(w)).withColumn("one", F.lit(0))


def _taps(spark, d):
    return raster.neighbours(grid(spark, d)).withColumn("one", F.lit(0))


def _sizes(spark, d):
    comp = raster.components(grid(spark, d)).withColumn("lab", F.col("component"))
    return raster.areas(comp)


COMP = GRID + """, e AS (SELECT a.y * 24 + a.x AS p, b.y * 24 + b.x AS q FROM grid a JOIN grid b ON a.lab = b.lab AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
r AS (SELECT y * 24 + x AS p, y * 24 + x AS root FROM grid UNION SELECT e.q, r.root FROM r JOIN e ON e.p = r.p WHERE e.q > r.root),
m AS (SELECT p, min(root) AS root FROM r GROUP BY p), d AS (SELECT root, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INT) AS component FROM (SELECT DISTINCT root FROM m)),
comp AS (SELECT g.x, g.y, g.lab, d.component FROM grid g JOIN m ON m.p = g.y * 24 + g.x JOIN d USING (root)), sizes AS (SELECT component, count(*) AS area FROM comp GROUP BY component)"""

QUERIES = {
    "j4_stencil": lambda s, d: raster.neighbours(grid(s, d)).select("x", "y", "lab", "left", "up", "up_left"),
    "g10_crack_planes": lambda s, d: raster.cracks(grid(s, d)).select("x", "y", "v", "h"),
    "a11_crack_length": lambda s, d: raster.crack_length(grid(s, d)).select("length"),
    "a12_adjacency": lambda s, d: raster.adjacency(grid(s, d)).select("a", "b", "len"),
    "a13_perimeter": lambda s, d: raster.perimeters(grid(s, d)).select("lab", "perimeter"),
    "a9_area": lambda s, d: raster.areas(grid(s, d)).select("lab", "area"),
    "j17_best_earlier": lambda s, d: raster.best_earlier(raster.adjacency(grid(s, d))).select("a", "b"),
    "g1_w10_components": lambda s, d: raster.components(grid(s, d)).select("x", "y", "lab", "component"),
    "a15_coverage": lambda s, d: raster.coverage(_sizes(s, d), (1, 10, 100)).select(*[F.round(c, 6).alias(c) for c in ("top1", "top10", "top100")]),
    "a17_tail_exponent": lambda s, d: raster.tail_exponent(_sizes(s, d), 2).select(F.round("alpha", 6).alias("alpha")),
    "e1_order0": lambda s, d: _bits(entropy.adaptive_bits(_taps(s, d), [], ["one"], "lab", 5)),
    "e1_order1": lambda s, d: _bits(entropy.adaptive_bits(_taps(s, d), [], ["left"], "lab", 5)),
    "e1_order2": lambda s, d: _bits(entropy.adaptive_bits(_taps(s, d), [], ["left", "up"], "lab", 5)),
    "e1_order3": lambda s, d: _bits(entropy.adaptive_bits(_taps(s, d), [], ["left", "up", "up_left"], "lab", 5)),
    "e3_kt_binary": lambda s, d: _bits(entropy.adaptive_bits(raster.cracks(grid(s, d)).withColumn("up", F.lag("v", 1, 0).over(raster.column())), [], ["up"], "v", 2, 0.5)),
    "w4_w8_e9_turns": lambda s, d: _bits(entropy.adaptive_bits(_turns(s, d), [], ["p1", "p2"], "sym", 5, 0.2)),
    "e12_static_entropy": lambda s, d: _bits(entropy.static_bits(_turns(s, d), [], ["p1"], "sym")),
    "a25_order0_entropy": lambda s, d: entropy.static_bits(_turns(s, d), ["chain"], [], "sym").select("chain", F.round("bits", 5).alias("bits")),
    "a24_w5_run_lengths": lambda s, d: entropy.run_lengths(symbols(s, d), ["chain"], ["ts", "event_id"], "sym"),
    "w6_delta": lambda s, d: grid(s, d).select("x", "y", (F.col("lab") - F.lag("lab", 1, 0).over(raster.row())).bitwiseAND(65535).alias("delta")),
    "c16_block_means": lambda s, d: raster.block_means(grid(s, d), 3, "lab").select(F.col("bx").cast("int"), F.col("by").cast("int"), F.round("mean", 6).alias("mean")),
}

ORACLE_SQL = {
    "j4_stencil": TAPS + ' SELECT x, y, lab, l AS "left", u AS up, ul AS up_left FROM taps2',
    "g10_crack_planes": CRACK + " SELECT x, y, v, h FROM k",
    "a11_crack_length": CRACK + " SELECT CAST(sum(v + h) AS BIGINT) AS length FROM k",
    "a12_adjacency": RAG + " SELECT * FROM rag",
    "a13_perimeter": RAG + " SELECT a AS lab, CAST(sum(len) AS BIGINT) AS perimeter FROM rag GROUP BY a",
    "a9_area": GRID + " SELECT lab, count(*) AS area FROM grid GROUP BY lab",
    "j17_best_earlier": RAG + " SELECT a, min({'l': -len, 'b': b}).b AS b FROM rag WHERE b < a GROUP BY a",
    "g1_w10_components": COMP + " SELECT * FROM comp",
    "a15_coverage": COMP + ", o AS (SELECT area, row_number() OVER (ORDER BY area DESC) AS i FROM sizes) SELECT round(sum(area) FILTER (i <= 1) / sum(area), 6) AS top1, round(sum(area) FILTER (i <= 10) / sum(area), 6) AS top10, round(sum(area) FILTER (i <= 100) / sum(area), 6) AS top100 FROM o",
    "a17_tail_exponent": COMP + " SELECT round(1 + count(*) / sum(ln(area / 2)), 6) AS alpha FROM sizes WHERE area >= 2",
    "e1_order0": GRID + ", o AS (SELECT 0 AS one, lab FROM grid) " + closed_form("o", "one", "lab", 5, 1.0),
    "e1_order1": TAPS + " " + closed_form("taps2", "l", "lab", 5, 1.0),
    "e1_order2": TAPS + " " + closed_form("taps2", "l, u", "lab", 5, 1.0),
    "e1_order3": TAPS + " " + closed_form("taps2", "l, u, ul", "lab", 5, 1.0),
    "e3_kt_binary": CRACK + ", q AS (SELECT v, lag(v, 1, 0) OVER (PARTITION BY x ORDER BY y) AS up FROM k) " + closed_form("q", "up", "v", 2, 0.5),
    "w4_w8_e9_turns": STREAM + " " + closed_form("t", "p1, p2", "sym", 5, 0.2),
    "e12_static_entropy": STREAM + ", k AS (SELECT p1, sym, count(*) AS k FROM t GROUP BY ALL), z AS (SELECT *, sum(k) OVER (PARTITION BY p1) AS n FROM k) SELECT round(sum(k * log2(n / k)), 5) AS bits FROM z",
    "a25_order0_entropy": STREAM + ", k AS (SELECT chain, sym, count(*) AS k FROM t GROUP BY ALL), z AS (SELECT *, sum(k) OVER (PARTITION BY chain) AS n FROM k) SELECT chain, round(sum(k * log2(n / k)), 5) AS bits FROM z GROUP BY chain",
    "a24_w5_run_lengths": STREAM + ", o AS (SELECT chain, sym, row_number() OVER (PARTITION BY chain ORDER BY ts, event_id) - row_number() OVER (PARTITION BY chain, sym ORDER BY ts, event_id) AS g FROM s), r AS (SELECT chain, sym, g, count(*) AS length FROM o GROUP BY ALL) SELECT chain, length, count(*) AS runs FROM r GROUP BY ALL",
    "w6_delta": GRID + " SELECT x, y, CAST((lab - lag(lab, 1, 0) OVER (PARTITION BY y ORDER BY x)) & 65535 AS INT) AS delta FROM grid",
    "c16_block_means": GRID + " SELECT CAST(x // 3 AS INT) AS bx, CAST(y // 3 AS INT) AS by, round(avg(lab), 6) AS mean FROM grid GROUP BY ALL",
}
