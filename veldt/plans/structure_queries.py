"""Queries over palettes by splitting and merging, cell tables, region merges, colour prices, order-dependent codes."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import colour
from ..operators import geometry, kmeans, merging, points, pricing, quantizers, raster, sequential
from ..sources.views import pixels
from ..sources.views import raster as grid
from ..sources.views import symbols, table
from . import image_queries
from .point_queries import PAL
from .raster_queries import COMP, closed_form


def _hist(spark, d):
    return points.histogram(pixels(spark, d), ["image"])


def _palette(spark, d, n=16):
    return points.popularity(points.histogram(pixels(spark, d)), n).select(F.col("idx").cast("long").alias("idx"), "r", "g", "b")


def _cells(spark, d):
    return raster.components(grid(spark, d))


def _regions(spark, d):
    """Components as regions with a colour each, and their shared boundaries."""
    comp = _cells(spark, d)
    n = F.count("*")
    regs = comp.groupBy("image", F.col("component").alias("lab"), F.col("lab").alias("kind")).agg(n.alias("area"), (n * 37 % 256).cast("int").alias("r"))
    regs = regs.withColumn("g", (F.col("lab") * 29 % 256).cast("int")).withColumn("b", F.col("kind") * 50).drop("kind")
    return regs, raster.adjacency(comp.select("image", "x", "y", F.col("component").alias("lab")))


def _merged(spark, d, key):
    regs, rag = _regions(spark, d)
    sums = regs.select("image", "lab", "area", *[(F.col(c) * F.col("area")).alias(c) for c in "rgb"])
    out = merging.merge_regions(sums, rag, [64, 16, 4], key=key)
    return out.select("mark", "region", "root", F.round("error", 4).alias("error"))


def segmentation(spark, d):
    w = grid(spark, d).withColumn("node", F.col("y") * 24 + F.col("x"))
    right = w.select("image", F.col("node").alias("a"), F.lead("node").over(raster.row()).alias("b"), (F.lead("lab").over(raster.row()) - F.col("lab")).alias("d"))
    below = w.select("image", F.col("node").alias("a"), F.lead("node").over(raster.column()).alias("b"), (F.lead("lab").over(raster.column()) - F.col("lab")).alias("d"))
    edges = right.union(below).filter("b is not null").select("image", "a", "b", F.abs("d").alias("weight"))
    return merging.segment(edges, 4.0, 3).select("node", "segment")


def _stream(spark, d):
    w = Window.partitionBy("chain").orderBy("ts", "event_id")
    rows = symbols(spark, d).withColumn("p1", F.lag("sym", 1, 0).over(w)).withColumn("p2", F.lag("sym", 2, 0).over(w))
    out = ((F.col("sym") + 1 + F.col("event_id") % 4) % 5).cast("int")
    return rows.withColumn("out", out).withColumn("allowed", F.array_except(F.array(*[F.lit(k) for k in range(5)]), F.array("out")))


def range_coder(spark, d):
    """Blocks of coded bits that decode to the bits they came from."""
    rows = symbols(spark, d).withColumn("bit", (F.col("sym") == 4).cast("int"))
    blocks = pricing.coded_blocks(rows, ["chain"], ["ts", "event_id"], "bit", 1024)
    back = pricing.decoded_blocks(blocks.withColumn("bytes", F.length("blob")))
    ones = F.aggregate("bits", F.lit(0), lambda s, b: s + b)
    return back.groupBy("chain").agg(F.sum("n").alias("n"), F.sum(ones).cast("long").alias("ones"))


STREAM = """WITH s AS (SELECT user_id % 16 AS chain, ts, event_id, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS sym FROM events),
t AS (SELECT *, (sym + 1 + event_id % 4) % 5 AS out, lag(sym, 1, 0) OVER w AS p1, lag(sym, 2, 0) OVER w AS p2 FROM s WINDOW w AS (PARTITION BY chain ORDER BY ts, event_id))"""
REGIONS = COMP + """, regs AS (SELECT component AS lab, CAST(count(*) AS BIGINT) AS area, CAST(count(*) * 37 % 256 AS INT) AS r, CAST(component * 29 % 256 AS INT) AS g, lab * 50 AS b FROM comp GROUP BY component, comp.lab),
pr AS (SELECT component AS a, lead(component) OVER (PARTITION BY y ORDER BY x) AS b FROM comp UNION ALL SELECT component, lead(component) OVER (PARTITION BY x ORDER BY y) FROM comp),
rag AS (SELECT a, b, count(*) AS len FROM (SELECT a, b FROM pr WHERE a <> b UNION ALL SELECT b, a FROM pr WHERE a <> b) GROUP BY ALL),
best AS (SELECT a, min({'l': -len, 'b': b}).b AS o FROM rag WHERE b < a GROUP BY a)"""


def _residual(source: str) -> str:
    each = " UNION ALL ".join(f"SELECT '{c}' AS channel, greatest(0, least(511, CAST(trunc({c} - p{c}) AS INT) + 256)) AS d FROM {source}" for c in "rgb")
    return f", res AS ({each}) " + closed_form("res", "channel", "d", 512, 1.0)


QUERIES = {
    "c2_median_cut": lambda s, d: quantizers.palettes(_hist(s, d), ["image"], 8),
    "c3_divisive_principal": lambda s, d: quantizers.palettes(_hist(s, d), ["image"], 8, quantizers.divisive),
    "c3_divisive_axis": lambda s, d: quantizers.palettes(_hist(s, d), ["image"], 8, partial(quantizers.divisive, principal=False)),
    "c10_ward": lambda s, d: quantizers.palettes(_hist(s, d), ["image"], 8, quantizers.ward),
    "c12_tree_cut": lambda s, d: quantizers.palettes(_hist(s, d), ["image"], 8, quantizers.tree_cut),
    "c13_anneal": lambda s, d: quantizers.palettes(_hist(s, d), ["image"], 8, quantizers.anneal),
    "j10_cell_lookup": lambda s, d: points.cell_lookup(points.histogram(pixels(s, d)), points.cell_table(_palette(s, d), 3), 3).select("key", "idx"),
    "j11_exact_cells": lambda s, d: points.nearest_by_cells(points.histogram(pixels(s, d)), _palette(s, d), 4, ["key"]),
    "g3_segmentation": segmentation,
    "g4_g9_potts_merge": lambda s, d: _merged(s, d, merging.potts_key),
    "g5_rate_merge": lambda s, d: _merged(s, d, merging.rate_key),
    "e10_exclusion": lambda s, d: pricing.exclusion_bits(_stream(s, d), ["chain"], ["p1"], ["ts", "event_id"], "sym", "allowed", 5).select("chain", F.round("bits", 5).alias("bits"), "n"),
    "e11_hierarchy": lambda s, d: pricing.hierarchy_bits(_stream(s, d), ["chain"], [[], ["p1"], ["p1", "p2"]], ["ts", "event_id"], "sym", 5, 2.0).select("chain", F.round("bits", 5).alias("bits"), "n"),
    "e15_neighbour_price": lambda s, d: pricing.neighbour_price(*_regions(s, d)).select(F.round("bits", 5).alias("bits")),
    "e16_blend_price": lambda s, d: pricing.blend_price(*_regions(s, d)).select(F.round("bits", 5).alias("bits")),
    "e17_palette_price": lambda s, d: pricing.palette_price(*_regions(s, d)).select("entries", F.round("bits", 5).alias("bits")),
    "e25_range_coder": range_coder,
}

ORACLE_SQL = {
    "j10_cell_lookup": "WITH " + PAL + ", c AS (SELECT DISTINCT r // 32 AS cr, g // 32 AS cg, b // 32 AS cb FROM hist), l AS (SELECT cr, cg, cb, min({'d': (cr * 32 + 16 - pr) ** 2 + (cg * 32 + 16 - pg) ** 2 + (cb * 32 + 16 - pb) ** 2, 'idx': idx}).idx AS idx FROM c CROSS JOIN pal GROUP BY ALL) SELECT key, idx FROM hist JOIN l ON cr = r // 32 AND cg = g // 32 AND cb = b // 32",
    "j11_exact_cells": "WITH " + PAL + " SELECT key, m.d AS d, m.idx AS idx FROM near",
    "e10_exclusion": STREAM + ", k AS (SELECT t.*, " + ", ".join(f"1 + count(*) FILTER (sym = {k}) OVER w AS c{k}" for k in range(5)) + " FROM t WINDOW w AS (PARTITION BY chain, p1 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), v AS (SELECT *, [c0, c1, c2, c3, c4] AS c FROM k) SELECT chain, round(sum(log2((list_sum(c) - c[CAST(out AS INT) + 1]) / c[sym + 1])), 5) AS bits, count(*) AS n FROM v GROUP BY chain",
    "e11_hierarchy": STREAM + ", k AS (SELECT chain, " + ", ".join(f"row_number() OVER (PARTITION BY chain{c}, sym ORDER BY ts, event_id) - 1 AS n{i}, row_number() OVER (PARTITION BY chain{c} ORDER BY ts, event_id) - 1 AS t{i}" for i, c in enumerate(("", ", p1", ", p1, p2"))) + " FROM t) SELECT chain, round(sum(-log2((n2 + 2 * (n1 + 2 * (n0 + 2 * 0.2::DOUBLE) / (t0 + 2)) / (t1 + 2)) / (t2 + 2))), 5) AS bits, count(*) AS n FROM k GROUP BY chain",
    "e15_neighbour_price": REGIONS + ", src AS (SELECT g.r, g.g, g.b, coalesce(o.r, 128) AS pr, coalesce(o.g, 128) AS pg, coalesce(o.b, 128) AS pb FROM regs g LEFT JOIN best ON best.a = g.lab LEFT JOIN regs o ON o.lab = best.o)" + _residual("src"),
    "e16_blend_price": REGIONS + ", mean AS (SELECT rag.a, round(sum(len * o.r) / sum(len)) AS pr, round(sum(len * o.g) / sum(len)) AS pg, round(sum(len * o.b) / sum(len)) AS pb FROM rag JOIN regs o ON o.lab = rag.b WHERE rag.b < rag.a GROUP BY rag.a), src AS (SELECT g.r, g.g, g.b, coalesce(pr, 128) AS pr, coalesce(pg, 128) AS pg, coalesce(pb, 128) AS pb FROM regs g LEFT JOIN mean ON mean.a = g.lab)" + _residual("src"),
    "e17_palette_price": REGIONS + ", q AS (SELECT (g.r * 256 + g.g) * 256 + g.b AS col, (o.r * 256 + o.g) * 256 + o.b AS near FROM regs g LEFT JOIN best ON best.a = g.lab LEFT JOIN regs o ON o.lab = best.o), en AS (SELECT count(DISTINCT col) AS entries FROM q), k AS (SELECT near, col, count(*) AS k FROM q GROUP BY ALL) SELECT entries, CASE WHEN entries > 512 THEN CAST('inf' AS DOUBLE) ELSE round(sum(b) + 24 * entries, 5) END AS bits FROM (SELECT entries, (lgamma(sum(k) + entries) - lgamma(entries) - sum(lgamma(k + 1))) / ln(2) AS b FROM k, en GROUP BY near, entries) GROUP BY entries",
    "e25_range_coder": STREAM + " SELECT chain, count(*) AS n, count(*) FILTER (sym = 4) AS ones FROM t GROUP BY chain",
}


def _dense(s, d):
    return image_queries.planes(s, d)


def _hyab(s, d):
    """HyAB k-means in OKLab, whose axes stand in for the palette's three, and back to 0..255."""
    rgb = [F.col(c) for c in "rgb"]
    points = _hist(s, d).select("image", "cnt", *[c.alias(n) for c, n in zip(colour.rgb_to_oklab(*rgb), "rgb", strict=True)])
    palette = quantizers.palettes(points, ["image"], 8, kmeans.hyab_kmeans)
    return palette.select("image", "idx", *[c.alias(n) for c, n in zip(colour.oklab_to_rgb(*rgb), "rgb", strict=True)])


def _mixing(s, d):
    w = Window.partitionBy("chain").orderBy("ts", "event_id")
    rows = symbols(s, d).withColumn("none", F.lit(0)).withColumn("one", F.lag("sym", 1, 0).over(w)).withColumn("two", F.col("one") * 5 + F.lag("sym", 2, 0).over(w))
    return sequential.mixing_bits(rows, ["chain"], ["ts", "event_id"], "sym", ["none", "one", "two"], width=3)


QUERIES |= {
    "c5_farthest_kmeans": lambda s, d: quantizers.palettes(_hist(s, d), ["image"], 8, kmeans.kmeans),
    "c4_error_weighted_kmeans": lambda s, d: quantizers.palettes(_hist(s, d), ["image"], 8, partial(kmeans.kmeans, by_error=True)),
    "c6_spread_kmeans": lambda s, d: quantizers.palettes(_hist(s, d), ["image"], 8, partial(kmeans.kmeans, seeds=kmeans.spread_seeds)),
    "c6_random_kmeans": lambda s, d: quantizers.palettes(_hist(s, d), ["image"], 8, partial(kmeans.kmeans, seeds=kmeans.random_seeds)),
    "c8_o4_restarts": lambda s, d: quantizers.palettes(_hist(s, d), ["image"], 8, kmeans.restarted),
    "c9_hyab_kmeans": _hyab,
    "g6_relax": lambda s, d: sequential.relax(_dense(s, d), 400.0),
    "e24_mixing": _mixing,
    "e26_compressed_sizes": lambda s, d: sequential.compressed_sizes(geometry.sidecar(_dense(s, d)), ["image"], ["y", "x"], "delta"),
    "m12_leave_one_out": lambda s, d: sequential.leave_one_out(table(s, d, "benchmark").select(F.lit(0).alias("set"), "item_id", "text"), ["set"], "item_id", "text"),
}
