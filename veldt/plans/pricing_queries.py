"""Queries over boundary graphs, quadtrees, flooded seeds, code sizes and ladders of models, on the two dense images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entropy, geometry, images, points, pricing, raster, stats
from ..sources.views import pixels, table
from .image_queries import CRACKS, H_TAPS, INSIDE, PX, SEVEN_V, V_TAPS, H, W, _planes_of_cracks, _round, coarse, planes, rects
from .point_queries import PAL

#: Edges that sizes of residuals are put in buckets by.
MAGNITUDES = (0, 1, 2, 4, 8, 16, 32)
RW = "PARTITION BY image, y ORDER BY x"
CW = "PARTITION BY image, x ORDER BY y"
REGIONS = PX + """, reg AS (SELECT image, lab, count(*) AS area, CAST(round(avg(r)) AS BIGINT) AS r, CAST(round(avg(g)) AS BIGINT) AS g, CAST(round(avg(b)) AS BIGINT) AS b FROM px GROUP BY ALL)"""
RAG = REGIONS + f""", sides AS (SELECT image, lab AS a, lead(lab) OVER ({RW}) AS b FROM px UNION ALL SELECT image, lab, lead(lab) OVER ({CW}) FROM px),
rag AS (SELECT image, a, b, count(*) AS len FROM (SELECT * FROM sides WHERE a <> b UNION ALL SELECT image, b, a FROM sides WHERE a <> b) GROUP BY ALL),
wm AS (SELECT image, a AS lab, sum(len * r) / CAST(sum(len) AS DOUBLE) AS mr, sum(len * g) / CAST(sum(len) AS DOUBLE) AS mg, sum(len * b.b) / CAST(sum(len) AS DOUBLE) AS mb
  FROM rag JOIN reg b ON b.image = rag.image AND b.lab = rag.b WHERE rag.b < rag.a GROUP BY ALL),
mean AS (SELECT reg.*, coalesce(mr, 128.0) AS mr, coalesce(mg, 128.0) AS mg, coalesce(mb, 128.0) AS mb FROM reg LEFT JOIN wm USING (image, lab))"""
RAG = RAG.replace("SELECT image, a AS lab, sum(len", "SELECT rag.image, a AS lab, sum(len")


def adaptive_sql(source: str, by: str, context: str, symbol: str, n: int, name: str = "bits") -> str:
    """Rows (by, name): bits of an adaptive model by gamma functions."""
    return f"""SELECT {by}, round(sum(b), 5) AS {name} FROM (SELECT {by}, (lgamma(sum(k) + {n}) - lgamma({n}) - sum(lgamma(k + 1))) / ln(2) AS b
FROM (SELECT {by}, {context} AS c, {symbol} AS s, count(*) AS k FROM {source} GROUP BY ALL) GROUP BY {by}, c) GROUP BY {by}"""


def _bits(df):
    return df.withColumn("bits", F.round("bits", 5))


def _graph(s, d):
    px = planes(s, d)
    regions, rag = images.region_colours(px).select("image", "lab", "r", "g", "b"), raster.adjacency(px)
    return regions, rag


def reference_price(s, d):
    px = planes(s, d)
    regions = images.region_colours(px).select("image", "lab", "r", "g", "b")
    return _bits(pricing.reference_price(regions, coarse(px).join(px.select("image", "x", "y", "lab"), ["image", "x", "y"])))


def pinned_gain(s, d):
    got = pricing.pinned_gain(pricing.earlier_means(*_graph(s, d)))
    return got.select("image", F.round(F.col("a_r").cast("double"), 4).alias("a_r"), F.round(F.col("a_b").cast("double"), 4).alias("a_b"))


def residual_contexts(s, d):
    """Green residuals against the weighted mean, in the context of the residual before."""
    regions, rag = _graph(s, d)
    rows = pricing.previous_residual(pricing.earlier_means(regions, rag), rag)
    rows = rows.withColumn("c", entropy.bucket(F.col("before"), MAGNITUDES)).withColumn("z", F.least(F.greatest(F.col("d") + 256, F.lit(0)), F.lit(511)))
    return _bits(entropy.adaptive_bits(rows, ["image"], ["c"], "z", 512).select("image", "bits"))


def flood(s, d):
    px = planes(s, d)
    seeds = px.select("image", "x", "y", F.when((F.col("r") + 3 * F.col("x") + 5 * F.col("y")) % 19 == 0, 1).alias("seed"))
    return geometry.jump_flood(seeds, W, H).select("image", "x", "y", "site")


def flood_sql() -> str:
    """One common table a step; the place of a tap decides equal distances."""
    out = PX + """, seed AS (SELECT image, x, y, row_number() OVER (PARTITION BY image ORDER BY y, x) - 1 AS site FROM px WHERE (r + 3 * x + 5 * y) % 19 = 0),
j AS (SELECT px.image, px.x, px.y, site FROM px LEFT JOIN seed USING (image, x, y))"""
    step, at = 32, "j"
    while step:
        out += f""", o{step} AS (SELECT p.image, p.x, p.y, q.site, (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) AS far, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE 1 + (dy + 1) * 3 + dx + 1 END AS place
FROM {at} p, (SELECT unnest([-1, 0, 1]) AS dx) t1, (SELECT unnest([-1, 0, 1]) AS dy) t2, {at} q, seed s
WHERE q.image = p.image AND q.x = p.x + dx * {step} AND q.y = p.y + dy * {step} AND s.image = q.image AND s.site = q.site),
j{step} AS (SELECT p.image, p.x, p.y, b.site FROM {at} p LEFT JOIN (SELECT image, x, y, arg_min(site, far * 10 + place) AS site FROM o{step} GROUP BY ALL) b USING (image, x, y))"""
        at, step = f"j{step}", step // 2
    return out + f" SELECT image, x, y, site FROM {at}"


#: The taps of an occupancy plane, lowest bit first.
SEED_TAPS = [("v", dx, dy) for _, dx, dy in V_TAPS[:9]] + [("v", -3, 0)]


def seed_map(s, d):
    """Bytes of a plane that marks seeds, each bit in the context of ten earlier ones."""
    px = planes(s, d).select("image", "x", "y", ((F.col("r") + 3 * F.col("x") + 5 * F.col("y")) % 19 == 0).cast("int").alias("v"))
    bits = entropy.adaptive_bits(images.template_context(px, SEED_TAPS), ["image"], ["context"], "v", 2)
    return _round(bits.select("image", (F.col("bits") / 8).alias("bytes")))


def by_rings(s, d):
    """The nearest popular colours again, without a broadcast."""
    hist = points.histogram(pixels(s, d))
    pal = points.popularity(hist, 16).select("idx", *[F.col(c).alias(f"p{c}") for c in "rgb"])
    got = points.nearest_by_rings(hist, pal, [(c, f"p{c}") for c in "rgb"], ["key"], 16.0)
    return got.select("key", F.col("d").cast("long").alias("d"), F.col("idx").cast("long").alias("idx"))


#: Named sets of taps for the bits to the right and below.
VARIANTS = {"ten": (V_TAPS, H_TAPS), "seven": (SEVEN_V, H_TAPS[:7]), "own": (V_TAPS[:4], H_TAPS[:4])}
MODES = ("planes", "planes_reversed", "cells", "cells_reversed")


def causality(s, d):
    """Taps of each variant that a schedule has not coded yet."""
    rows = [(name, own, "vh".index(p), dx, dy) for name, taps in VARIANTS.items() for own, t in zip("vh", taps, strict=True) for p, dx, dy in t]
    taps, out = s.createDataFrame(rows, "variant string, own string, plane int, dx int, dy int"), None
    for mode in MODES:
        early = F.when(F.col("own") == "v", geometry.is_causal(mode, "v", F.col("plane"), F.col("dx"), F.col("dy"))).otherwise(geometry.is_causal(mode, "h", F.col("plane"), F.col("dx"), F.col("dy")))
        got = taps.groupBy("variant").agg(F.count_if(~early).alias("late")).select(F.lit(mode).alias("schedule"), "variant", "late")
        out = got if out is None else out.union(got)
    return out


def causality_sql() -> str:
    taps = ", ".join(f"('{n}', {i}, {'vh'.index(p)}, {dx}, {dy})" for n, ts in VARIANTS.items() for i, t in enumerate(ts) for p, dx, dy in t)
    first = {"planes": "pl < own OR (pl = own AND {yx})", "planes_reversed": "pl > own OR (pl = own AND {yx})", "cells": "{yx} OR (dx = 0 AND dy = 0 AND pl < own)", "cells_reversed": "{yx} OR (dx = 0 AND dy = 0 AND pl > own)"}
    yx = "(dy < 0 OR (dy = 0 AND dx < 0))"
    return f"WITH t(variant, own, pl, dx, dy) AS (VALUES {taps}) " + " UNION ALL ".join(f"SELECT '{m}' AS schedule, variant, count(*) FILTER (NOT ({c.format(yx=yx)})) AS late FROM t GROUP BY variant" for m, c in first.items())


def schedules(s, d):
    """Bytes of both planes for every variant; the schedule decides which variants are allowed, not what they cost."""
    cracks, out = _planes_of_cracks(s, d), None
    for name, taps in VARIANTS.items():
        for plane, wanted in zip("vh", taps, strict=True):
            rows = images.template_context(cracks, wanted)
            got = entropy.adaptive_bits(rows, ["image"], ["context"], plane, 2).select(F.lit(name).alias("variant"), F.lit(plane).alias("plane"), "image", (F.col("bits") / 8).alias("bytes"))
            out = got if out is None else out.union(got)
    return _round(out)


def _context_sql(taps) -> str:
    return " + ".join(f"coalesce((SELECT {p} FROM cr b WHERE b.image = a.image AND b.x = a.x + ({dx}) AND b.y = a.y + ({dy})), 0) * {1 << i}" for i, (p, dx, dy) in enumerate(taps))


def schedules_sql() -> str:
    parts = [f"SELECT image, '{n}' AS variant, '{p}' AS plane, {p} AS bit, {_context_sql(t)} AS ctx FROM cr a" for n, ts in VARIANTS.items() for p, t in zip("vh", ts, strict=True)]
    return CRACKS + f", o AS ({' UNION ALL '.join(parts)}) SELECT variant, plane, image, round(sum(b) / 8, 6) AS bytes FROM (SELECT variant, plane, image, (lgamma(sum(k) + 2) - sum(lgamma(k + 1))) / ln(2) AS b FROM (SELECT variant, plane, image, ctx, bit, count(*) AS k FROM o GROUP BY ALL) GROUP BY variant, plane, image, ctx) GROUP BY ALL"


POOL = V_TAPS[1:7]


def _tap_columns(s, d):
    """Boundary bits to the right, that of the cell to the left as `base`, and the pool of taps."""
    rows = _planes_of_cracks(s, d)
    for i, tap in enumerate([V_TAPS[0], *POOL]):
        rows = images.template_context(rows, [tap]).withColumnRenamed("context", "base" if i == 0 else f"t{i}")
    return rows.filter(INSIDE["v"])


def greedy(s, d):
    got = pricing.greedy_taps(_tap_columns(s, d), "v", "base", [f"t{i + 1}" for i in range(len(POOL))], 3)
    return s.createDataFrame([(i, c, round(b, 4)) for i, (c, b) in enumerate(got)], "step int, tap string, bits double")


def greedy_sql() -> str:
    cols = ", ".join(f"{_context_sql([t])} AS {'base' if i == 0 else f't{i}'}" for i, t in enumerate([V_TAPS[0], *POOL]))
    pool = ", ".join(f"{{'tap': 't{i + 1}', 'bit': t{i + 1}}}" for i in range(len(POOL)))
    out = CRACKS + f", w AS (SELECT image, x, y, v, {cols} FROM cr a WHERE {INSIDE['v']}), l AS (SELECT image, x, y, v, unnest([{pool}], recursive := true) FROM w), c0 AS (SELECT image, x, y, base AS ctx FROM w), used0 AS (SELECT '' AS tap)"
    for k in range(3):
        out += f""", p{k} AS (SELECT tap, round(sum(b), 6) AS bits FROM (SELECT tap, (lgamma(sum(k) + 2) - sum(lgamma(k + 1))) / ln(2) AS b FROM (SELECT tap, ctx * 2 + bit AS ctx, v, count(*) AS k FROM l JOIN c{k} USING (image, x, y) GROUP BY ALL) GROUP BY tap, ctx)
WHERE tap NOT IN (SELECT tap FROM used{k}) GROUP BY tap), b{k} AS (SELECT tap, bits FROM p{k} ORDER BY bits, tap LIMIT 1), used{k + 1} AS (SELECT tap FROM used{k} UNION ALL SELECT tap FROM b{k}),
c{k + 1} AS (SELECT image, x, y, ctx * 2 + bit AS ctx FROM c{k} JOIN l USING (image, x, y) JOIN b{k} USING (tap))"""
    return out + " " + " UNION ALL ".join(f"SELECT CAST({k} AS INT) AS step, tap, round(bits, 4) AS bits FROM b{k}" for k in range(3))


MODELS = {"a_none": [], "b_left": ["base"], "c_left_up": ["base", "t2"], "d_four": ["base", "t2", "t3", "t4"], "e_junk": ["junk"]}


def _ladder(s, d):
    rows = _tap_columns(s, d).withColumn("junk", entropy.congruential(F.col("x") + F.col("y") * W) % 8)
    return pricing.model_ladder(rows, ["image"], MODELS, "v", 2)


def ladder_sql() -> str:
    cols = ", ".join(f"{_context_sql([t])} AS {'base' if i == 0 else f't{i}'}" for i, t in enumerate([V_TAPS[0], *POOL]))
    key = lambda cs: " || ',' || ".join([f"CAST({c} AS VARCHAR)" for c in cs]) or "''"
    named = " UNION ALL ".join(f"SELECT image, v, '{m}' AS model, {key(cs)} AS ctx FROM w" for m, cs in MODELS.items())
    return CRACKS + f""", w AS (SELECT image, v, (CAST(x + y * {W} AS BIGINT) * 1664525 + 1013904223) % 4294967296 % 8 AS junk, {cols} FROM cr a WHERE {INSIDE['v']}), m AS ({named}), k AS (SELECT image, model, ctx, v, count(*) AS k FROM m GROUP BY ALL),
t AS (SELECT image, model, ctx, (lgamma(sum(k) + 2) - sum(lgamma(k + 1))) / ln(2) AS a, sum(k) * log2(sum(k)) - sum(k * log2(k)) AS s FROM k GROUP BY ALL), ladder AS (SELECT image, model, sum(a) AS adaptive, sum(s) AS static FROM t GROUP BY ALL)"""


def quadtree_sql() -> str:
    """Nodes level by level: those whose parent holds two values."""
    out = PX + f", q0 AS (SELECT image, x, y, r // 32 AS v, 0 AS l, 0 AS t, {W} AS w, {H} AS h FROM px)"
    depth = max(W - 1, H - 1).bit_length()
    for k in range(depth + 1):
        out += f", n{k} AS (SELECT image, l, t, w, h, min(v) <> max(v) AS mixed FROM q{k} GROUP BY ALL)"
        if k < depth:
            out += f""", q{k + 1} AS (SELECT q.image, q.x, q.y, v, CASE WHEN x >= l + (w + 1) // 2 THEN l + (w + 1) // 2 ELSE l END AS l, CASE WHEN y >= t + (h + 1) // 2 THEN t + (h + 1) // 2 ELSE t END AS t,
CASE WHEN x >= l + (w + 1) // 2 THEN w - (w + 1) // 2 ELSE (w + 1) // 2 END AS w, CASE WHEN y >= t + (h + 1) // 2 THEN h - (h + 1) // 2 ELSE (h + 1) // 2 END AS h FROM q{k} q JOIN n{k} USING (image, l, t, w, h) WHERE mixed)"""
    every = " UNION ALL ".join(f"SELECT image, mixed FROM n{k}" for k in range(depth + 1))
    return out + f" SELECT image, count(*) AS nodes, count(*) FILTER (NOT mixed) AS leaves, CAST(ceil((count(*) + 8 * count(*) FILTER (NOT mixed)) / 8.0) AS BIGINT) AS bytes FROM ({every}) GROUP BY image"


def levels(px):
    return px.withColumn("v", F.expr("r div 32"))


VARINT = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 ELSE 3 END"

QUERIES = {
    "g11_crack_vertices": lambda s, d: geometry.crack_vertices(planes(s, d)),
    "g14_quadtree": lambda s, d: geometry.quadtree(levels(planes(s, d)), "v", W, H),
    "g17_causality": causality,
    "j16_jump_flood": flood,
    "e27_run_code": lambda s, d: geometry.run_code_bytes(geometry.runs_by_row(levels(planes(s, d)), "v")),
    "e27_rectangle_code": lambda s, d: geometry.rectangle_code_bytes(rects(s, d), ["x", "y", "w", "h", "lab"], "lab", 16, 11),
    "e30_sidecar": lambda s, d: geometry.sidecar(planes(s, d)),
    "e18_reference_price": reference_price,
    "e19_first_cell_entropy": lambda s, d: _bits(pricing.first_cell_entropy(planes(s, d))),
    "a28_pinned_gain": pinned_gain,
    "w11_previous_residual": residual_contexts,
    "e6_schedules": schedules,
    "e21_seed_map": seed_map,
    "j12_nearest_by_rings": by_rings,
    "a29_experiment_summary": lambda s, d: _round(stats.experiment_summary(table(s, d, "lineitem"), "l_returnflag", "l_orderkey", "l_linenumber", "l_suppkey")),
    "o5_greedy_taps": greedy,
    "e22_model_ladder": lambda s, d: _round(_ladder(s, d)),
    "o8_best_models": lambda s, d: pricing.best_models(_ladder(s, d), ["image"]).select("image", "best", F.round("bits", 4).alias("bits"), "best_static", F.round("static_bits", 4).alias("static_bits")),
    "s18_hosts_and_urls": lambda s, d: table(s, d, "pages").groupBy(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host")).agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls")),
}

ORACLE_SQL = {
    "g11_crack_vertices": CRACKS + f""", ends AS (SELECT image, x + 1 AS vx, y AS vy FROM cr WHERE v = 1 UNION ALL SELECT image, x + 1, y + 1 FROM cr WHERE v = 1 UNION ALL SELECT image, x, y + 1 FROM cr WHERE h = 1 UNION ALL SELECT image, x + 1, y + 1 FROM cr WHERE h = 1)
SELECT image, vx, vy, CAST(count(*) AS INT) AS degree, (vx IN (0, {W}) OR vy IN (0, {H})) AS frame FROM ends GROUP BY image, vx, vy""",
    "g14_quadtree": quadtree_sql(),
    "g17_causality": causality_sql(),
    "j16_jump_flood": flood_sql(),
    "e27_run_code": PX + f""", z AS (SELECT image, y, x, r // 32 AS v FROM px), n AS (SELECT *, CASE WHEN v = lag(v) OVER ({RW}) THEN 0 ELSE 1 END AS new FROM z), u AS (SELECT *, sum(new) OVER ({RW}) AS run FROM n),
k AS (SELECT image, y, run, count(*) AS len FROM u GROUP BY ALL) SELECT image, CAST(sum({VARINT.format('len')} + 1) AS BIGINT) AS bytes FROM k GROUP BY image""",
    "e27_rectangle_code": f"""WITH z AS (SELECT unnest([s_suppkey % 16, s_suppkey % 11, 1 + s_nationkey % 4, 1 + s_suppkey % 3, s_nationkey]) AS f FROM supplier),
c AS (SELECT count(*) AS rects, count(DISTINCT s_nationkey) AS entries FROM supplier), f AS (SELECT sum({VARINT.format('f')}) AS f FROM z)
SELECT 0 AS image, rects, entries, CAST(2 + {VARINT.format('entries')} + {VARINT.format('rects')} + 3 * entries + f AS BIGINT) AS bytes FROM c, f""",
    "e30_sidecar": CRACKS + f" SELECT px.image, px.x, px.y, px.lab % 65536 AS plane, (px.lab - lag(px.lab, 1, 0) OVER (PARTITION BY px.image, px.y ORDER BY px.x) + 65536) % 65536 AS delta, v + 2 * h AS edge FROM px JOIN cr USING (image, x, y)",
    "e18_reference_price": REGIONS + """, ref AS (SELECT image, lab, round(avg(qr)) AS r, round(avg(qg)) AS g, round(avg(qb)) AS b FROM px JOIN qx USING (image, x, y) GROUP BY ALL),
d AS (SELECT image, unnest([{'c': 'r', 'd': reg.r - ref.r}, {'c': 'g', 'd': reg.g - ref.g}, {'c': 'b', 'd': reg.b - ref.b}], recursive := true) FROM reg JOIN ref USING (image, lab))
""" + adaptive_sql("d", "image", "c", "greatest(0, least(511, d + 256))", 512),
    "e19_first_cell_entropy": PX + f""", m AS (SELECT image, lab, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM px GROUP BY ALL), n AS (SELECT image, lab, x, y, coalesce(lag(lab) OVER ({RW}), lag(lab) OVER ({CW})) AS near FROM px),
fc AS (SELECT image, lab, arg_min(near, y * 1000 + x) AS near FROM (SELECT image, lab, x, y, coalesce(near, -1) AS near FROM n) GROUP BY ALL),
d AS (SELECT fc.image, unnest([CAST(round(a.r - coalesce(o.r, 128)) AS INT), CAST(round(a.g - coalesce(o.g, 128)) AS INT), CAST(round(a.b - coalesce(o.b, 128)) AS INT)]) AS d FROM fc JOIN m a USING (image, lab) LEFT JOIN m o ON o.image = fc.image AND o.lab = fc.near),
k AS (SELECT image, d, count(*) AS k FROM d GROUP BY ALL) SELECT image, round(sum(k) * log2(sum(k)) - sum(k * log2(k)), 5) AS bits FROM k GROUP BY image""",
    "a28_pinned_gain": RAG + """, z AS (SELECT image, g - mg AS t, r - mr AS yr, b - mb AS yb, CASE WHEN mg >= 1 THEN (g - mg) * (mr / mg - 1) ELSE 0 END AS xr, CASE WHEN mg >= 1 THEN (g - mg) * (mb / mg - 1) ELSE 0 END AS xb FROM mean)
SELECT image, round(CAST(CAST((sum(yr * xr) - sum(t * xr)) / sum(xr * xr) AS FLOAT) AS DOUBLE), 4) AS a_r, round(CAST(CAST((sum(yb * xb) - sum(t * xb)) / sum(xb * xb) AS FLOAT) AS DOUBLE), 4) AS a_b FROM z GROUP BY image""",
    "w11_previous_residual": RAG + """, e AS (SELECT image, lab, CAST(g - round(mg) AS INT) AS d FROM mean), pr AS (SELECT image, lab, d, lag(d) OVER (PARTITION BY image ORDER BY lab) AS p FROM e),
best AS (SELECT image, a AS lab, arg_min(b, -len * 1000000 + b) AS b FROM rag WHERE b < a GROUP BY ALL),
z AS (SELECT pr.image, pr.d, abs(coalesce(o.d, pr.p, 0)) AS before FROM pr LEFT JOIN best USING (image, lab) LEFT JOIN e o ON o.image = pr.image AND o.lab = best.b)
""" + adaptive_sql("z", "image", "CASE " + " ".join(f"WHEN before <= {e} THEN {i}" for i, e in enumerate(MAGNITUDES)) + f" ELSE {len(MAGNITUDES)} END", "greatest(0, least(511, d + 256))", 512),
    "e6_schedules": schedules_sql(),
    "e21_seed_map": PX + ", cr AS (SELECT image, x, y, CAST((r + 3 * x + 5 * y) % 19 = 0 AS INT) AS v FROM px), o AS (SELECT image, v, " + _context_sql(SEED_TAPS) + """ AS ctx FROM cr a),
k AS (SELECT image, ctx, v, count(*) AS k FROM o GROUP BY ALL), t AS (SELECT image, ctx, (lgamma(sum(k) + 2) - sum(lgamma(k + 1))) / ln(2) AS b FROM k GROUP BY ALL) SELECT image, round(sum(b) / 8, 6) AS bytes FROM t GROUP BY image""",
    "j12_nearest_by_rings": "WITH " + PAL + " SELECT key, m.d AS d, m.idx AS idx FROM near",
    "a29_experiment_summary": "SELECT l_returnflag, CAST(sum(l_orderkey) AS BIGINT) AS total, max(l_linenumber) AS slowest_encode, max(l_suppkey) AS slowest_decode, round(avg(l_orderkey), 6) AS mean FROM lineitem GROUP BY l_returnflag",
    "o5_greedy_taps": greedy_sql(),
    "e22_model_ladder": ladder_sql() + " SELECT image, model, round(adaptive, 6) AS adaptive, round(static, 6) AS static FROM ladder",
    "o8_best_models": ladder_sql() + """, r AS (SELECT image, model, round(adaptive, 6) AS a, round(static, 6) AS s FROM ladder), x AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY a, model) AS i, row_number() OVER (PARTITION BY image ORDER BY s, model) AS j FROM r)
SELECT image, max(model) FILTER (i = 1) AS best, round(max(a) FILTER (i = 1), 4) AS bits, max(model) FILTER (j = 1) AS best_static, round(max(s) FILTER (j = 1), 4) AS static_bits FROM x GROUP BY image""",
    "s18_hosts_and_urls": "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS n, count(DISTINCT url) AS urls FROM pages GROUP BY ALL",
}
