"""Queries over two dense images of the events: paired errors, crops, region statistics, planes, partitions, templates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import colour
from ..operators import entropy, images, raster, stats
from ..sources.views import pixels, symbols, table
from .function_queries import OKLAB, _colours, _rgb
from .point_queries import HIST, PAL, _near
from .raster_queries import STREAM

W, H = 24, 31
PX = f"""WITH c AS (SELECT CAST(user_id % 2 AS INT) AS image, CAST(hour(ts) AS INT) AS x, CAST(day(ts) AS INT) - 1 AS y, count(*) AS n,
  count(*) FILTER (event_type = 'click') AS k, count(*) FILTER (event_type = 'view') AS v FROM events GROUP BY ALL),
f AS (SELECT CAST(i AS INT) AS image, CAST(a AS INT) AS x, CAST(b AS INT) AS y FROM range(2) t(i), range({W}) u(a), range({H}) w(b)),
px AS (SELECT image, x, y, CAST(coalesce(n, 0) * 37 % 256 AS INT) AS r, CAST(coalesce(k, 0) * 53 % 256 AS INT) AS g, CAST(coalesce(v, 0) * 71 % 256 AS INT) AS b,
  CAST(x // 3 * 100 + y // 3 * 2 + coalesce(n, 0) % 2 AS INT) AS lab, CAST(x // 4 * 100 + y // 3 * 2 + coalesce(n, 0) % 2 AS INT) AS lab2 FROM f LEFT JOIN c USING (image, x, y)),
qx AS (SELECT image, x, y, r - r % 32 + 16 AS qr, g - g % 32 + 16 AS qg, b - b % 32 + 16 AS qb FROM px)"""


def planes(spark, d):
    """Every cell of two images of hours by days: channels and two labels; cells without events count as 0."""
    kind = F.col("event_type")
    counts = table(spark, d, "events").groupBy((F.col("user_id") % 2).cast("int").alias("image"), F.hour("ts").alias("x"), (F.dayofmonth("ts") - 1).alias("y"))
    counts = counts.agg(F.count("*").alias("n"), F.count_if(kind == "click").alias("k"), F.count_if(kind == "view").alias("v"))
    cell = F.col("id").cast("int")
    frame = spark.range(2 * W * H).select(F.floor(cell / (W * H)).cast("int").alias("image"), (cell % W).alias("x"), (F.floor(cell / W) % H).cast("int").alias("y"))
    rows = frame.join(counts, ["image", "x", "y"], "left").fillna(0, ["n", "k", "v"])
    lab = lambda size: F.expr(f"cast(x div {size} * 100 + y div 3 * 2 + n % 2 as int)")
    scaled = [(F.col(c) * m % 256).cast("int").alias(name) for c, m, name in (("n", 37, "r"), ("k", 53, "g"), ("v", 71, "b"))]
    return rows.select("image", "x", "y", *scaled, lab(3).alias("lab"), lab(4).alias("lab2"))


def coarse(px):
    return px.select("image", "x", "y", *[(F.col(c) - F.col(c) % 32 + 16).alias(c) for c in "rgb"])


def _round(df):
    """Doubles to six decimals and without negative zeros, so that both engines agree on the last digit."""
    return df.select(*[(F.round(f.name, 6) + F.lit(0.0)).alias(f.name) if f.dataType.simpleString() == "double" else f.name for f in df.schema.fields])


def _pairs(s, d):
    px = planes(s, d)
    return images.paired(px, coarse(px))


PAIRS = PX + """, e AS (SELECT px.*, abs(r - qr) AS er, abs(g - qg) AS eg, abs(b - qb) AS eb FROM px JOIN qx USING (image, x, y))"""
FIDELITY = """count(*) AS n, CAST(sum(er * er + eg * eg + eb * eb) AS BIGINT) AS sse, CAST(max(greatest(er, eg, eb)) AS BIGINT) AS most,
""" + ", ".join(f"round(100.0 * count(*) FILTER (greatest(er, eg, eb) > {t}) / count(*), 6) AS over{t}" for t in (1, 2, 4, 8)) + ", round(sum(er + eg + eb) / (3.0 * count(*)), 6) AS mae"  # fmt: skip
WINDOWS = [("corner", 0, 0, 6, 6), ("middle", 8, 10, 9, 12), ("edge", 20, 25, 4, 6)]


def fidelity(s, d):
    rows = images.fidelity(_pairs(s, d), ["image"])
    return _round(rows.withColumn("psnr", colour.psnr_99(F.col("sse"), F.col("n"))).withColumn("psnr_inf", colour.psnr_inf(F.col("sse") / (3 * F.col("n")))))


def exact_fidelity(s, d):
    """An image against itself: 99 by one definition, infinite by the other."""
    px = planes(s, d)
    rows = images.fidelity(images.paired(px, px.select("image", "x", "y", *"rgb")), ["image"]).select("image", "n", "sse")
    return rows.withColumn("psnr", colour.psnr_99(F.col("sse"), F.col("n"))).withColumn("psnr_inf", colour.psnr_inf(F.col("sse") / (3 * F.col("n"))))


def amplified(s, d):
    e = [F.least(F.lit(255), 8 * c) for c in images.errors()]
    rows = _pairs(s, d).groupBy("image").agg(F.max(F.greatest(*e)).alias("most"), F.avg(sum(e, F.lit(0)) / 3).alias("mean"))
    return _round(rows)


def _sizes(s, d):
    px = planes(s, d)
    per = raster.perimeters(px)
    return raster.areas(px).join(per, ["image", "lab"], "left").fillna(0, ["perimeter"])


SIZES = PX + """, s1 AS (SELECT image, lab AS a, lead(lab) OVER (PARTITION BY image, y ORDER BY x) AS b FROM px UNION ALL SELECT image, lab, lead(lab) OVER (PARTITION BY image, x ORDER BY y) FROM px),
p1 AS (SELECT image, a AS lab FROM s1 WHERE a <> b UNION ALL SELECT image, b FROM s1 WHERE a <> b), p2 AS (SELECT image, lab, count(*) AS perimeter FROM p1 GROUP BY ALL),
sizes AS (SELECT z.image, z.lab, area, coalesce(perimeter, 0) AS perimeter FROM (SELECT image, lab, count(*) AS area FROM px GROUP BY ALL) z LEFT JOIN p2 USING (image, lab)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY area DESC, lab) AS i, count(*) OVER (PARTITION BY image) AS n,
  sum(area) OVER (PARTITION BY image ORDER BY area DESC, lab) AS ca, sum(perimeter) OVER (PARTITION BY image ORDER BY area DESC, lab) AS cp FROM sizes)"""


def _planes_of_cracks(s, d):
    return raster.cracks(planes(s, d)).select("image", "x", "y", "v", "h")


CRACKS = PX + f""", cr AS (SELECT image, x, y, coalesce(CAST(lead(lab) OVER (PARTITION BY image, y ORDER BY x) <> lab AS INT), 0) AS v, coalesce(CAST(lead(lab) OVER (PARTITION BY image, x ORDER BY y) <> lab AS INT), 0) AS h FROM px)"""

#: The cells whose bits form the context of a boundary bit, lowest bit first (plane, dx, dy).
V_TAPS = [("v", -1, 0), ("v", -2, 0), ("v", 0, -1), ("v", -1, -1), ("v", 1, -1), ("v", 2, -1), ("v", 0, -2), ("v", -1, -2), ("v", 1, -2), ("v", -2, -1)]
H_TAPS = [("h", -1, 0), ("h", 0, -1), ("h", -1, -1), ("h", 1, -1), ("v", 1, 0), ("v", 0, 0), ("v", -1, 0), ("v", 0, 1), ("v", -1, 1), ("h", -2, 0)]
SEVEN = [(0, -1, 0), (0, 0, -1), (0, -1, -1), (0, 1, -1), (0, -2, 0), (1, 0, -1), (1, -1, 0)]
SEVEN_V = [("vh"[p], dx, dy) for p, dx, dy in SEVEN]
SEVEN_H = [("hv"[p], dx, dy) for p, dx, dy in SEVEN]
INSIDE = {"v": f"x < {W - 1}", "h": f"y < {H - 1}"}


def templates(s, d, taps, alpha, measure=entropy.adaptive_bits):
    """Bytes of both boundary planes, each bit in the context of its taps."""
    cracks, total = _planes_of_cracks(s, d), None
    for plane, wanted in zip("vh", taps, strict=True):
        rows = images.template_context(cracks, wanted).filter(INSIDE[plane])
        if measure is entropy.adaptive_bits:
            bits = measure(rows, ["image"], ["context"], plane, 2, alpha).select("image", "bits", "contexts")
        else:
            bits = measure(rows, ["image"], ["context"], plane).join(rows.groupBy("image").agg(F.countDistinct("context").alias("contexts")), "image")
        total = bits if total is None else total.union(bits)
    return _round(total.groupBy("image").agg((F.sum("bits") / 8).alias("bytes"), F.sum("contexts").cast("long").alias("contexts")))


def templates_sql(taps, alpha) -> str:
    parts = []
    for plane, wanted in zip("vh", taps, strict=True):
        bits = " + ".join(f"coalesce((SELECT {p} FROM cr b WHERE b.image = a.image AND b.x = a.x + ({dx}) AND b.y = a.y + ({dy})), 0) * {1 << i}" for i, (p, dx, dy) in enumerate(wanted))
        parts.append(f"SELECT image, '{plane}' AS plane, {plane} AS bit, {bits} AS ctx FROM cr a WHERE {INSIDE[plane]}")
    k = CRACKS + f", o AS ({' UNION ALL '.join(parts)}), k AS (SELECT image, plane, ctx, bit, count(*) AS k FROM o GROUP BY ALL), t AS (SELECT image, plane, ctx, sum(k) AS t"
    if alpha is None:
        return k + ", sum(k * log2(k)) AS kl FROM k GROUP BY ALL) SELECT image, round(sum(t * log2(t) - kl) / 8, 6) AS bytes, count(*) AS contexts FROM t GROUP BY image"
    a = f"CAST({alpha} AS DOUBLE)"
    return k + f", sum(lgamma(k + {a}) - lgamma({a})) AS num FROM k GROUP BY ALL) SELECT image, round(sum((lgamma(t + 2 * {a}) - lgamma(2 * {a}) - num) / ln(2)) / 8, 6) AS bytes, count(*) AS contexts FROM t GROUP BY image"


def numbers(s, d):
    v, n = F.col("l_linenumber").cast("int"), F.col("l_orderkey")
    q = (F.col("l_quantity") - 25).cast("int")
    a, b = entropy.schedule_key("cells", v % 2, q, v), entropy.schedule_key("cells", v % 3, q + 1, v)
    return table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", entropy.human(n * n).alias("human"), entropy.signed_bucket(q).alias("signed"), entropy.gradient_context(q, v * 5, F.lit(9)).cast("long").alias("gradient"),
        entropy.capped(v, 4).alias("capped"), entropy.recent_turns(n, 3).alias("recent"), (a < b).alias("earlier"), F.expr("l_orderkey * l_orderkey * 9 div 16").alias("px"),
    )


def _bucket_sql(v: str, edges) -> str:
    return "CAST(CASE " + " ".join(f"WHEN {v} <= {e} THEN {i}" for i, e in enumerate(edges)) + f" ELSE {len(edges)} END AS INT)"


NUMBERS = f"""WITH n AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS INT) AS v, CAST(l_quantity - 25 AS INT) AS q, l_orderkey * l_orderkey AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.1f KB', CAST(s AS DOUBLE) / 1024) ELSE printf('%.2f MB', CAST(s AS DOUBLE) / 1048576) END AS human,
{_bucket_sql('q', entropy.SIGNED_EDGES)} AS signed, CAST({_bucket_sql('abs(v * 5 - q)', entropy.GRADIENT_EDGES)} * 9 + {_bucket_sql('abs(9 - v * 5)', entropy.GRADIENT_EDGES)} AS BIGINT) AS gradient,
least(v, 3) AS capped, l_orderkey % 27 AS recent, (q < q + 1) AS earlier, s * 9 // 16 AS px FROM n"""


def _de_sql(source: str) -> str:
    """CTEs from source(key, cnt, l1, a1, b1, l2, a2, b2) to de(key, cnt, de)."""
    hue = lambda b, a: f"CASE WHEN {a} = 0 AND {b} = 0 THEN 0 WHEN degrees(atan2({b}, {a})) < 0 THEN degrees(atan2({b}, {a})) + 360 ELSE degrees(atan2({b}, {a})) END"
    return f"""d1 AS (SELECT *, pow((sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2, 7) AS c7 FROM {source}),
d2 AS (SELECT *, (1.5 - 0.5 * sqrt(c7 / (c7 + 6103515625.0))) * a1 AS x1, (1.5 - 0.5 * sqrt(c7 / (c7 + 6103515625.0))) * a2 AS x2 FROM d1),
d3 AS (SELECT *, sqrt(x1 * x1 + b1 * b1) AS c1, sqrt(x2 * x2 + b2 * b2) AS c2, {hue('b1', 'x1')} AS h1, {hue('b2', 'x2')} AS h2 FROM d2),
d4 AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS turn,
  CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm, (l1 + l2) / 2 - 50 AS lo, (c1 + c2) / 2 AS cm FROM d3),
d5 AS (SELECT *, 2 * sqrt(c1 * c2) * sin(radians(turn / 2)) AS dh, 1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.20 * cos(radians(4 * hm - 63)) AS t,
  -2 * sqrt(pow(cm, 7) / (pow(cm, 7) + 6103515625.0)) * sin(radians(60 * exp(-pow((hm - 275) / 25, 2)))) AS rt FROM d4),
d6 AS (SELECT *, (l2 - l1) / (1 + 0.015 * lo * lo / sqrt(20 + lo * lo)) AS u, (c2 - c1) / (1 + 0.045 * cm) AS v, dh / (1 + 0.015 * cm * t) AS w FROM d5),
de AS (SELECT key, cnt, sqrt(u * u + v * v + w * w + rt * v * w) AS de FROM d6)"""


def _lab_sql(source: str, name: str, r: str, g: str, b: str, keep: str) -> str:
    lin = lambda c: f"CASE WHEN {c} / CAST(255 AS DOUBLE) <= 0.04045 THEN {c} / CAST(255 AS DOUBLE) / 12.92 ELSE pow(({c} / CAST(255 AS DOUBLE) + 0.055) / 1.055, 2.4) END"
    f = lambda v: f"CASE WHEN {v} > {colour.EPSILON!r} THEN cbrt({v}) ELSE ({colour.KAPPA!r} * {v} + 16) / 116 END"
    row = lambda m, w: "(" + " + ".join(f"CAST({k!r} AS DOUBLE) * l{c}" for k, c in zip(m, "rgb", strict=True)) + f") / CAST({w!r} AS DOUBLE)"
    x, y, z = (row(m, w) for m, w in zip(colour.XYZ, colour.WHITE, strict=True))
    return f"""{name}_l AS (SELECT {keep}, {lin(r)} AS lr, {lin(g)} AS lg, {lin(b)} AS lb FROM {source}), {name}_x AS (SELECT {keep}, {x} AS x, {y} AS y, {z} AS z FROM {name}_l),
{name}_f AS (SELECT {keep}, {f('x')} AS fx, {f('y')} AS fy, {f('z')} AS fz FROM {name}_x), {name} AS (SELECT {keep}, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b FROM {name}_f)"""


def de_scores(s, d):
    """Palette scoring: MSE, PSNR, mean and 95th percentile (floor place) of CIEDE2000 against the nearest entry."""
    lab = lambda cols: colour.rgb_to_lab(*(F.col(c) for c in cols))
    rows = _near(s, d).withColumn("de", F.round(colour.ciede2000(lab(("r", "g", "b")), lab(("pr", "pg", "pb"))), 9))
    per = rows.groupBy("de").agg(F.sum("cnt").alias("c"), F.sum(F.col("d") * F.col("cnt")).alias("sse"))
    per = per.withColumn("_s", F.floor("de"))
    parts = per.groupBy("_s").agg(F.sum("c").alias("own")).withColumn("upto", F.sum("own").over(Window.orderBy("_s")))  # a row for each whole unit of difference
    all_ = rows.agg(F.sum("cnt").alias("n"), F.sum(F.col("d") * F.col("cnt")).alias("sse"), (F.sum(F.col("de") * F.col("cnt")) / F.sum("cnt")).alias("mean_de")).withColumn("at", F.least(F.col("n") - 1, F.floor(F.lit(0.95) * F.col("n"))))
    near = per.join(F.broadcast(parts), "_s").join(F.broadcast(all_.select("at"))).filter((F.col("at") >= F.col("upto") - F.col("own")) & (F.col("at") < F.col("upto")))
    last = F.col("upto") - F.col("own") + F.sum("c").over(Window.partitionBy("_s").orderBy("de"))
    p95 = near.withColumn("last", last).filter(F.col("last") > F.col("at")).agg(F.min("de").alias("p95_de"))
    mse = F.col("sse") / (3 * F.col("n"))
    return all_.join(F.broadcast(p95)).select("n", F.round(mse, 6).alias("mse"), F.round(colour.psnr_inf(mse), 6).alias("psnr"), F.round("mean_de", 6).alias("mean_de"), F.round("p95_de", 6).alias("p95_de"))


DE_PAIRS = (
    "WITH " + PAL + ", pp AS (SELECT key, cnt, r, g, b, m.pr AS pr, m.pg AS pg, m.pb AS pb, m.d AS d FROM near), "
    + _lab_sql("pp", "la", "r", "g", "b", "key, cnt") + ", " + _lab_sql("pp", "lb", "pr", "pg", "pb", "key")
    + ", pair AS (SELECT la.key, cnt, la.l AS l1, la.a AS a1, la.b AS b1, lb.l AS l2, lb.a AS a2, lb.b AS b2 FROM la JOIN lb USING (key)), " + _de_sql("pair")
)


def human_windows(s, d):
    return images.in_windows(_pairs(s, d), WINDOWS)


def rects(s, d):
    k = F.col("s_suppkey")
    return table(s, d, "supplier").select(F.lit(0).alias("image"), k.alias("seq"), (k % 16).alias("x"), (k % 11).alias("y"), (1 + F.col("s_nationkey") % 4).cast("long").alias("w"), (1 + k % 3).alias("h"), F.col("s_nationkey").alias("lab"))


def completeness(s, d):
    """Pairs of image and window that a table of window statistics lacks."""
    have = human_windows(s, d).filter("r > 40").select("image", "window").distinct()
    names = F.explode(F.array(*[F.lit(n) for n, *_ in WINDOWS], F.lit("absent")))
    return planes(s, d).select("image").distinct().select("image", names.alias("window")).join(have, ["image", "window"], "left_anti")


def _space():
    return Window.partitionBy("chain").orderBy("ts", "event_id")


QUERIES = {
    "f10_crop": lambda s, d: images.crop(planes(s, d), 4, 5, 12, 10).select("image", "x", "y", "r", "g", "b"),
    "j7_m22_m23_fidelity": fidelity,
    "p19_p20_exact_fidelity": exact_fidelity,
    "m25_amplified_difference": amplified,
    "m27_window_fidelity": lambda s, d: _round(images.fidelity(human_windows(s, d), ["image", "window"])),
    "a20_corpus_means": lambda s, d: _round(images.fidelity(_pairs(s, d), ["image"]).agg(F.avg(F.col("sse") / (3 * F.col("n"))).alias("mse"), F.avg("mae").alias("mae"))),
    "p40_gradient": lambda s, d: _round(images.gradient(planes(s, d)).select("image", "x", "y", "gradient")),
    "a9_region_colours": lambda s, d: images.region_colours(planes(s, d)),
    "a14_area_distribution": lambda s, d: _round(images.area_distribution(_sizes(s, d))),
    "a16_area_shares": lambda s, d: _round(images.shares(_sizes(s, d), 4)),
    "a18_isoperimetric_excess": lambda s, d: _round(images.isoperimetric_excess(_sizes(s, d))),
    "a19_dominant_share": lambda s, d: _round(images.dominance(images.in_windows(planes(s, d), WINDOWS), ["image", "window"])),
    "a21_a22_plane_fits": lambda s, d: _round(images.plane_fits(planes(s, d), ["image", "lab"], "r").withColumn("qx", images.quantized_slope(F.round("gx", 9))).withColumn("qy", images.quantized_slope(F.round("gy", 9)))),
    "j8_m26_u3_agreement": lambda s, d: _round(images.agreement(planes(s, d), planes(s, d).withColumn("lab", F.col("lab2")))),
    "e4_templates": lambda s, d: templates(s, d, (V_TAPS, H_TAPS), 1.0),
    "e5_crack_edges": lambda s, d: templates(s, d, (SEVEN_V, SEVEN_H), 0.5),
    "e7_static_templates": lambda s, d: templates(s, d, (V_TAPS, H_TAPS), None, entropy.static_bits),
    "e14_used_contexts": lambda s, d: _round(images.template_context(_planes_of_cracks(s, d), V_TAPS).groupBy("image").agg(F.countDistinct("context").alias("contexts"), (F.count("*") / F.countDistinct("context")).alias("samples"))),
    "g16_parity": lambda s, d: images.parity(planes(s, d)),
    "g15_cover": lambda s, d: images.cover(rects(s, d)),
    "m14_coherence": lambda s, d: _round(planes(s, d).withColumn("e", (F.col("lab") == F.lag("lab").over(raster.row())).cast("int")).groupBy("image").agg(F.avg("e").alias("equal"))),
    "a23_stream_shape": lambda s, d: _round(entropy.stream_shape(symbols(s, d), ["chain"], ["ts", "event_id"], "sym")),
    "p31_turn_balance": lambda s, d: entropy.turn_balance(symbols(s, d), ["chain"], ["ts", "event_id"], "sym", 8).select("chain", "event_id", "straight", "balance"),
    "w3_stratified": lambda s, d: entropy.stratified(images.gradient(planes(s, d)).withColumn("dens", F.round("gradient", 3)), ["y", "x"], "dens", 40, ["image"]).select("image", "sample", "x", "y"),
    "w7_planar": lambda s, d: symbols(s, d).withColumn("i", F.row_number().over(_space()) - 1).withColumn("at", F.row_number().over(Window.partitionBy("chain").orderBy(F.col("i") % 3, "i")) - 1).select("chain", "i", "at", "sym"),
    "p22_p25_p29_p32_p33_p35_numbers": numbers,
    "p17_oklab_bytes": lambda s, d: _colours(s, d).select("key", *[c.alias(n) for c, n in zip(colour.oklab_bytes(*[F.round(v, 9) for v in colour.rgb_to_oklab(*_rgb())]), ("l", "a", "b"), strict=True)]),
    "m20_a20_de_scores": de_scores,
    "p15_m21_ciede2000": lambda s, d: _near(s, d).select("key", F.round(colour.ciede2000(colour.rgb_to_lab(*_rgb()), colour.rgb_to_lab(*(F.col(c) for c in ("pr", "pg", "pb")))), 5).alias("de")),
    "j18_completeness": completeness,
    "f4_f6_f11_f12_rows": lambda s, d: table(s, d, "documents").filter((F.length("text") >= 1024) & F.col("lang").isin("en", "de") & (F.abs(F.col("n_chars") - 2000) <= 0.05 * 2000)).withColumn("run", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).filter("run >= 2").select("doc_id", "run"),
    "f1_o2_listing": lambda s, d: table(s, d, "pages").select("page_id", "url").filter(F.lower("url").rlike(r"[02468]/?$|\.html?$")).orderBy("url", "page_id"),
    "m9_clean_means": lambda s, d: _round(table(s, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.min("value").alias("least")).join(stats.percentile_nearest_rank(table(s, d, "events"), "value", ["event_type"]), "event_type")),
    "m13_not_nearest": lambda s, d: _round(_near(s, d).withColumn("lazy", colour.dist2(_rgb(), tuple(F.lit(v) for v in (127, 127, 127))).cast("long")).agg((100 * F.sum(F.when(F.col("lazy") > F.col("d"), F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("pct"), F.max(F.col("lazy") - F.col("d")).alias("extra"))),
    "o7_row_coders": lambda s, d: planes(s, d).withColumn("e", (F.col("lab") != F.lag("lab").over(raster.row())).cast("int")).groupBy("image", "y").agg((F.coalesce(F.sum("e"), F.lit(0)) * 2 + 2).alias("runs"), F.countDistinct("lab").alias("kinds")).select("image", "y", F.least("runs", F.col("kinds") * 5).alias("bytes")),
    "o10_w9_searches": lambda s, d: pixels(s, d).groupBy("image", F.expr("r div 32").alias("rung"), F.expr("g div 32").alias("q")).agg(F.count("*").alias("bytes"), F.round(F.avg("b"), 6).alias("psnr")).filter(F.col("bytes") <= 500 * 1.05).groupBy("image").agg(F.max(F.struct("psnr", "rung", "q")).alias("m"), F.min(F.when(F.col("bytes") > 100, F.col("psnr"))).alias("crossover")).select("image", F.col("m.psnr").alias("psnr"), F.col("m.rung").alias("rung"), F.col("m.q").alias("q"), "crossover"),
    "o6_tap_order": lambda s, d: rects(s, d).withColumn("place", F.row_number().over(Window.partitionBy("image").orderBy(F.col("x") * F.col("x") + F.col("y") * F.col("y"), "lab", "seq"))).select("seq", "place"),
    "e13_entropies": lambda s, d: _round(entropy.static_bits(planes(s, d).withColumn("key", colour.pack(*_rgb())), ["image"], [], "key").select("image", (F.col("bits") / 8).alias("joint")).join(entropy.static_bits(planes(s, d).withColumn("low", F.col("r") % 16).withColumn("high", F.expr("r div 16")), ["image"], ["high"], "low").select("image", (F.col("bits") / 8).alias("conditional")), "image")),
}

_E = PAIRS + " SELECT image, " + FIDELITY
ORACLE_SQL = {
    "f10_crop": PX + " SELECT image, x - 4 AS x, y - 5 AS y, r, g, b FROM px WHERE x BETWEEN 4 AND 15 AND y BETWEEN 5 AND 14",
    "j7_m22_m23_fidelity": PAIRS + f", z AS (SELECT image, {FIDELITY} FROM e GROUP BY image) SELECT *, round(10 * log10(65025.0 * 3 * n / sse), 6) AS psnr, round(10 * log10(65025.0 / (sse / (3.0 * n))), 6) AS psnr_inf FROM z",
    "p19_p20_exact_fidelity": PX + " SELECT image, count(*) AS n, CAST(0 AS BIGINT) AS sse, CAST(99 AS DOUBLE) AS psnr, CAST('inf' AS DOUBLE) AS psnr_inf FROM px GROUP BY image",
    "m25_amplified_difference": PAIRS + " SELECT image, max(greatest(least(255, 8 * er), least(255, 8 * eg), least(255, 8 * eb))) AS most, round(avg((least(255, 8 * er) + least(255, 8 * eg) + least(255, 8 * eb)) / CAST(3 AS DOUBLE)), 6) AS mean FROM e GROUP BY image",
    "m27_window_fidelity": PAIRS + ", w(name, x0, y0, x1, y1) AS (VALUES " + ", ".join(f"('{n}', {x}, {y}, {x + w - 1}, {y + h - 1})" for n, x, y, w, h in WINDOWS) + f") SELECT image, name AS \"window\", {FIDELITY} FROM e JOIN w ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL",
    "a20_corpus_means": PAIRS + ", z AS (SELECT image, sum(er * er + eg * eg + eb * eb) / (3.0 * count(*)) AS mse, sum(er + eg + eb) / (3.0 * count(*)) AS mae FROM e GROUP BY image) SELECT round(avg(mse), 6) AS mse, round(avg(mae), 6) AS mae FROM z",
    "p40_gradient": PX + " SELECT image, x, y, round(sqrt(" + " + ".join(f"pow(coalesce(lead({c}) OVER {w}, {c}) - coalesce(lag({c}) OVER {w}, {c}), 2)" for c in "rgb" for w in ("rw", "cl")) + "), 6) AS gradient FROM px WINDOW rw AS (PARTITION BY image, y ORDER BY x), cl AS (PARTITION BY image, x ORDER BY y)",
    "a9_region_colours": PX + " SELECT image, lab, count(*) AS area, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS sum_{c}" for c in "rgb") + ", " + ", ".join(f"CAST(round(avg({c})) AS BIGINT) AS {c}" for c in "rgb") + " FROM px GROUP BY ALL",
    "a14_area_distribution": SIZES + " SELECT image, max(area) AS largest, max(area) FILTER (i - 1 = n // 2) AS middle, round(avg(area), 6) AS mean, " + ", ".join(f"max(area) FILTER (i - 1 = n * {k} // 10) AS d{k}" for k in range(10)) + " FROM ranked GROUP BY image",
    "a16_area_shares": SIZES + " SELECT image, " + ", ".join(f"round(100.0 * max({c}) FILTER (i = n // {k}) / sum({t}), 6) AS top{100 // k}_{t}" for k in (10, 2) for c, t in (("ca", "area"), ("cp", "perimeter"))) + ", " + ", ".join(f"round(100.0 * coalesce(sum({t}) FILTER (area <= 4), 0) / sum({t}), 6) AS small_{t}" for t in ("area", "perimeter")) + " FROM ranked GROUP BY image",
    "a18_isoperimetric_excess": SIZES + " SELECT image, round(sum(perimeter) / sum(4 * sqrt(area)), 6) AS excess FROM sizes GROUP BY image",
    "a19_dominant_share": PX + ", w(name, x0, y0, x1, y1) AS (VALUES " + ", ".join(f"('{n}', {x}, {y}, {x + w - 1}, {y + h - 1})" for n, x, y, w, h in WINDOWS) + "), c2 AS (SELECT image, name, lab, count(*) AS c FROM px JOIN w ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL) SELECT image, name AS \"window\", count(*) AS labels, round(max(c) / sum(c), 6) AS share FROM c2 GROUP BY ALL",
    "a21_a22_plane_fits": PX + """, m AS (SELECT image, lab, count(*) AS n, avg(r) AS mean, var_pop(x) * count(*) AS mxx, covar_pop(x, y) * count(*) AS mxy, var_pop(y) * count(*) AS myy, covar_pop(x, r) * count(*) AS bx, covar_pop(y, r) * count(*) AS by_, var_pop(r) * count(*) AS rr FROM px GROUP BY ALL),
g AS (SELECT *, CASE WHEN mxx * myy - mxy * mxy <= 1e-6 THEN 0 ELSE (myy * bx - mxy * by_) / (mxx * myy - mxy * mxy) END AS gx, CASE WHEN mxx * myy - mxy * mxy <= 1e-6 THEN 0 ELSE (mxx * by_ - mxy * bx) / (mxx * myy - mxy * mxy) END AS gy FROM m)
SELECT image, lab, n, round(mean, 6) AS mean, round(gx, 6) + 0 AS gx, round(gy, 6) + 0 AS gy, round(greatest(0, rr - gx * bx - gy * by_), 6) AS sse, CAST(greatest(-127, least(127, round(round(gx, 9) / 0.125))) AS BIGINT) AS qx, CAST(greatest(-127, least(127, round(round(gy, 9) / 0.125))) AS BIGINT) AS qy FROM g""",
    "j8_m26_u3_agreement": PX + """, s AS (SELECT image, lead(lab) OVER rw <> lab AS a, lead(lab2) OVER rw <> lab2 AS b FROM px WINDOW rw AS (PARTITION BY image, y ORDER BY x) UNION ALL SELECT image, lead(lab) OVER cl <> lab, lead(lab2) OVER cl <> lab2 FROM px WINDOW cl AS (PARTITION BY image, x ORDER BY y)),
z AS (SELECT image, count(*) AS pairs, count(*) FILTER (a = b) AS agree, count(*) FILTER (b AND NOT a) AS invented, count(*) FILTER (a AND NOT b) AS missed, count(*) FILTER (a AND b) AS shared FROM s WHERE a IS NOT NULL GROUP BY image)
SELECT *, round(100.0 * agree / pairs, 6) AS agreement, round(shared / CAST(shared + invented + missed AS DOUBLE), 6) AS jaccard FROM z""",
    "e4_templates": templates_sql((V_TAPS, H_TAPS), 1.0),
    "e5_crack_edges": templates_sql((SEVEN_V, SEVEN_H), 0.5),
    "e7_static_templates": templates_sql((V_TAPS, H_TAPS), None),
    "e14_used_contexts": CRACKS + ", o AS (SELECT image, " + " + ".join(f"coalesce((SELECT {p} FROM cr b WHERE b.image = a.image AND b.x = a.x + ({dx}) AND b.y = a.y + ({dy})), 0) * {1 << i}" for i, (p, dx, dy) in enumerate(V_TAPS)) + " AS ctx FROM cr a) SELECT image, count(DISTINCT ctx) AS contexts, round(count(*) / count(DISTINCT ctx), 6) AS samples FROM o GROUP BY image",
    "g16_parity": CRACKS + """, q AS (SELECT a.image, a.h, a.v, b.h AS hb, d.v AS vd, pa.lab AS la, pb.lab AS lb, pc.lab AS lc, pd.lab AS ld FROM cr a JOIN cr b ON b.image = a.image AND b.x = a.x + 1 AND b.y = a.y JOIN cr d ON d.image = a.image AND d.x = a.x AND d.y = a.y + 1
JOIN px pa ON pa.image = a.image AND pa.x = a.x AND pa.y = a.y JOIN px pb ON pb.image = a.image AND pb.x = a.x + 1 AND pb.y = a.y JOIN px pc ON pc.image = a.image AND pc.x = a.x + 1 AND pc.y = a.y + 1 JOIN px pd ON pd.image = a.image AND pd.x = a.x AND pd.y = a.y + 1),
z AS (SELECT image, (h + v + hb + vd) % 2 = 1 AS bad, len(list_distinct([la, lb, lc, ld])) AS meet FROM q) SELECT image, count(*) FILTER (bad) AS violations, count(*) FILTER (meet >= 3) AS junctions, count(*) FILTER (bad AND meet < 3) AS at_two_labels FROM z GROUP BY image""",
    "g15_cover": "WITH r AS (SELECT 0 AS image, s_suppkey AS seq, s_suppkey % 16 AS x, s_suppkey % 11 AS y, 1 + s_nationkey % 4 AS w, 1 + s_suppkey % 3 AS h, s_nationkey AS lab FROM supplier), c AS (SELECT image, seq, lab, x + unnest(range(w)) AS x, y, h FROM r), e AS (SELECT image, seq, lab, x, y + unnest(range(h)) AS y FROM c) SELECT image, x, y, arg_max(lab, seq) AS lab FROM e GROUP BY ALL",
    "m14_coherence": PX + ", z AS (SELECT image, CAST(lab = lag(lab) OVER (PARTITION BY image, y ORDER BY x) AS INT) AS e FROM px) SELECT image, round(avg(e), 6) AS equal FROM z GROUP BY image",
    "a23_stream_shape": STREAM + ", z AS (SELECT chain, sym, CASE WHEN sym = lag(sym) OVER (PARTITION BY chain ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM s) SELECT chain, round(100.0 * count(*) FILTER (sym = 0) / count(*), 6) AS zero_pct, round(count(*) / sum(new), 6) AS mean_run FROM z GROUP BY chain",
    "p31_turn_balance": STREAM + " SELECT chain, event_id, CAST(sum(CAST(sym = 0 AS INT)) OVER w AS BIGINT) AS straight, CAST(sum(CAST(sym = 1 AS INT) - CAST(sym = 2 AS INT)) OVER w AS BIGINT) AS balance FROM s WINDOW w AS (PARTITION BY chain ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)",
    "w7_planar": STREAM + ", z AS (SELECT chain, sym, row_number() OVER (PARTITION BY chain ORDER BY ts, event_id) - 1 AS i FROM s) SELECT chain, CAST(i AS INT) AS i, CAST(row_number() OVER (PARTITION BY chain ORDER BY i % 3, i) - 1 AS INT) AS at, CAST(sym AS INT) AS sym FROM z",
    "p22_p25_p29_p32_p33_p35_numbers": NUMBERS,
    "p17_oklab_bytes": "WITH " + OKLAB + " SELECT key, " + ", ".join(f"CAST(greatest(0, least(255, round({e}))) AS INT) AS {n}" for n, e in (("l", "round(ol, 9) * 255"), ("a", "(round(oa, 9) + 0.4) / 0.8 * 255"), ("b", "(round(ob, 9) + 0.4) / 0.8 * 255"))) + " FROM ok",
    "m20_a20_de_scores": DE_PAIRS + ", o AS (SELECT round(de, 9) AS de, sum(cnt) OVER (ORDER BY round(de, 9), key) AS upto, sum(cnt) OVER () AS n FROM de) SELECT CAST((SELECT sum(cnt) FROM pp) AS BIGINT) AS n, round((SELECT sum(d * cnt) / (3.0 * sum(cnt)) FROM pp), 6) AS mse, round(10 * log10(65025.0 / (SELECT sum(d * cnt) / (3.0 * sum(cnt)) FROM pp)), 6) AS psnr, round((SELECT sum(round(de, 9) * cnt) / sum(cnt) FROM de), 6) AS mean_de, round(min(de) FILTER (upto > least(n - 1, floor(0.95 * n))), 6) AS p95_de FROM o",
    "p15_m21_ciede2000": DE_PAIRS + " SELECT key, round(de, 5) AS de FROM de",
    "j18_completeness": PX + ", w(name, x0, y0, x1, y1) AS (VALUES " + ", ".join(f"('{n}', {x}, {y}, {x + w - 1}, {y + h - 1})" for n, x, y, w, h in WINDOWS) + ", ('absent', 1, 1, 0, 0)) SELECT i.image, w.name AS \"window\" FROM (SELECT DISTINCT image FROM px) i, w WHERE NOT EXISTS (SELECT 1 FROM px WHERE px.image = i.image AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND r > 40)",
    "f4_f6_f11_f12_rows": "WITH z AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS run FROM documents WHERE length(text) >= 1024 AND lang IN ('en', 'de') AND abs(n_chars - 2000) <= 100) SELECT * FROM z WHERE run >= 2",
    "f1_o2_listing": r"SELECT page_id, url FROM pages WHERE regexp_matches(lower(url), '[02468]/?$|\.html?$') ORDER BY url, page_id",
    "m9_clean_means": "WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value) FILTER (i = round_even(0.95 * (n - 1), 0)), 6) AS p FROM o GROUP BY event_type",
    "m13_not_nearest": "WITH " + PAL + ", z AS (SELECT cnt, m.d AS d, (r - 127) * (r - 127) + (g - 127) * (g - 127) + (b - 127) * (b - 127) AS lazy FROM near) SELECT round(100.0 * sum(cnt) FILTER (lazy > d) / sum(cnt), 6) AS pct, CAST(max(lazy - d) AS BIGINT) AS extra FROM z",
    "o7_row_coders": PX + ", z AS (SELECT image, y, lab, CAST(lab <> lag(lab) OVER (PARTITION BY image, y ORDER BY x) AS INT) AS e FROM px) SELECT image, y, CAST(least(sum(e) * 2 + 2, count(DISTINCT lab) * 5) AS BIGINT) AS bytes FROM z GROUP BY ALL",
    "o10_w9_searches": "WITH " + HIST.split(", hist AS")[0] + ", z AS (SELECT image, r // 32 AS rung, g // 32 AS q, count(*) AS bytes, round(avg(b), 6) AS psnr FROM px GROUP BY ALL) SELECT image, max({'p': psnr, 'r': rung, 'q': q}).p AS psnr, CAST(max({'p': psnr, 'r': rung, 'q': q}).r AS BIGINT) AS rung, CAST(max({'p': psnr, 'r': rung, 'q': q}).q AS BIGINT) AS q, min(psnr) FILTER (bytes > 100) AS crossover FROM z WHERE bytes <= 525 GROUP BY image",
    "o6_tap_order": "SELECT s_suppkey AS seq, CAST(row_number() OVER (ORDER BY (s_suppkey % 16) * (s_suppkey % 16) + (s_suppkey % 11) * (s_suppkey % 11), s_nationkey, s_suppkey) AS INT) AS place FROM supplier",
    "e13_entropies": PX + ", a AS (SELECT image, r * 65536 + g * 256 + b AS key, count(*) AS k FROM px GROUP BY ALL), b AS (SELECT *, sum(k) OVER (PARTITION BY image) AS t FROM a), c2 AS (SELECT image, r // 16 AS hi, r % 16 AS lo, count(*) AS k FROM px GROUP BY ALL), d AS (SELECT *, sum(k) OVER (PARTITION BY image, hi) AS t FROM c2) SELECT image, (SELECT round(sum(k * log2(t / k)) / 8, 6) FROM b WHERE b.image = i.image) AS joint, (SELECT round(sum(k * log2(t / k)) / 8, 6) FROM d WHERE d.image = i.image) AS conditional FROM (SELECT DISTINCT image FROM px) i",
}
ORACLE_SQL["w3_stratified"] = (
    "WITH " + ORACLE_SQL["p40_gradient"].removeprefix("WITH ").replace(" SELECT image, x, y, round(sqrt(", ", gr AS (SELECT image, x, y, round(round(sqrt(", 1).replace("), 6) AS gradient FROM px", "), 6), 3) + 0.001 AS dens FROM px", 1)
    + "), cum AS (SELECT image, x, y, sum(dens) OVER (PARTITION BY image ORDER BY y, x) AS upto, sum(dens) OVER (PARTITION BY image) / 40 AS step FROM gr), hit AS (SELECT image, x, y, CAST(least(40, floor(upto / step + 0.5 + 1e-9)) AS INT) AS n FROM cum), "
    "fr AS (SELECT *, lag(n, 1, 0) OVER (PARTITION BY image ORDER BY y, x) AS b FROM hit) SELECT image, CAST(unnest(range(b, n)) AS INT) AS sample, x, y FROM fr"
)
