"""Queries that exercise the scalar functions over points and whole numbers of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour
from ..operators import entropy
from ..sources.views import pixels, table
from .point_queries import HIST

def _rgb():
    return tuple(F.col(c) for c in "rgb")


def _colours(spark, d):
    return pixels(spark, d).select("r", "g", "b").distinct().withColumn("key", colour.pack(*_rgb()))


def _r(cols, names, n=6):
    return [F.round(c, n).alias(x) for c, x in zip(cols, names, strict=True)]


def _lin(c: str) -> str:
    return f"(CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END)"


def _mat(m, v) -> list[str]:
    return [" + ".join(f"({a!r}) * {x}" for a, x in zip(row, v, strict=True)) for row in m]


_LINS = ", ".join(f"CAST({_lin(c)} AS DOUBLE) AS l{c}" for c in "rgb")
_X, _Y, _Z = (f"({e}) / {w!r}" for e, w in zip(_mat(colour.XYZ, ("lr", "lg", "lb")), colour.WHITE, strict=True))
_F = lambda t: f"(CASE WHEN {t} > {colour.EPSILON!r} THEN cbrt({t}) ELSE ({colour.KAPPA!r} * {t} + 16) / 116 END)"
LAB = HIST + f", lin AS (SELECT key, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM hist), l AS (SELECT key, {_LINS} FROM lin), f AS (SELECT key, {_F(_X)} AS fx, {_F(_Y)} AS fy, {_F(_Z)} AS fz FROM l), lab AS (SELECT key, 116 * fy - 16 AS ll, 500 * (fx - fy) AS la, 200 * (fy - fz) AS lb FROM f)"
_L, _M, _S = (f"cbrt({e})" for e in _mat(colour.LMS, ("lr", "lg", "lb")))
_OK = _mat(colour.OK, ("cl", "cm", "cs"))
OKLAB = HIST + f", lin AS (SELECT key, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM hist), l AS (SELECT key, {_LINS} FROM lin), c AS (SELECT key, {_L} AS cl, {_M} AS cm, {_S} AS cs FROM l), ok AS (SELECT key, {_OK[0]} AS ol, {_OK[1]} AS oa, {_OK[2]} AS ob FROM c)"


def round_trip(spark, d):
    """OKLab there and back gives every colour again."""
    rows = _colours(spark, d)
    back = colour.oklab_to_rgb(*colour.rgb_to_oklab(*_rgb()))
    return rows.select("key", *[c.alias(n) for c, n in zip(back, "rgb", strict=True)])


def deltas(spark, d):
    """Squared, HyAB and 16-bit distances of every colour to mid grey."""
    grey = tuple(F.lit(128) for _ in range(3))
    lab, mid = colour.rgb_to_lab(*_rgb()), colour.rgb_to_lab(*(F.lit(128.0) for _ in range(3)))
    rows = _colours(spark, d)
    return rows.select("key", colour.dist2(_rgb(), grey).cast("long").alias("d2"), colour.dist2_16bit(_rgb(), grey).alias("d16"), F.round(colour.hyab(lab, mid), 6).alias("hyab"))


_D16 = " + ".join(f"((((CAST({c} AS BIGINT) - 128) * 257) * ((CAST({c} AS BIGINT) - 128) * 257)) >> 2)" for c in "rgb")


def _grey() -> tuple[float, float, float]:
    """Lab of mid grey; the matrix leaves it a trace of colour."""
    linear = ((128 / 255 + 0.055) / 1.055) ** 2.4
    x, y, z = ((sum(row) * linear / w) ** (1 / 3) for row, w in zip(colour.XYZ, colour.WHITE, strict=True))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


_GREY = _grey()


def numbers(spark, d):
    v = (F.col("l_quantity") - 25).cast("int")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"))
    m = F.col("v")
    return rows.select(
        "l_orderkey", "l_linenumber", entropy.token(m).alias("token"), entropy.bucket(F.abs(m), (0, 1, 2, 4, 8, 16)).alias("bucket"),
        entropy.varint_bytes(F.col("l_orderkey") * 1000).alias("varint"), entropy.congruential(F.col("l_orderkey")).alias("lcg"),
        ((F.col("l_orderkey") * 2654435761) % F.lit(4294967296)).alias("hash"), colour.clamp8(F.col("v") * 12.75).alias("c8"), colour.clamp8_floor(F.col("v") * 12.75).alias("c8f"),
    )


NUMBERS = """WITH n AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity - 25 AS INT) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN v = 0 THEN 0 ELSE sign(v) * (floor(log2(abs(v))) + 1) END AS INT) AS token,
CAST(CASE WHEN abs(v) <= 0 THEN 0 WHEN abs(v) <= 1 THEN 1 WHEN abs(v) <= 2 THEN 2 WHEN abs(v) <= 4 THEN 3 WHEN abs(v) <= 8 THEN 4 WHEN abs(v) <= 16 THEN 5 ELSE 6 END AS INT) AS bucket,
CAST(CASE WHEN l_orderkey * 1000 < 128 THEN 1 WHEN l_orderkey * 1000 < 16384 THEN 2 WHEN l_orderkey * 1000 < 2097152 THEN 3 WHEN l_orderkey * 1000 < 268435456 THEN 4 ELSE 5 END AS INT) AS varint,
(l_orderkey * 1664525 + 1013904223) % 4294967296 AS lcg, (l_orderkey * 2654435761) % 4294967296 AS hash,
CAST(greatest(0, least(255, round(v * CAST(12.75 AS DOUBLE)))) AS INT) AS c8, CAST(CASE WHEN v <= 0 THEN 0 WHEN v * 12.75 >= 255 THEN 255 ELSE floor(v * CAST(12.75 AS DOUBLE) + 0.5) END AS INT) AS c8f FROM n"""


def predictors(spark, d):
    rows = _colours(spark, d)
    g, rg, bg = colour.reversible(*_rgb())
    back = colour.unpack(F.col("key"))
    p = F.col("r") / 256 + 0.001
    return rows.select("key", colour.med(*_rgb()).alias("med"), g.alias("g"), rg.alias("rg"), bg.alias("bg"), *[c.alias(f"u{n}") for c, n in zip(back, "rgb", strict=True)], F.round(entropy.stretch(p), 6).alias("stretch"), F.round(entropy.squash(entropy.stretch(p)), 9).alias("squash"), F.round(colour.hue_angle(F.col("b") - 100.0, F.col("g") - 100.0), 6).alias("hue"), colour.morton3(*_rgb()).alias("z"))


_MORTON = " + ".join(f"(((({c}) >> {bit}) & 1) << {3 * bit + k})" for bit in range(8) for k, c in enumerate("rgb"))
PREDICT = "WITH " + HIST + f""" SELECT key, CASE WHEN b >= greatest(r, g) THEN least(r, g) WHEN b <= least(r, g) THEN greatest(r, g) ELSE r + g - b END AS med, g, r - g AS rg, b - g AS bg, r AS ur, g AS ug, b AS ub,
round(ln((r / 256.0 + 0.001) / (1 - (r / 256.0 + 0.001))), 6) AS stretch, round(CAST(r AS DOUBLE) / 256 + 0.001, 9) AS squash,
round(CASE WHEN b = 100 AND g = 100 THEN 0 WHEN degrees(atan2(b - 100.0, g - 100.0)) < 0 THEN degrees(atan2(b - 100.0, g - 100.0)) + 360 ELSE degrees(atan2(b - 100.0, g - 100.0)) END, 6) AS hue, CAST({_MORTON} AS INT) AS z FROM hist"""

QUERIES = {
    "p3_p6_lab": lambda s, d: _colours(s, d).select("key", *_r(colour.rgb_to_lab(*_rgb()), ("ll", "la", "lb"))),
    "p7_oklab": lambda s, d: _colours(s, d).select("key", *_r(colour.rgb_to_oklab(*_rgb()), ("ol", "oa", "ob"))),
    "p8_oklab_round_trip": round_trip,
    "p13_p14_p41_distances": deltas,
    "p10_p11_p24_p26_p37_p38_p39_numbers": numbers,
    "p1_p2_p16_p18_p27_p28_p30_predictors": predictors,
    "p23_combination_bits": lambda s, d: table(s, d, "part").select("p_partkey", F.round(entropy.combination_bits(F.col("p_size") + 10, F.col("p_size") % 10), 6).alias("bits")),
    "p36_sha256": lambda s, d: table(s, d, "pages").select("page_id", F.sha2("html", 256).alias("sha")),
    "p21_hex": lambda s, d: _colours(s, d).withColumn("h", F.concat(F.lit("#"), F.lower(F.lpad(F.hex("key"), 6, "0")))).select("key", "h", *[c.alias(n) for c, n in zip(colour.parse_hex(F.col("h")), "rgb", strict=True)]),
}

ORACLE_SQL = {
    "p3_p6_lab": "WITH " + LAB + " SELECT key, round(ll, 6) AS ll, round(la, 6) AS la, round(lb, 6) AS lb FROM lab",
    "p7_oklab": "WITH " + OKLAB + " SELECT key, round(ol, 6) AS ol, round(oa, 6) AS oa, round(ob, 6) AS ob FROM ok",
    "p8_oklab_round_trip": "WITH " + HIST + " SELECT key, r, g, b FROM hist",
    "p13_p14_p41_distances": "WITH " + LAB + f" SELECT key, CAST((r - 128) * (r - 128) + (g - 128) * (g - 128) + (b - 128) * (b - 128) AS BIGINT) AS d2, {_D16} AS d16, round(abs(ll - {_GREY[0]!r}) + sqrt(pow(la - {_GREY[1]!r}, 2) + pow(lb - {_GREY[2]!r}, 2)), 6) AS hyab FROM lab JOIN hist USING (key)",
    "p10_p11_p24_p26_p37_p38_p39_numbers": NUMBERS,
    "p1_p2_p16_p18_p27_p28_p30_predictors": PREDICT,
    "p23_combination_bits": "SELECT p_partkey, round((lgamma(p_size + 11) - lgamma(p_size % 10 + 1) - lgamma(p_size + 11 - p_size % 10)) / ln(2), 6) AS bits FROM part",
    "p36_sha256": "SELECT page_id, sha256(html) AS sha FROM pages",
    "p21_hex": "WITH " + HIST + " SELECT key, printf('#%06x', key) AS h, r, g, b FROM hist",
}
QUERIES["p15_ciede2000"] = lambda s, d: _colours(s, d).select("key", F.round(colour.ciede2000(colour.rgb_to_lab(*_rgb()), colour.rgb_to_lab(*(F.lit(128.0) for _ in range(3)))), 6).alias("de"))
