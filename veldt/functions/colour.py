"""Colour and pixel expressions. All are column expressions inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB transfer curve, D65 white, CIE constants, published OKLab matrices.
SRGB_CUT, SRGB_CUT_LINEAR = 0.04045, 0.0031308
EPSILON, KAPPA = 216 / 24389, 24389 / 27
WHITE = (0.95047, 1.0, 1.08883)
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
OK = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
OK_INVERSE = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
LMS_INVERSE = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))


def pack(r: Column, g: Column, b: Column) -> Column:
    """24-bit key."""
    return (F.shiftleft(r.cast("int"), 16) + F.shiftleft(g.cast("int"), 8) + b.cast("int")).cast("int")


def unpack(key: Column) -> tuple[Column, Column, Column]:
    return (F.shiftright(key, 16).bitwiseAND(255), F.shiftright(key, 8).bitwiseAND(255), key.bitwiseAND(255))


def _dot(row: tuple, v: tuple) -> Column:
    return F.lit(row[0]) * v[0] + F.lit(row[1]) * v[1] + F.lit(row[2]) * v[2]


def srgb_to_linear(c: Column) -> Column:
    v = c / 255.0
    return F.when(v <= SRGB_CUT, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= SRGB_CUT_LINEAR, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def lab_f(t: Column) -> Column:
    return F.when(t > EPSILON, F.cbrt(t)).otherwise((F.lit(KAPPA) * t + 16) / 116)


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    lin = tuple(srgb_to_linear(c) for c in (r, g, b))
    x, y, z = (lab_f(_dot(row, lin) / w) for row, w in zip(XYZ, WHITE, strict=True))
    return (116 * y - 16, 500 * (x - y), 200 * (y - z))


def rgb_to_oklab(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    lin = tuple(srgb_to_linear(c) for c in (r, g, b))
    lms = tuple(F.cbrt(_dot(row, lin)) for row in LMS)
    return tuple(_dot(row, lms) for row in OK)


def oklab_to_rgb(l: Column, a: Column, b: Column) -> tuple[Column, ...]:
    lms = tuple(F.pow(_dot(row, (l, a, b)), F.lit(3.0)) for row in OK_INVERSE)
    return tuple(clamp8(255 * linear_to_srgb(F.greatest(F.lit(0.0), _dot(row, lms)))) for row in LMS_INVERSE)


def clamp8(v: Column) -> Column:
    """Round half away from zero, then clamp to 0..255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.round(v))).cast("int")


def clamp8_floor(v: Column) -> Column:
    """Clamp to 0..255, then truncate v + 0.5."""
    return F.when(v <= 0, 0).when(v >= 255, 255).otherwise(F.floor(v + 0.5)).cast("int")


def dist2(a: tuple, b: tuple) -> Column:
    return (a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2])


def dist2_arrays(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, v: s + v)


def dist2_16bit(a: tuple, b: tuple) -> Column:
    """Distance on 8-bit channels promoted to 16 bits, each square shifted right by two."""
    total = None
    for x, y in zip(a, b, strict=True):
        d = (x.cast("long") - y.cast("long")) * 257
        total = F.shiftright(d * d, 2) if total is None else total + F.shiftright(d * d, 2)
    return total


def hyab(a: tuple, b: tuple) -> Column:
    return F.abs(a[0] - b[0]) + F.hypot(a[1] - b[1], a[2] - b[2])


def hue_angle(b: Column, a: Column) -> Column:
    """Degrees in [0, 360); 0 at zero chroma."""
    h = F.degrees(F.atan2(b, a))
    return F.when((a == 0) & (b == 0), 0.0).when(h < 0, h + 360).otherwise(h)


def _let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body over named values, each worked out once: plain columns would be copied into every place of use."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), 1)


def ciede2000(p: tuple, q: tuple) -> Column:
    """CIEDE2000 with unit weights (Sharma, Wu, Dalal 2005)."""
    return _let(dict(zip(("l1", "a1", "b1", "l2", "a2", "b2"), (*p, *q), strict=True)), _ciede_chroma)


def _ciede_chroma(s: Column) -> Column:
    c7 = F.pow((F.hypot(s.a1, s.b1) + F.hypot(s.a2, s.b2)) / 2, F.lit(7.0))
    g = 1.5 - 0.5 * F.sqrt(c7 / (c7 + F.lit(25.0**7)))
    keep = {k: s[k] for k in ("l1", "b1", "l2", "b2")}
    return _let(keep | {"x1": g * s.a1, "x2": g * s.a2}, _ciede_hue)


def _ciede_hue(s: Column) -> Column:
    polar = {"c1": F.hypot(s.x1, s.b1), "c2": F.hypot(s.x2, s.b2), "h1": hue_angle(s.b1, s.x1), "h2": hue_angle(s.b2, s.x2)}
    return _let({"l1": s.l1, "l2": s.l2} | polar, _ciede_means)


def _ciede_means(s: Column) -> Column:
    grey, gap, hs = (s.c1 * s.c2) == 0, s.h2 - s.h1, s.h1 + s.h2
    dh = F.when(grey, 0.0).when(F.abs(gap) <= 180, gap).when(gap > 180, gap - 360).otherwise(gap + 360)
    hm = F.when(grey, hs).when(F.abs(gap) <= 180, hs / 2).when(hs < 360, (hs + 360) / 2).otherwise((hs - 360) / 2)
    big = 2 * F.sqrt(s.c1 * s.c2) * F.sin(F.radians(dh / 2))
    return _let({"dl": s.l2 - s.l1, "dc": s.c2 - s.c1, "dh": big, "lm": (s.l1 + s.l2) / 2, "cm": (s.c1 + s.c2) / 2, "hm": hm}, _ciede_terms)


def _ciede_terms(s: Column) -> Column:
    hm, cm7, off = s.hm, F.pow(s.cm, F.lit(7.0)), (s.lm - 50) * (s.lm - 50)
    t = 1 - 0.17 * F.cos(F.radians(hm - 30)) + 0.24 * F.cos(F.radians(2 * hm)) + 0.32 * F.cos(F.radians(3 * hm + 6)) - 0.20 * F.cos(F.radians(4 * hm - 63))
    turn = -2 * F.sqrt(cm7 / (cm7 + F.lit(25.0**7))) * F.sin(F.radians(60 * F.exp(-F.pow((hm - 275) / 25, F.lit(2.0)))))
    sl, sc, sh = 1 + 0.015 * off / F.sqrt(20 + off), 1 + 0.045 * s.cm, 1 + 0.015 * s.cm * t
    parts = {"u": s.dl / sl, "v": s.dc / sc, "w": s.dh / sh, "turn": turn}
    return _let(parts, lambda z: F.sqrt(z.u * z.u + z.v * z.v + z.w * z.w + z.turn * z.v * z.w))


def morton3(a: Column, b: Column, c: Column) -> Column:
    """24-bit Z-order key of three bytes."""
    total = F.lit(0)
    for bit in range(8):
        for k, v in enumerate((a, b, c)):
            total = total + F.shiftleft(F.shiftright(v.cast("int"), bit).bitwiseAND(1), 3 * bit + k)
    return total


def psnr_99(sse: Column, pixels: Column) -> Column:
    """99 dB for an exact match; three channels."""
    return F.when(sse <= 0, 99.0).otherwise(10 * F.log10(255.0 * 255.0 * 3 * pixels / sse))


def psnr_inf(mse: Column) -> Column:
    """Infinite for an exact match."""
    return F.when(mse <= 0, float("inf")).otherwise(10 * F.log10(255.0 * 255.0 / mse))


def parse_hex(s: Column) -> tuple[Column, Column, Column]:
    return tuple(F.conv(F.substring(s, at, 2), 16, 10).cast("int") for at in (2, 4, 6))


def reversible(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Green, and red and blue as differences from it."""
    return (g, r - g, b - g)


def med(w: Column, n: Column, nw: Column) -> Column:
    """Median edge predictor."""
    return F.when(nw >= F.greatest(w, n), F.least(w, n)).when(nw <= F.least(w, n), F.greatest(w, n)).otherwise(w + n - nw)


def oklab_bytes(l: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """OKLab as three bytes; a and b from -0.4 to 0.4."""
    return (clamp8(l * 255), clamp8((a + 0.4) / 0.8 * 255), clamp8((b + 0.4) / 0.8 * 255))
