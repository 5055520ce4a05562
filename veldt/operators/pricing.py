"""Code lengths that depend on order, colour prices of region graphs, and a binary range coder.

Order-dependent models use running counts: windows over one context (exclusion) or one context and symbol
(hierarchies), so work spreads over contexts. Colour prices are order-free and go through entropy.adaptive_bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import entropy, raster


def exclusion_bits(rows: DataFrame, by: list[str], context: list[str], order: list[str], symbol: str, allowed: str, symbols: int, alpha: float = 1.0) -> DataFrame:
    """Bits of an adaptive model whose probabilities are renormalised over the symbols in the array `allowed`.

    A symbol that is not allowed makes its group's bits infinite.
    """
    past = Window.partitionBy(*by, *context).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows
    for k in range(symbols):
        seen = seen.withColumn(f"_c{k}", F.count_if(F.col(symbol) == k).over(past) + F.lit(alpha))
    den = sum((F.when(F.array_contains(allowed, k), F.col(f"_c{k}")).otherwise(0.0) for k in range(symbols)), F.lit(0.0))
    own = F.coalesce(*[F.when(F.col(symbol) == k, F.col(f"_c{k}")) for k in range(symbols)])
    bits = F.when(F.array_contains(allowed, F.col(symbol)), F.log2(den / own)).otherwise(F.lit(float("inf")))
    return seen.groupBy(*by).agg(F.sum(bits).alias("bits"), F.count("*").alias("n"))


def hierarchy_bits(rows: DataFrame, by: list[str], levels: list[list[str]], order: list[str], symbol: str, symbols: int, k: float) -> DataFrame:
    """Bits of nested models, coarse to fine: p = (count + k * coarser p) / (total + k), from 1 / symbols."""
    seen, p = rows, F.lit(1.0 / symbols)
    for i, context in enumerate(levels):
        own = Window.partitionBy(*by, *context, symbol).orderBy(*order)
        all_ = Window.partitionBy(*by, *context).orderBy(*order)
        seen = seen.withColumn(f"_n{i}", F.row_number().over(own) - 1).withColumn(f"_t{i}", F.row_number().over(all_) - 1)
        p = (F.col(f"_n{i}") + k * p) / (F.col(f"_t{i}") + k)
    return seen.groupBy(*by).agg(F.sum(-F.log2(p)).alias("bits"), F.count("*").alias("n"))


def _residuals(predicted: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """One row a region and channel: the residual class, whole and clamped to 0..511."""
    parts = [F.struct(F.lit(c).alias("channel"), F.least(F.greatest((F.col(c) - F.col(f"p_{c}")).cast("int") + 256, F.lit(0)), F.lit(511)).alias("d")) for c in channels]
    return predicted.select("image", F.explode(F.array(*parts)).alias("_e")).select("image", "_e.channel", "_e.d")


def neighbour_price(regions: DataFrame, rag: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Bits of region colours against the earlier neighbour with the longest shared boundary (128 without one)."""
    best = raster.best_earlier(rag).select("image", F.col("a").alias("lab"), F.col("b").alias("_other"))
    other = regions.select("image", F.col("lab").alias("_other"), *[F.col(c).alias(f"p_{c}") for c in channels])
    got = regions.join(best, ["image", "lab"], "left").join(other, ["image", "_other"], "left").fillna(128, [f"p_{c}" for c in channels])
    return entropy.adaptive_bits(_residuals(got, channels), ["image"], ["channel"], "d", 512).select("image", "bits")


def blend_price(regions: DataFrame, rag: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Bits of region colours against the rounded boundary-weighted mean of all earlier neighbours."""
    other = regions.select("image", F.col("lab").alias("_other"), *[F.col(c).alias(f"o_{c}") for c in channels])
    mean = rag.filter("b < a").withColumnRenamed("b", "_other").join(other, ["image", "_other"]).groupBy("image", F.col("a").alias("lab"))
    mean = mean.agg(*[F.round(F.sum(F.col("len") * F.col(f"o_{c}")) / F.sum("len")).alias(f"p_{c}") for c in channels])
    got = regions.join(mean, ["image", "lab"], "left").fillna(128, [f"p_{c}" for c in channels])
    return entropy.adaptive_bits(_residuals(got, channels), ["image"], ["channel"], "d", 512).select("image", "bits")


def palette_price(regions: DataFrame, rag: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), limit: int = 512) -> DataFrame:
    """Bits of palette indexes in the context of the best earlier neighbour's, and 24 a palette entry; infinite
    beyond `limit` entries."""
    keyed = regions.select("image", "lab", F.struct(*channels).alias("colour"))
    best = raster.best_earlier(rag).select("image", F.col("a").alias("lab"), F.col("b").alias("_other"))
    other = keyed.select("image", F.col("lab").alias("_other"), F.col("colour").alias("near"))
    got = keyed.join(best, ["image", "lab"], "left").join(other, ["image", "_other"], "left")
    # A context with t rows costs log2 of (n)(n+1)...(n+t-1): its own n differs by image, so it is summed here.
    counts = got.groupBy("image", "near", "colour").agg(F.count("*").alias("k"))
    per = counts.groupBy("image", "near").agg(F.sum("k").alias("t"), F.sum(entropy.rising_bits(1.0, F.col("k"))).alias("num"))
    size = keyed.groupBy("image").agg(F.countDistinct("colour").alias("entries"))
    bits = per.join(size, "image").groupBy("image", "entries").agg(F.sum(entropy.rising_bits(F.col("entries"), F.col("t")) - F.col("num")).alias("bits"))
    return bits.select("image", "entries", F.when(F.col("entries") > limit, F.lit(float("inf"))).otherwise(F.col("bits") + 24 * F.col("entries")).alias("bits"))


class _Model:
    """Counts of a bit in the context of the one before it, starting at a half each; 16-bit chances of a one."""

    def __init__(self) -> None:
        self.counts, self.context = [[1, 1], [1, 1]], 0

    def chance(self) -> int:
        zeros, ones = self.counts[self.context]
        return min(max(ones * 65536 // (zeros + ones), 1), 65535)

    def see(self, bit: int) -> None:
        self.counts[self.context][bit] += 2
        self.context = bit


def range_encode(bits: list[int]) -> bytes:
    """A binary range coder: a 32-bit range whose carries run back into the bytes written."""
    low, width, out, model = 0, (1 << 32) - 1, bytearray(), _Model()
    for bit in bits:
        split = (width >> 16) * model.chance()
        if bit:
            width = split
        else:
            low, width = low + split, width - split
        model.see(bit)
        if low >> 32:
            low &= (1 << 32) - 1
            at = len(out) - 1
            while out[at] == 255:
                out[at] = 0
                at -= 1
            out[at] += 1
        while width < 1 << 24:
            out.append(low >> 24)
            low, width = (low << 8) & ((1 << 32) - 1), width << 8
    final = low + width - 1
    if final >> 32:
        at = len(out) - 1
        while out[at] == 255:
            out[at] = 0
            at -= 1
        out[at] += 1
        final &= (1 << 32) - 1
    return bytes(out) + final.to_bytes(4, "big")


def range_decode(blob: bytes, n: int) -> list[int]:
    code, at, width, out, model = int.from_bytes(blob[:4], "big"), 4, (1 << 32) - 1, [], _Model()
    for _ in range(n):
        split = (width >> 16) * model.chance()
        bit = int(code < split)
        if bit:
            width = split
        else:
            code, width = code - split, width - split
        model.see(bit)
        out.append(bit)
        while width < 1 << 24:
            code = (code << 8 | (blob[at] if at < len(blob) else 0)) & ((1 << 32) - 1)
            at, width = at + 1, width << 8
    return out


def coded_blocks(rows: DataFrame, by: list[str], order: list[str], bit: str, block: int = 4096) -> DataFrame:
    """blocks(by..., block, n, blob): each run of `block` bits of a group coded on its own."""
    types = dict(rows.dtypes)
    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    numbered = numbered.select(*by, F.expr(f"cast(_i div {block} as long)").alias("block"), "_i", F.col(bit).cast("int").alias("_bit"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        bits = part.sort_values("_i")._bit.tolist()
        return pd.DataFrame({**{k: [part[k].iloc[0]] for k in by}, "block": [part.block.iloc[0]], "n": [len(bits)], "blob": [range_encode(bits)]})

    schema = ", ".join([f"{k} {types[k]}" for k in by] + ["block long", "n int", "blob binary"])
    return numbered.groupBy(*by, "block").applyInPandas(one, schema)


def decoded_blocks(blocks: DataFrame) -> DataFrame:
    """The bits of coded blocks again, as arrays."""

    @F.pandas_udf("array<int>")
    def decode(blob: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(range_decode(b, c), np.int32) for b, c in zip(blob, n)])

    return blocks.withColumn("bits", decode("blob", "n")).drop("blob")


def reference_price(regions: DataFrame, cells: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Bits of region colours against the rounded mean of a reference image over the same cells, cells(image, lab, channels)."""
    mean = cells.groupBy("image", "lab").agg(*[F.round(F.avg(c)).alias(f"p_{c}") for c in channels])
    return entropy.adaptive_bits(_residuals(regions.join(mean, ["image", "lab"]), channels), ["image"], ["channel"], "d", 512).select("image", "bits")


def first_cell_entropy(px: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Empirical entropy of region means less those of the region to the left of the first cell, or above it, or 128.
    One histogram an image for all channels."""
    means = px.groupBy("image", "lab").agg(*[F.avg(c).alias(c) for c in channels])
    near = F.coalesce(F.lag("lab").over(raster.row()), F.lag("lab").over(raster.column()))
    first = px.withColumn("_near", near).groupBy("image", "lab").agg(F.min(F.struct("y", "x", F.col("_near").alias("near"))).alias("_f")).select("image", "lab", F.col("_f.near").alias("near"))
    other = means.select("image", F.col("lab").alias("near"), *[F.col(c).alias(f"p_{c}") for c in channels])
    rows = means.join(first, ["image", "lab"]).join(other, ["image", "near"], "left").fillna(128.0, [f"p_{c}" for c in channels])
    rows = rows.select("image", F.explode(F.array(*[F.round(F.col(c) - F.col(f"p_{c}")).cast("int") for c in channels])).alias("d"))
    return entropy.static_bits(rows, ["image"], [], "d")


def earlier_means(regions: DataFrame, rag: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Adds m_<channel>, the boundary-weighted mean of earlier neighbours, 128 without any."""
    other = regions.select("image", F.col("lab").alias("_b"), *[F.col(c).alias(f"o_{c}") for c in channels])
    mean = rag.filter("b < a").select("image", F.col("a").alias("lab"), F.col("b").alias("_b"), "len").join(other, ["image", "_b"]).groupBy("image", "lab")
    mean = mean.agg(*[(F.sum(F.col("len") * F.col(f"o_{c}")) / F.sum("len")).alias(f"m_{c}") for c in channels])
    return regions.join(mean, ["image", "lab"], "left").fillna(128.0, [f"m_{c}" for c in channels])


def pinned_gain(means: DataFrame) -> DataFrame:
    """Least squares of a in c = m_c + step (1 + a (m_c / m_g - 1)) for red and blue, the step being green's residual;
    as 32-bit floats, 0 where nothing is to be fitted."""
    step = F.col("g") - F.col("m_g")
    out = []
    for c in ("r", "b"):
        x = F.when(F.col("m_g") >= 1, step * (F.col(f"m_{c}") / F.col("m_g") - 1)).otherwise(0.0)
        y = F.col(c) - F.col(f"m_{c}")
        fit = (F.sum(y * x) - F.sum(step * x)) / F.sum(x * x)
        out.append(F.when(F.sum(x * x) > 0, fit).otherwise(0.0).cast("float").alias(f"a_{c}"))
    return means.groupBy("image").agg(*out)


def previous_residual(means: DataFrame, rag: DataFrame, channel: str = "g") -> DataFrame:
    """image, lab, d, before: a region's rounded residual, and the size of that of the best earlier neighbour, else of the
    region before it, else 0."""
    rows = means.select("image", "lab", (F.col(channel) - F.round(f"m_{channel}")).cast("int").alias("d"))
    best = raster.best_earlier(rag).select("image", F.col("a").alias("lab"), F.col("b").alias("_b"))
    rows = rows.withColumn("_last", F.lag("d").over(Window.partitionBy("image").orderBy("lab")))
    other = rows.select("image", F.col("lab").alias("_b"), F.col("d").alias("_near"))
    rows = rows.join(best, ["image", "lab"], "left").join(other, ["image", "_b"], "left")
    return rows.select("image", "lab", "d", F.abs(F.coalesce("_near", "_last", F.lit(0))).alias("before"))


def model_ladder(rows: DataFrame, by: list[str], models: dict[str, list[str]], symbol: str, symbols: int) -> DataFrame:
    """Adaptive and static bits of each named model (a list of context columns), all from one pass over the counts."""
    named = F.array(*[F.struct(F.lit(m).alias("model"), F.to_json(F.array(*[F.col(c).cast("string") for c in cs])).alias("context")) for m, cs in models.items()])
    long = rows.select(*by, F.col(symbol).alias("_s"), F.explode(named).alias("_m")).select(*by, "_s", "_m.model", "_m.context")
    counts = long.groupBy(*by, "model", "context", "_s").agg(F.count("*").alias("_c"))
    per = counts.groupBy(*by, "model", "context").agg(F.sum("_c").alias("_t"), F.sum(entropy.rising_bits(1.0, F.col("_c"))).alias("_n"), F.sum(F.col("_c") * F.log2("_c")).alias("_l"))
    adaptive = F.sum(entropy.rising_bits(float(symbols), F.col("_t")) - F.col("_n"))
    static = F.sum(F.col("_t") * F.log2("_t") - F.col("_l"))
    return per.groupBy(*by, "model").agg(adaptive.alias("adaptive"), static.alias("static"))


def best_models(ladder: DataFrame, by: list[str]) -> DataFrame:
    """The best model that can be coded and the best with its tables for free; ties go to the first name."""
    pick = lambda c: F.min(F.struct(F.round(c, 6).alias("bits"), F.col("model").alias("model")))
    got = ladder.groupBy(*by).agg(pick("adaptive").alias("a"), pick("static").alias("s"))
    return got.select(*by, F.col("a.model").alias("best"), F.col("a.bits").alias("bits"), F.col("s.model").alias("best_static"), F.col("s.bits").alias("static_bits"))


def greedy_taps(rows: DataFrame, symbol: str, base: str, pool: list[str], want: int) -> list[tuple[str, float]]:
    """Grows a context bit by bit: each step prices base with every column of pool that is left, in one job, and keeps
    the one with the fewest adaptive bits (first in pool on ties). Only one row a candidate reaches the driver."""
    chosen: list[tuple[str, float]] = []
    while len(chosen) < want and len(chosen) < len(pool):
        taken = [c for c, _ in chosen]
        left = {c: [base, *taken, c] for c in pool if c not in taken}
        priced = model_ladder(rows.withColumn("_all", F.lit(0)), ["_all"], left, symbol, 2).collect()
        best = min(priced, key=lambda r: (round(r.adaptive, 6), pool.index(r.model)))
        chosen.append((best.model, round(best.adaptive, 6)))
    return chosen
