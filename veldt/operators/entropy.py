"""Code lengths of adaptive and static models as aggregates.

An adaptive coder with prior weight alpha over n symbols spends -log2((c + alpha) / (T + alpha n)) a symbol. Within
a context the multiset of numerators and denominators does not depend on arrival order, so the total is a sum over
row numbers, and that sum is a difference of log-gamma values: `adaptive_bits` needs no state and no global order, and
its work is one expression for each count, however large.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: ten steps up, then Stirling's series."""
    z, steps = x.cast("double") + 10, F.lit(0.0)
    for k in range(10):
        steps = steps + F.log(x.cast("double") + k)
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - 1 / (1680 * z * z * z * z * z * z * z)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - steps


def rising_bits(start: Column | float, count: Column) -> Column:
    """log2 of start (start + 1) ... (start + count - 1); start > 0."""
    first = log_gamma(start) if isinstance(start, Column) else F.lit(math.lgamma(start))
    return (log_gamma(start + count) - first) / math.log(2)


def adaptive_bits(rows: DataFrame, by: list[str], context: list[str], symbol: str, symbols: int, alpha: float = 1.0) -> DataFrame:
    """Total bits of an adaptive model with `symbols` symbols, for each group of `by`."""
    counts = rows.groupBy(*by, *context, symbol).agg(F.count("*").alias("_c"))
    spent = counts.select(*by, *context, "_c", rising_bits(alpha, F.col("_c")).alias("_num"))
    per = spent.groupBy(*by, *context).agg(F.sum("_c").alias("_t"), F.sum("_num").alias("_num"))
    return per.withColumn("_bits", rising_bits(alpha * symbols, F.col("_t")) - F.col("_num")).groupBy(*by).agg(F.sum("_bits").alias("bits"), F.count("*").alias("contexts"), F.sum("_t").alias("n"))


def static_bits(rows: DataFrame, by: list[str], context: list[str], symbol: str) -> DataFrame:
    """Static conditional entropy in bits: sum of k log2(t / k)."""
    counts = rows.groupBy(*by, *context, symbol).agg(F.count("*").alias("k"))
    totals = counts.groupBy(*by, *context).agg(F.sum("k").alias("t"), F.sum(F.col("k") * F.log2("k")).alias("kl"))
    return totals.groupBy(*by).agg(F.sum(F.col("t") * F.log2("t") - F.col("kl")).alias("bits"))


def run_lengths(rows: DataFrame, by: list[str], order: list[str], symbol: str) -> DataFrame:
    """Histogram of runs of equal symbols, the last run included."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.col(symbol) == F.lag(symbol).over(w), 0).otherwise(1)
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "_run").agg(F.count("*").alias("length")).groupBy(*by, "length").agg(F.count("*").alias("runs"))


def varint_bytes(v: Column) -> Column:
    """Bytes of an unsigned base-128 integer."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(v.cast("long"))) / 7)).cast("int")


def bucket(v: Column, edges: tuple) -> Column:
    """Place of the first edge that is not below v."""
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(v <= edges[i], i).otherwise(out)
    return out


def token(v: Column) -> Column:
    """Signed magnitude class: 0, or sign times the bit length."""
    return F.when(v == 0, 0).otherwise(F.signum(v) * F.length(F.bin(F.abs(v).cast("long")))).cast("int")


def combination_bits(p: Column, n: Column) -> Column:
    """log2 of p choose n, for 0 <= n <= p."""
    return F.when(n <= 0, 0.0).otherwise(rising_bits(p - n + 1, n) - rising_bits(1.0, n))


def stretch(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def squash(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def congruential(s: Column) -> Column:
    return (s.cast("long") * 1664525 + 1013904223) % F.lit(4294967296)


def human(size: Column) -> Column:
    """Bytes as text: B below a kilobyte, KB with one decimal below a megabyte, MB with two from there."""
    n, kilo, mega = size.cast("double"), 1024.0, 1024.0 * 1024.0
    text = F.when(n < mega, F.format_string("%.1f KB", F.bround(n / kilo, 1))).otherwise(F.format_string("%.2f MB", F.bround(n / mega, 2)))
    return F.when(n < kilo, F.concat(size.cast("string"), F.lit(" B"))).otherwise(text)


#: Edges of signed buckets and of gradient buckets.
SIGNED_EDGES = (-16, -8, -4, -2, -1, 0, 1, 2, 4, 8, 16)
GRADIENT_EDGES = (0, 1, 2, 4, 8, 16, 32)


def signed_bucket(v: Column) -> Column:
    """Twelve buckets that keep the sign."""
    return bucket(v, SIGNED_EDGES)


def gradient_context(w: Column, nw: Column, n: Column) -> Column:
    """Two gradients of decoded neighbours, nine buckets apart."""
    return bucket(F.abs(nw - w), GRADIENT_EDGES) * 9 + bucket(F.abs(n - nw), GRADIENT_EDGES)


def capped(v: Column, k: int) -> Column:
    return F.least(v, F.lit(k - 1))


def recent_turns(history: Column, k: int) -> Column:
    """The last k of turns kept as base-3 digits."""
    return history % 3**k


def schedule_key(mode: str, plane: Column, x: Column, y: Column) -> Column:
    """Place of a cell in a coding order, as a struct that compares field by field."""
    keys = {"planes": (plane, y, x), "planes_reversed": (1 - plane, y, x), "cells": (y, x, plane), "cells_reversed": (y, x, 1 - plane)}
    return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys[mode])])


def turn_balance(rows: DataFrame, by: list[str], order: list[str], symbol: str, n: int) -> DataFrame:
    """Of the last n symbols, the row's own included: how many are 0, and ones less twos."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - n, 0)
    of = lambda s: F.sum((F.col(symbol) == s).cast("int")).over(w)
    return rows.withColumn("straight", of(0)).withColumn("balance", of(1) - of(2))


def stratified(rows: DataFrame, order: list[str], density: str, n: int, by: list[str]) -> DataFrame:
    """n samples at equal steps of the running density (1e-3 added to each row), the first half a step in; a row may get
    several, one row for each."""
    part = Window.partitionBy(*by)
    own = F.col(density) + 1e-3
    step = F.sum(own).over(part) / n
    upto = F.sum(own).over(part.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    hits = F.least(F.lit(n), F.floor(upto / step + 0.5 + 1e-9)).cast("int")
    got = rows.withColumn("_upto", hits).withColumn("_before", F.coalesce(F.lag("_upto").over(part.orderBy(*order)), F.lit(0)))
    got = got.filter(F.col("_upto") > F.col("_before"))
    return got.withColumn("sample", F.explode(F.sequence(F.col("_before"), F.col("_upto") - 1))).drop("_upto", "_before")


def stream_shape(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Percentage of zeros and mean run of a stream."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)
    return rows.withColumn("_new", new).groupBy(*by).agg((100 * F.count_if(F.col(value) == 0) / F.count("*")).alias("zero_pct"), (F.count("*") / F.sum("_new")).alias("mean_run"))
