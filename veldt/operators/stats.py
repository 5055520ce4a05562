"""Percentiles by several definitions, candidate scoring with bootstrap intervals, rate-distortion curves."""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SLICES = 1024


def order_statistics(rows: DataFrame, value: str, by: list[str], places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The values at places (from 0, as a function of the count) of each group's ascending list.

    Equal values are counted first; a group's range is cut into SLICES equal parts, whose counts tell which parts hold a
    place, and only those are put in order. No task sorts a whole group.
    """
    hist = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    span = hist.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_c").alias("_n"))
    width = F.col("_hi") - F.col("_lo")
    part = F.when(width > 0, F.floor((F.col(value) - F.col("_lo")) / width * (SLICES - 1))).otherwise(0).alias("_s")
    dealt = hist.join(span, by).select(*by, value, "_c", "_n", part)
    upto = Window.partitionBy(*by).orderBy("_s")
    parts = dealt.groupBy(*by, "_s").agg(F.sum("_c").alias("_own")).withColumn("_upto", F.sum("_own").over(upto))
    held = F.lit(False)
    for place in places.values():
        held |= (place(F.col("_n")) >= F.col("_before")) & (place(F.col("_n")) < F.col("_upto"))
    near = dealt.join(parts.select(*by, "_s", "_upto", (F.col("_upto") - F.col("_own")).alias("_before")), [*by, "_s"]).filter(held)
    last = F.col("_before") + F.sum("_c").over(Window.partitionBy(*by, "_s").orderBy(value))
    near = near.withColumn("_last", last)
    pick = lambda at: F.max(F.when((at >= F.col("_last") - F.col("_c")) & (at < F.col("_last")), F.col(value)))
    return near.groupBy(*by).agg(*[pick(place(F.col("_n"))).alias(name) for name, place in places.items()], F.first("_n").alias("_n"))


def percentile_floor(rows: DataFrame, value: str, by: list[str], p: float = 0.95) -> DataFrame:
    """sorted[min(n - 1, floor(p n))]."""
    return order_statistics(rows, value, by, {"p": lambda n: F.least(n - 1, F.floor(F.lit(p) * n))}).drop("_n")


def percentile_nearest_rank(rows: DataFrame, value: str, by: list[str], p: float = 0.95) -> DataFrame:
    """sorted[round(p (n - 1))], halves to even."""
    return order_statistics(rows, value, by, {"p": lambda n: F.bround(F.lit(p) * (n - 1))}).drop("_n")


def percentile_linear(rows: DataFrame, value: str, by: list[str], ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Between the neighbours of place p (n - 1), by its fraction."""
    places = {}
    for k, p in enumerate(ps):
        places[f"_lo{k}"] = lambda n, p=p: F.floor(F.lit(p) * (n - 1))
        places[f"_hi{k}"] = lambda n, p=p: F.ceil(F.lit(p) * (n - 1))
    got, out = order_statistics(rows, value, by, places), []
    for k, p in enumerate(ps):
        at = F.lit(p) * (F.col("_n") - 1)
        out.append((F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * (at - F.floor(at))).alias(f"p{round(100 * p)}"))
    return got.select(*by, *out)


def score(row: dict[str, Column], alpha: float, beta: float) -> Column:
    """Bytes plus weighted encode and decode times."""
    return row["bytes"] + F.lit(alpha) * row["encode"] + F.lit(beta) * row["decode"]


def deltas(base: DataFrame, candidate: DataFrame, item: str = "item") -> DataFrame:
    """Items that both runs have: baseline, candidate, delta, percentage."""
    both = base.select(item, F.col("score").alias("baseline")).join(candidate.select(item, F.col("score").alias("candidate")), item)
    d = F.col("candidate") - F.col("baseline")
    return both.withColumn("delta", d).withColumn("pct", 100 * d / F.col("baseline"))


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Both published percentages: ratio of totals, and mean of the items' ratios."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("delta").alias("mean_delta"),
        F.expr("percentile(delta, 0.5)").alias("median_delta"),
        (100 * F.sum("delta") / F.sum("baseline")).alias("pct_of_totals"),
        F.avg("pct").alias("mean_pct"),
    )


def bootstrap_bounds(values: list[float], rounds: int = 10_000, alpha: float = 0.05, seed: int = 0xC0FFEE) -> tuple[float, float]:
    """Percentile interval of resampled means; empty input gives (0, 0). Deterministic for a given order. Draws come from
    Python's own generator, one by one, so that the stream of the published results is kept."""
    n = len(values)
    if not n:
        return 0.0, 0.0
    draw = random.Random(seed).randrange
    means = sorted(sum(values[draw(n)] for _ in range(n)) / n for _ in range(rounds))
    return means[int(alpha / 2 * rounds)], means[int((1 - alpha / 2) * rounds)]


def bootstrap(rows: DataFrame, by: list[str], item: str = "item", rounds: int = 10_000) -> DataFrame:
    """rows(by, item, baseline, delta): interval of the mean and the decision (KEEP only if all of it is below zero), and
    the interval of the mean of the items' percentages (0 where the baseline is not above 0)."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", ci_low double, ci_high double, ci_low_pct double, ci_high_pct double, decision string"

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(item)
        low, high = bootstrap_bounds(group.column("delta").to_pylist(), rounds)
        low_pct, high_pct = bootstrap_bounds(group.column("pct").to_pylist(), rounds)
        out = {c: group.column(c)[:1] for c in by}
        return pa.table(out | {"ci_low": [low], "ci_high": [high], "ci_low_pct": [low_pct], "ci_high_pct": [high_pct], "decision": ["KEEP" if high < 0 else "DROP"]})

    pct = F.when(F.col("baseline") > 0, F.col("delta") / F.col("baseline") * 100.0).otherwise(0.0)
    return rows.select(*by, item, "delta", pct.alias("pct")).groupBy(*by).applyInArrow(run, schema)


def hashed_bootstrap(rows: DataFrame, by: list[str], item: str, rounds: int) -> DataFrame:
    """The same interval with draws from a linear congruential sequence: plain SQL, portable between engines.

    Item i of draw (round, slot) is (1664525 (round 1009 + slot) + 1013904223) mod 2^32 mod n. Groups are explicit
    item lists, as in candidate scoring; the expansion is rounds times items of a group.
    """
    part = Window.partitionBy(*by)
    ranked = rows.withColumn("_i", F.row_number().over(part.orderBy(item)) - 1).withColumn("_n", F.count("*").over(part))
    draws = ranked.select(*by, F.col("_i").alias("slot"), "_n", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    draw = ((F.col("round") * 1009 + F.col("slot")).cast("long") * 1664525 + 1013904223) % F.lit(4294967296) % F.col("_n")
    picked = draws.withColumn("_i", draw).join(ranked.select(*by, "_i", "delta"), [*by, "_i"])
    means = picked.groupBy(*by, "round").agg(F.avg("delta").alias("m"))
    ordered = means.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("m")) - 1)
    low, high = int(0.025 * rounds), int(0.975 * rounds)
    return ordered.groupBy(*by).agg(F.max(F.when(F.col("_r") == low, F.col("m"))).alias("ci_low"), F.max(F.when(F.col("_r") == high, F.col("m"))).alias("ci_high"))


def interpolate(curve: DataFrame, wanted: DataFrame, by: list[str], x: str = "x", y: str = "y", at: str = "at") -> DataFrame:
    """y of each wanted x on the curve's first bracketing segment; null outside the curve, never extrapolated."""
    w = Window.partitionBy(*by).orderBy(x)
    seg = curve.select(*by, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1")).filter("x1 is not null")
    hit = wanted.join(seg, by, "left").filter(F.col("x0").isNull() | F.col(at).between(F.col("x0"), F.col("x1")))
    value = F.when(F.col("x1") == F.col("x0"), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col(at) - F.col("x0")) / (F.col("x1") - F.col("x0")))
    found = hit.filter("x0 is not null").groupBy(*by, at).agg(F.min(F.struct("x0", value.alias("v"))).alias("_m"))
    return wanted.join(found.select(*by, at, F.col("_m.v").alias("value")), [*by, at], "left")


def _skyline(v: np.ndarray) -> np.ndarray:
    """Places of the rows that no other row beats on one axis while matching it on all; equal rows stay."""
    order, kept = np.lexsort(v.T[::-1]), []
    for i in order.tolist():
        own = v[kept]
        if not ((own <= v[i]).all(1) & (own < v[i]).any(1)).any():
            kept.append(i)
    return np.array(kept, np.int64)


def undominated(rows: DataFrame, axes: list[str]) -> DataFrame:
    """Rows that no other row beats on one axis while matching it on all. Each task keeps what its own points leave, one
    task merges these, and rows join the points that remain; rows with a null axis are compared with none and stay."""
    points = rows.select(*[F.col(a).cast("double").alias(a) for a in axes]).dropna().distinct()

    def local(batches):
        held = np.empty((0, len(axes)))
        for batch in batches:
            v = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], 1)])
            held = v[_skyline(v)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.T], axes)

    schema = ", ".join(f"`{a}` double" for a in axes)
    best = points.mapInArrow(local, schema).coalesce(1).mapInArrow(local, schema).select(*[F.col(a).alias(f"_{a}") for a in axes])
    same = F.lit(True)
    missing = F.lit(False)
    for a in axes:
        same &= F.col(a).cast("double") == F.col(f"_{a}")
        missing |= F.col(a).isNull()
    return rows.join(best, same, "left_semi").union(rows.filter(missing))


def experiment_summary(rows: DataFrame, experiment: str, size: str, encode: str, decode: str) -> DataFrame:
    """For each experiment: total size, slowest encoding and decoding, mean size."""
    return rows.groupBy(experiment).agg(F.sum(size).alias("total"), F.max(encode).alias("slowest_encode"), F.max(decode).alias("slowest_decode"), F.avg(size).alias("mean"))
