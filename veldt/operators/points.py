"""Weighted points: histograms, moments, top-k palettes, nearest-reference joins, cuts along an order.

A histogram is the first step of everything here: distinct points with weights are far fewer than rows, so the
aggregation runs below any distance work. Reference tables (palettes) are bounded by MAX_REFERENCES, which
`nearest` checks before it broadcasts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour

MAX_REFERENCES = 4096


def histogram(pixels: DataFrame, group: list[str] | None = None) -> DataFrame:
    """pixels(r, g, b): distinct points with key and cnt."""
    keyed = pixels.withColumn("key", colour.pack(F.col("r"), F.col("g"), F.col("b")))
    return keyed.groupBy(*(group or []), "key", "r", "g", "b").agg(F.count("*").alias("cnt"))


def bin_histogram(hist: DataFrame, cap: int) -> DataFrame:
    """The finest shift 0..6 that leaves at most cap bins, and the bins' weights and weighted means."""
    binned = [colour.pack(*(F.shiftright(F.col(c), s) for c in "rgb")) for s in range(7)]
    sizes = hist.agg(*[F.countDistinct(k).alias(f"n{s}") for s, k in enumerate(binned)])
    shift = F.lit(6)
    for s in range(5, -1, -1):
        shift = F.when(F.col(f"n{s}") <= cap, s).otherwise(shift)
    chosen = sizes.select(shift.cast("int").alias("shift"))
    key = colour.pack(*(F.expr(f"shiftright({c}, shift)") for c in "rgb"))
    rows = hist.crossJoin(F.broadcast(chosen)).withColumn("bin", key)
    w = F.col("cnt")
    return rows.groupBy("shift", "bin").agg(F.sum(w).alias("cnt"), *[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in "rgb"])


def centroid(points: DataFrame, by: list[str], axes: list[str], weight: str = "cnt") -> DataFrame:
    return points.groupBy(*by).agg(F.sum(weight).alias("w"), *[(F.sum(F.col(a) * F.col(weight)) / F.sum(weight)).alias(a) for a in axes])


def mean_trunc(points: DataFrame, by: list[str]) -> DataFrame:
    """Weighted mean colour in whole numbers."""
    return points.groupBy(*by).agg(*[F.expr(f"sum({c} * cnt) div sum(cnt)").alias(c) for c in "rgb"], F.sum("cnt").alias("cnt"))


def moments(points: DataFrame, axes: list[str], by: list[str] | None = None, weight: str = "cnt") -> DataFrame:
    """Weighted means, covariances and squared error of each group, in one aggregation."""
    w = F.col(weight)
    sums = [F.sum(w).alias("w"), *[F.sum(w * F.col(a)).alias(f"s_{a}") for a in axes]]
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    sums += [F.sum(w * F.col(a) * F.col(b)).alias(f"s_{a}{b}") for a, b in pairs]
    got = points.groupBy(*(by or [])).agg(*sums)
    cov = [(F.col(f"s_{a}{b}") / F.col("w") - F.col(f"s_{a}") / F.col("w") * F.col(f"s_{b}") / F.col("w")).alias(f"cov_{a}{b}") for a, b in pairs]
    out = got.select(*(by or []), "w", *[(F.col(f"s_{a}") / F.col("w")).alias(f"mean_{a}") for a in axes], *cov)
    return out.withColumn("sse", F.col("w") * sum((F.col(f"cov_{a}{a}") for a in axes), F.lit(0.0)))


def extent(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Range of each channel and the longest axis, r before g before b."""
    out = points.groupBy(*(by or [])).agg(*[(F.max(c) - F.min(c)).alias(f"range_{c}") for c in "rgb"])
    r, g, b = (F.col(f"range_{c}") for c in "rgb")
    return out.withColumn("axis", F.when((r >= g) & (r >= b), "r").when(g >= b, "g").otherwise("b"))


def weighted_median(points: DataFrame, value: str, by: list[str], weight: str = "cnt") -> DataFrame:
    """The first value whose running weight reaches half of the group's."""
    per = points.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*by).orderBy(value)
    run = per.withColumn("_cum", F.sum("_w").over(w)).withColumn("_all", F.sum("_w").over(Window.partitionBy(*by)))
    return run.filter(F.col("_cum") * 2 >= F.col("_all")).groupBy(*by).agg(F.min(value).alias("median"))


def popularity(hist: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """The n heaviest colours (ties: smaller key) with their rank from 0."""
    if not by:
        top = hist.orderBy(F.desc("cnt"), "key").limit(n)
        return top.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("cnt"), "key")) - 1)
    w = Window.partitionBy(*by).orderBy(F.desc("cnt"), "key")
    return hist.withColumn("idx", F.row_number().over(w) - 1).filter(F.col("idx") < n)


def nearest(points: DataFrame, references: DataFrame, distance: Column, key: list[str], idx: str = "idx", carry: tuple[str, ...] = ()) -> DataFrame:
    """The nearest reference of each point, lowest index on ties. `distance` uses columns of both sides.

    references are checked to be at most MAX_REFERENCES rows, then broadcast; points should be distinct.
    """
    count = references.count()
    if count > MAX_REFERENCES:
        raise ValueError(f"{count} references; no more than {MAX_REFERENCES} are built")
    pairs = points.join(F.broadcast(references)).withColumn("_d", distance)
    best = pairs.groupBy(*key).agg(F.min(F.struct("_d", idx, *carry)).alias("_m"))
    return best.select(*key, F.col("_m._d").alias("d"), F.col(f"_m.{idx}").alias("idx"), *[F.col(f"_m.{c}").alias(c) for c in carry])


def cell_table(palette: DataFrame, bits: int) -> DataFrame:
    """Approximate inverse map: the nearest palette entry to the centre of every cell of `bits` bits a channel."""
    spark, s = palette.sparkSession, 8 - bits
    axis = lambda c: spark.range(1 << bits).select(F.col("id").cast("int").alias(c))
    cells = axis("cr").join(axis("cg")).join(axis("cb"))
    centre = [F.shiftleft(F.col(c), s) + (1 << s >> 1) for c in ("cr", "cg", "cb")]
    d = colour.dist2(tuple(centre), (F.col("r"), F.col("g"), F.col("b")))
    return nearest(cells, palette.select("idx", "r", "g", "b"), d, ["cr", "cg", "cb"])


def segments(points: DataFrame, order: list[str], n: int, weight: str = "cnt", by: list[str] | None = None) -> DataFrame:
    """Equal-weight cuts along an order, at most one after each row: adds segment from 0 to n - 1.

    With F = floor(running weight / (total / n)), cuts after row i are min over j <= i of (F_j - j), plus i; a row
    belongs to the cuts after the row before it.
    """
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    run = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = points.withColumn("_i", F.row_number().over(part.orderBy(*order)))
    rows = rows.withColumn("_f", F.floor(F.sum(weight).over(run) * n / F.sum(weight).over(part)))
    rows = rows.withColumn("_cuts", F.least(F.col("_i"), F.min(F.col("_f") - F.col("_i")).over(run) + F.col("_i"), F.lit(n - 1)))
    return rows.withColumn("segment", F.coalesce(F.lag("_cuts").over(part.orderBy(*order)), F.lit(0)).cast("int")).drop("_i", "_f", "_cuts")


def median_split(points: DataFrame, axis: str, by: list[str]) -> DataFrame:
    """Adds side: rows up to the first one whose running weight reaches half go left; neither side is empty."""
    w = Window.partitionBy(*by).orderBy(axis, "key")
    all_ = Window.partitionBy(*by)
    rows = points.withColumn("_i", F.row_number().over(w)).withColumn("_cum", F.sum("cnt").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_n", F.count("*").over(all_)).withColumn("_all", F.sum("cnt").over(all_))
    at = F.min(F.when(F.col("_cum") * 2 >= F.col("_all"), F.col("_i"))).over(all_)
    at = F.greatest(F.lit(1), F.least(at, F.col("_n") - 1))
    return rows.withColumn("side", F.when(F.col("_i") <= at, 0).otherwise(1)).drop("_i", "_cum", "_n", "_all")


def cell_lookup(points: DataFrame, cells: DataFrame, bits: int) -> DataFrame:
    """Points with their cell's row of a cell table, by an equality join on the cell."""
    at = [F.shiftright(F.col(c), 8 - bits).alias(f"c{c}") for c in "rgb"]
    return points.select("*", *at).join(cells, ["cr", "cg", "cb"])


def interior_cells(palette: DataFrame, bits: int) -> DataFrame:
    """A cell table with `interior`: the cell's entry is nearest (lowest index on ties) to every point of the cell.

    The gap between two squared distances is linear in the point, so its least value lies in a corner that each
    axis settles on its own.
    """
    side = 1 << (8 - bits)
    own = palette.select("idx", *[F.col(c).alias(f"o{c}") for c in "rgb"])
    other = palette.select(F.col("idx").alias("other"), *[F.col(c).alias(f"n{c}") for c in "rgb"])
    gap = F.lit(0)
    for c in "rgb":
        lo = F.col(f"c{c}") * side
        q, o = F.col(f"n{c}"), F.col(f"o{c}")
        gap = gap + q * q - o * o - 2 * (q - o) * F.when(q > o, lo + side - 1).otherwise(lo)
    wins = (F.col("other") == F.col("idx")) | (gap > 0) | ((gap == 0) & (F.col("idx") < F.col("other")))
    rows = cell_table(palette, bits).join(F.broadcast(own), "idx").join(F.broadcast(other)).withColumn("_wins", wins)
    return rows.groupBy("cr", "cg", "cb", "idx").agg(F.min("_wins").alias("interior"))


def nearest_by_cells(points: DataFrame, palette: DataFrame, bits: int, key: list[str]) -> DataFrame:
    """Exact nearest entries: interior cells answer by lookup, only points of other cells meet the palette."""
    found = cell_lookup(points, interior_cells(palette, bits), bits)
    hits = found.filter("interior").join(F.broadcast(palette.select("idx", *[F.col(c).alias(f"p{c}") for c in "rgb"])), "idx")
    d = colour.dist2(tuple(F.col(c) for c in "rgb"), tuple(F.col(f"p{c}") for c in "rgb")).cast("long")
    rest = found.filter("not interior").select(*points.columns)
    return hits.select(*key, d.alias("d"), "idx").union(nearest(rest, palette.select("idx", *[F.col(c).alias(f"p{c}") for c in "rgb"]), d, key))


def nearest_by_rings(points: DataFrame, references: DataFrame, axes: list[tuple[str, str]], key: list[str], cell: float, idx: str = "idx") -> DataFrame:
    """key..., d, idx: the reference with the least squared distance, lowest index on ties, of any number of references.

    Both sides are joined on cells, a point with the 3^k cells around its own. What lies outside is farther than a cell's
    side, so a point whose best is no farther is done; the others go on with cells twice as large. Nothing is broadcast
    here. Points should be distinct on key, without nulls; with no references there are no rows. A point far from a dense
    cluster meets all of it.
    """
    extents = [side.agg(*[f(a[i]).cast("double") for a in axes for f in (F.min, F.max)]).first() for i, side in enumerate((points, references))]
    if any(v is None for e in extents for v in e):
        return points.select(*key, F.lit(0.0).alias("d"), F.lit(0).alias(idx)).limit(0)
    extent = max(max(e[2 * k + 1] for e in extents) - min(e[2 * k] for e in extents) for k in range(len(axes)))
    names = [f"_k{k}" for k in range(len(axes))]
    far = sum((((F.col(p) - F.col(r)) * (F.col(p) - F.col(r))) for p, r in axes), F.lit(0))
    left, done, size = points, None, float(cell)
    while True:
        around = left
        for name, (p, _) in zip(names, axes, strict=True):
            at = F.floor(F.col(p) / size)
            around = around.withColumn(name, F.explode(F.array(at - 1, at, at + 1)))
        held = references.select(idx, *[r for _, r in axes], *[F.floor(F.col(r) / size).alias(n) for n, (_, r) in zip(names, axes, strict=True)])
        best = around.join(held, names).groupBy(*key).agg(F.min(F.struct(far.alias("d"), idx)).alias("_m"))
        last = size > extent
        near = (best if last else best.filter(F.col("_m.d") <= size * size)).select(*key, F.col("_m.d").alias("d"), F.col(f"_m.{idx}").alias(idx)).checkpoint()
        done = near if done is None else done.union(near)
        if last:
            return done
        left = left.join(near.select(*key), key, "left_anti").checkpoint()
        if left.isEmpty():
            return done
        size *= 2
