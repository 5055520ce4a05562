"""Images as rows (image, x, y, channels): paired errors, crops, gradients, region statistics, plane fits, agreement of
partitions, templates of boundary bits. Windows run along the lines of one image; regions are groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import raster

RGB = ("r", "g", "b")


def crop(px: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The window's pixels, moved to its corner; ValueError if it leaves the image."""
    most = px.agg(F.max("x").alias("x"), F.max("y").alias("y")).first()
    if x < 0 or y < 0 or w <= 0 or h <= 0 or most.x is None or x + w > most.x + 1 or y + h > most.y + 1:
        raise ValueError(f"window {x},{y} {w}x{h} is not inside the image")
    inside = px.filter(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))
    return inside.withColumn("x", F.col("x") - x).withColumn("y", F.col("y") - y)


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels that both images have: channels of a, and of b with a q before their names."""
    return a.join(b.select("image", "x", "y", *[F.col(c).alias(f"q{c}") for c in RGB]), ["image", "x", "y"])


def errors() -> list[Column]:
    """Absolute differences of the channels of paired pixels."""
    return [F.abs(F.col(c) - F.col(f"q{c}")) for c in RGB]


def fidelity(pairs: DataFrame, by: list[str], over: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """Squared error, mean and largest difference of channels, and the share of pixels whose largest exceeds `over`."""
    e = errors()
    worst = F.greatest(*e)
    rows = pairs.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(sum((x * x for x in e), F.lit(0))).cast("long").alias("sse"),
        F.sum(sum(e, F.lit(0))).cast("long").alias("sum"),
        F.max(worst).cast("long").alias("most"),
        *[(100 * F.count_if(worst > t) / F.count("*")).alias(f"over{t}") for t in over],
    )
    return rows.withColumn("mae", F.col("sum") / (3 * F.col("n"))).drop("sum")


def in_windows(px: DataFrame, windows: list[tuple[str, int, int, int, int]]) -> DataFrame:
    """A row for each named window (name, x, y, w, h) that holds a pixel."""
    inside = [F.when(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1), F.lit(n)) for n, x, y, w, h in windows]
    return px.withColumn("window", F.explode(F.filter(F.array(*inside), lambda n: n.isNotNull())))


def gradient(px: DataFrame) -> DataFrame:
    """Length of the central differences of all channels, with the image's edge repeated."""
    total = F.lit(0)
    for c in RGB:
        for line in (raster.row(), raster.column()):
            d = F.coalesce(F.lead(c).over(line), F.col(c)) - F.coalesce(F.lag(c).over(line), F.col(c))
            total = total + d * d
    return px.withColumn("gradient", F.sqrt(total))


def region_colours(px: DataFrame) -> DataFrame:
    """Area, channel sums and rounded mean colour of every region of px(lab, channels)."""
    return px.groupBy("image", "lab").agg(F.count("*").alias("area"), *[F.sum(c).cast("long").alias(f"sum_{c}") for c in RGB], *[F.round(F.avg(c)).cast("long").alias(c) for c in RGB])


def _by_size() -> Window:
    return Window.partitionBy("image").orderBy(F.desc("area"), "lab")


def area_distribution(sizes: DataFrame) -> DataFrame:
    """Largest, middle (place n / 2 of the descending list), mean, and the deciles at places i n / 10."""
    ranked = sizes.withColumn("_i", F.row_number().over(_by_size()) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("image")))
    at = lambda place: F.max(F.when(F.col("_i") == place, F.col("area")))
    n = F.col("_n")
    return ranked.groupBy("image").agg(F.max("area").alias("largest"), at(F.floor(n / 2)).alias("middle"), F.avg("area").alias("mean"), *[at(F.floor(n * i / 10)).alias(f"d{i}") for i in range(10)])


def shares(sizes: DataFrame, small: int = 16) -> DataFrame:
    """sizes(area, perimeter): percentages of area and perimeter that the largest tenth and half of the regions and
    those of up to `small` cells have."""
    run = _by_size().rowsBetween(Window.unboundedPreceding, 0)
    rows = sizes.withColumn("_i", F.row_number().over(_by_size())).withColumn("_n", F.count("*").over(Window.partitionBy("image")))
    rows = rows.withColumn("_a", F.sum("area").over(run)).withColumn("_p", F.sum("perimeter").over(run))
    out = []
    for k in (10, 2):
        for c, total in (("_a", "area"), ("_p", "perimeter")):
            out.append((100 * F.max(F.when(F.col("_i") == F.floor(F.col("_n") / k), F.col(c))) / F.sum(total)).alias(f"top{100 // k}_{total}"))
    out += [(100 * F.sum(F.when(F.col("area") <= small, F.col(c)).otherwise(0)) / F.sum(c)).alias(f"small_{c}") for c in ("area", "perimeter")]
    return rows.groupBy("image").agg(*out)


def isoperimetric_excess(sizes: DataFrame) -> DataFrame:
    """Perimeters over those of squares of the same areas."""
    return sizes.groupBy("image").agg((F.sum("perimeter") / F.sum(4 * F.sqrt("area"))).alias("excess"))


def dominance(cells: DataFrame, by: list[str]) -> DataFrame:
    """Distinct labels of each group and the share of the most frequent one."""
    return cells.groupBy(*by, "lab").agg(F.count("*").alias("_c")).groupBy(*by).agg(F.count("*").alias("labels"), (F.max("_c") / F.sum("_c")).alias("share"))


def plane_fits(px: DataFrame, by: list[str], channel: str) -> DataFrame:
    """Least-squares plane of a channel over x and y: slopes and residual; a constant where the cells lie on a line."""
    x, y, c = F.col("x").cast("double"), F.col("y").cast("double"), F.col(channel).cast("double")
    s = px.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in (("sx", x), ("sy", y), ("sxx", x * x), ("sxy", x * y), ("syy", y * y), ("sc", c), ("sxc", x * c), ("syc", y * c), ("scc", c * c))])
    n = F.col("n")
    centred = lambda a, b, ab: F.col(ab) - F.col(a) * F.col(b) / n
    s = s.withColumn("mxx", centred("sx", "sx", "sxx")).withColumn("mxy", centred("sx", "sy", "sxy")).withColumn("myy", centred("sy", "sy", "syy"))
    s = s.withColumn("bx", centred("sx", "sc", "sxc")).withColumn("by", centred("sy", "sc", "syc")).withColumn("det", F.expr("mxx * myy - mxy * mxy"))
    flat = F.col("det") <= 1e-6
    s = s.withColumn("gx", F.when(flat, 0.0).otherwise(F.expr("(myy * bx - mxy * by) / det"))).withColumn("gy", F.when(flat, 0.0).otherwise(F.expr("(mxx * by - mxy * bx) / det")))
    return s.withColumn("sse", F.greatest(F.lit(0.0), F.expr("scc - sc * sc / n - gx * bx - gy * by"))).select(*by, "n", (F.col("sc") / n).alias("mean"), "gx", "gy", "sse")


def quantized_slope(v: Column, step: float = 0.125) -> Column:
    return F.greatest(F.lit(-127), F.least(F.lit(127), F.round(v / step))).cast("long")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of neighbours of partition a and whether b has a boundary where a has one: agreement in percent, boundaries
    that b invents and misses, those of both over those of either."""
    both = a.select("image", "x", "y", F.col("lab").alias("la")).join(b.select("image", "x", "y", F.col("lab").alias("lb")), ["image", "x", "y"])
    sides = [F.when(F.lead("la").over(w).isNotNull(), F.struct((F.lead("la").over(w) != F.col("la")).alias("a"), (F.lead("lb").over(w) != F.col("lb")).alias("b"))) for w in (raster.row(), raster.column())]
    pairs = both.select("image", *[s.alias(f"s{i}") for i, s in enumerate(sides)]).select("image", F.explode(F.array("s0", "s1")).alias("s")).filter("s is not null")
    a_, b_ = F.col("s.a"), F.col("s.b")
    out = pairs.groupBy("image").agg(F.count("*").alias("pairs"), F.count_if(a_ == b_).alias("agree"), F.count_if(b_ & ~a_).alias("invented"), F.count_if(a_ & ~b_).alias("missed"), F.count_if(a_ & b_).alias("shared"))
    return out.withColumn("agreement", 100 * F.col("agree") / F.col("pairs")).withColumn("jaccard", F.col("shared") / (F.col("shared") + F.col("invented") + F.col("missed")))


def template_context(planes: DataFrame, wanted: list[tuple[str, int, int]]) -> DataFrame:
    """planes(image, x, y, <plane>...): adds context, the bits at (plane, dx, dy) of each cell, 0 outside, first lowest."""
    shifted = planes
    for i, (plane, dx, dy) in enumerate(wanted):
        tap = planes.select("image", (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col(plane).alias(f"_t{i}"))
        shifted = shifted.join(tap, ["image", "x", "y"], "left")
    bits = sum((F.coalesce(F.col(f"_t{i}"), F.lit(0)) * (1 << i) for i in range(len(wanted))), F.lit(0))
    return shifted.withColumn("context", bits).drop(*[f"_t{i}" for i in range(len(wanted))])


def parity(labelled: DataFrame) -> DataFrame:
    """Around each inner vertex: does the boundary below equal the exclusive or of the three others, how many labels
    meet, and violations where only two do (there are none)."""
    rows = raster.cracks(labelled)
    row, column = raster.row(), raster.column()
    rows = rows.withColumn("_b", F.lead("lab").over(row)).withColumn("_d", F.lead("lab").over(column)).withColumn("_v", F.lead("v").over(column)).withColumn("_h", F.lead("h").over(row))
    rows = rows.withColumn("_c", F.lead("_d").over(row)).filter("_c is not null")
    bad = F.col("h").bitwiseXOR(F.col("v")).bitwiseXOR(F.col("_v")).bitwiseXOR(F.col("_h")) != 0
    meet = F.size(F.array_distinct(F.array("lab", "_b", "_c", "_d")))
    return rows.groupBy("image").agg(F.count_if(bad).alias("violations"), F.count_if(meet >= 3).alias("junctions"), F.count_if(bad & (meet < 3)).alias("at_two_labels"))


def cover(rects: DataFrame) -> DataFrame:
    """rects(image, seq, x, y, w, h, lab) as cells; a later rectangle overwrites an earlier one."""
    span = lambda at, size: F.explode(F.sequence(F.col(at), F.col(at) + F.col(size) - 1))
    cells = rects.select("image", "seq", "lab", "y", "h", span("x", "w").alias("cx")).select("image", "seq", "lab", "cx", span("y", "h").alias("cy"))
    return cells.groupBy("image", F.col("cx").alias("x"), F.col("cy").alias("y")).agg(F.max_by("lab", "seq").alias("lab"))
