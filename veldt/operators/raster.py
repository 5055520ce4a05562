"""Rasters and region graphs: neighbours, components, adjacency, crack planes, boundary measures.

A raster is grid(image, x, y, lab). Windows run along rows or columns of one image, so work spreads over images
and lines; no window spans the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def row():
    return Window.partitionBy("image", "y").orderBy("x")


def column():
    return Window.partitionBy("image", "x").orderBy("y")


def neighbours(grid: DataFrame, value: str = "lab", default: int = 0) -> DataFrame:
    """Adds left, up, up_left (0 outside the raster)."""
    out = grid.withColumn("left", F.lag(value, 1, default).over(row())).withColumn("up", F.lag(value, 1, default).over(column()))
    return out.withColumn("up_left", F.lag("up", 1, default).over(row()))


def cracks(grid: DataFrame) -> DataFrame:
    """Bits of the boundary to the right (v) and below (h)."""
    right, below = F.lead("lab").over(row()), F.lead("lab").over(column())
    return grid.withColumn("v", F.coalesce((right != F.col("lab")).cast("int"), F.lit(0))).withColumn("h", F.coalesce((below != F.col("lab")).cast("int"), F.lit(0)))


def crack_length(grid: DataFrame) -> DataFrame:
    return cracks(grid).groupBy("image").agg(F.sum(F.col("v") + F.col("h")).alias("length"))


def adjacency(grid: DataFrame) -> DataFrame:
    """rag(image, a, b, len): shared boundary of every two touching regions, both ways."""
    sides = grid.select("image", F.col("lab").alias("a"), F.lead("lab").over(row()).alias("_r"), F.lead("lab").over(column()).alias("_d"))
    pairs = sides.select("image", "a", F.explode(F.array("_r", "_d")).alias("b"))
    pairs = pairs.filter(F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = pairs.union(pairs.select("image", F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("image", "a", "b").agg(F.count("*").alias("len"))


def best_earlier(rag: DataFrame) -> DataFrame:
    """The earlier neighbour with the longest shared boundary, lowest id on ties."""
    return rag.filter("b < a").groupBy("image", "a").agg(F.min(F.struct((-F.col("len")).alias("l"), F.col("b").alias("b"))).alias("_m")).select("image", "a", F.col("_m.b").alias("b"))


def _stars(edges: DataFrame, rounds: int) -> DataFrame:
    """edges(image, a, b), a > b: image, node, root, the smallest node reachable, of every node that has an edge but the
    roots. Alternating large and small stars: rounds grow with the logarithm of a region's height, not with its height."""
    now, before = edges.checkpoint(), None
    for _ in range(rounds):
        both = now.union(now.select("image", F.col("b"), F.col("a"))).toDF("image", "a", "b")
        least = both.groupBy("image", "a").agg(F.min("b").alias("m")).select("image", "a", F.least("a", "m").alias("m"))
        large = both.join(least, ["image", "a"]).filter("b > a").select("image", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("image", "a").agg(F.min("b").alias("m"))
        small = large.join(least, ["image", "a"]).filter("b > m").select("image", F.col("b").alias("a"), F.col("m").alias("b"))
        now = small.union(least.select("image", "a", F.col("m").alias("b"))).distinct().checkpoint()
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("image", "a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select("image", F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
    raise RuntimeError(f"components have not settled in {rounds} rounds")


def components(grid: DataFrame, rounds: int = 60) -> DataFrame:
    """4-connected components of equal lab; ids in raster order of first appearance.

    Runs of equal labels within a row are nodes; touching runs of neighbouring rows are edges; stars join what
    touches under the smallest position until nothing changes, and raise if that takes more than `rounds`.
    """
    new = F.when((F.col("lab") == F.lag("lab").over(row())) & (F.col("x") == F.lag("x").over(row()) + 1), 0).otherwise(1)
    runs = grid.withColumn("_run", F.sum(new).over(row()))
    width = Window.partitionBy("image")
    pos = F.col("y") * (F.max("x").over(width) + 1) + F.col("x")
    cells = runs.withColumn("_pos", pos.cast("long")).withColumn("_node", F.min(pos.cast("long")).over(Window.partitionBy("image", "y", "_run")))
    cells = cells.select("image", "x", "y", "lab", F.col("_node").alias("node")).checkpoint()
    up = cells.withColumn("_up", F.lag("node").over(column())).withColumn("_lab", F.lag("lab").over(column())).withColumn("_y", F.lag("y").over(column()))
    edges = up.filter((F.col("_lab") == F.col("lab")) & (F.col("_y") == F.col("y") - 1)).select("image", F.col("node").alias("a"), F.col("_up").alias("b")).distinct()
    found = _stars(edges, rounds)
    nodes = cells.select("image", "node").distinct()
    labels = nodes.join(found, ["image", "node"], "left").withColumn("root", F.coalesce("root", "node")).checkpoint()
    ids = labels.select("image", "root").distinct().withColumn("component", F.row_number().over(Window.partitionBy("image").orderBy("root")) - 1)
    return cells.join(labels, ["image", "node"]).join(ids, ["image", "root"]).select("image", "x", "y", "lab", "component")


def areas(grid: DataFrame) -> DataFrame:
    return grid.groupBy("image", "lab").agg(F.count("*").alias("area"))


def perimeters(grid: DataFrame) -> DataFrame:
    return adjacency(grid).groupBy("image", F.col("a").alias("lab")).agg(F.sum("len").alias("perimeter"))


def coverage(sizes: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Share of the area that the k largest regions cover, for each k."""
    order = Window.partitionBy("image").orderBy(F.desc("area"), "lab").rowsBetween(Window.unboundedPreceding, 0)
    run = sizes.withColumn("_c", F.sum("area").over(order)).withColumn("_k", F.row_number().over(Window.partitionBy("image").orderBy(F.desc("area"), "lab")))
    return run.groupBy("image").agg(*[(F.max(F.when(F.col("_k") <= k, F.col("_c"))) / F.sum("area")).alias(f"top{k}") for k in ks])


def tail_exponent(sizes: DataFrame, xmin: int) -> DataFrame:
    return sizes.filter(F.col("area") >= xmin).groupBy("image").agg((1 + F.count("*") / F.sum(F.log(F.col("area") / xmin))).alias("alpha"))


def block_means(grid: DataFrame, f: int, value: str) -> DataFrame:
    return grid.groupBy("image", F.expr(f"x div {f}").alias("bx"), F.expr(f"y div {f}").alias("by")).agg(F.avg(value).alias("mean"))
