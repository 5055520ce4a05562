"""Geometry of label rasters: vertices of the boundary graph, quadtrees, seeds by jump flooding, sizes of run and
rectangle codes, and the order of coded cells. Everything is joins and groups on (image, x, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import entropy, raster


def crack_vertices(grid: DataFrame) -> DataFrame:
    """Corners of cells that a boundary touches: degree (1 to 4) and whether they lie on the image's frame."""
    size = Window.partitionBy("image")
    rows = raster.cracks(grid).withColumn("_w", F.max("x").over(size) + 1).withColumn("_h", F.max("y").over(size) + 1)
    at = lambda x, y: F.struct(x.cast("int").alias("vx"), y.cast("int").alias("vy"))
    x, y = F.col("x"), F.col("y")
    ends = F.concat(
        F.when(F.col("v") == 1, F.array(at(x + 1, y), at(x + 1, y + 1))).otherwise(F.array()),
        F.when(F.col("h") == 1, F.array(at(x, y + 1), at(x + 1, y + 1))).otherwise(F.array()),
    )
    met = rows.select("image", "_w", "_h", F.explode(ends).alias("e")).groupBy("image", "_w", "_h", "e.vx", "e.vy").agg(F.count("*").cast("int").alias("degree"))
    frame = (F.col("vx") == 0) | (F.col("vy") == 0) | (F.col("vx") == F.col("_w")) | (F.col("vy") == F.col("_h"))
    return met.select("image", "vx", "vy", "degree", frame.alias("frame"))


def quadtree(grid: DataFrame, value: str, width: int, height: int) -> DataFrame:
    """Nodes, leaves and bytes of a quadtree whose odd sides give their first half the extra cell: a bit for each node and
    eight more for each leaf. Where a cell's nodes lie depends on the image's size only, so one grouping of all levels
    finds those with two values; they are all inner nodes, and their children follow from their sides."""
    depth = max(width - 1, height - 1, 0).bit_length()
    rows, start, nodes = grid, (F.lit(0), F.lit(0), F.lit(width), F.lit(height)), []
    for k in range(depth):
        names = [f"_{n}{k}" for n in "ltwh"]
        rows = rows.withColumns(dict(zip(names, start, strict=True)))
        left, top, w, h = map(F.col, names)
        nodes.append(F.struct(F.lit(k).alias("level"), left.alias("l"), top.alias("t"), w.alias("w"), h.alias("h")))
        mx, my = F.expr(f"cast((_w{k} + 1) div 2 as int)"), F.expr(f"cast((_h{k} + 1) div 2 as int)")
        right, low = F.col("x") >= left + mx, F.col("y") >= top + my
        start = (F.when(right, left + mx).otherwise(left), F.when(low, top + my).otherwise(top), F.when(right, w - mx).otherwise(mx), F.when(low, h - my).otherwise(my))
    found = rows.select("image", F.col(value).alias("_v"), F.explode(F.array(*nodes)).alias("n")).groupBy("image", "n").agg((F.min("_v") < F.max("_v")).alias("mixed"))
    children = F.when(F.col("n.w") > 1, 2).otherwise(1) * F.when(F.col("n.h") > 1, 2).otherwise(1)
    total = found.groupBy("image").agg((1 + F.sum(F.when(F.col("mixed"), children).otherwise(0))).alias("nodes"), F.count_if("mixed").alias("inner"))
    total = total.select("image", "nodes", (F.col("nodes") - F.col("inner")).alias("leaves"))
    return total.withColumn("bytes", F.ceil((F.col("nodes") + 8 * F.col("leaves")) / 8).cast("long"))


def jump_flood(cells: DataFrame, width: int, height: int) -> DataFrame:
    """cells(image, x, y, seed or null) -> site, the number in raster order of the seed that flooding brings to each
    cell. Each round reads the cells a step up, down, left and right and those diagonal to them; the step halves. On
    equal distances the cell's own site stays, then the first tap in raster order wins. Approximate, as defined."""
    number = (F.row_number().over(Window.partitionBy("image").orderBy("y", "x")) - 1).cast("long")
    seeds = cells.filter(F.col("seed").isNotNull()).select("image", "x", "y", number.alias("site"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    now = cells.select("image", "x", "y").join(seeds, ["image", "x", "y"], "left")
    step = 1
    while step < max(width, height):
        step *= 2
    while step >= 1:
        taps = [(dx, dy) for dy in (-step, 0, step) for dx in (-step, 0, step)]
        # The own site is place 0, the taps follow in raster order; min of (distance, place) is the first best.
        offers = F.array(*[F.struct(F.lit(0 if (dx, dy) == (0, 0) else i + 1).alias("place"), (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y")) for i, (dx, dy) in enumerate(taps)])
        sent = now.filter("site is not null").select("image", "site", "sx", "sy", F.explode(offers).alias("o")).select("image", "site", "sx", "sy", "o.*")
        sent = sent.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
        far = (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy"))
        best = sent.groupBy("image", "x", "y").agg(F.min(F.struct(far.alias("far"), "place", "site", "sx", "sy")).alias("b"))
        now = cells.select("image", "x", "y").join(best.select("image", "x", "y", "b.site", "b.sx", "b.sy"), ["image", "x", "y"], "left")
        step //= 2
    return now


def runs_by_row(grid: DataFrame, value: str) -> DataFrame:
    """Runs of equal values in each row: image, y, run, x, length, value."""
    new = F.when(F.col(value) == F.lag(value).over(raster.row()), 0).otherwise(1)
    rows = grid.withColumn("_run", F.sum(new).over(raster.row()))
    return rows.groupBy("image", "y", F.col("_run").alias("run")).agg(F.min("x").alias("x"), F.count("*").alias("length"), F.first(value).alias("value"))


def run_code_bytes(runs: DataFrame) -> DataFrame:
    """Size of rows as runs: a varint for each length and a byte for each value."""
    return runs.groupBy("image").agg(F.sum(entropy.varint_bytes(F.col("length")) + 1).cast("long").alias("bytes"))


def rectangle_code_bytes(rects: DataFrame, fields: list[str], entry: str, width: int, height: int) -> DataFrame:
    """Size of a list of rectangles: varints of the image's sides, of both counts and of all fields, and three bytes
    for each palette entry."""
    varint = entropy.varint_bytes
    per = rects.groupBy("image").agg(F.count("*").alias("rects"), F.countDistinct(entry).alias("entries"), F.sum(sum((varint(F.col(f)) for f in fields), F.lit(0))).alias("_f"))
    head = varint(F.lit(width)) + varint(F.lit(height)) + varint(F.col("entries")) + varint(F.col("rects"))
    return per.select("image", "rects", "entries", (head + 3 * F.col("entries") + F.col("_f")).cast("long").alias("bytes"))


def sidecar(grid: DataFrame) -> DataFrame:
    """A label plane as 16 bits, as differences along its rows modulo 2^16, and as two boundary bits (right, below)."""
    delta = F.col("lab") - F.lag("lab", 1, 0).over(raster.row())
    return raster.cracks(grid).select("image", "x", "y", (F.col("lab") % 65536).alias("plane"), F.pmod(delta, F.lit(65536)).alias("delta"), (F.col("v") + 2 * F.col("h")).alias("edge"))


def is_causal(mode: str, own: str, plane: Column, dx: Column, dy: Column) -> Column:
    """Does the schedule code the cell at (dx, dy) of plane 0 (v) or 1 (h) before the own plane's cell at (0, 0)?"""
    here = entropy.schedule_key(mode, F.lit("vh".index(own)), F.lit(0), F.lit(0))
    return entropy.schedule_key(mode, plane, dx, dy) < here
