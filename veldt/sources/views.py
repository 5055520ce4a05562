"""Role views: the engine's inputs derived from the star-schema tables, and text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in 0..255: quantity, discount and tax of line items, scaled from whole hundredths."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_returnflag").alias("image"),
        "l_orderkey",
        "l_linenumber",
        F.expr("cast(cast(round(l_quantity) as int) * 255 div 50 as int)").alias("r"),
        F.expr("cast(cast(round(l_discount * 100) as int) * 255 div 10 as int)").alias("g"),
        F.expr("cast(cast(round(l_tax * 100) as int) * 255 div 8 as int)").alias("b"),
    )


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grid(image, x, y, lab): hour, day and the most frequent event type (ties: first by name) as 0..4."""
    kinds = "click error purchase signup view".split()
    rows = table(spark, sf_dir, "events").select(F.dayofmonth("ts").alias("y"), F.hour("ts").alias("x"), "event_type")
    counts = rows.groupBy("x", "y", "event_type").agg(F.count("*").alias("n"))
    top = counts.groupBy("x", "y").agg(F.min(F.struct((-F.col("n")).alias("n"), "event_type")).alias("m"))
    return top.select(F.lit(0).alias("image"), "x", "y", (F.array_position(F.array(*map(F.lit, kinds)), F.col("m.event_type")) - 1).cast("int").alias("lab"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream(user, seq, sym): event types of each user in time order."""
    kinds = "click error purchase signup view".split()
    rows = table(spark, sf_dir, "events")
    sym = (F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type")) - 1).cast("int")
    return rows.select((F.col("user_id") % 16).alias("chain"), "ts", "event_id", sym.alias("sym"))


def keyed_json(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """Rows of a JSON object keyed by item: item and the fields of its value."""
    text = spark.read.text(path, wholetext=True)
    items = text.select(F.explode(F.from_json("value", f"map<string, struct<{value_schema}>>")).alias("item", "v"))
    return items.select("item", "v.*")


def fields(spark: SparkSession, path: str, names: list[str], sep: str = r"\s+") -> DataFrame:
    """Rows of a text table with exactly len(names) fields; other lines are left out."""
    f = F.split(F.trim("value"), sep)
    rows = spark.read.text(path).select(f.alias("f")).filter(F.size("f") == len(names))
    return rows.select(*[F.col("f")[i].alias(n) for i, n in enumerate(names)])


def matched(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Groups of a pattern on each line that it matches."""
    rows = spark.read.text(path).filter(F.col("value").rlike(pattern))
    return rows.select(*[F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(names)])


def tab_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a tab-separated file without a header; a row that does not fit the schema stops the read."""
    return spark.read.csv(path, sep="\t", schema=schema, mode="FAILFAST")


def complete(rows: DataFrame, keys: DataFrame, parts: list[str], part: str) -> DataFrame:
    """rows, once every key has a row for each of `parts`; otherwise ValueError names some that lack one. Keys are a
    table of steps or windows, and parts a short list."""
    wanted = keys.select("*", F.explode(F.array(*map(F.lit, parts))).alias(part))
    lacking = wanted.join(rows, [*keys.columns, part], "left_anti").limit(5).collect()
    if lacking:
        raise ValueError(f"rows are missing: {[tuple(r) for r in lacking]}")
    return rows


def lossless_and_lossy(rows: DataFrame, psnr: str = "psnr", bound: float = 99.0) -> tuple[DataFrame, DataFrame]:
    return rows.filter(F.col(psnr) >= bound), rows.filter(F.col(psnr) < bound)


def run_times(spark: SparkSession, path: str) -> DataFrame:
    """run, seconds: the times of the first result in a timing tool's JSON report."""
    report = spark.read.schema("results array<struct<times: array<double>>>").json(path, multiLine=True)
    return report.select(F.posexplode(F.expr("results[0].times")).alias("run", "seconds"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
