"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written_at


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    # every edge has a > b here
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """node, component: the smallest node reachable, for every node that has an edge."""
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    (now, path), before = written_at(now, "edges"), None
    for _ in range(rounds):
        now, after = written_at(_small(_large(now).filter("a <> b").distinct()).filter("a <> b").distinct(), "edges")
        discard(now.sparkSession, path)
        path = after
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
