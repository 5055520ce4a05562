"""What the two vector searches share: valid vectors, classes of equal vectors, regions, indexed shards, merging.

Equal vectors form a class. A search needs at most k + 1 ids of a class (one may be the query itself), the
smallest ones, because ties go to the smaller id. A group limit keeps those before any shuffle, so a vector that
a third of all rows share never meets in one task.

Classes are dealt to regions: at most REGIONS centres for each vector length, by k-means on a sample of at most
8 vectors for each, and every class goes to its nearest one. A region is a ball (centre, radius); one with more than
SHARD classes has several shards. A shard's index is built once and written as flat arrays. Queries first meet the
shards of their own region, which gives a kth score to beat; then a query goes to another region only if that ball can
hold a score as high (q.c + |q| r). Results are merged by rank. What is sent to all tasks is centres and radii, at most
REGIONS for each of the lengths in the sample; a length that the sample lacks has one region.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import parts, written

#: Distinct vectors in a shard, queries in a block, regions for each vector length.
SHARD, BLOCK, REGIONS = 4096, 512, 512


def valid(vector: Column, zero: bool) -> Column:
    """Not null, no null or non-finite component; with zero, not all zeros either."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = vector.isNotNull() & finite & (F.size(vector) > 0)
    return F.coalesce(ok & F.exists(vector, lambda x: x != 0) if zero else ok, F.lit(False))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """rows(vec_id, v array<double>): one row for each distinct vector with its `keep` smallest ids."""
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of `dim` doubles from an Arrow array of lists or doubles."""
    flat = column.flatten() if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else column
    return np.ascontiguousarray(flat.to_numpy(zero_copy_only=False).reshape(-1, dim), np.float64)


def scaled(v: np.ndarray, unit: bool) -> np.ndarray:
    """The vectors as regions see them; of unit length if only the direction counts."""
    if not unit:
        return v
    most = np.abs(v).max(1, keepdims=True)
    v = v / most
    return v / np.sqrt(np.einsum("nd,nd->n", v, v))[:, None]


def centres_of(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k centres by farthest points, then k-means steps; a centre that no vector is nearest to stays."""
    chosen = [0]
    nearest = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    centres = sample[chosen]
    for _ in range(rounds):
        own = nearest_of(sample, centres)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


@dataclass
class Index:
    """shards: one row each (dim, region, shard and INDEX); balls by vector length: centres and radii."""

    shards: DataFrame
    balls: dict[int, tuple[np.ndarray, np.ndarray]]
    unit: bool


INDEX = "shard int, region int, dim int, vectors array<double>, ids array<array<bigint>>, links array<int>, numbers array<double>"


def _by_dim(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """Length, row numbers and vectors of the rows of each vector length."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, batch.column(column).take(pa.array(at))


def assign(rows: DataFrame, column: str, centres: dict[int, np.ndarray], unit: bool) -> DataFrame:
    """Adds region and distance to its centre to rows(dim, <column>)."""
    names = rows.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", region int, distance double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region, distance = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            for dim, at, vectors in _by_dim(batch, column):
                x = scaled(matrix(vectors, dim), unit)
                own = centres.get(dim, np.zeros((1, dim)))
                region[at] = nearest_of(x, own)
                distance[at] = np.sqrt(((x - own[region[at]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region), pa.array(distance)], [*names, "region", "distance"])

    return rows.mapInArrow(run, schema)


def indexed(rows: DataFrame, keep: int, build: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], unit: bool = False, shard: int = SHARD) -> Index:
    """The index of rows(vec_id, v): distinct vectors, their ids and what build(vectors) gives, for each shard."""
    found = written(classes(rows, keep).withColumn("dim", F.size("v")), "classes")
    n = found.count()
    regions = min(REGIONS, max(1, -(-n // shard)))
    sample: dict[int, list] = {}
    for r in found.orderBy(F.xxhash64("v"), "v").limit(8 * regions).select("dim", "v").collect():
        sample.setdefault(r.dim, []).append(r.v)
    centres = {dim: centres_of(scaled(np.array(v, float), unit), regions) for dim, v in sample.items()}
    dealt = written(assign(found, "v", centres, unit), "dealt")
    sizes = dealt.groupBy("dim", "region").agg(F.count("*").alias("n"), F.max("distance").alias("radius"))
    # a row for each region: at most REGIONS for each length in the sample, one for every other
    balls = {dim: (c, np.full(len(c), -np.inf)) for dim, c in centres.items()}
    for r in sizes.collect():
        balls.setdefault(r.dim, (np.zeros((1, r.dim)), np.full(1, -np.inf)))[1][r.region] = r.radius
    part = F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / shard).cast("int")).cast("int")
    rows = dealt.join(F.broadcast(sizes.drop("radius")), ["dim", "region"]).withColumn("shard", part)
    grouped = rows.groupBy("shard", "region", "dim").agg(F.sort_array(F.collect_list(F.struct("ids", "v"))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                members, dim = batch.column("m")[i].values, batch.column("dim")[i].as_py()
                v = matrix(members.field("v"), dim)
                links, numbers = build(v)
                columns = [batch.column(c)[i : i + 1] for c in ("shard", "region", "dim")]
                columns += [pa.array([x], t) for x, t in ((v.ravel(), pa.list_(pa.float64())), (members.field("ids").to_pylist(), pa.list_(pa.list_(pa.int64()))), (links.astype(np.int32), pa.list_(pa.int32())), (numbers.astype(float), pa.list_(pa.float64())))]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in INDEX.split(", ")])

    return Index(written(grouped.mapInArrow(run, INDEX), "index"), balls, unit)


def _met(asked: DataFrame, index: Index, find: Callable, k: int, score: str, block: int) -> DataFrame:
    """asked(query_id, q, dim, region, least): every query in every shard of the region; its best k there."""
    spark = asked.sparkSession
    counts = asked.groupBy("dim", "region").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = asked.join(counts, ["dim", "region"]).withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks"))
    rows = rows.groupBy("dim", "region", "block").agg(F.collect_list(F.struct("query_id", "q", "least")).alias("queries"))
    pairs = rows.join(index.shards, ["dim", "region"]).repartition(parts(spark), "dim", "region", "shard", "block")
    kind = pa.float64() if score == "double" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                dim = batch.column("dim")[i].as_py()
                own_ = batch.column("queries")[i].values
                q, v = matrix(own_.field("q"), dim), matrix(batch.column("vectors")[i].values, dim)
                ids, links, numbers = batch.column("ids")[i].as_py(), batch.column("links")[i].values.to_numpy(), batch.column("numbers")[i].values.to_numpy()
                out: tuple[list, list, list] = ([], [], [])
                found = find(q, v, ids, links, numbers, own_.field("least").to_numpy())
                for own, (near, scores) in zip(own_.field("query_id").to_pylist(), found, strict=True):
                    # a class is worth at most k rows besides the query itself
                    got = [(-s, x) for c, s in zip(near.tolist(), scores.tolist(), strict=True) for x in ids[c] if x != own]
                    for s, x in sorted(got)[:k]:
                        out[0].append(own)
                        out[1].append(x)
                        out[2].append(-s)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], kind)], ["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, f"query_id long, vec_id long, score {score}")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def others(rows: DataFrame, index: Index) -> DataFrame:
    """rows(query_id, q, dim, region, least): a row for each further region whose ball can hold a score of least."""
    balls, unit = index.balls, index.unit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, vectors in _by_dim(batch, "q"):
                part = batch.take(pa.array(at))
                x = scaled(matrix(vectors, dim), unit)
                centres, radii = balls.get(dim, (np.zeros((0, dim)), np.zeros(0)))
                length, least = np.sqrt((x**2).sum(1)), part.column("least").to_numpy()
                slack = 1e-9 * (1 + length[:, None] * (np.sqrt((centres**2).sum(1)) + np.maximum(radii, 0))[None, :])
                bound = x @ centres.T + length[:, None] * radii[None, :] + slack
                ok = (bound >= (least - 1e-9 * np.abs(np.where(np.isinf(least), 0, least)))[:, None]) & (radii > -np.inf)[None, :]
                ok[np.arange(len(x)), part.column("region").to_numpy()] = False
                who, where = np.nonzero(ok)
                for lo in range(0, len(who), 4096):
                    some = part.take(pa.array(who[lo : lo + 4096]))
                    yield pa.RecordBatch.from_arrays([some.column("query_id"), some.column("q"), some.column("dim"), pa.array(where[lo : lo + 4096].astype(np.int32)), some.column("least")], ["query_id", "q", "dim", "region", "least"])

    return rows.select("query_id", "q", "dim", "region", "least").mapInArrow(run, "query_id long, q array<double>, dim int, region int, least double")


def search(queries: DataFrame, index: Index, find: Callable, k: int, score: str, block: int = BLOCK) -> DataFrame:
    """queries(query_id, q). find(Q, V, ids, links, numbers, least) gives for each query (class numbers, scores), best
    first, at least k + 1 where there are as many that reach least. Returns query_id, rank, vec_id, score."""
    queries = queries.dropDuplicates(["query_id", "q"])
    at = assign(queries.withColumn("dim", F.size("q")), "q", {dim: c for dim, (c, _) in index.balls.items()}, index.unit)
    at = written(at.drop("distance").withColumn("least", F.lit(float("-inf"))), "queries")
    home = written(_ranked(_met(at, index, find, k, score, block), k), "home")
    least = home.filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("kth"))
    far = others(at.join(least, "query_id", "left").withColumn("least", F.coalesce("kth", "least")), index)
    found = home.select("query_id", "vec_id", "score").union(_met(written(far, "others"), index, find, k, score, block))
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
