"""Operator 10: mixing sources to target weights as a min-cost flow over membership patterns.

Documents are aggregated by the set of sources that they belong to (their pattern). Words flow from patterns to
the sources' quotas; each further use of a pattern's words costs one more than the use before, so the cost is
convex and no words repeat while unused ones could serve. The flow has one node for each pattern and source,
never one for each document. Every pattern goes through the network, single sources as well.

Within a pattern, documents are taken whole, in the order of a seeded hash, until the flow is used up; then the
document whose size is nearest to what is still missing closes the gap. Running sums work on slices of the
hash range: totals of slices first, then rows within a slice, so no pattern meets in one task however many rows
it holds.

Sizes are words, `[^\\x20\\x09-\\x0D]+`. A null or empty text has size 0: it belongs to the mix as long as its
pattern does, and counts nothing. A null source is a source of its own, last in order. Repeated rows count each.
Other columns are not looked at. An empty table gives no rows. More than `max_patterns` patterns raise an error rather than overfill the driver.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import nested, table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
SEED = "mix-1"
SLICES = 4096
MAX_PATTERNS = 100_000


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of total by weight, none above cap times its size; what is cut off is shared again by weight."""
    out, active, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while active:
        weight = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in active:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        active = [i for i in active if i not in set(over)]
    return out


class Flow:
    """Maximum flow by blocking flows in level graphs. Arcs may be added between runs; flow so far stays."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.at: list[list[int]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, capacity: int) -> int:
        for x, y, room in ((a, b, capacity), (b, a, 0)):
            self.at[x].append(len(self.to))
            self.to.append(y)
            self.room.append(room)
        return len(self.to) - 2

    def sent(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def _levels(self, source: int, sink: int) -> list[int] | None:
        level, queue = [-1] * len(self.at), deque([source])
        level[source] = 0
        while queue:
            x = queue.popleft()
            for e in self.at[x]:
                y = self.to[e]
                if self.room[e] > 0 and level[y] < 0:
                    level[y] = level[x] + 1
                    queue.append(y)
        return level if level[sink] >= 0 else None

    def run(self, source: int, sink: int) -> None:
        while level := self._levels(source, sink):
            untried = [iter(arcs) for arcs in self.at]
            path, x = [], source
            while True:
                if x == sink:
                    push = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= push
                        self.room[e ^ 1] += push
                    # go on from the start of the first arc that is full now
                    full = next(i for i, e in enumerate(path) if not self.room[e])
                    x = self.to[path[full] ^ 1]
                    del path[full:]
                    continue
                e = next((e for e in untried[x] if self.room[e] > 0 and level[self.to[e]] == level[x] + 1), None)
                if e is not None:
                    path.append(e)
                    x = self.to[e]
                elif path:
                    x = self.to[path.pop() ^ 1]
                else:
                    break


def route(patterns: list[tuple[tuple, int]], quotas: dict, repeats: int = REPEATS) -> list[dict]:
    """patterns: (sources, words). Gives for each pattern the words that go to each source, by a min-cost flow.

    The r-th use of a pattern's words costs r, and only the arcs into patterns cost anything, so a path costs what its
    first arc does. Shortest paths first therefore means: all flow that first uses allow, then what second uses add to
    it (earlier flow may be led another way), and so on. That is a maximum flow of least cost.
    """
    sources = sorted({s for own, _ in patterns for s in own}, key=lambda s: (s is None, s or ""))
    place = {s: 2 + len(patterns) + k for k, s in enumerate(sources)}
    flow = Flow(2 + len(patterns) + len(sources))
    for s in sources:
        flow.add(place[s], 1, quotas.get(s, 0))
    arcs = [{s: flow.add(2 + i, place[s], repeats * words) for s in own} for i, (own, words) in enumerate(patterns)]
    for _ in range(repeats):
        for i, (_, words) in enumerate(patterns):
            flow.add(0, 2 + i, words)
        flow.run(0, 1)
    return [{s: flow.sent(e) for s, e in own.items() if flow.sent(e)} for own in arcs]


def plan(docs: DataFrame, share: float = SHARE, weights=WEIGHTS, repeats: int = REPEATS, max_patterns: int = MAX_PATTERNS) -> tuple[list[dict], list[dict]]:
    """docs(pattern array, size). Gives sources with size and target, and patterns with size and flow."""
    rows = docs.groupBy("pattern").agg(F.sum("size").alias("words")).limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    sizes: dict = defaultdict(int)
    for r in rows:
        for s in r.pattern:
            sizes[s] += r.words
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    total = sum(r.words for r in rows)
    targets = water_fill([sizes[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], share * total, repeats)
    quotas = {s: round(t) for s, t in zip(names, targets, strict=True)}
    flows = route([(tuple(r.pattern), r.words) for r in rows], quotas, repeats)
    return (
        [{"source": s, "source_size": sizes[s], "target": t} for s, t in zip(names, targets, strict=True)],
        [{"pattern": list(r.pattern), "words": r.words, "flow": sum(f.values())} for r, f in zip(rows, flows, strict=True)],
    )


def select(docs: DataFrame, flows: list[dict], seed: str = SEED) -> DataFrame:
    """Adds copies: how often the mix takes a document of docs(doc_id, pattern, size, ...).

    Tables of one row for each pattern are broadcast: `plan` has bounded their number by max_patterns.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    table_ = [(p["pattern"], p["flow"] // p["words"] if p["words"] else int(p["flow"] > 0), p["flow"] % p["words"] if p["words"] else 0) for p in flows]
    goals = spark.createDataFrame(table_ or [([], 0, 0)], "pattern array<string>, base long, extra long")
    rows = docs.withColumn("_key", key).withColumn("_slice", F.shiftrightunsigned("_key", 52).cast("int"))
    rows = rows.join(F.broadcast(goals), "pattern")
    slices = rows.groupBy("pattern", "_slice").agg(F.sum("size").alias("_words"))
    upto = Window.partitionBy("pattern").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("pattern", "_slice", F.coalesce(F.sum("_words").over(upto), F.lit(0)).alias("_before"))
    within = Window.partitionBy("pattern", "_slice").orderBy("_key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(slices, ["pattern", "_slice"]).withColumn("_upto", F.col("_before") + F.sum("size").over(within))
    rows = rows.withColumn("_in", F.col("_upto") <= F.col("extra"))
    gaps = rows.groupBy("pattern").agg((F.first("extra") - F.coalesce(F.sum(F.when(F.col("_in"), F.col("size"))), F.lit(0))).alias("_gap"))
    misfit = F.abs(F.col("size") - F.col("_gap"))
    rest = rows.filter(~F.col("_in")).join(F.broadcast(gaps), "pattern").filter(misfit < F.col("_gap"))
    last = rest.groupBy("pattern").agg(F.min(F.struct(misfit.alias("m"), "_key", "_upto", "doc_id")).alias("_last"))
    rows = rows.join(F.broadcast(last), "pattern", "left")
    closes = F.coalesce(~F.col("_in") & (F.col("_upto") == F.col("_last._upto")) & F.col("doc_id").eqNullSafe(F.col("_last.doc_id")) & (F.col("_key") == F.col("_last._key")), F.lit(False))
    copies = F.col("base") + F.when(F.col("_in") | closes, 1).otherwise(0)
    return rows.withColumn("copies", copies).drop("_key", "_slice", "base", "extra", "_before", "_upto", "_in", "_last")


def members(docs: DataFrame, sources: str | Column = "source") -> DataFrame:
    """Adds pattern and size to docs(doc_id, text, source)."""
    return docs.withColumn("pattern", F.array(sources)).withColumn("size", size_of(F.col("text")))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = members(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "source", "pattern", "size")
    docs = written(docs, "sizes")
    sources, flows = plan(docs)
    goals = spark.createDataFrame([(s["source"], s["source_size"], s["target"]) for s in sources], "goal_source string, source_size long, target double")
    mixed = select(docs, flows).join(F.broadcast(goals), F.col("source").eqNullSafe(F.col("goal_source")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it. Columns of any name pass through; null sources and
    texts as above; an empty table stays empty."""
    rows = nested(docs).select("row", "row.doc_id", F.array("row.source").alias("pattern"), size_of(F.col("row.text")).alias("size"))
    rows = written(rows, "sizes")
    _, flows = plan(rows.select("pattern", "size"))
    chosen = select(rows, flows).filter("copies > 0")
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
