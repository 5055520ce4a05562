"""Operator 4: n-gram Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows.

1 - Jaccard is a metric on sets, and two documents link when it is at most eps = 1 - t. For sets without a common
shingle it is 1 whatever the sets, so a document only has to meet pivots that it can be near to at all. Which these
are, prefixes say: shingles have one global order, rare ones first, and the first |x| - ceil(t |x|) + spare(|x|)
shingles of two linked documents have spare(t |x|) of them in common (or all that the documents share, if those are
fewer). The pivot of a shingle is the document with the smallest digest among those that have it in their prefix; a
document lies in the regions of its shingles' pivots. Linked documents thus share pivots, and rows grow with the
prefixes, not with pairs. Most regions of a document are owed to one or two shingles met by chance. A document leaves
those it owes to the fewest, as long as it gives up fewer than half of spare(t |x|) shingles in all: at least one
common shingle remains that neither end of a link gave up. (The order comes from a sketch of fixed size that counts
shingles by hash; any order is exact, this one keeps frequent passages from making regions.)

Each region is joined recursively: documents are taken as pivots, each other document goes to the cell of its nearest
pivot and to every cell whose pivot is no more than 2 eps further away, which by the triangle inequality brings both
ends of each link together. Documents that are at least t from all pivots form a cell of their own and enter a pivot's
cell only if they share a shingle with it. Cells are cut until they are small or pivots no longer thin them out, and
are then compared in full. Regions of up to LEAF units (a document, or 32 KB of text) are one task's work. Larger ones
are cut in the same way by tasks over runs of their documents; a cell that pivots do not thin out (copies with many
random changes are all about as far from each other) is dealt into blocks, and every pair of blocks is a region:
exact, at the price of copies that grow with the cell.

A region returns a forest of its links and the number of links of each member. Each link counts in one region, the
smallest of those that hold both ends. Equal sets are one class from the start and are never compared. Links become
components by alternating stars. Defined results: null or blank texts have no shingles and link with nothing (each
such row is its own component); a row without doc_id has component null and takes no part; rows that repeat a doc_id
are compared each with its own text, and share the id; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import discard, nested, parts, release, table, written, written_at
from .shingles import mix, sets

LEAF, BLOCK = 256, 256
#: Bytes of text that count as one document in the size of a region.
UNIT = 32 << 10
PIVOTS = 12
DEPTH = 3
#: Cells of up to so many documents are compared in full.
SMALL = 24
#: spare(n) = COMMON + n // SHARE.
COMMON, SHARE = 9, 20
SKETCH = 1 << 20
_CHUNK = 1 << 14
_COLUMNS = 4096


def sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Levels of frequency (half powers of two over the median) by the top bits of a shingle's hash. Fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for _, hashes, _ in sets(batch.column(0), width):
                total += np.bincount((hashes >> np.uint64(44)).astype(np.int64), minlength=SKETCH)
        if total.any():
            chunks = [c.tobytes() for c in total.reshape(-1, _CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array(chunks, pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of a partition come one after the other; a sum for each chunk is all that is held
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(counts.as_py(), np.int64)
                total[chunk] = total[chunk] + own if chunk in total else own
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])

    counted = docs.select("text").mapInArrow(count, "chunk int, counts binary")
    rows = counted.repartition(SKETCH // _CHUNK, "chunk").mapInArrow(add, "chunk int, counts binary").collect()
    out = np.zeros(SKETCH, np.int64)
    for r in rows:
        out[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = np.frombuffer(r.counts, np.int64)
    middle = max(1.0, float(np.median(out)))
    return np.floor(2 * np.log2(np.maximum(out / middle, 1))).astype(np.uint8)


def _digest(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over mixed hashes for each set."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    with np.errstate(over="ignore"):
        for salt in (0x51ED270B, 0x2545F491):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(salt)), dtype=np.uint64)])
            out.append((total[upto[1:]] - total[upto[:-1]]).view(np.int64))
    return out[0], out[1]


def _needed(n: np.ndarray, t: int) -> np.ndarray:
    """Places of the order that a set of n shingles takes: n - ceil(t n / 100) + spare(n), at most all n."""
    return np.where(n > 0, np.minimum(n, n + (-t * n // 100) + COMMON + n // SHARE), 0)


SIGNATURE = "doc_id long, n long, d1 long, d2 long, chars long, first array<long>"


def signatures(docs: DataFrame, width: int, t: int, levels: np.ndarray) -> DataFrame:
    """Set size, digest and prefix of every document; of equal sets in a batch only one shows its prefix, of those
    with a doc_id (the others take no part)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, chars, seen = batch.column(0), batch.column(2), set()
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            for i, hashes, sizes in sets(batch.column(1), width):
                d1, d2 = _digest(hashes, sizes)
                need = _needed(sizes, t)
                for r, key in enumerate(zip(sizes.tolist(), d1.tolist(), d2.tolist(), strict=True)):
                    if key in seen or not known[i + r]:
                        need[r] = 0
                    else:
                        seen.add(key)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((hashes, levels[(hashes >> np.uint64(44)).astype(np.int64)], owner))
                rank = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                first = hashes[order][rank < need[owner]].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(need)]), pa.int32()), pa.array(first))
                upto = i + len(sizes)
                yield pa.RecordBatch.from_arrays([ids[i:upto], pa.array(sizes.astype(np.int64)), pa.array(d1), pa.array(d2), chars[i:upto], lists], ["doc_id", "n", "d1", "d2", "chars", "first"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return rows.mapInArrow(sign, SIGNATURE)


def pivots_of(known: DataFrame, t: int) -> DataFrame:
    """known(first, n, d1): x, p (digests): a document lies in the region of pivot p. Rows of a document's own region are
    left out, and regions that it owes to few shingles where that cannot hide a link."""
    least = F.ceil(F.col("n") * t / 100)
    shared = F.least(COMMON + F.floor(least / SHARE), least).cast("int")
    rows = known.select("d1", shared.alias("k"), F.explode("first").alias("shingle"))
    dealt = rows.repartition(parts(known.sparkSession), "shingle").sortWithinPartitions("shingle", "d1")

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot = None, None
        for batch in batches:
            d1, k, shingle = (c.to_numpy() for c in batch.columns)
            if not len(d1):
                continue
            new = np.ones(len(d1), bool)
            new[1:] = shingle[1:] != shingle[:-1]
            if last is not None and shingle[0] == last:
                new[0] = False
            start = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            leader = np.concatenate([d1[start], [pivot if pivot is not None else 0]])[run]
            other = d1 != leader
            # a class that shows its prefix in two batches counts each shingle twice: that keeps more, never less
            x, p, own = d1[other], leader[other], k[other]
            o = np.lexsort((p, x))
            x, p, own = x[o], p[o], own[o]
            first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (p[1:] != p[:-1])])) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[first]), pa.array(p[first]), pa.array(own[first]), pa.array(np.diff(np.append(first, len(x))))], ["x", "p", "k", "c"])
            last, pivot = shingle[-1], leader[-1]

    found = dealt.mapInArrow(lead, "x long, p long, k int, c long")
    counted = found.repartition(parts(known.sparkSession), "x").groupBy("x", "p").agg(F.max("k").alias("k"), F.sum("c").alias("c"))
    fewest = Window.partitionBy("x").orderBy("c", "p").rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("_given", F.sum("c").over(fewest)).filter(2 * F.col("_given") > F.col("k") - 1).select("x", "p")


class Sets:
    """Some documents' shingle sets; common(a, b) counts what documents a have in common with documents b."""

    def __init__(self, flat: list[np.ndarray]):
        self.size = np.array([len(x) for x in flat], np.int64)
        self.owner = np.repeat(np.arange(len(flat)), self.size)
        values = np.concatenate(flat) if flat else np.empty(0, np.uint64)
        _, self.place, count = np.unique(values, return_inverse=True, return_counts=True)
        keep = count[self.place] > 1
        self.owner, self.place = self.owner[keep], np.unique(self.place[keep], return_inverse=True)[1]
        order = np.argsort(self.place, kind="stable")
        self.owner, self.place = self.owner[order], self.place[order]
        self.width = int(self.place[-1]) + 1 if len(self.place) else 0

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Products of incidence matrices, _COLUMNS shingles at a time; counts are exact in single precision."""
        out = np.zeros((len(a), len(b)), np.float32)
        row = np.full((2, len(self.size)), -1)
        row[0, a], row[1, b] = np.arange(len(a)), np.arange(len(b))
        for lo in range(0, self.width, _COLUMNS):
            i, j = np.searchsorted(self.place, [lo, lo + _COLUMNS])
            sides = []
            for r, n in ((row[0], len(a)), (row[1], len(b))):
                m = np.zeros((n, min(_COLUMNS, self.width - lo)), np.float32)
                who = r[self.owner[i:j]]
                m[who[who >= 0], self.place[i:j][who >= 0] - lo] = 1
                sides.append(m)
            out += sides[0] @ sides[1].T
        return out.astype(np.int64)

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = self.common(a, b)
        return 1 - both / np.maximum(self.size[a][:, None] + self.size[b][None, :] - both, 1)


def cells(d: np.ndarray, t: int) -> list[list[int]]:
    """d: distances of documents to pivots. The cells of each document: its nearest pivot's, those within the window,
    or -1 (far from all)."""
    eps, home = 1 - t / 100, d.min(1)
    window = (d <= home[:, None] + 2 * eps + 1e-9) & (d < 1)
    far = home >= t / 100 - 1e-9
    return [([-1] if f else []) + np.flatnonzero(w).tolist() for f, w in zip(far, window, strict=True)]


def thinned(sizes: list[int], n: int) -> bool:
    """Whether cells of these sizes cut n documents well enough to go on with them."""
    return max(sizes) <= 0.7 * n and sum(sizes) <= 2.5 * n


def links(flat: list[np.ndarray], t: int, small: int = SMALL, pivots: int = PIVOTS) -> np.ndarray:
    """Which documents link (100 |common| >= t |union|), as a matrix; found by Voronoi cells within cells."""
    s, n = Sets(flat), len(flat)
    out, todo = np.zeros((n, n), bool), [np.arange(n)]
    while todo:
        rows = todo.pop()
        if len(rows) > small:
            # spread over the documents by size, which bounds the distance from below
            at = rows[np.argsort(s.size[rows], kind="stable")][np.linspace(0, len(rows) - 1, pivots).astype(int)]
            members: dict[int, list[int]] = {}
            for i, own in zip(rows.tolist(), cells(s.distances(rows, at), t), strict=True):
                for c in own:
                    members.setdefault(c, []).append(i)
            if thinned([len(m) for m in members.values()], len(rows)):
                todo += [np.array(m) for m in members.values() if len(m) > 1]
                continue
        both = s.common(rows, rows)
        ok = (both > 0) & (100 * both >= t * (s.size[rows][:, None] + s.size[rows][None, :] - both))
        out[np.ix_(rows, rows)] |= ok
    np.fill_diagonal(out, False)
    return out


def _own_sets(rows, width: int) -> list[np.ndarray]:
    """The set of each row's text, in order."""
    out = []
    for _, hashes, sizes in sets(rows, width):
        out += np.split(hashes, np.cumsum(sizes)[:-1])
    return out


#: own: the row's block, -1 without blocks; also: its regions on each level, as "17,-42/0,3/-1"; units: its size.
MEMBER = ["region", "node", "d1", "text", "own", "also", "units"]
_MEMBER = "region string, node long, d1 long, text string, own int, also string, units int"


def cut(rows: DataFrame, width: int, t: int, leaf: int, block: int, depth: int = DEPTH, pivots: int = PIVOTS) -> DataFrame:
    """rows of MEMBER: the same columns with regions of at most leaf units, or pairs of blocks."""
    done, todo, spent = None, rows, 0
    while True:
        sizes = written(todo.groupBy("region").agg(F.sum("units").alias("size")), "regions")
        small = todo.join(sizes.filter(F.col("size") <= leaf).select("region"), "region", "left_semi").select(*MEMBER)
        done = small if done is None else done.union(small)
        large = sizes.filter(F.col("size") > leaf)
        if large.isEmpty():
            return done
        todo = todo.join(large, "region")
        order = Window.partitionBy("region").orderBy(F.xxhash64("node", F.lit(spent)), "node")
        if spent < depth:
            picked = todo.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= pivots)
            tried = written(_assign(todo, picked.drop("_n"), width, t, block), "voronoi")
            after = tried.groupBy("parent", "region").agg(F.sum("units").alias("n"), F.first("size").alias("size"))
            after = after.groupBy("parent").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.first("size").alias("size"))
            good = written(after.filter((F.col("most") <= 0.7 * F.col("size")) & (F.col("all") <= 2.5 * F.col("size"))).select("parent"), "thinned")
            stuck = todo.join(good, F.col("region") == F.col("parent"), "left_anti")
            todo = tried.join(good, "parent", "left_semi").select(*MEMBER)
        else:
            stuck, todo = todo, todo.limit(0).select(*MEMBER)
        blocks = F.ceil(F.col("size") / block).cast("int")
        own = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) * blocks / (1 << 30)
        stuck = stuck.withColumn("own", F.floor(own).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        pair = F.concat_ws("/", "region", F.least("own", "_other"), F.greatest("own", "_other"))
        done = done.union(stuck.withColumn("region", pair).select(*MEMBER))
        spent += 1
        todo = written(todo, "regions")


def _assign(rows: DataFrame, picked: DataFrame, width: int, t: int, block: int) -> DataFrame:
    """rows and picked (MEMBER and size): each row in each of its cells. A region's rows are dealt into runs of about
    block units, and its pivots go with every run."""
    runs = F.ceil(F.col("size") / block).cast("int")
    own = rows.withColumn("_run", F.pmod(F.xxhash64("node", F.lit(7)), runs).cast("int")).withColumn("_pivot", F.lit(False))
    to_all = picked.withColumn("_run", F.explode(F.sequence(F.lit(0), runs - 1))).withColumn("_pivot", F.lit(True))

    def assign(group: pa.Table) -> pa.Table:
        is_pivot = group.column("_pivot").to_numpy()
        points = group.filter(pa.array(is_pivot)).sort_by([("node", "ascending"), ("text", "ascending")])  # ids may repeat
        docs = group.filter(pa.array(~is_pivot))
        at, to, among = [], [], []
        before = docs.column("also").to_pylist()
        if docs.num_rows:
            n, region = docs.num_rows, docs.column("region")[0].as_py()
            s = Sets(_own_sets(docs.column("text"), width) + _own_sets(points.column("text"), width))
            for i, found in enumerate(cells(s.distances(np.arange(n), np.arange(n, len(s.size))), t)):
                at += [i] * len(found)
                to += [f"{region}.{k}" for k in found]
                among += [before[i] + "/" + ",".join(map(str, found))] * len(found)
        took = docs.take(pa.array(at, pa.int64()))
        columns = {"parent": took.column("region"), "region": pa.array(to, pa.string()), "also": pa.array(among, pa.string())}
        return pa.table([columns.get(c, took.column(c) if c in took.column_names else None) for c in ("parent", *MEMBER, "size")], ["parent", *MEMBER, "size"])

    columns = [*MEMBER, "_run", "_pivot", "size"]
    dealt = own.select(*columns).union(to_all.select(*columns)).groupBy("region", "_run")
    return dealt.applyInArrow(assign, f"parent string, {_MEMBER}, size long")


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the matrix connects, one less than documents in each component."""
    n = len(near)
    fresh, out = np.ones(n, bool), []
    for root in range(n):
        if not fresh[root]:
            continue
        fresh[root] = False
        todo = [root]
        while todo:
            i = todo.pop()
            found = np.flatnonzero(near[i] & fresh)
            fresh[found] = False
            out += [(i, int(j)) for j in found]
            todo += found.tolist()
    return out


def _counted_elsewhere(region: str, own: list[int], also: list[str]) -> np.ndarray:
    """Which pairs of members count in another region: a link counts in the smallest region of every level that holds
    both ends, and with blocks in the one region of two blocks, or of one with itself."""
    home, *blocks = region.split("/")
    n = len(own)
    out = np.zeros((n, n), bool)
    if blocks and blocks[0] != blocks[1]:
        out |= np.equal.outer(own, own)
    levels = [a.split("/") for a in also]
    for depth, here in enumerate(home.split(".")):
        less = [[int(k) for k in x[depth].split(",") if int(k) < int(here)] for x in levels]
        names = {k: i for i, k in enumerate({k for x in less for k in x})}
        if names:
            m = np.zeros((n, len(names)), np.float32)
            m[np.repeat(np.arange(n), [len(x) for x in less]), [names[k] for x in less for k in x]] = 1
            out |= m @ m.T > 0
    return out


def _join_regions(rows: DataFrame, width: int, t: int) -> DataFrame:
    """Of each region: a forest of its links (a, b), and how many count here for each member (a, links)."""

    def join(group: pa.Table) -> pa.Table:
        own = _own_sets(group.column("text"), width)
        sizes = np.array([len(x) for x in own], np.int64)
        d1, _ = _digest(np.concatenate(own) if own else np.empty(0, np.uint64), sizes)
        nodes, want = group.column("node").to_numpy(), group.column("d1").to_numpy()
        keep = {int(nodes[i]): i for i in range(len(own)) if d1[i] == want[i]}  # ids may repeat with other texts
        at = sorted(keep.values())
        near = links([own[i] for i in at], t)
        of = lambda c: [group.column(c)[i].as_py() for i in at]
        number = (near & ~_counted_elsewhere(group.column("region")[0].as_py(), of("own"), of("also"))).sum(1)
        tree, some = forest(near), np.flatnonzero(number).tolist()
        id_ = [int(nodes[i]) for i in at]
        a, b = [id_[i] for i, _ in tree] + [id_[i] for i in some], [id_[j] for _, j in tree] + [None] * len(some)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array([None] * len(tree) + number[some].tolist(), pa.int64())})

    return rows.groupBy("region").applyInArrow(join, "a long, b long, links long")


def jaccard_components(docs: DataFrame, width: int, t: int, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text): doc_id, n_shingles, component_id, links (of its class to others), class_size."""
    spark = docs.sparkSession
    whole, path = written_at(signatures(docs, width, t, sketch(docs, width)), "signatures")
    signed = written(whole.drop("first", "chars"), "keys")
    known = whole.filter("doc_id is not null and n > 0")
    least = known.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("class_size"), F.max("chars").alias("chars"))
    classes = written(least.withColumn("node", F.monotonically_increasing_id()), "classes")
    # Here d1 alone names a set; should two sets share it, more is compared than need be.
    near = written(pivots_of(known, t), "regions")
    discard(spark, path)
    release(spark)
    # every document's regions, its own included where it is a pivot, and the texts that they ask for, once
    both = near.union(near.select(F.col("p").alias("x"), "p"))
    lists = both.groupBy("x").agg(F.array_sort(F.collect_set("p")).cast("array<string>").alias("regions"))
    wanted = classes.join(lists, F.col("d1") == F.col("x")).select(F.col("first_id").alias("id"), "node", "d1", "chars", "regions")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    units = F.ceil((F.col("chars") + 1) / UNIT).cast("int")
    members, path = written_at(texts.join(wanted, "id").select("node", "d1", "text", units.alias("units"), "regions"), "members")
    release(spark)
    region = F.explode("regions").alias("region")
    sizes = written(members.select(region, "units").groupBy("region").agg(F.sum("units").alias("size")).filter(F.col("size") > leaf), "large")
    rows = members.select(region, "node", "d1", "text", F.lit(-1).alias("own"), F.array_join("regions", ",").alias("also"), "units").select(*MEMBER)
    found = _join_regions(rows.join(sizes, "region", "left_anti"), width, t)
    if not sizes.isEmpty():
        large = written(rows.join(sizes.select("region"), "region", "left_semi"), "cut")
        found = found.union(_join_regions(cut(large, width, t, leaf, block), width, t))
    found = written(found, "links")
    discard(spark, path)
    release(spark)
    tree = found.filter("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    joined = components(tree, "a", "b").withColumnRenamed("component", "_root")
    degree = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named_ = classes.join(joined, "node", "left").join(degree, "node", "left").withColumn("_root", F.coalesce("_root", "node"))
    roots = named_.groupBy("_root").agg(F.min("first_id").alias("component_id"))
    result = written(named_.join(roots, "_root").select("n", "d1", "d2", "component_id", F.coalesce("links", F.lit(0)).alias("links"), "class_size"), "components")
    linked = result.filter((F.col("class_size") > 1) | (F.col("links") > 0)).drop("n")
    out = signed.select("doc_id", "n", "d1", "d2").join(linked, ["d1", "d2"], "left")
    real = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(real & F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(real, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).alias("links"),
        F.when(real, F.coalesce("class_size", F.lit(1))).otherwise(F.lit(1)).cast("long").alias("class_size"),
    )


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 4, 85)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: five-word shingles, similarity 0.8; every row takes part under a number of its own, whatever its
    doc_id. Of each component one row stays, that with the smallest doc_id (rows without one come last, ties go by a
    hash of the text), and so do all rows without shingles. Columns of any name pass through; an empty table stays
    empty."""
    rows = written(nested(docs).withColumn("number", F.monotonically_increasing_id()), "rows")
    found = jaccard_components(rows.select(F.col("number").alias("doc_id"), "row.text"), 5, 80)
    linked = found.filter("links > 0 or class_size > 1").select(F.col("doc_id").alias("number"), "component_id")
    order = F.struct(F.col("row.doc_id").isNull(), "row.doc_id", F.xxhash64("row.text"), "number")
    members = written(linked.join(rows.select("number", order.alias("place")), "number"), "members")
    kept = members.groupBy("component_id").agg(F.min("place").getField("number").alias("number"))
    gone = members.select("number").join(kept, "number", "left_anti")
    return rows.join(gone, "number", "left_anti").select("row.*")
