"""Operator 8: removal of repeated byte strings through suffix arrays of shards.

A byte goes if it is covered by a string of WIDTH bytes that also starts earlier: in a smaller doc_id, or earlier
in the same document. Equal strings must meet in one shard. Each string of WIDTH bytes has one anchor, the
leftmost of its smallest GRAM-byte grams by hash, so equal strings have equal anchors at equal places. Strings
with one anchor overlap and are a context: the bytes they cover. The steps:

1. Contexts are found in one pass, as hashes and places, without text. Contexts that repeat exactly need no
   sorting: every one but the first goes. A batch settles its own repeats before the shuffle. (Two 64-bit hashes, of
   gram and content, must be equal; bytes are not compared here.)
2. What remains are distinct contexts that share an anchor's gram with another one. Their bytes are fetched and
   dealt to shards by the gram. A shard's suffix array is built by induced sorting, permuted common prefixes
   follow, and runs of suffixes with a common prefix of WIDTH are equal strings: all but the earliest go.
3. The places meet by document and the covered bytes are cut out.

Matches never cross documents or contexts. Null doc_id is smaller than all others; rows with one doc_id and
different texts are documents in the order of a hash of their text; rows equal in both count as one document
(none removes from the other, both lose the same). Null and empty texts lose nothing. A text cut for the pipeline
drops what a cut leaves of a split character. Other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import nested, parts, release, table, written
from .shingles import mix
from .suffixes import plcp, suffix_array
from .tokens import _BASE, _CODE, powers, text_bytes

WIDTH = 100
GRAM = 24
_BLOCK = 1 << 19
#: Bytes of contexts in one suffix array, unless one gram alone has more.
SHARD_BYTES = 256 << 10


def bands(width: int = WIDTH, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """Four bands of distances from a string's start to its gram: number, least, most."""
    edges = [(width - gram + 1) * k // 4 for k in range(5)]
    return [(k, edges[k], edges[k + 1] - 1) for k in range(4)]


def anchors(raw: np.ndarray, bounds: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """Contexts of the texts raw[bounds[i]:bounds[i+1]]: text, first start, last start, gram hash, content hash, and
    for each band of places that the gram can have in a string, a hash (16 bits, 0 for none) of the bytes that all
    those strings cover."""
    n, span = len(raw), width - gram + 1
    none = tuple(np.empty(0, d) for d in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    if n < width:
        return none
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_CODE[raw] * powers(_BASE, n), out=total[1:])
        down = powers(pow(_BASE, -1, 1 << 64), n)
        grams = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
        bits = np.uint64(max(1, int(n).bit_length()))
        key = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        least, have = key, 1
        while 2 * have <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        rest = span - have
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        starts = np.arange(len(anchor))
        owner = np.searchsorted(bounds, starts, "right") - 1
        inside = starts + width <= bounds[owner + 1]
        starts, owner, anchor = starts[inside], owner[inside], anchor[inside]
        if not len(starts):
            return none
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        lo, hi, a = starts[first], starts[last], anchor[first]
        content = (total[hi + width] - total[lo]) * down[lo]
        content = mix(content + mix((hi - lo).astype(np.uint64) * np.uint64(1 << 20) + (a - lo).astype(np.uint64)))
        sides = np.zeros(len(a), np.uint64)
        for band, least, most in bands(width, gram):
            # strings that start between `most` and `least` bytes before the gram all cover these bytes
            p, q = a - least, a + width - most
            p_, q_ = np.maximum(p, 0), np.minimum(q, n)
            own = mix((total[q_] - total[p_]) * down[np.minimum(p_, n - 1)]) >> np.uint64(48)
            there = (a - lo >= least) & (a - hi <= most)
            sides |= np.where(there, np.maximum(own, np.uint64(1)), np.uint64(0)) << np.uint64(16 * band)
    text = owner[first]
    return text, lo - bounds[text], hi - bounds[text], grams[a], content, sides


PLACE = [("kind", pa.int32()), ("g", pa.int64()), ("c", pa.int64()), ("doc", pa.int64()), ("mark", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("sides", pa.int64())]
_PLACE = "kind int, g long, c long, doc long, mark long, lo int, hi int, sides long"
OPEN, GONE = 0, 1


def _batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(t.to_pandas_dtype())) for x, (_, t) in zip(columns, PLACE, strict=True)], [k for k, _ in PLACE])


def _runs(doc: np.ndarray, mark: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Joins touching ranges of starts within a document."""
    if not len(doc):
        return [doc, mark, lo, hi]
    o = np.lexsort((lo, mark, doc))
    doc, mark, lo, hi = doc[o], mark[o], lo[o], hi[o]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (lo[1:] > hi[:-1] + 1)
    first = np.flatnonzero(new)
    return [doc[first], mark[first], lo[first], np.maximum.reduceat(hi, first)]


def _settle(g, c, doc, mark, lo, hi, sides):
    """Sorts contexts by (g, c, doc, mark, lo) and tells which are not the first of their content. The same context
    of rows that are one document (same doc, mark and lo) is first for all of them."""
    o = np.lexsort((lo, mark, doc, c, g))
    rows = [x[o] for x in (g, c, doc, mark, lo, hi, sides)]
    g, c, doc, mark, lo = rows[:5]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    same = np.zeros(len(g), bool)
    same[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (mark[1:] == mark[:-1]) & (lo[1:] == lo[:-1])
    if same.any():
        rows, new = [x[~same] for x in rows], new[~same]
    return *rows, new


def _gone_batch(doc: np.ndarray, mark: np.ndarray, lo: np.ndarray, hi: np.ndarray, spread: bool = False) -> pa.RecordBatch:
    doc, mark, lo, hi = _runs(doc, mark, lo, hi)
    g = mix(doc.astype(np.uint64) + lo.astype(np.uint64)).view(np.int64) if spread else np.zeros(len(doc))
    return _batch([np.ones(len(doc)), g, np.zeros(len(doc)), doc, mark, lo, hi, np.zeros(len(doc))])


def places(docs: DataFrame) -> DataFrame:
    """Contexts of every document, and starts already known to go."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            raw, offsets = text_bytes(batch.column(2))
            found, i, n = [], 0, len(offsets) - 1
            while i < n:
                j = min(max(int(np.searchsorted(offsets, offsets[i] + _BLOCK, "right")) - 1, i + 1), n)
                text, lo, hi, g, c, sides = anchors(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                found.append((g.view(np.int64), c.view(np.int64), ids[i + text], marks[i + text], lo, hi, sides.view(np.int64)))
                i = j
            if not found:
                continue
            *rows, new = _settle(*map(np.concatenate, zip(*found, strict=True)))
            yield _batch([np.zeros(new.sum()), *(x[new] for x in rows)])
            yield _gone_batch(*(x[~new] for x in rows[2:6]), spread=True)

    return docs.select("doc", "mark", "text").mapInArrow(find, _PLACE)


def _shared(g: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Which contexts have the bytes of a band in common with another context of the gram. Equal strings of WIDTH bytes
    have their anchor at the same place and so cover the bytes of one band."""
    out = np.zeros(len(g), bool)
    for shift in range(0, 64, 16):
        side = (sides.view(np.uint64) >> np.uint64(shift)) & np.uint64(0xFFFF)
        with np.errstate(over="ignore"):
            key = mix(g.view(np.uint64) + mix(side + np.uint64(shift)))
        _, group, counts = np.unique(key, return_inverse=True, return_counts=True)
        out |= (side > 0) & (counts[group] > 1)
    return out


def settle(found: DataFrame) -> DataFrame:
    """Of contexts that meet by gram: exact repeats go; distinct ones that can share a string stay open. Rows come in
    the order of their grams; memory: a batch, and the contexts of one gram (of each batch of documents, one for each
    content)."""

    def settled(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        *rows, new = _settle(*rows)
        yield _gone_batch(*(x[~new] for x in rows[2:6]))
        rows = [x[new] for x in rows]
        keep = _shared(rows[0], rows[6])
        yield _batch([np.zeros(keep.sum()), *(x[keep] for x in rows)])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            kind, *rest = (x.to_numpy() for x in batch.columns)
            if (kind == GONE).any():
                yield _gone_batch(*(x[kind == GONE] for x in rest[2:6]))
            rest = [x[kind == OPEN] for x in rest]
            if not len(rest[0]):
                continue
            last = int(np.searchsorted(rest[0], rest[0][-1]))  # where the last gram's rows begin
            if held and (last or rest[0][0] != held[-1][0][-1]):
                held.append([x[:last] for x in rest])
                yield from settled([np.concatenate(x) for x in zip(*held, strict=True)])
                held = []
            elif last:
                yield from settled([x[:last] for x in rest])
            held.append([x[last:] for x in rest])
        if held:
            yield from settled([np.concatenate(x) for x in zip(*held, strict=True)])

    return found.repartition(parts(found.sparkSession), "g").sortWithinPartitions("g").mapInArrow(one, _PLACE)


def repeated(contexts: list[bytes], lasts: list[int], width: int = WIDTH) -> list[list[tuple[int, int]]]:
    """contexts in document order, each with strings starting at 0..last: the ranges of starts that go."""
    size = np.array([len(x) + 1 for x in contexts], np.int64)
    begin = np.cumsum(size) - size
    raw = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    t = raw.astype(np.int64) + 1
    t[begin + size - 1] = 0
    valid = np.zeros(len(raw), bool)
    count = np.asarray(lasts, np.int64) + 1
    valid[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())] = True
    sa = suffix_array(t)
    common = plcp(raw, sa, width, valid)
    group = np.cumsum(common[sa] < width)
    use = valid[sa]
    at, group = sa[use], group[use]
    least = np.full(int(group.max(initial=0)) + 1, len(raw), np.int64)
    np.minimum.at(least, group, at)
    gone = np.sort(at[at != least[group]])
    owner = np.searchsorted(begin, gone, "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    if len(gone):
        cut = np.flatnonzero((np.diff(gone) != 1) | (np.diff(owner) != 0)) + 1
        for run, who in zip(np.split(gone, cut), owner[np.concatenate([[0], cut])].tolist(), strict=True):
            out[who].append((int(run[0] - begin[who]), int(run[-1] - begin[who])))
    return out


GONE_ROW = "doc long, mark long, lo int, hi int"


def compare(open_: DataFrame, docs: DataFrame) -> DataFrame:
    """Fetches the open contexts' bytes, deals them to shards by gram and gives the starts that go."""
    wanted = open_.groupBy("doc", "mark").agg(F.collect_list(F.struct("g", "lo", "hi")).alias("at"))
    rows = docs.select("doc", "mark", "text").dropDuplicates(["doc", "mark"]).join(wanted, ["doc", "mark"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, mark, text, at in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                data = text.encode()
                for p in at:
                    for column, v in zip(out, (p["g"], doc, mark, p["lo"], p["hi"], data[p["lo"] : p["hi"] + WIDTH]), strict=True):
                        column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["g", "doc", "mark", "lo", "hi", "bytes"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if size > SHARD_BYTES and row[0] != last:
                    yield _gone(held)
                    held, size = [], 0
                last = row[0]
                size += len(row[5])
                held.append(row[1:])
        if held:
            yield _gone(held)

    cut = rows.select("doc", "mark", "text", "at").mapInArrow(fetch, "g long, doc long, mark long, lo int, hi int, bytes binary")
    shards = cut.repartition(parts(docs.sparkSession), "g").sortWithinPartitions("g")
    return shards.mapInArrow(sort, GONE_ROW)


def _gone(held: list[tuple]) -> pa.RecordBatch:
    held = sorted(held, key=lambda r: r[:3])
    out: list[list] = [[] for _ in range(4)]
    for (doc, mark, lo, hi, _), ranges in zip(held, repeated([r[4] for r in held], [r[3] - r[2] for r in held]), strict=True):
        for a, b in ranges:
            for column, v in zip(out, (doc, mark, lo + a, lo + b), strict=True):
                column.append(v)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc", "mark", "lo", "hi"])


def spans(lo: np.ndarray, hi: np.ndarray, width: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the strings starting at lo..hi cover."""
    out: list[list[int]] = []
    for a, b in sorted(zip(lo, hi, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + width)
        else:
            out.append([a, b + width])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """docs(doc_id, text, ...): doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text also adds the input row as
    struct `row`, and kept, the text that is left."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    keyed = nested(docs if with_text else docs.select("doc_id", "text")).withColumn("text", text)
    # rows that share a doc_id but not a text are told apart by a hash of the text; all others need no mark
    told = keyed.filter(F.col("row.doc_id").isNotNull()).select(F.col("row.doc_id").alias("_id"), F.xxhash64("text").alias("h"))
    several = told.groupBy("_id").agg(F.min("h").alias("least"), F.max("h").alias("most")).filter("least <> most").select("_id")
    keyed = keyed.join(written(several, "repeated-ids"), F.col("row.doc_id") == F.col("_id"), "left")
    mark = F.when(F.col("row.doc_id").isNull() | F.col("_id").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0)).cast("long")
    keyed = keyed.withColumn("doc", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))).withColumn("mark", mark).drop("_id")
    met = written(settle(places(keyed)), "contexts")
    release(spark)
    found = met.filter(F.col("kind") == GONE).select("doc", "mark", "lo", "hi")
    found = found.union(written(compare(met.filter(F.col("kind") == OPEN), keyed), "gone"))
    release(spark)
    gone = found.groupBy("doc", "mark").agg(F.collect_list("lo").alias("_lo"), F.collect_list("hi").alias("_hi"))
    carry = F.col("row") if with_text else F.struct("row.doc_id")
    rows = keyed.withColumn("row", carry).join(gone, ["doc", "mark"], "left").select("row", "text", "_lo", "_hi")
    kind = rows.schema["row"].dataType.simpleString()
    schema = f"row {kind}" + (", kept string" if with_text else "") + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, lo, hi in zip(*(x.to_pylist() for x in batch.columns[1:]), strict=True):
                data = text.encode()
                runs = spans(lo, hi, WIDTH) if lo else []
                kept, at = [], 0
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                left = b"".join([*kept, data[at:]]) if runs else data
                for column, v in zip(out, (left.decode("utf-8", "ignore") if with_text else "", len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest()), strict=True):
                    column.append(v)
            tail = [pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            names = ["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            drop = 0 if with_text else 1
            yield pa.RecordBatch.from_arrays([batch.column(0), *tail[drop:]], ["row", *names[drop:]])

    out = rows.mapInArrow(cut, schema)
    return out if with_text else out.select("row.doc_id", *[c for c in out.columns if c != "row"])


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated strings go from the texts; n_chars follows the text. Columns of any other name pass
    through; null ids and texts, repeated rows and empty tables as above (a null text becomes an empty one)."""
    out = dedup(docs, with_text=True)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])
