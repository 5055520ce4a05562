"""Operator 7: best-fit packing of token pieces, improved by swap-based local search.

Every text becomes its ids and an end id; only texts longer than a sequence are cut. Pieces are dealt by a hash
into groups of about GROUP pieces, so that no key decides a group's size, and each group is packed on its own:
best fit, longest first, then local search. The search takes the emptiest bins in turn and moves a piece into
another bin, or exchanges one or two pieces for a shorter one or one for two, whenever the sum of squared fills grows,
the largest growth first; a bin whose pieces have all left is gone. It stops at the lower bound, or when a whole pass
over the bins has emptied none. A group wastes less than one sequence over its bound by being a group.

Null and empty texts are one piece, the end id. Repeated rows are packed each for itself. Other
columns are not looked at. An empty table gives no rows. Memory: one group of pieces, without their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table, written
from .tokens import Encoder, crc, tokenizer_path

GROUP = 16_384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, with_ids: bool = False) -> DataFrame:
    """The pieces of every document; with_ids adds their ids as little-endian unsigned 32-bit integers."""
    schema = PIECES + (", ids binary" if with_ids else "")
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, ids, counts in encoder.ids(batch.column(1)):
                rows = [[] for _ in fields]
                at = 0
                for doc_id, n in zip(doc_ids[first : first + len(counts)], counts.tolist(), strict=True):
                    own = np.append(ids[at : at + n], end_id).astype("<u4")
                    at += n
                    for k, start in enumerate(range(0, n + 1, size)):
                        part = own[start : start + size]
                        row = (doc_id, k, start, len(part), crc(part)) + ((part.tobytes(),) if with_ids else ())
                        for column, v in zip(rows, row, strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(rows, fields, strict=True)], [f for f, _ in fields])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins as lists of positions; longest first into the fullest bin that still takes it."""
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    mask, bins = 0, []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            rooms[room - n].append(b)
            mask |= 1 << (room - n)
    return bins


def lower_bound(lengths: list[int], size: int) -> int:
    """No packing needs fewer: total length, or with pieces over size - t alone for each t up to half."""
    ordered = np.sort(np.asarray(lengths, np.int64))
    upto = np.concatenate([[0], np.cumsum(ordered)])
    best = -(-int(upto[-1]) // size)
    for t in np.unique(ordered[ordered <= size // 2]).tolist():
        large = len(ordered) - int(np.searchsorted(ordered, size - t, "right"))
        lo, hi = int(np.searchsorted(ordered, t, "left")), int(np.searchsorted(ordered, size - t, "right"))
        mid = int(np.searchsorted(ordered, size // 2, "right"))
        halves = hi - mid
        free = halves * size - int(upto[hi] - upto[mid])
        best = max(best, large + halves + max(0, -(-(int(upto[mid] - upto[lo]) - free) // size)))
    return best


class Search:
    """Local search over the bins that have room. A trade takes some pieces out of bin a for fewer tokens from bin b, and
    is made only if the sum of squared fills grows: b, with what it gains, becomes fuller than a was."""

    def __init__(self, lengths: list[int], bins: list[list[int]], size: int):
        self.lengths, self.size = np.asarray(lengths, np.int64), size
        self.bins = bins
        self.where = np.empty(len(lengths), np.int64)
        for b, own in enumerate(bins):
            self.where[own] = b
        self.fill = np.array([int(self.lengths[own].sum()) for own in bins], np.int64)
        self.pairs_of: dict[int, np.ndarray] = {}

    def _pairs(self, b: int) -> np.ndarray:
        """Pairs of pieces of a bin: sum, first, second; one for each sum."""
        if b not in self.pairs_of:
            own = np.array(self.bins[b])
            i, j = np.triu_indices(len(own), 1)
            total = self.lengths[own[i]] + self.lengths[own[j]]
            total, first = np.unique(total, return_index=True)
            self.pairs_of[b] = np.stack([total, own[i[first]], own[j[first]], np.full(len(total), b)])
        return self.pairs_of[b]

    def _trade(self, a: int, out: list[int], b: int, back: list[int]) -> None:
        for pieces, x, y in ((out, a, b), (back, b, a)):
            for i in pieces:
                self.bins[x].remove(i)
                self.bins[y].append(i)
                self.where[i] = y
                self.fill[[x, y]] += [-self.lengths[i], self.lengths[i]]
        self.pairs_of.pop(a, None)
        self.pairs_of.pop(b, None)

    def _best(self, a: int, total: int, theirs: np.ndarray, bins: np.ndarray) -> tuple[int, int] | None:
        """Of what other bins could give for `total` tokens of bin a: growth of the squared fills, and place."""
        gain, fill = total - theirs, self.fill[bins]
        ok = (gain > 0) & (fill + gain <= self.size) & (fill + gain > self.fill[a]) & (bins != a)
        if not ok.any():
            return None
        growth = np.where(ok, 2 * gain * (fill - self.fill[a] + gain), 0)
        at = int(growth.argmax())
        return int(growth[at]), at

    def step(self, a: int) -> bool:
        """The move or exchange that raises the squared fills most: a piece moves, or one or two pieces go for one, or
        one for two."""
        open_ = (self.fill > 0) & (self.fill < self.size)
        open_[a] = False
        bins = np.flatnonzero(open_)
        if not len(bins):
            return False
        pieces = np.flatnonzero(open_[self.where])
        pairs = np.concatenate([self._pairs(b) for b in bins.tolist()], axis=1)
        own = {int(n): i for n, i in zip(self.lengths[self.bins[a]], self.bins[a], strict=True)}
        two = {int(x[0]): [int(x[1]), int(x[2])] for x in self._pairs(a).T}
        best, trade = 0, None
        for total, out in [*((n, [i]) for n, i in own.items()), *two.items()]:
            offers = [(np.zeros(len(bins), np.int64), bins, None), (self.lengths[pieces], self.where[pieces], pieces[:, None])]
            if len(out) == 1:
                offers.append((pairs[0], pairs[3], pairs[1:3].T))
            for theirs, of, back in offers:
                found = self._best(a, total, theirs, of)
                if found and found[0] > best:
                    best, trade = found[0], (out, int(of[found[1]]), [] if back is None else back[found[1]].tolist())
        if trade:
            self._trade(a, *trade)
        return trade is not None

    def run(self, bound: int) -> list[list[int]]:
        """Emptiest bins first, until the bound is reached or a whole pass has emptied none."""
        before = None
        while (alive := int((self.fill > 0).sum())) != before and alive > bound:
            before = alive
            for a in np.argsort(self.fill, kind="stable").tolist():
                while 0 < self.fill[a] < self.size and self.step(a):
                    pass
                if not self.fill[a] and int((self.fill > 0).sum()) <= bound:
                    break
        return [b for b in self.bins if b]


def pack_group(lengths: list[int], size: int) -> list[list[int]]:
    bins = best_fit(lengths, size)
    bound = lower_bound(lengths, size)
    return bins if len(bins) <= bound else Search(lengths, bins, size).run(bound)


def pack(cut: DataFrame, size: int, group: int = GROUP) -> DataFrame:
    """Places pieces(length, ...) into sequences: adds sequence_id and offset."""
    cut = written(cut, "pieces")
    groups = max(1, -(-cut.count() // group))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields) + ", sequence_id long, offset long"

    def place(rows: pa.Table) -> pa.Table:
        lengths = rows.column("length").to_pylist()
        base = rows.column("group")[0].as_py() << 32
        order, sequence, offset = [], [], []
        for b, bin_ in enumerate(pack_group(lengths, size)):
            at = 0
            for i in bin_:
                order.append(i)
                sequence.append(base + b)
                offset.append(at)
                at += lengths[i]
        out = rows.drop_columns(["group"]).take(pa.array(order, pa.int64()))
        return out.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return dealt.groupBy("group").applyInArrow(place, schema)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), tokenizer_path(), 0, 2048), 2048)
