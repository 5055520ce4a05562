"""Operator 9: exact top-k by inner product with a dual-tree search over cover trees.

Each shard of candidates has a cover tree in its simplified form: a node of level l lies within BASE^l of all its
points, its children are points of it that lie more than BASE^(l-1) apart and within that distance of all points, and
the first of them is the node's own centre. The queries that meet a shard get a tree of their own. For a pair of nodes
with centres a, b, radii r, s and the largest query length L in the query node, no inner product exceeds
`a.b + r |b| + L s`; a pair goes when this is below the worst kth score in the query group, so ties stay. Pairs of
nodes, inner ones and leaves alike, are visited best bound first, and a visit splits both nodes (leaves of one parent
that are still in are visited together). Before that, whole regions go by the same bound (see vectors).

Scores are whole numbers: products run in double precision while they are exact there (below 2**53), in 64-bit
integers up to 2**63, and in unbounded integers beyond; a score outside the range of long becomes its nearest long.
Vectors that are null or hold null or non-finite components take no part; vectors meet only those of their own length;
fewer candidates than k give fewer rows; rows that repeat a vec_id count each; other columns are not looked at; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table
from .vectors import indexed, search, valid

LEAF = 64
BASE = 1.3
_LONG = (1 << 63) - 1


def cover_tree(v: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """links: number of nodes, then for each node centre, first child, children, begin and end in the order of
    points, which follows. numbers: the nodes' radii."""
    n = len(v)
    order, squares = np.arange(n), np.einsum("nd,nd->n", v, v)
    nodes: list[list[int]] = []
    radii: list[float] = []

    def radius(points: np.ndarray, centre: int) -> float:
        d = v[points] - v[centre]
        return float(np.sqrt(np.einsum("nd,nd->n", d, d).max()))

    todo = []
    if n:
        centre = int(np.argmin(np.einsum("nd,nd->n", v - v.mean(0), v - v.mean(0))))
        nodes.append([centre, -1, 0, 0, n])
        radii.append(radius(order, centre))
        todo.append(0)
    while todo:
        at = todo.pop()
        centre, _, _, begin, end = nodes[at]
        if end - begin <= leaf or radii[at] == 0:
            continue
        points = order[begin:end].copy()
        own, far = v[points], squares[points]
        goal = BASE ** (2 * (math.ceil(math.log(radii[at], BASE)) - 1))  # squared
        centres = [int(np.flatnonzero(points == centre)[0])]
        nearest, owner = far + far[centres[0]] - 2 * own @ own[centres[0]], np.zeros(len(points), np.int64)
        nearest[centres[0]] = 0
        while nearest.max() > goal:
            c = int(np.argmax(nearest))
            d = far + far[c] - 2 * own @ own[c]
            d[c] = 0
            closer = d < nearest
            owner[closer] = len(centres)
            nearest = np.where(closer, d, nearest)
            centres.append(c)
        if len(centres) == 1:  # rounding alone held the radius above its level
            continue
        by = np.argsort(owner, kind="stable")
        order[begin:end] = points[by]
        counts = np.bincount(owner, minlength=len(centres))
        nodes[at][1], nodes[at][2] = len(nodes), len(centres)
        start = begin
        for c, count in zip(centres, counts.tolist(), strict=True):
            nodes.append([int(points[c]), -1, 0, start, start + count])
            radii.append(radius(order[start : start + count], int(points[c])) if count > 1 else 0.0)
            todo.append(len(nodes) - 1)
            start += count
    return np.concatenate([np.array([len(nodes)]), np.array(nodes, np.int64).ravel(), order]).astype(np.int64), np.array(radii)


def unpack(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = int(links[0])
    return links[1 : 1 + 5 * n].reshape(n, 5), links[1 + 5 * n :]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as long; beyond its range, the nearest long."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [[[int(x) for x in row] for row in m.tolist()] for m in (a, b)]
    return np.array([[max(-_LONG, min(_LONG, sum(x * y for x, y in zip(p, q, strict=True)))) for q in whole[1]] for p in whole[0]], np.int64).reshape(len(a), len(b))


def _lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("nd,nd->n", v, v))


class _Best:
    """The best `need` classes of each query so far: score first, then the class with the smallest id."""

    def __init__(self, queries: int, need: int, smallest: np.ndarray, least: np.ndarray):
        self.need, self.smallest = need, smallest
        self.scores, self.found = np.full((queries, need), -_LONG, np.int64), np.full((queries, need), -1, np.int64)
        self.worst = least.astype(float).copy()

    def add(self, group: np.ndarray, points: np.ndarray, got: np.ndarray) -> None:
        some = (got >= self.worst[group][:, None]).any(0)
        points, got = points[some], got[:, some]
        scores = np.hstack([self.scores[group], got])
        found = np.hstack([self.found[group], np.broadcast_to(points, got.shape)])
        first = np.where(found < 0, np.iinfo(np.int64).max, self.smallest[np.maximum(found, 0)])
        by = np.lexsort((first, -scores, found < 0), axis=1)[:, : self.need]
        self.scores[group], self.found[group] = np.take_along_axis(scores, by, 1), np.take_along_axis(found, by, 1)
        full = self.found[group, -1] >= 0
        self.worst[group] = np.where(full, np.maximum(self.worst[group], self.scores[group, -1].astype(float)), self.worst[group])


def finder(k: int, seen: list | None = None):
    """seen: gets (products worked out, products there are) of every search."""
    need = k + 1

    def find(q, v, ids, links, radii, least):
        nodes, order = unpack(links)
        best = _Best(len(q), need, np.array([x[0] for x in ids], np.int64), least)
        q_links, q_radii = cover_tree(q, 32)
        q_nodes, q_order = unpack(q_links)
        c_centre, c_length = v[nodes[:, 0]], _lengths(v[nodes[:, 0]])
        q_centre, lengths = q[q_nodes[:, 0]], _lengths(q)
        longest = np.array([lengths[q_order[b:e]].max() for _, _, _, b, e in q_nodes.tolist()])

        def bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            top = q_centre[a] @ c_centre[b].T + q_radii[a][:, None] * c_length[b][None, :] + longest[a][:, None] * radii[b][None, :]
            return top + 1e-9 * (longest[a][:, None] * (c_length[b] + radii[b])[None, :] + 1)

        def worst(a: int) -> float:
            return best.worst[q_order[q_nodes[a, 3] : q_nodes[a, 4]]].min()

        def children(tree: np.ndarray, at: int) -> np.ndarray:
            return np.arange(tree[at, 1], tree[at, 1] + tree[at, 2])

        done, number = 0, 0
        leaf = nodes[:, 2] == 0
        # (bound, number, query node, candidate nodes: one inner node, or sibling leaves)
        heap: list[tuple[float, int, int, np.ndarray]] = [(-np.inf, 0, 0, np.array([0]))] if len(q) and len(v) else []
        while heap:
            bound, _, a, at = heapq.heappop(heap)
            if -bound < worst(a):
                continue
            if leaf[at[0]] and not q_nodes[a, 2]:
                at = at[bounds(np.array([a]), at)[0] >= worst(a)]
                group = q_order[q_nodes[a, 3] : q_nodes[a, 4]]
                points = np.concatenate([order[nodes[i, 3] : nodes[i, 4]] for i in at.tolist()] or [order[:0]])
                done += len(group) * len(points)
                best.add(group, points, products(q[group], v[points]))
                continue
            left = children(q_nodes, a) if q_nodes[a, 2] else np.array([a])
            right = at if leaf[at[0]] else children(nodes, int(at[0]))
            top = bounds(left, right)
            for i, x in enumerate(left.tolist()):
                ok = top[i] >= worst(x)
                for some in [np.flatnonzero(ok & leaf[right]), *np.flatnonzero(ok & ~leaf[right])[:, None]]:
                    if len(some):
                        number += 1
                        heapq.heappush(heap, (-float(top[i, some].max()), number, x, right[some]))
        if seen is not None:
            seen.append((done, len(q) * len(v)))
        return [(f[f >= 0], s[f >= 0]) for f, s in zip(best.found, best.scores, strict=True)]

    return find


def op9_exact_topk(spark, sf_dir: str, k: int = 5, every: int = 50) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(valid(F.col("v"), zero=False) & F.col("vec_id").isNotNull())
    # doubles from 2**53 on are whole already, and may be too large for a long
    whole = lambda x: F.when(F.abs(x * 256) < 2.0**53, F.floor(x * 256).cast("double")).otherwise(x * 256)
    rows = rows.withColumn("v", F.transform("v", whole)).filter(valid(F.col("v"), zero=False))
    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return search(queries, indexed(rows, k + 1, cover_tree), finder(k), k, "long")
