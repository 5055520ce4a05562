"""Operator 6: approximate nearest neighbours by a hierarchical navigable small-world graph for each shard.

A shard's graph is built from the top layer down; each higher layer holds one in M of the nodes below. Nodes are
inserted in short waves (an eighth of the graph at most): a greedy descent through the layers above finds where to
begin, a beam search of the layer's own graph finds up to WIDE candidates, up to M of them are chosen by the diversity
rule (a candidate stays only if it is nearer to the node than to every neighbour chosen before it), and links go back;
a node whose list overflows chooses again by the same rule. Early nodes keep their far links, which make the graph
navigable. The graph is stored as flat neighbour arrays. A query descends the layers greedily and searches the
bottom one with a beam of EF; the shards' results are merged. Shards hold regions, and a region that cannot hold a
better cosine than those found is not searched (see vectors). Reported scores are exact cosines in double precision
on the original vectors.

Every vector is indexed. Vectors that are null, zero or hold null or non-finite components take no part, as
query or candidate; vectors meet only those of their own length; fewer candidates than k give fewer rows;
repeated ids are rows of their own; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table
from .vectors import indexed, search, valid

M = 16
WIDE = 64
EF = 96
EXPAND = 6


def _diverse(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Of each node's candidates (best first, -1 for none) at most m, by the diversity rule, filled up by rank."""
    out = np.full((len(nodes), m), -1, np.int32)
    for lo in range(0, len(nodes), 256):
        c, s = cand[lo : lo + 256], sims[lo : lo + 256]
        v = x[np.maximum(c, 0)]
        between = v @ v.transpose(0, 2, 1)
        n, width = c.shape
        chosen = np.zeros((n, width), bool)
        count = np.zeros(n, np.int64)
        closest = np.full((n, width), -np.inf)
        for j in range(width):
            take = (c[:, j] >= 0) & (count < m) & (s[:, j] > closest[:, j])
            chosen[take, j] = True
            count += take
            np.maximum(closest, np.where(take[:, None], between[:, j], -np.inf), out=closest)
        # places left go to the nearest ones passed over
        rank = np.where(c < 0, 2 * width, np.where(chosen, 0, width) + np.arange(width))
        order = np.argsort(rank, axis=1, kind="stable")[:, :m]
        picked = np.take_along_axis(c, order, 1)
        out[lo : lo + n, : picked.shape[1]] = picked
    return out


def _insert(x: np.ndarray, graph: np.ndarray, done: int, upto: int, start: np.ndarray, m: int) -> None:
    """Links the rows done..upto of x into the graph of the rows before: neighbours come from a beam search of that
    graph from the start nodes, are chosen by the diversity rule, and are linked back to."""
    cap, new = graph.shape[1], np.arange(done, upto)
    cand, sims = beam(x[:done], x[new], graph[:done], start, WIDE)
    picked = _diverse(x, new, cand, sims, m)
    graph[new, : picked.shape[1]] = picked
    # links back: sort (target, source) and append to the target's list, choosing again where it overflows
    source, target = np.repeat(new, picked.shape[1]), picked.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    touched, first, counts = np.unique(target, return_index=True, return_counts=True)
    back = np.full((len(touched), int(counts.max())), -1, np.int64)
    back[np.repeat(np.arange(len(touched)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
    both = np.hstack([graph[touched], back])
    for lo in range(0, len(touched), 1024):
        rows, c = touched[lo : lo + 1024], both[lo : lo + 1024]
        s = np.where(c >= 0, np.einsum("nd,nwd->nw", x[rows], x[np.maximum(c, 0)]), -np.inf)
        order = np.argsort(-s, axis=1, kind="stable")
        c, s = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)
        full = (c >= 0).sum(1) > cap
        graph[rows] = -1
        graph[rows[~full], : min(cap, c.shape[1])] = c[~full][:, :cap]
        if full.any():
            again = _diverse(x, rows[full], c[full], s[full], cap)
            graph[rows[full], : again.shape[1]] = again


def _waves(n: int, first: int) -> list[tuple[int, int]]:
    """Runs of rows that are inserted together: an eighth of what is there already, at least 16."""
    out, done = [], first
    while done < n:
        upto = min(n, done + max(min(16, done), done // 8))
        out.append((done, upto))
        done = upto
    return out


def build(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """links: number of layers, then for each layer its size and width, its nodes and its neighbour lists, bottom
    layer first. A layer's first nodes are those of the layer above, in the same order. numbers: the lengths."""
    norms = np.sqrt(np.einsum("nd,nd->n", v, v))
    x = v / norms[:, None]
    order = np.random.default_rng(11).permutation(len(x))
    sizes = [len(x)]
    while sizes[-1] > M:
        sizes.append(max(1, sizes[-1] // M))
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    for n in reversed(sizes):  # from the top
        places = order[:n]
        own, graph = x[places], np.full((n, 2 * M), -1, np.int64)
        above = len(layers[0][0]) if layers else 1
        for done, upto in _waves(n, 1):
            start = np.zeros((upto - done, 1), np.int64)
            if done >= above and layers:  # greedy descent through the layers above
                start = descend(x, own[done:upto], layers)
            _insert(own, graph, done, upto, start, M)
        layers.insert(0, (places, graph))
    flat = [np.array([len(layers)])]
    for places, graph in layers:
        flat += [np.array([len(places), graph.shape[1]]), places, graph.ravel()]
    return np.concatenate(flat), norms


def descend(x: np.ndarray, q: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The nodes of the lowest of the layers that greedy search from the top ends at, as places in it and so in the
    layer below."""
    start = np.zeros((len(q), 1), np.int64)
    for places, graph in reversed(layers):
        start, _ = beam(x[places], q, graph, start, 4)
    return start


def _layers(links: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 1
    for _ in range(int(links[0])):
        n, width = int(links[at]), int(links[at + 1])
        at += 2
        out.append((links[at : at + n], links[at + n : at + n + n * width].reshape(n, width)))
        at += n + n * width
    return out


def beam(x: np.ndarray, q: np.ndarray, graph: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ef best nodes met from its start nodes, best first (-1 for none)."""
    n, queries = len(x), len(q)
    ef = min(ef, n)
    rows = np.arange(queries)[:, None]
    ids = np.full((queries, ef), -1, np.int64)
    sims = np.full((queries, ef), -np.inf)
    seen = np.zeros((queries, n + 1), bool)
    width = min(start.shape[1], ef)
    ids[:, :width] = start[:, :width]
    sims[:, :width] = np.where(start[:, :width] >= 0, np.einsum("qd,qwd->qw", q, x[np.maximum(start[:, :width], 0)]), -np.inf)
    seen[rows, np.where(ids >= 0, ids, n)] = True
    expanded = ids < 0
    active = np.arange(queries)
    while len(active):
        own = np.arange(len(active))[:, None]
        open_ = np.where(expanded[active], -np.inf, sims[active])
        best = np.argsort(-open_, axis=1, kind="stable")[:, :EXPAND]
        ok = np.take_along_axis(open_, best, 1) > -np.inf
        go = ok.any(1)
        active, best, ok, own = active[go], best[go], ok[go], own[: go.sum()]
        if not len(active):
            break
        expanded[active[:, None], best] = True
        from_ = np.where(ok, ids[active[:, None], best], -1)
        near = np.where(from_[:, :, None] >= 0, graph[np.maximum(from_, 0)], -1).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[active[:, None], np.where(near >= 0, near, n)]] = -1
        seen[active[:, None], np.where(near >= 0, near, n)] = True
        got = np.where(near >= 0, np.einsum("qd,qwd->qw", q[active], x[np.maximum(near, 0)]), -np.inf)
        all_sims = np.hstack([sims[active], got])
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
        sims[active] = np.take_along_axis(all_sims, order, 1)
        ids[active] = np.take_along_axis(np.hstack([ids[active], near]), order, 1)
        expanded[active] = np.take_along_axis(np.hstack([expanded[active], near < 0]), order, 1)
    return ids, sims


def finder(k: int, ef: int = EF):
    def find(q, v, ids, links, norms, least):
        x = v / norms[:, None]
        size = np.sqrt(np.einsum("qd,qd->q", q, q))
        unit = q / size[:, None]
        layers = _layers(links)
        start = descend(x, unit, layers[1:]) if len(layers) > 1 else np.zeros((len(q), 1), np.int64)
        places, graph = layers[0]
        near, _ = beam(x[places], unit, graph, start, ef)
        for i in range(len(q)):
            c = places[near[i][near[i] >= 0]]
            exact = np.einsum("d,nd->n", q[i], v[c]) / (size[i] * norms[c])
            order = np.lexsort(([ids[j][0] for j in c], -exact))[: k + 1]
            yield c[order], exact[order]

    return find


def op6_ann(spark, sf_dir: str, k: int = 5, every: int = 50) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(valid(F.col("v"), zero=True) & F.col("vec_id").isNotNull()).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return search(queries, indexed(rows, k + 1, build, unit=True), finder(k), k, "double")
