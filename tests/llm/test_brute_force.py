"""The operators without SQL against brute-force versions of their contracts, rows of every odd kind included."""

from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.llm import ann, exact_topk, mixing, packing, quality, token_records, toxicity
from veldt.llm.tokens import Encoder, tokenizer_path
from veldt.llm.vectors import indexed, search, valid

DOCS = "doc_id long, text string, start string, part string"
ODD = [
    (4, "It's <|endoftext|> 12% ÀÉß×÷ é  x", "s", "p"), (1, None, "s", None), (2, "", None, "p"), (3, "  \n ", "s", "p"),
    (5, "Hello, hello WORLD", "s", "p"), (5, "Hello, hello WORLD", "s", "p"), (6, "don't we'll I'd 3rd ﬁ İ ǅ ñ ñ", "s", "p"),
    (7, "ab1" * 20_000, "s", "p"), (8, "word " * 3000, "s", "p"), (None, "no id", "s", "p"), (None, None, "s", "p"),
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text, end: [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1_equals_library(spark, library):
    got = token_records.read_records(token_records.write_records(spark.createDataFrame(ODD, DOCS), tokenizer_path(), 2, shard_bytes=4096)).collect()
    want, start = [], 0
    for doc_id, text, *_ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library(text, 2)
        want.append((doc_id, len(ids), _crc(ids)))
        start += len(ids)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    got = sorted(got, key=lambda r: r.start)
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=key) == sorted(want, key=key)
    assert [r.doc_id for r in got] == [d for d, *_ in want]
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]


def test_clash_of_hashes_and_foreign_files_go_through_the_library(tmp_path):
    texts = ["alpha beta", "gamma it's 7", ""]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    starts = np.cumsum([0, *map(len, texts[:-1])])
    e = Encoder(tokenizer_path())
    want = e.whole(raw, starts)
    e.block(raw, starts)
    e.bytes.data[: e.bytes.n] = 0  # every piece was learned from other bytes
    assert [x.tolist() for x in e.block(raw, starts)] == [x.tolist() for x in want]
    other = tmp_path / "other.json"
    other.write_text(open(tokenizer_path(), encoding="utf-8").read().replace('"type":"Lowercase"', '"type":"NFKC"').replace('"type": "Lowercase"', '"type": "NFKC"'), encoding="utf-8")
    assert not Encoder(str(other)).by_piece and Encoder(tokenizer_path()).by_piece


def test_op2_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None]), round(rng.random(), 3)) for i in range(200)] + [(900, "lone", "x", 0.5), (901, "lone2", None, 0.5)]
    scored = spark.createDataFrame(rows + rows[:3], "doc_id long, host string, path string, p double")
    rows = rows + rows[:3]
    hosts, paths = defaultdict(list), defaultdict(list)
    for _, h, x, p in rows:
        hosts[h].append(p)
        paths[h, x].append(p)
    n, s = len(rows), sum(r[3] for r in rows)

    def worth(within, groups, parents, n_parents):
        between = sum(sum(g) ** 2 / len(g) for g in groups.values()) - sum(sum(g) ** 2 / len(g) for g in parents.values()) - (len(groups) - n_parents) * within
        return max(1.0, min(1e6, within / max(1e-9, between / max(1e-9, n - spread)) - 1))

    all_ = {0: [r[3] for r in rows]}
    spread = sum(len(g) ** 2 for g in hosts.values()) / n
    wh = worth(s / n * (1 - s / n), hosts, all_, 1)
    spread = sum(sum(len(g) ** 2 for (h, _), g in paths.items() if h == k) / len(own) for k, own in hosts.items())
    wp = worth(sum(sum(g) * (1 - sum(g) / len(g)) for g in hosts.values()) / n, paths, hosts, len(hosts))
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    got = quality.combine(scored, *quality.posteriors(scored)).collect()
    assert len(got) == n
    for r in got:
        rate = (s - r.p) / (n - 1)
        host = (sum(hosts[r.host]) - r.p + wh * rate) / (len(hosts[r.host]) - 1 + wh)
        path = (sum(paths[r.host, r.path]) - r.p + wp * host) / (len(paths[r.host, r.path]) - 1 + wp)
        odds = logit(r.p) - logit(rate) + logit(path)
        assert abs(r.host_rate - host) < 1e-9 and abs(r.path_rate - path) < 1e-9 and abs(r.quality - 1 / (1 + math.exp(-odds))) < 1e-9


def test_op5_measure_equals_brute_force():
    lexicon = toxicity.Lexicon({"idio": 3.0, "idiot": 5.0, "moron": 4.0}, {"kind idiot", f"moron {'z' * 60}"}, (0.0, 0.0, 0.0))
    texts = ["", "1d10t!", "kind idiot, an idiot; idioms", f"moron {'z' * 60} x moron", "a_moron sidiot іdiоt", "idiot " * 3000]
    for text in texts:
        folded = toxicity.fold(text)
        words = [(m.start(), m[0]) for m in toxicity._WORD.finditer(folded)]
        total = 0.0
        for i, (_, w) in enumerate(words):
            weight = max((x for e, x in lexicon.weights.items() if w.startswith(e)), default=0)
            near = {f"{words[i - 1][1]} {w}" if i else "", f"{w} {words[i + 1][1]}" if i + 1 < len(words) else ""}
            total += 0 if near & lexicon.exceptions else weight
        # a word after an underscore begins a word of its own, as for the matcher
        assert lexicon.measure(text) == (math.log1p(total), 100 * total / (len(folded) + 200)), text[:40]


def test_op5_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "you idiot"), (3, "you idiot"), (4, "fine " * 20_000), (None, "x")] + [(100 + i, "rude idiot" if i % 2 else "fine day") for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(40)], "doc_id long, toxic int")
    lexicon = toxicity.learn(frame, labels)
    got = defaultdict(set)
    for r in frame.select("doc_id", toxicity.score(lexicon)("text").alias("s")).collect():
        got[r.doc_id].add(r.s)
    assert all(len(v) == 1 for v in got.values()) and got[1] == got[2] and min(got[3]) > max(got[4])
    assert toxicity.learn(frame, labels.filter("toxic = 0")).score(np.zeros((1, 2)))[0] < 1e-6
    assert frame.limit(0).select(toxicity.score(lexicon)("text")).count() == 0


def _vector_rows():
    rng = np.random.default_rng(2)
    v = np.round(np.concatenate([rng.normal(size=(250, 8)), rng.normal(size=(250, 8)) + 30]) * 20)
    v[400:] = v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(600, None), (650, [1.0, None]), (700, [float("nan")] * 8), (750, [float("inf")] * 8), (800, [0.0] * 8), (850, []), (900, [1.0, 2.0]), (901, [2.0, 1.0]), (3, rows[7][1])]
    return rows


def _vector_wants(rows, cosine):
    ok = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and (not cosine or any(v))]
    want = {}
    for i, q in ok:
        if i % 50 == 0:
            found = []
            for j, v in ok:
                if j != i and len(v) == len(q):
                    s = sum(a * b for a, b in zip(q, v))
                    found.append((-(s / math.sqrt(sum(a * a for a in q)) / math.sqrt(sum(b * b for b in v)) if cosine else s), j))
            want[i] = sorted(found)[:5]
    return want


def test_op9_equals_brute_force(spark):
    rows = _vector_rows()
    frame = spark.createDataFrame(rows, "vec_id long, v array<double>").filter(valid(F.col("v"), zero=False))
    q = frame.filter("vec_id % 50 = 0").selectExpr("vec_id as query_id", "v as q")
    got = search(q, indexed(frame, 6, exact_topk.cover_tree, shard=64), exact_topk.finder(5), 5, "long").collect()
    want = _vector_wants(rows, False)
    mine = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        mine[r.query_id].append((-r.score, r.vec_id))
    assert mine == {k: [(int(s), j) for s, j in v] for k, v in want.items() if v}


def test_op6_finds_brute_force_neighbours(spark):
    rows = _vector_rows()
    frame = spark.createDataFrame(rows, "vec_id long, v array<double>").filter(valid(F.col("v"), zero=True))
    q = frame.filter("vec_id % 50 = 0").selectExpr("vec_id as query_id", "v as q")
    got = search(q, indexed(frame, 6, ann.build, unit=True, shard=64), ann.finder(5), 5, "double").collect()
    want = _vector_wants(rows, True)
    score = {(r.query_id, r["rank"]): r.score for r in got}
    hits = sum(abs(score.get((k, n + 1), -9) + s) < 1e-12 for k, v in want.items() for n, (s, _) in enumerate(v))
    assert hits >= 0.95 * sum(map(len, want.values()))
    none = frame.limit(0)
    assert search(none.selectExpr("vec_id as query_id", "v as q"), indexed(none, 6, ann.build, unit=True), ann.finder(5), 5, "double").count() == 0


def test_op6_recall_on_the_embeddings(spark):
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01"
    got = defaultdict(dict)
    for r in ann.op6_ann(spark, path).collect():
        got[r.query_id][r.vec_id] = r.score
    t = pq.read_table(f"{path}/embeddings.parquet").to_pylist()
    t = [(r["vec_id"], np.array(r["embedding"], float)) for r in t if r["embedding"] and None not in r["embedding"] and np.isfinite(np.array(r["embedding"], float)).all() and any(r["embedding"])]
    ids, v = np.array([i for i, _ in t]), np.stack([x for _, x in t])
    unit, hits, all_ = v / np.linalg.norm(v, axis=1)[:, None], 0, 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[q]
        best = [ids[j] for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:5]
        hits, all_ = hits + len(set(best) & set(got[ids[q]])), all_ + len(best)
    assert hits >= 0.95 * all_


def test_cover_tree_and_pruned_pairs():
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(300, 4)) + 100 * c for c in rng.normal(size=(8, 4))])
    links, radii = exact_topk.cover_tree(v)
    nodes, order = exact_topk.unpack(links)
    assert sorted(order) == list(range(len(v)))
    for at, (centre, first, count, begin, end) in enumerate(nodes.tolist()):
        assert np.linalg.norm(v[order[begin:end]] - v[centre], axis=1).max() <= radii[at] + 1e-9
        if count:
            goal = exact_topk.BASE ** (math.ceil(math.log(radii[at], exact_topk.BASE)) - 1)
            own = v[nodes[first : first + count, 0]]
            apart = np.linalg.norm(own[:, None] - own[None], axis=2) + 1e9 * np.eye(count)
            assert nodes[first, 0] == centre and apart.min() > goal - 1e-6 and radii[first : first + count].max() <= goal + 1e-6
    seen: list = []
    exact_topk.finder(5, seen)(v[::20], v, [[i] for i in range(len(v))], links, radii, np.full(120, -np.inf))
    assert seen[0][0] < 0.5 * seen[0][1]  # most pairs are never scored


def test_products_beyond_doubles():
    a, b = np.array([[2.0**31, 1.0]]), np.array([[2.0**31, 1.0], [2.0**31, 2.0], [2.0**31, 0.0]])
    assert exact_topk.products(a, b).tolist() == [[2**62 + 1, 2**62 + 2, 2**62]]
    assert exact_topk.products(a * 2.0**20, b * 2.0**20).tolist() == [[2**63 - 1] * 3]
    links, radii = exact_topk.cover_tree(b)
    (found, scores), = exact_topk.finder(3)(a, b, [[0], [1], [2]], links, radii, np.array([-np.inf]))
    assert found.tolist() == [1, 0, 2] and scores.tolist() == [2**62 + 2, 2**62 + 1, 2**62]


def test_op7_pieces_equal_library(spark, library):
    cut = packing.pieces(spark.createDataFrame(ODD, DOCS), tokenizer_path(), 0, 64)
    got = packing.pack(cut, 64).collect()
    want = []
    for doc_id, text, *_ in ODD:
        ids = library(text, 0)
        want += [(doc_id, k, s, len(ids[s : s + 64]), _crc(ids[s : s + 64])) for k, s in enumerate(range(0, len(ids), 64))]
    key = lambda r: (r[0] or -1, r[1], r[4])
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=key) == sorted(want, key=key)


def test_local_search_raises_squared_fill():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 60, 60).tolist()
        bins = [[i] for i in range(60)]
        search_ = packing.Search(lengths, bins, 100)
        before = int((search_.fill**2).sum())
        for a in range(60):
            while 0 < search_.fill[a] < 100 and search_.step(a):
                now = int((search_.fill**2).sum())
                assert now > before and search_.fill.max() <= 100
                before = now
        assert [sum(lengths[i] for i in b) for b in search_.bins] == search_.fill.tolist()
        assert len(packing.pack_group(lengths, 100)) <= len(packing.best_fit(lengths, 100))


def _cheapest(patterns, quotas, repeats):
    """Least cost of a maximum flow, by trying all whole flows of a tiny instance."""
    import itertools

    arcs = [(i, s) for i, (own, _) in enumerate(patterns) for s in own]
    best = None
    for flow in itertools.product(*[range(min(repeats * patterns[i][1], quotas[s]) + 1) for i, s in arcs]):
        if any(sum(f for f, (_, t) in zip(flow, arcs) if t == s) > q for s, q in quotas.items()):
            continue
        used = [sum(f for f, (j, _) in zip(flow, arcs) if j == i) for i in range(len(patterns))]
        if any(u > repeats * w for u, (_, w) in zip(used, patterns)):
            continue
        cost = sum(max(0, u - w) for u, (_, w) in zip(used, patterns))
        best = min(best, (-sum(flow), cost)) if best else (-sum(flow), cost)
    return best


def test_op10_flow_is_cheapest_and_always_runs(monkeypatch):
    rng = random.Random(8)
    runs = []
    run = mixing.Flow.run
    monkeypatch.setattr(mixing.Flow, "run", lambda self, *a: runs.append(1) or run(self, *a))
    for _ in range(40):
        patterns = [(own, rng.randrange(0, 3)) for own in [("a",), ("b",), ("a", "b"), (None, "b")][: rng.randrange(1, 5)]]
        quotas = {s: rng.randrange(0, 5) for own, _ in patterns for s in own}
        got = mixing.route(patterns, quotas, 2)
        used = [sum(f.values()) for f in got]
        assert all(sum(f.get(s, 0) for f in got) <= q for s, q in quotas.items())
        assert (-sum(used), sum(max(0, u - w) for u, (_, w) in zip(used, patterns))) == _cheapest(patterns, quotas, 2)
    assert len(runs) == 80
    single = [((s,), 7 * k) for k, s in enumerate("abc")]
    assert [f.get(own[0], 0) for f, (own, _) in zip(mixing.route(single, {"a": 3, "b": 9, "c": 99}), single)] == [0, 9, 28]


def test_op10_takes_what_the_contract_says(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(["w"] * rng.randrange(0, 30)), rng.choice(["s1", "s2", "s3", "s4", None])) for i in range(300)]
    docs += [(900, None, "s1"), (7, "twice two", "s2"), (7, "twice two", "s2")]
    frame = mixing.members(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    sources, flows = mixing.plan(frame)
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len((t or "").split())
    names, weights = ["s1", "s2", "s3", "s4", None], [5, 2, 1, 5, 2]
    goal, left, active = {}, 1.5 * sum(sizes.values()), set(names)
    while active:
        total = sum(weights[names.index(s)] for s in active)
        over = {s for s in active if left * weights[names.index(s)] / total > 2 * sizes[s]}
        for s in over or active:
            goal[s] = 2.0 * sizes[s] if over else left * weights[names.index(s)] / total
        left -= sum(goal[s] for s in over)
        active = active - over if over else set()
    assert [(s["source"], s["source_size"]) for s in sources] == [(s, sizes[s]) for s in names]
    assert all(abs(s["target"] - goal[s["source"]]) < 1e-6 for s in sources)
    got = mixing.select(frame, flows).collect()
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    assert len(got) == len(docs) and all(abs(taken[s] - goal[s]) <= 15 for s in names)
    again = mixing.select(frame, flows).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    empty = frame.limit(0)
    assert mixing.select(empty, mixing.plan(empty)[1]).count() == 0
