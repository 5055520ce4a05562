"""The ten operators against brute force, round trips and defined results, on small fixtures."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from veldt.llm import chat, jaccard, mixing, packing, quality, suffix_dedup, token_records, toxicity
from veldt.llm.suffixes import of_names, plcp, suffix_array
from veldt.llm.tokens import Encoder, tokenizer_path

ODD = [(1, None), (2, ""), (3, "  \n "), (4, "It's <|endoftext|> 12% ÀÉß×÷ é  x"), (5, "Hello, hello WORLD"), (5, "Hello, hello WORLD"), (None, "no id"), (7, "x" * 50_000)]
DOCS = "doc_id long, text string"


def test_encoder_equals_library():
    e = Encoder(tokenizer_path())
    texts = [t for _, t in ODD]
    got = []
    for _, ids, counts in e.ids(pa.array(texts, pa.string())):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [x.ids for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_records_round_trip(spark):
    manifest = token_records.write_records(spark.createDataFrame(ODD, DOCS), tokenizer_path(), 2, shard_bytes=4096)
    rows = sorted(token_records.read_records(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 5, 7]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    m = manifest.first()
    assert len(list(token_records.read_at(m.path, m.index_path, range(m.records)))) == m.records
    with pytest.raises(ValueError):
        bad = bytearray(token_records.frame(b"abc"))
        bad[13] ^= 1
        token_records.unframe(memoryview(bytes(bad)), 0)


def test_packing_places_every_piece(spark):
    cut = packing.pieces(spark.createDataFrame(ODD, DOCS), tokenizer_path(), 0, 64)
    rows = packing.pack(cut, 64).collect()
    assert len(rows) == cut.count()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64


def test_local_search_empties_bins():
    lengths = [6, 6, 6, 4, 4, 4, 3, 3, 3, 3, 5, 5, 5, 5]
    bins = packing.pack_group(lengths, 10)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 10 for b in bins) and len(bins) <= packing.lower_bound(lengths, 10) + 1


def _shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def _components(docs, width, t):
    sets = {d: _shingles(x, width) for d, x in docs}
    root = {d: d for d in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_jaccard_equals_brute_force_with_cut_regions(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(3)]
    docs = []
    for i in range(150):
        own = list(base[i % 3])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            own[rng.randrange(60)] = rng.choice(words)
        docs.append((i, " ".join(own)))
    docs += [(900, None), (901, ""), (902, "a b"), (903, "A b"), (904, "x")]
    got = jaccard.jaccard_components(spark.createDataFrame([*docs, (None, "a b")], DOCS), 4, 85, leaf=12, block=6).collect()
    want = _components(docs, 4, 85)
    assert len(got) == len(docs) + 1
    assert all(want[r.doc_id] == (r.n_shingles, r.component_id) for r in got if r.doc_id is not None)
    own = {d: frozenset(_shingles(x, 4)) for d, x in docs}
    linked = {a: sum(100 * len(a & b) >= 85 * len(a | b) for b in set(own.values()) if a and b and a != b) for a in own.values()}
    assert all(linked[own[r.doc_id]] == r.links for r in got if r.doc_id is not None)


def test_jaccard_copy_without_id_hides_no_link(spark):
    words = [f"w{i}" for i in range(60)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    docs = spark.createDataFrame([(None, text), (1, text), (2, near)], DOCS).coalesce(1)
    got = {r.doc_id: (r.component_id, r.links, r.class_size) for r in jaccard.jaccard_components(docs, 4, 85).collect()}
    assert got == {None: (None, 0, 1), 1: (1, 1, 1), 2: (1, 1, 1)}


def test_near_duplicates_go_by_row(spark):
    words = [f"w{i}" for i in range(60)]
    text, near, own, lone = " ".join(words), " ".join([*words[:-1], "other"]), " ".join(words[::-1]), " ".join(words[::2])
    docs = [(5, near), (1, text), (5, own), (5, own), (None, text), (None, lone), (None, lone), (None, None), (8, "")]
    got = jaccard.stage(spark, spark.createDataFrame(docs, DOCS), "").collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([(1, text), (5, own), (None, lone), (None, None), (8, "")], DOCS).collect()))


def test_suffix_array_and_plcp():
    rng = np.random.default_rng(1)
    for trial in range(60):
        t = rng.integers(0, int(rng.choice([1, 2, 3, 30])), int(rng.integers(1, 120)))
        sa = suffix_array(t)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert of_names(t.tolist(), int(t.max()) + 1) == sa.tolist()
        raw = t.astype(np.uint8)
        common = plcp(raw, sa, 20)
        for a, b in zip(sa, sa[1:]):
            n = 0
            while n < 20 and max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
                n += 1
            assert common[b] == n


def test_suffix_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    parts = ["".join(rng.choice("abcdefgh é") for _ in range(400)) for _ in range(4)]
    docs = [(i, "".join(rng.choice([parts[rng.randrange(4)][rng.randrange(300) :][:200], "x" * rng.randrange(1, 300)]) for _ in range(rng.randrange(0, 7)))) for i in range(60)]
    docs += [(500, None), (501, ""), (502, "é" * 300), (503, "ab" * 400)]
    seen, want = set(), {}
    for d, x in sorted(docs, key=lambda r: r[0]):
        b = (x or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            gone[i : i + 100] |= w in seen
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want[d] = (len(b), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    for r in suffix_dedup.dedup(spark.createDataFrame(docs, DOCS)).collect():
        assert want[r.doc_id] == (r.n_bytes, r.n_removed, r.kept_sha256)


def test_flow_prefers_first_uses():
    got = mixing.route([(("a", "b"), 10), (("a",), 10), (("b",), 10)], {"a": 15, "b": 15})
    assert sum(sum(f.values()) for f in got) == 30 and all(sum(f.values()) <= 10 for f in got)
    got = mixing.route([(("a", "b"), 10), (("a",), 10)], {"a": 25, "b": 5})
    assert sum(sum(f.values()) for f in got) == 30


def test_mixing_meets_targets(spark):
    docs = [(i, " ".join(["w"] * (1 + i % 17)), [None, "a", "b", "c"][i % 4]) for i in range(400)] + [(900, None, "a")]
    rows = mixing.members(spark.createDataFrame(docs, DOCS + ", source string"))
    sources, flows = mixing.plan(rows)
    got = mixing.select(rows.select("doc_id", "pattern", "size"), flows).collect()
    taken = Counter()
    for r in got:
        assert r.copies <= 2
        taken[r.pattern[0]] += r.copies * r.size
    assert len(got) == len(docs)
    for s in sources:
        assert abs(taken[s["source"]] - s["target"]) <= 20


def test_chat_round_trip(spark):
    told = [(1, 0, "system", "s[x]|\\("), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "a\\\\[/]b"), (1, 3, "user", None), (1, 4, "assistant", "word " * 40), (2, 0, None, "")]
    rows = spark.createDataFrame(told, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.windows(rows, budget=10)).collect()}
    want = "".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in told if c == 1)
    loss = "".join(t for c, _, r, t in told if c == 1 and r == "assistant")
    assert got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[1].n_turns == 5
    assert got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[1].loss_chars == len(loss) and got[1].windows > 1


def test_toxicity_folds_and_scores(spark):
    docs = [(i, ("you 1d10t " if i % 5 == 0 else "kind words ") + f"here {i}") for i in range(300)] + [(900, None), (901, "you i​diоt here")]
    frame = spark.createDataFrame(docs, DOCS)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    lexicon = toxicity.learn(frame, labels)
    got = {r.doc_id: r.s for r in frame.select("doc_id", toxicity.score(lexicon)("text").alias("s")).collect()}
    assert min(got[i] for i in range(0, 300, 5)) > max(got[i] for i in range(300) if i % 5) and got[901] > 0.7 > got[900]


def test_quality_shrinks_and_survives_odd_rows(spark):
    docs = [(i, ("JUNK!! " * 9 if i % 4 == 0 else "some quiet words, in order. ") + f"{i}", "big" if i else "tiny", None) for i in range(200)] + [(900, None, None, "en")]
    frame = spark.createDataFrame(docs, DOCS + ", host string, path string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 200)], "doc_id long, quality int")
    scored = frame.select("doc_id", "host", "path", quality.evidence(quality.train(frame, labels))("text").alias("p"))
    rows = {r.doc_id: r for r in quality.combine(scored, *quality.posteriors(scored)).collect()}
    assert len(rows) == 201 and all((rows[i].quality >= 0.5) == (i % 4 != 0) for i in range(1, 200))


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert token_records.read_records(token_records.write_records(none, tokenizer_path(), 2)).count() == 0
    assert packing.pack(packing.pieces(none, tokenizer_path(), 0, 64), 64).count() == 0
    assert suffix_dedup.dedup(none).count() == 0
    assert jaccard.jaccard_components(none, 4, 85).count() == 0
    assert chat.digest(chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
