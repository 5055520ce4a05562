"""The pipeline: every stage against a brute-force version of its decisions, and columns with clashing names."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veldt.llm import jaccard, mixing, quality, suffix_dedup

EXTRA = ["row", "number", "host", "path", "p", "_gone", "_row", "doc", "mark", "size", "pattern", "copy", "copies", "kept", "_slice", "_key", "region", "node"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def _docs():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = []
    for i in range(40):
        own = [rng.choice(words) for _ in range(80)]
        texts.append(" ".join(own))
        if i % 5 == 0:
            texts.append(" ".join([*own[:-1], "changed"]))
        if i % 7 == 0:
            texts.append(f"{' '.join(own[:30])} {passage} tail {i}")
        if i % 9 == 0:
            texts.append("JUNK!! " * 12 + str(i))
    rows = [(i, t, "en", ["s1", "s2", None][i % 3], len(t)) for i, t in enumerate(texts)]
    rows += [(900, None, "en", "s1", 0), (901, "", None, "s2", 0), (902, "x" * 30_000, "en", "s1", 30_000), (None, "no id at all here", "en", None, 5), rows[3], (3, "same id, another text", "en", "s1", 1)]
    return [(*r, *[f"{c}{k}" for c in EXTRA]) for k, r in enumerate(rows)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("stages")
    rows = _docs()
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], int("JUNK" not in r[1]), 0) for r in rows if r[0] is not None and r[1]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def steps(spark, folder):
    """The rows after each stage."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, folder)
        found.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append((docs.columns, [tuple(r) for r in docs.collect()]))
    return out


def test_columns_pass_through(steps):
    own = {r[5]: r for r in _docs()}  # the first extra column names the row
    names = [c.split()[0].strip("`") for c in COLUMNS.split(", ")]
    for columns, rows in steps[:4]:
        assert columns == names
        for r in rows:
            assert r[5:] == own[r[5]][5:] and r[0] == own[r[5]][0] and r[2:4] == own[r[5]][2:4]


def test_quality_keeps_what_the_posterior_keeps(spark, folder, steps):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = docs.select(F.col("row").alias("key"), F.col("source").alias("host"), F.col("lang").alias("path"), quality.evidence(model)("text").alias("p"))
    want = {r.key for r in quality.combine(scored, *quality.posteriors(scored)).collect() if r.quality >= quality.KEEP}
    assert {r[5] for r in steps[0][1]} == want and not any("JUNK" in (r[1] or "") for r in steps[0][1])


def test_near_duplicates_equal_brute_force(steps):
    before, after = steps[0][1], steps[1][1]
    sets = []
    for r in before:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(before)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[max(top(i), top(j))] = min(top(i), top(j))
    groups: dict[int, list] = {}
    for i, r in enumerate(before):
        groups.setdefault(top(i), []).append(r)
    assert len(after) == len(groups) < len(before)
    kept = Counter(r[5] for r in after)
    for group in groups.values():
        assert sum(kept[r[5]] for r in group) == 1
        known = [r[0] for r in group if r[0] is not None]
        if known:
            assert [r[0] for r in group if kept[r[5]]] == [min(known)]


def test_repeated_strings_equal_brute_force(steps):
    before, after = steps[1][1], {r[5]: r for r in steps[2][1]}
    seen: set = set()
    order = sorted(before, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(after) == len(before)
    for r in order:
        data = (r[1] or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            gone[i : i + 100] |= data[i : i + 100] in seen
            seen.add(data[i : i + 100])
        left = bytes(np.frombuffer(data, np.uint8)[~gone]).decode()
        assert after[r[5]][1] == left and after[r[5]][4] == len(left)


def test_mixing_repeats_what_select_says(spark, folder, steps):
    before, after = steps[2][1], Counter(r[5] for r in steps[3][1])
    frame = mixing.members(spark.read.parquet(f"{folder}/repeated_strings").select("doc_id", "text", "source", F.col("row").alias("name")))
    sources, flows = mixing.plan(frame)
    copies = {r.name: r.copies for r in mixing.select(frame, flows).collect()}
    assert all(after[r[5]] == copies[r[5]] for r in before)
    for s in sources:
        words = sum(after[r[5]] * len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in before if r[3] == s["source"])
        assert abs(words - s["target"]) <= 100


def test_packing_places_every_token(steps):
    columns, rows = steps[4]
    at = {c: i for i, c in enumerate(columns)}
    from tokenizers import Tokenizer

    from veldt.llm.tokens import tokenizer_path

    tokenizer = Tokenizer.from_file(tokenizer_path())
    total = sum(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in steps[3][1])
    assert sum(r[at["length"]] for r in rows) == total
    bins: dict = {}
    for r in rows:
        bins.setdefault(r[at["sequence_id"]], []).append((r[at["offset"]], r[at["length"]]))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048


def test_run_is_the_stages(spark, folder, steps):
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == Counter(r[:2] + r[3:5] for r in steps[4][1])


@pytest.mark.parametrize("stage", range(4))
def test_empty_tables_stay_empty(spark, folder, stage):
    none = spark.createDataFrame([], COLUMNS)
    out = corpus_pipeline.STAGES[stage][1](spark, none, folder)
    assert out.columns == none.columns and out.count() == 0


def test_dedup_tells_repeated_and_missing_ids_apart(spark):
    a, b = "a" * 50 + "repeat " * 30, "b" * 50 + "repeat " * 30
    docs = [(1, a), (1, b), (1, b), (None, a), (2, a), (3, "y" * 200_000)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.dedup(rows).collect())
    assert [g[0] for g in got] == [0, 1, 1, 1, 2, 3]
    assert got[4][2:] == (len(a), hashlib.sha256(b"").hexdigest()) and got[5][2] == 199_999


def test_near_duplicates_of_long_texts(spark):
    rng = random.Random(2)
    long_ = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    docs = [(1, " ".join(long_)), (2, " ".join([*long_[:-5], "x"])), (3, " ".join(long_[:30_000])), (3, "short one"), (3, "short one")]
    got = {(r.doc_id, r.n_shingles): r for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect()}
    assert {k[0]: r.component_id for k, r in got.items()} == {1: 1, 2: 1, 3: 3} and sorted(r.links for r in got.values()) == [0, 0, 1, 1]
