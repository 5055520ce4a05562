"""Operator 5: toxicity by a weighted lexicon, matched with Aho-Corasick.

Texts are folded first: case, look-alike letters of other scripts, digits and signs that stand for letters,
invisible characters. Lexicon entries are word beginnings of 4 to 12 folded letters; an entry's weight is its
smoothed log odds of occurring in toxic against other documents, learned from at most about FIT_ROWS labelled
training rows. A phrase of two words that only clean training documents hold is an exception: a match inside it
does not count. A document's measure is the weight of its matches, in all and by its length; a logistic curve
fitted on the same rows turns it into a score.

Only the text enters a score. Null and empty texts have no match and get the curve's value there. Without
training rows of both kinds every score is the share of toxic rows (0 without any). Repeated rows score alike;
other
columns are not looked at; an empty table gives no rows. On the driver: FIT_ROWS pairs of numbers, and the lexicon and
its exceptions, whole: both hold only what three rows of that sample or more contain.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table, written

FIT_ROWS = 12_000
#: An entry occurs in at least so many toxic rows, and in this share of them.
MIN_DOCS, MIN_SHARE = 3, 0.003
MIN_WEIGHT = 3.0
SHORTEST, LONGEST = 4, 12
TOXIC = 0.7

# Look-alikes of Latin letters, digits and signs that stand for letters, invisible characters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "ε": "e", "η": "n",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɡ": "g", "ı": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

_FOLD = {ord(k): v for k, v in (LOOKALIKES | DIGITS).items()} | {ord(c): None for c in INVISIBLE}
_FOLD |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    return text.casefold().translate(_FOLD)


def beginnings(text: str) -> set[str]:
    """The folded word beginnings that could be lexicon entries."""
    return {w[:n] for w in set(_WORD.findall(text)) for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}


class Lexicon:
    """Entries with weights, exceptions and the curve; sent to every task."""

    def __init__(self, weights: dict[str, float], exceptions: set[str], curve: tuple[float, ...]):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self._machine = None

    def __getstate__(self):
        return (self.weights, self.exceptions, self.curve)

    def __setstate__(self, state):
        self.__init__(*state)

    def machine(self):
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for entry, w in self.weights.items():
                self._machine.add_word(entry, (len(entry), w))
            self._machine.make_automaton()
        return self._machine

    def matches(self, folded: str) -> list[tuple[int, float]]:
        """Start and weight of the heaviest entry at each word that begins with one."""
        if not self.weights:
            return []
        found: dict[int, float] = {}
        for end, (n, w) in self.machine().iter(folded):
            at = end - n + 1
            if (at == 0 or not folded[at - 1].isalnum()) and w > found.get(at, 0):
                found[at] = w
        return sorted(found.items())

    def measure(self, text: str) -> tuple[float, float]:
        """Weight of the matches outside exceptions: in all, and for each hundred characters."""
        folded = fold(text)
        found = self.matches(folded)
        near = phrases(folded, [at for at, _ in found]) if self.exceptions and found else {}
        total = sum(w for at, w in found if self.exceptions.isdisjoint(near.get(at, ())))
        return math.log1p(total), 100 * total / (len(folded) + 200)

    def score(self, measures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + measures @ np.asarray(self.curve[1:]), -30, 30)))


def phrases(folded: str, at: list[int]) -> dict[int, list[str]]:
    """For each place where a word begins, the word with the one before it and with the one after it."""
    words = list(_WORD.finditer(folded))
    place = {m.start(): i for i, m in enumerate(words)}
    out = {}
    for x in at:
        if (i := place.get(x)) is not None:
            out[x] = [f"{a[0]} {b[0]}" for a, b in zip(words[max(0, i - 1) : i + 1], words[max(0, i - 1) + 1 : i + 2])]
    return out


def _counted(rows: DataFrame, of, schema: str = "entry string, toxic long, clean long") -> DataFrame:
    """Documents of each kind that hold an entry; each batch is counted before the shuffle."""

    def count(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if y else clean).update(of(text or ""))
            if len(toxic) + len(clean) > 2_000_000:
                yield _pairs(toxic, clean)
                toxic, clean = Counter(), Counter()
        yield _pairs(toxic, clean)

    return rows.mapInArrow(count, schema).groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _pairs(toxic: Counter, clean: Counter) -> pa.RecordBatch:
    keys = list(toxic | clean)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], ["entry", "toxic", "clean"])


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """docs(doc_id, text) and labels(doc_id, toxic), training rows only."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("_y"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    share = min(1.0, fit_rows / max(1, n))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = written(docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "_y"), "toxicity-sample")
    ny = rows.groupBy().agg(F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("p")).first()
    if not ny.p or ny.p == ny.n:
        rate = toxic / n if n else 0.0
        return Lexicon({}, set(), (math.log(max(rate, 1e-9) / max(1 - rate, 1e-9)), 0.0, 0.0))
    odds = F.log((F.col("toxic") + 0.5) / F.lit(ny.p + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(ny.n - ny.p + 1.0))
    found = _counted(rows, lambda t: beginnings(fold(t))).withColumn("weight", odds)
    found = found.filter((F.col("toxic") >= max(MIN_DOCS, MIN_SHARE * ny.p)) & (F.col("weight") >= MIN_WEIGHT))
    top = found.orderBy(F.desc("toxic"), F.length("entry"), "entry").collect()
    weights: dict[str, float] = {}
    for r in top:  # a longer entry stays only where it says clearly more than a shorter one that begins it
        shorter = max((weights.get(r.entry[:k], 0.0) for k in range(SHORTEST, len(r.entry))), default=0.0)
        if r.weight > shorter + 1.0:
            weights[r.entry] = r.weight
    lexicon = Lexicon(weights, set(), (0.0, 0.0, 0.0))

    def held(text: str) -> set[str]:
        folded = fold(text)
        return {p for near in phrases(folded, [at for at, _ in lexicon.matches(folded)]).values() for p in near}

    benign = _counted(rows, held).filter("toxic = 0 and clean >= 3")
    lexicon.exceptions = {fold(x) for x in exceptions} | {r.entry for r in benign.collect()}

    def measure(batches):
        for batch in batches:
            x = np.array([lexicon.measure(t or "") for t in batch.column(0).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.float64()), pa.array(x[:, 0]), pa.array(x[:, 1])], ["y", "a", "b"])

    got = rows.mapInArrow(measure, "y double, a double, b double").toPandas().sort_values(["y", "a", "b"])
    lexicon.curve = _curve(got[["a", "b"]].to_numpy(), got.y.to_numpy())
    return lexicon


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    a, w = np.hstack([np.ones((len(x), 1)), x]), np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(3), a.T @ (p - y) + 0.05 * w * [0, 1, 1])
    return tuple(map(float, w))


def score(lexicon: Lexicon):
    @F.arrow_udf("double")
    def s(text: pa.Array) -> pa.Array:
        x = np.array([lexicon.measure(t or "") for t in text.to_pylist()]).reshape(-1, 2)
        return pa.array(lexicon.score(x))

    return s


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold_ = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    lexicon = learn(docs, labels.filter(fold_ != 1))
    out = docs.select("doc_id", F.coalesce(fold_ == 1, F.lit(False)).alias("held_out"), score(lexicon)(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))
