"""Operator 2: quality by hierarchical empirical Bayes.

A document's own evidence is a logistic classifier over surface measures of its whole text (case, signs, table
bars, repeated words, word lengths, ...), fitted on at most FIT_ROWS labelled rows. Its expected labels are
summed by host and by path within host. A host's rate shrinks towards the global rate with the strength that the
spread between hosts supports, a path's towards its host's with the strength that the spread between paths of a host
supports (method of moments for each level), so sparse sites stay near their parents. The posterior odds of a document
are its likelihood ratio times its path's prior odds, and its own evidence is left out of the sums behind that prior.

Every grouped sum pre-aggregates before its shuffle; posteriors are one row for each path. Defined results: a
null or empty text has measures of 0; a null host or path is a group of its own; repeated rows count each;
without labelled rows of both kinds every document's own probability is 0.5; other columns are not looked at; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import nested, table, written
from .tokens import _BASE, _CODE, powers, text_bytes

#: At most about so many labelled rows fit the classifier; chosen by a hash of doc_id.
FIT_ROWS = 20_000
KEEP = 0.5
#: Up to so many paths their sums are sent to every task; more are joined by a shuffle.
BROADCAST = 10_000
MEASURES = ("upper", "signs", "bars", "digits", "high", "spaces", "word_length", "distinct", "stutter", "lines", "marks", "size", "short")
_BLOCK = 1 << 19


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.float64)])
    return upto[bounds[1:]] - upto[bounds[:-1]]


def _block(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    texts, n = len(bounds) - 1, len(raw)
    size = np.maximum(np.diff(bounds), 1).astype(float)
    upper = (raw >= 65) & (raw <= 90)
    lower = (raw >= 97) & (raw <= 122)
    digit = (raw >= 48) & (raw <= 57)
    high = raw >= 128
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    plain = (raw == 44) | (raw == 46)
    sign = ~(upper | lower | digit | high | space | plain)
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    begin_text = np.zeros(n, bool)
    begin_text[bounds[:-1][bounds[:-1] < n]] = True
    solid = ~space
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | begin_text))
    words = np.bincount(owner[starts], minlength=texts).astype(float)
    out = np.zeros((texts, len(MEASURES)))
    letters = _per_text(upper | lower, bounds)
    out[:, 0] = _per_text(upper, bounds) / np.maximum(letters, 1)
    out[:, 1] = _per_text(sign, bounds) / size
    out[:, 2] = _per_text(raw == 124, bounds) / np.maximum(words, 1)
    out[:, 3] = _per_text(digit, bounds) / size
    out[:, 4] = _per_text(high, bounds) / size
    out[:, 5] = _per_text(space, bounds) / size
    out[:, 6] = np.minimum(_per_text(solid, bounds) / np.maximum(words, 1), 40) / 10
    out[:, 9] = _per_text(raw == 10, bounds) / np.maximum(words, 1)
    out[:, 10] = _per_text(plain, bounds) / np.maximum(words, 1)
    out[:, 11] = np.log1p(np.diff(bounds)) / 10
    out[:, 12] = words < 4
    if len(starts):
        event = np.flatnonzero((space & before) | begin_text)
        after = np.searchsorted(event, starts, side="right")
        ends = np.where(after < len(event), event[np.minimum(after, len(event) - 1)], n) if len(event) else np.full(len(starts), n)
        with np.errstate(over="ignore"):
            total = np.empty(n + 1, np.uint64)
            total[0] = 0
            np.cumsum(_CODE[raw] * powers(_BASE, n), out=total[1:])
            hashes = (total[ends] - total[starts]) * powers(pow(_BASE, -1, 1 << 64), n)[starts]
        who = owner[starts]
        same = (hashes[1:] == hashes[:-1]) & (who[1:] == who[:-1])
        out[:, 8] = np.bincount(who[1:][same], minlength=texts) / np.maximum(words, 1)
        order = np.lexsort((hashes, who))
        first = np.ones(len(order), bool)
        first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (who[order][1:] != who[order][:-1])
        distinct = np.bincount(who[order][first], minlength=texts)
        # the share of distinct words falls with length for any text: compare on a log scale
        out[:, 7] = np.log(np.maximum(words, 1)) - np.log(np.maximum(distinct, 1))
    return out


def measures(column: pa.Array) -> np.ndarray:
    """One row of MEASURES for each text."""
    raw, offsets = text_bytes(column)
    out, i, n = [np.zeros((0, len(MEASURES)))], 0, len(offsets) - 1
    while i < n:
        j = min(max(int(np.searchsorted(offsets, offsets[i] + _BLOCK, side="right")) - 1, i + 1), n)
        out.append(_block(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
        i = j
    return np.concatenate(out)


def _expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack([np.ones((len(z), 1)), z, z**2])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> dict | None:
    """Logistic regression on standardised measures and their squares, by Newton steps."""
    if not len(y) or y.min() == y.max():
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = _expand(x, mean, scale)
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "scale": scale, "w": w, "rate": float(y.mean())}


def probabilities(column: pa.Array, model: dict | None) -> np.ndarray:
    x = measures(column)
    if model is None:
        return np.full(len(x), 0.5)
    return 1 / (1 + np.exp(-np.clip(_expand(x, model["mean"], model["scale"]) @ model["w"], -12, 12)))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict | None:
    """Fits the classifier on docs joined with labels(doc_id, quality)."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_y"))
    n = known.count()
    share = min(1.0, fit_rows / max(1, n))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    names = [f"m{k}" for k in range(len(MEASURES))]

    def measure(batches):
        for batch in batches:
            x = measures(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.float64()), *[pa.array(c) for c in x.T]], ["y", *names])

    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "_y")
    got = rows.mapInArrow(measure, "y double, " + ", ".join(f"{c} double" for c in names)).toPandas().sort_values(["y", *names])
    return fit(got[names].to_numpy(), got.y.to_numpy())


def evidence(model: dict | None):
    """A column function: the classifier's probability of a text."""

    @F.arrow_udf("double")
    def p(text: pa.Array) -> pa.Array:
        return pa.array(probabilities(text, model))

    return p


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def strength(within: float, between: float) -> float:
    """How many documents a prior is worth: variance within groups over variance between them, less one."""
    return max(1.0, min(1e6, within / max(1e-9, between) - 1))


def posteriors(scored: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """scored(host, path, p): one row for each path with its own and its host's sums; totals, and the strengths of the
    global prior of hosts and of the host prior of paths, each by the method of moments for its own level."""
    paths = written(scored.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n")), "paths")
    square = F.col("s") * F.col("s") / F.col("n")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"), F.sum(square).alias("ss"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("k"))
    of_hosts = F.sum(F.col("hs") * F.col("hs") / F.col("hn"))
    one = hosts.agg(F.sum("hs").alias("s"), F.sum("hn").alias("n"), F.count("*").alias("h"), F.sum("k").alias("k"), of_hosts.alias("hh"), F.sum(F.col("hn") * F.col("hn")).alias("hn2"), F.sum("ss").alias("pp"), F.sum(F.col("nn") / F.col("hn")).alias("pn2")).first()
    total = {"s": one.s or 0.0, "n": float(one.n or 0), "host": 1.0, "path": 1.0}
    if one.n:
        rate = one.s / one.n
        within = rate * (1 - rate)
        total["host"] = strength(within, (one.hh - one.n * rate * rate - (one.h - 1) * within) / max(1e-9, one.n - one.hn2 / one.n))
        within = (one.s - one.hh) / one.n
        total["path"] = strength(within, (one.pp - one.hh - (one.k - one.h) * within) / max(1e-9, one.n - one.pn2))
    hosts = hosts.select(F.col("host").alias("_host"), "hs", "hn")
    rates = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host")))
    rates = rates.select("_host", F.col("path").alias("_path"), "s", "n", "hs", "hn")
    return (F.broadcast(rates) if (one.k or 0) <= BROADCAST else rates), total


def combine(scored: DataFrame, rates: DataFrame, total: dict[str, float]) -> DataFrame:
    """Adds host_rate, path_rate and quality, the posterior probability, to scored(host, path, p, ...). A document's
    own evidence is left out of its priors, so that it counts once."""
    joined = scored.join(rates, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    p = F.col("p")
    rate = (F.lit(total["s"]) - p) / (total["n"] - 1) if total["n"] > 1 else F.lit(0.5)
    joined = joined.withColumn("_rate", rate)
    joined = joined.withColumn("host_rate", (F.col("hs") - p + total["host"] * F.col("_rate")) / (F.col("hn") - 1 + total["host"]))
    joined = joined.withColumn("path_rate", (F.col("s") - p + total["path"] * F.col("host_rate")) / (F.col("n") - 1 + total["path"]))
    odds = _logit(p) - _logit(F.col("_rate")) + _logit(F.col("path_rate"))
    return joined.withColumn("quality", 1 / (1 + F.exp(-odds))).drop("_host", "_path", "s", "n", "hs", "hn", "_rate")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = written(docs.select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), evidence(model)(F.col("text")).alias("p")), "quality")
    out = combine(scored, *posteriors(scored))
    return out.select("doc_id", "host", "path", "p", "host_rate", "path_rate", "quality", (F.col("quality") >= KEEP).alias("keep"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go. Columns of any name pass through; null texts, hosts and
    paths as above; repeated rows count each; an empty table stays empty."""
    model = train(docs, table(spark, sf_dir, "labels"))
    text = F.col("row.text")
    scored = nested(docs).select("row", F.col("row.source").alias("host"), F.col("row.lang").alias("path"), text.alias("text"))
    scored = written(scored.select("row", "host", "path", evidence(model)(F.col("text")).alias("p")), "quality")
    return combine(scored, *posteriors(scored.select("host", "path", "p"))).filter(F.col("quality") >= KEEP).select("row.*")
