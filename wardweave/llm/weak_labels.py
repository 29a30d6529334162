"""Quality classifier from weak labels.

Ten heuristics vote good, bad or nothing on each whole text. Votes make one of 3**10 patterns;
their counts over all documents, at most 59,049 rows, are all that expectation maximisation
needs to estimate how often each labeller votes how on good and on bad texts. Posteriors of a
sample's patterns then train a linear scorer over hashed words, as logistic regression: at
most about `MAX_DOCS` documents and `MAX_WORDS` words, by hash of doc_id. It scores every whole
text. `labels` is never read. A text is kept if its score is at least `LEAST`.

Null texts are empty, without words they score the labellers' posterior; repeated rows score
alike; an empty table gives no rows; other columns are kept by `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, flat, materialize, slices, table, text_of, word_hashes, words

MAX_DOCS, MAX_WORDS, BITS, ROUNDS, LEAST = 8192, 4_000_000, 18, 150, 0.5


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(text: Column) -> list[Column]:
    """Each labeller's vote: 1 good, -1 bad, 0 none."""
    n = F.regexp_count(text, F.lit(WORD)).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    ratio = lambda pattern: F.regexp_count(text, F.lit(pattern)) / chars
    # where most characters are of a class, taking out the others makes fewer matches
    many = lambda others: F.length(F.regexp_replace(text, others, ""))
    lines = F.regexp_count(text, F.lit(r"\n")) + 1.0
    distinct = F.size(F.array_distinct(F.split(text, "\n"))).cast("double")
    letters, symbols, pipes = many(r"\P{L}+") / chars, F.regexp_count(text, F.lit(r"[#*$%&<>]")), F.regexp_count(text, F.lit(r"(?m)\||^\x20*[-*•]"))
    short = F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,3}(?![^\x20\x09-\x0D])")) / F.greatest(n, F.lit(1.0))
    length = many(r"[\x20\x09-\x0D]+") / F.greatest(n, F.lit(1.0))
    return [
        _vote(n >= 50, n < 20),
        _vote(symbols <= 0.01 * n, symbols > 0.1 * n),
        _vote((length >= 3) & (length <= 8), (length < 2) | (length > 12)),
        _vote((lines > 1) & (distinct == lines), distinct < 0.7 * lines),
        _vote(letters >= 0.7, letters < 0.55),
        _vote(text.rlike(r"[.!?\"']\s*\z"), ~text.rlike(r"[.!?\"',;:)]\s*\z")),
        _vote(ratio(r"\p{Lu}") < 0.1, ratio(r"\p{Lu}") > 0.3),
        _vote(ratio(r"[0-9]") < 0.01, ratio(r"[0-9]") > 0.1),
        _vote(F.lit(False), pipes > 0.2 * n),
        _vote((short >= 0.2) & (short <= 0.7), (short < 0.1) | (short > 0.85)),
    ]


N_VOTES = 10


def pattern(text: Column) -> Column:
    """The votes as one number, base 3."""
    p = F.lit(0)
    for i, v in enumerate(votes(text)):
        p = p + (v + 1) * 3**i
    return p.cast("int")


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The posterior of good for every pattern, by expectation maximisation. Start: labellers
    that vote are right seven times of ten."""
    v = (patterns[:, None] // 3 ** np.arange(N_VOTES)) % 3
    every = (np.arange(3**N_VOTES)[:, None] // 3 ** np.arange(N_VOTES)) % 3
    log = np.log(np.array([[0.3, 0.3, 0.4], [0.1, 0.3, 0.6]]))[:, None, :].repeat(N_VOTES, 1)  # [class, labeller, vote]
    prior = 0.8
    j = np.arange(N_VOTES)

    def posterior(v):
        bad, good = (log[c, j, v].sum(1) + np.log(x) for c, x in ((0, 1 - prior), (1, prior)))
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))

    for _ in range(rounds if len(counts) else 0):
        q = posterior(v)
        last = prior
        prior = float(np.clip((q * counts).sum() / counts.sum(), 0.01, 0.99))
        for c, w in ((0, (1 - q) * counts), (1, q * counts)):
            for k in range(3):
                log[c, :, k] = np.log((w[:, None] * (v == k)).sum(0) + 1.0)
            log[c] -= np.log(np.exp(log[c]).sum(1, keepdims=True))
        if abs(prior - last) < 1e-9:
            break
    return posterior(every)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        whole, offsets = flat(b.column(1))
        starts, ends, counts = words(whole, offsets)
        h = (word_hashes(whole, starts, ends) >> np.uint64(64 - BITS)).astype(np.uint32)
        cut = np.concatenate(([0], np.cumsum(counts)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["p", "h"])


def train(rows: list[tuple[float, np.ndarray]], rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on mean hashed words, with soft labels."""
    rows = [(p, h) for p, h in rows if len(h)]
    w, bias = np.zeros(1 << BITS), 0.0
    if not rows:
        return w, bias
    y, n = np.array([r[0] for r in rows]), np.array([len(r[1]) for r in rows])
    doc, at = np.repeat(np.arange(len(rows)), n), np.concatenate([r[1] for r in rows])
    key, x = np.unique(doc * (1 << BITS) + at, return_counts=True)
    doc, at = key >> BITS, key & ((1 << BITS) - 1)
    x = x / n[doc]
    used, at = np.unique(at, return_inverse=True)
    u, past, bias_past = np.zeros(len(used)), np.full(len(used), 1e-8), 1e-8
    for _ in range(rounds):  # steps by past gradients, so rare words move too
        error = 1 / (1 + np.exp(-np.clip(np.bincount(doc, u[at] * x, len(y)) + bias, -50, 50))) - y
        g, gb = np.bincount(at, error[doc] * x, len(used)) / len(y), error.mean()
        past += g * g
        bias_past += gb * gb
        u -= 1.0 * g / np.sqrt(past)
        bias -= 0.1 * gb / np.sqrt(bias_past)
    w[used] = u
    return w, float(bias)


def voted(docs: DataFrame) -> DataFrame:
    """(doc_id, p, text): each row's pattern of votes beside its text."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), pattern(text_of()).alias("p"), text_of().alias("text"))


def fit(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors by pattern, weights and bias."""
    return fit_voted(materialize(voted(docs), "votes"))


def fit_voted(t: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """The same, from rows of `voted`."""
    seen = t.groupBy("p").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    prob = estimate(np.array([r["p"] for r in seen], np.int64), np.array([r["n"] for r in seen], np.float64))
    n, size = sum(r["n"] for r in seen), sum(r["bytes"] for r in seen)
    rate = min(1.0, MAX_DOCS / max(1, n), MAX_WORDS * 6 / max(1, size))
    t = t.select("p", "text", F.xxhash64("doc_id", "text").alias("key"))
    sample = t if rate == 1 else t.filter(F.shiftrightunsigned("key", 1) < int(2**63 * rate))
    rows = sample.dropDuplicates(["key"]).select("p", "text").mapInArrow(_features, "p int, h binary").collect()
    return prob, *train([(float(prob[r["p"]]), np.frombuffer(r["h"], np.uint32)) for r in rows])


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, p_weak, score) for each row."""
    return score_voted(voted(docs), model)


def score_voted(t: DataFrame, model) -> DataFrame:
    """The same, from rows of `voted`."""
    shared = t.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prob, w, bias = shared.value
        for b in batches:
            weak = prob[b.column(1).to_numpy()]
            out = weak.copy()
            whole, offsets = flat(b.column(2))
            for x, y in slices(offsets):
                data, off = whole[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]
                starts, ends, counts = words(data, off)
                h = (word_hashes(data, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
                mean = np.bincount(np.repeat(np.arange(y - x), counts), w[h], y - x) / np.maximum(1, counts)
                out[x:y] = np.where(counts > 0, 1 / (1 + np.exp(-np.clip(mean + bias, -50, 50))), weak[x:y])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weak), pa.array(out)], names=["doc_id", "p_weak", "score"])

    return t.mapInArrow(run, "doc_id long, p_weak double, score double")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    t = materialize(voted(docs), "votes")  # patterns are matched once, then read three times
    return score_voted(t, fit_voted(t)).withColumn("kept", F.col("score") >= LEAST)
