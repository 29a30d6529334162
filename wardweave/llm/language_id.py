"""Language identification with a word-first backoff.

A known word scores its log frequency in each language; an unseen one the mean log frequency of
its longest known character n-grams, orders 5 to 1, of the word between marks. Sums over a
text's words give posteriors over the languages; the best is the prediction, its posterior the
score, ties go to the first language by code point. Only text and lang of training rows are
learned from.

Languages are those of all training rows, whose counts by language go to the driver, and so does
the model. The fit uses about `max_train` rows at most, but one of each language at least: every
language gives all its rows or about as many as any other, those with the smallest hash of id
and text, equal rows once. All words and n-grams of these rows are in the model. If they are
more than `max_entries`, half as many rows are taken, until they are not or a language gives one
row, so what is broadcast has a bound. Every whole text is scored.

Null texts and those without a letter are `und` with score 0, as is everything when no row can
be learned from. Languages without a word are never predicted for a text with known words.
Repeated rows are scored alike; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import group_sums, residue, table, tidy

LETTERS = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
MAX_TRAIN, MAX_ENTRIES, ALPHA = 8_000, 1_000_000, 0.5
#: Texts by languages that are scored at once.
MOST_CELLS = 1 << 22
#: Languages whose rates are broadcast; beyond, they are joined by shuffling.
MOST_BROADCAST = 100_000
UNKNOWN = "und"


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            if sum(map(len, counts.values())) > 300_000:
                yield from _rows(counts)
                counts.clear()
    yield from _rows(counts)


def _rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, c in counts.items():
        t = pa.table({"lang": pa.array([lang] * len(c)), "w": pa.array(list(c), pa.string()), "n": pa.array(list(c.values()), pa.int64())})
        yield from t.to_batches(max_chunksize=50_000)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: dict[str, Counter] = {}
        for lang, w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            c = counts.setdefault(lang, Counter())
            for k in ORDERS:
                for g in grams(w, k):
                    c[g] += n
        yield from _rows(counts)


class Model:
    """Log frequencies of words and of each order's n-grams: for each language that of an unseen one
    (`base`, a row for words and for each order), and for each entry the languages that have it and
    by how much more (`lang` and `more`, from `stop`)."""

    def __init__(self, langs: list[str], word_rows: pa.Table, gram_rows: pa.Table, alpha: float = ALPHA):
        self.langs = sorted(langs, key=lambda x: x.encode())
        place = {x: i for i, x in enumerate(self.langs)}
        length = pc.utf8_length(gram_rows["w"])
        self.at: list[dict[str, int]] = []
        base, parts, at = [], [], 0
        for t in (word_rows, *(gram_rows.filter(pc.equal(length, k)) for k in ORDERS)):
            names: dict[str, int] = {}
            rows = np.array([names.setdefault(w, at + len(names)) for w in t["w"].to_pylist()], np.int64)
            lang, n = np.array([place[x] for x in t["lang"].to_pylist()], np.int64), t["n"].to_numpy().astype(np.float64)
            base.append(np.log(alpha / (np.bincount(lang, n, len(self.langs)) + alpha * (len(names) + 1))))
            parts.append((rows, lang, np.log((n + alpha) / alpha)))
            self.at.append(names)
            at += len(names)
        rows, lang, more = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((lang, rows))
        self.lang, self.more, self.stop = lang[order], more[order], np.searchsorted(rows[order], np.arange(at + 1))
        self.base = np.stack([*base, np.zeros(len(self.langs))])

    def parts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word the kind that knows it (the last: none does) and the number of languages it
        has, and these, and their shares beyond the base."""
        rows = np.array([self.at[0].get(w, -1) for w in words], np.int64)
        kind = np.where(rows >= 0, 0, len(self.at))
        rest = np.flatnonzero(rows < 0)
        owner, entry, weight = [np.flatnonzero(rows >= 0)], [rows[rows >= 0]], [np.ones(len(words) - len(rest))]
        for order, (k, names) in enumerate(zip(ORDERS, self.at[1:], strict=True), 1):
            known = [[names[g] for g in grams(words[i], k) if g in names] for i in rest.tolist()]
            n = np.array([len(x) for x in known], np.int64)
            owner.append(np.repeat(rest, n))
            entry.append(np.array([x for own in known for x in own], np.int64))
            weight.append(np.repeat(1 / np.maximum(n, 1), n))
            kind[rest[n > 0]] = order
            rest = rest[n == 0]
        owner, entry, weight = (np.concatenate(x) for x in (owner, entry, weight))
        size = self.stop[entry + 1] - self.stop[entry]
        at = np.repeat(self.stop[entry] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        key, more = group_sums(np.repeat(owner, size) * len(self.langs) + self.lang[at], self.more[at] * np.repeat(weight, size))
        return kind, np.bincount(key // len(self.langs), minlength=len(words)), key % len(self.langs), more

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return lang, score
        step = max(1, MOST_CELLS // len(self.langs))
        for at in range(0, len(texts), step):
            for i, b, p in self._some(texts[at : at + step]):
                lang[at + i], score[at + i] = self.langs[b], p
        return lang, score

    def _some(self, texts: list[str | None]):
        """(place, language, posterior) of the texts with letters."""
        index: defaultdict[str, int] = defaultdict(count().__next__)
        flat: list[int] = []
        counts, letters = [], []
        for t in texts:
            w = LETTERS.findall(t.lower()) if t else []
            letters.append(any(map(str.isalpha, w)) or any(c.isalpha() for x in w for c in x))
            flat += map(index.__getitem__, w)
            counts.append(len(w))
        if not index:
            return
        kind, size, of, more = self.parts(list(index))
        word, text = np.array(flat, np.int64), np.repeat(np.arange(len(texts)), counts)
        each = size[word]
        at = np.repeat((np.cumsum(size) - size)[word] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        shape = len(texts), len(self.langs)
        total = np.bincount(np.repeat(text, each) * shape[1] + of[at], more[at], shape[0] * shape[1]).reshape(shape)
        kinds = len(self.base)
        total += np.bincount(text * kinds + kind[word], minlength=shape[0] * kinds).reshape(-1, kinds) @ self.base
        total -= total.max(1, keepdims=True)
        p = np.exp(total)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        for i in np.flatnonzero(letters).tolist():
            yield i, int(best[i]), float(p[i, best[i]])


def fair_share(counts: list[int], most: int) -> int:
    """The largest share so that languages of so many rows, each giving at most it, give at most
    `most` in all; one at least."""
    left, share = most, 1
    for k, n in enumerate(sorted(counts)):
        share = left // (len(counts) - k)
        if n > share:
            break
        left -= n
        share = n
    return max(1, share)


def _row_hash():
    return F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)


def sample(rows: DataFrame, counts: dict[str, tuple[int, int]], share: int) -> DataFrame:
    """About `share` rows of each language, all of those with fewer, and one at least; counts has
    each language's rows and least hash. Texts are not shuffled for it unless languages are many."""
    most = [(k, max(least, 2**63 - 1 if n <= share else int(2**63 * (share / n)))) for k, (n, least) in counts.items()]
    rate = rows.sparkSession.createDataFrame(most, "lang string, most long")
    keyed = rows.select("lang", "text", _row_hash().alias("h"))
    return keyed.join(F.broadcast(rate) if len(most) <= MOST_BROADCAST else rate, "lang").filter("h <= most").select("lang", "text", "h").distinct()


def fit(train: DataFrame, max_train: int = MAX_TRAIN, max_entries: int = MAX_ENTRIES) -> Model:
    """A model of rows (doc_id, text, lang)."""
    t = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: (r["n"], r["h"]) for r in t.groupBy("lang").agg(F.count("*").alias("n"), F.min(_row_hash()).alias("h")).collect()}
    share = fair_share([n for n, _ in counts.values()], max_train)
    names = "lang string, w string, n long"
    while True:
        words = sample(t, counts, share).select("lang", "text").mapInArrow(tidy(_count_words), names).groupBy("lang", "w").agg(F.sum("n").alias("n")).persist()
        pieces = words.mapInArrow(tidy(_count_grams), names).groupBy("lang", "w").agg(F.sum("n").alias("n")).persist()
        few = share == 1 or words.count() + pieces.count() <= max_entries
        model = Model(list(counts), words.toArrow(), pieces.toArrow()) if few else None
        words.unpersist()
        pieces.unpersist()
        if model:
            return model
        share = max(1, share // 2)


def predict(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its posterior, in place of columns of these names."""
    docs = docs.drop(lang, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    names = [*docs.columns, lang, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                best, p = m.predict(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.string()), pa.array(p, pa.float64())], names=names)

    schema = docs.schema.jsonValue()
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    out = StructType([*StructType.fromJson(schema).fields, StructField(lang, StringType()), StructField(score, DoubleType())])
    return docs.mapInArrow(tidy(run), out)


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(residue("doc_id", 3) != 1).select("doc_id", "text", "lang")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents with a language; those that are `und` or below `least` go. Rows are wrapped, so no
    column of docs can clash with the prediction's."""
    model = fit(train_rows(docs))
    p = predict(docs.select(docs["text"].alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("whole")), model)
    ok: Column = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)
    return p.filter(ok).select("whole.*")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    p = predict(docs.select("doc_id", "text"), fit(train_rows(docs)))
    return p.select("doc_id", (residue("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
