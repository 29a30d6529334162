"""Language-model scoring by context-tree weighting over bytes.

The text that is modelled is its token stream: A-Z lower-cased, words parted by one blank, a
line feed as end. Each byte is eight binary decisions, each with its own tree over the bytes
before it, to DEPTH. A node's Krichevsky-Trofimov estimate of its training bits is weighed
half and half against the product of its children's, all the way up, which mixes all depths;
a prediction blends the estimates along the path by the weights that training has left. Below
a context that training never met, the last estimate that has data stands.

Trees stay fixed while scoring, so a text's log probability is a sum over its (DEPTH + 1)-byte
grams, and the model is a table of grams. Neither it nor the word counts are ever broadcast:

1. documents fall into chunks of neighbouring rows; each chunk asks for its distinct grams and
   words and gives their training counts (`_requests`);
2. a bucket of requests is one part of the vocabulary, or all grams that end in the same two
   context bytes: the counts add up there, and each chunk gets an answer for what it asked;
3. the two upper levels of the trees, at most 65,280 rows, go through the driver;
4. chunks meet their answers and score whole texts.

Requests are distinct within a chunk, so a word that makes up a third of the corpus is one row
a chunk. Null texts are empty and score their end alone; repeated rows count each time; an
empty table gives no rows; with nothing to learn from every bit has probability one half.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, flat, materialize, parallelism, residue, slices, table, text_of, word_hashes, words

DEPTH = 5
CHUNK_BYTES, BUCKET_BYTES = 24 << 20, 24 << 20
WORDS, GRAMS = 0, 1
REQUEST = "kind int, bucket int, chunk long, keys binary, counts binary"
ANSWER = "kind int, chunk long, keys binary, values binary, distinct long, total long"
_K = np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------------- streams and grams


def stream(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The modelled bytes of all texts, one after another, and where each text begins."""
    n = ends - starts
    blank = np.maximum(counts, 1)  # bytes after words; a text without words is its end alone
    doc = np.repeat(np.arange(len(counts)), counts)
    lead = np.concatenate(([0], np.cumsum((counts == 0).astype(np.int64))))[doc]
    to = np.cumsum(n + 1) - (n + 1) + lead
    size = int(n.sum() + blank.sum())
    out = np.full(size, 32, np.uint8)
    out[np.repeat(to - (np.cumsum(n) - n), n) + np.arange(n.sum())] = _LOWER[data[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
    each = np.bincount(doc, weights=n, minlength=len(counts)).astype(np.int64) + blank
    stop = np.cumsum(each)
    out[stop - 1] = 10
    return out, stop - each


def gram_keys(s: np.ndarray, begin: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each byte itself and `depth` bytes before it, older ones higher, 0 before the text."""
    key = s.astype(np.uint64)
    stop = np.concatenate((begin[1:], [len(s)]))
    for j in range(1, depth + 1):
        old = np.zeros(len(s), np.uint64)
        old[j:] = s[:-j] if j < len(s) else s[:0]
        for k in range(j):
            at = begin + k
            old[at[at < stop]] = 0
        key |= old << np.uint64(8 * j)
    return key


def _distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.diff(np.r_[at, len(keys)])


class _Tally:
    """Distinct keys with their counts in training texts, 0 for those elsewhere only."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, train: np.ndarray) -> None:
        a, n = _distinct([keys[train]])
        b, _ = _distinct([keys[~train]])
        self.keys, self.counts = add_up([self.keys, a, b], [self.counts, n, np.zeros(len(b), np.int64)])


def add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    if not len(k):
        return k, n
    order = np.argsort(k)
    k, n = k[order], n[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[at], np.add.reduceat(n, at)


def _bucket(kind: int, keys: np.ndarray, n: int) -> np.ndarray:
    """Words by hash; grams by the two bytes just before the last, so shallow contexts stay together."""
    part = keys if kind == WORDS else (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    return (((part + np.uint64(1)) * _K) >> np.uint64(33)).astype(np.int64) % n


def _requests(n: int, depth: int):
    def run(batches):
        tallies: dict[int, tuple[_Tally, _Tally]] = {}

        def out(chunk: int):
            for kind, t in enumerate(tallies.pop(chunk)):
                b = _bucket(kind, t.keys, n)
                order = np.argsort(b, kind="stable")
                cut = np.searchsorted(b[order], np.arange(n + 1))
                rows = [(pack_array(t.keys[o]), pack_array(t.counts[o].astype(np.uint32))) for o in (order[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([chunk] * n, pa.int64()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                    names=["kind", "bucket", "chunk", "keys", "counts"],
                )

        for batch in batches:
            chunks = batch.column(0).to_numpy()
            for chunk in np.unique(chunks).tolist():
                for done in [c for c in tallies if c != chunk]:
                    yield from out(done)
                mine = batch.filter(pa.array(chunks == chunk))
                word, gram = tallies.setdefault(chunk, (_Tally(), _Tally()))
                learn = mine.column(1).to_numpy(zero_copy_only=False).astype(bool)
                whole, offsets = flat(mine.column(2))
                for a, b in slices(offsets):
                    data, off = whole[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                    starts, ends, counts = words(data, off)
                    word.add(word_hashes(data, starts, ends), np.repeat(learn[a:b], counts))
                    s, begin = stream(data, starts, ends, counts)
                    gram.add(gram_keys(s, begin, depth), np.repeat(learn[a:b], np.diff(np.r_[begin, len(s)])))
        for chunk in list(tallies):
            yield from out(chunk)

    return run


# ------------------------------------------------------------------------ context trees

_SMALL = 4096
_HALF = np.concatenate(([0.0], np.cumsum(np.log(np.arange(_SMALL) + 0.5))))
_WHOLE = np.concatenate(([0.0], np.cumsum(np.log(np.arange(_SMALL) + 1.0))))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""

    def half(n):
        return np.where(n < _SMALL, _HALF[np.minimum(n, _SMALL)], _log_gamma(np.maximum(n, _SMALL) + 0.5) - 0.5 * math.log(math.pi))

    n = n0 + n1
    return half(n0) + half(n1) - np.where(n < _SMALL, _WHOLE[np.minimum(n, _SMALL)], _log_gamma(np.maximum(n, _SMALL) + 1.0))


class Level:
    """The nodes of one depth for one bit of the byte: key is context and the bits before."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bit: int):
        byte = keys & np.uint64(0xFF)
        node = (keys & ~np.uint64(0xFF)) | ((byte | np.uint64(256)) >> np.uint64(8 - bit))
        one = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
        at = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        self.keys = node[at]
        total = np.add.reduceat(counts, at)
        self.n1 = np.add.reduceat(counts * one, at)
        self.n0 = total - self.n1
        self.own = log_kt(self.n0, self.n1)
        self.weighted = self.own
        self.stop = np.ones(len(at))

    def weigh(self, child: Level, mask: np.uint64) -> None:
        below = np.bincount(np.searchsorted(self.keys, child.keys & mask), weights=child.weighted, minlength=len(self.keys))
        self.weighted, self.stop = halves(self.own, below)


def halves(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log(e^own / 2 + e^below / 2), and the first part's share of it."""
    w = np.logaddexp(own, below) - math.log(2)
    return w, np.exp(own - math.log(2) - w)


def _mask(depth: int) -> np.uint64:
    return np.uint64((1 << (8 * depth + 8)) - 1)


def trees(keys: np.ndarray, counts: np.ndarray, depth: int, least: int):
    """For each bit, its levels from `depth` to `least`, weighed bottom up."""
    by_depth = {depth: (keys, counts)}
    for d in range(depth - 1, least - 1, -1):
        by_depth[d] = add_up([by_depth[d + 1][0] & _mask(d)], [by_depth[d + 1][1]])
    for bit in range(8):
        levels = {d: Level(*by_depth[d], bit) for d in by_depth}
        for d in range(depth - 1, least - 1, -1):
            levels[d].weigh(levels[d + 1], _mask(d))
        yield bit, levels


class Upper:
    """Depths 0 and 1 of all trees: shares of stopping, estimates of a one, and whether met."""

    def __init__(self, rows):
        """rows: (context byte and bits before, zeros, ones, log product of the depth below)."""
        n = np.zeros((2, 65536), np.int64)
        below = np.zeros(65536)
        for k, a, b, w in rows:
            n[0, k], n[1, k], below[k] = a, b, w
        own = log_kt(n[0], n[1])
        weighted, stop = halves(own, below)
        self.one = [None, (n[1] + 0.5) / (n.sum(0) + 1.0)]
        self.stop, self.met = [None, stop], [None, n.sum(0) > 0]
        z = n.reshape(2, 256, 256).sum(1)
        _, self.stop[0] = halves(log_kt(z[0], z[1]), np.where(self.met[1], weighted, 0.0).reshape(256, 256).sum(0))
        self.one[0], self.met[0] = (z[1] + 0.5) / (z.sum(0) + 1.0), z.sum(0) > 0


def log_probabilities(keys: np.ndarray, counts: np.ndarray, upper: Upper, depth: int = DEPTH) -> np.ndarray:
    """log10 of each gram's last byte given the others; keys are sorted and distinct."""
    out = np.zeros(len(keys))
    byte = (keys & np.uint64(0xFF)).astype(np.int64)
    for bit, levels in trees(keys, counts, depth, 2):
        last = levels[depth]
        p = (last.n1 + 0.5) / (last.n0 + last.n1 + 1.0)
        met = last.n0 + last.n1 > 0
        for d in range(depth - 1, -1, -1):
            if d >= 2:
                at = np.searchsorted(levels[d].keys, last.keys & _mask(d))
                n0, n1 = levels[d].n0[at], levels[d].n1[at]
                one, stop, here = (n1 + 0.5) / (n0 + n1 + 1.0), levels[d].stop[at], n0 + n1 > 0
            else:
                at = (last.keys & _mask(d)).astype(np.int64)
                one, stop, here = upper.one[d][at], upper.stop[d][at], upper.met[d][at]
            p, met = np.where(met, stop * one + (1 - stop) * p, one), here
        node = (keys & ~np.uint64(0xFF)) | ((byte.astype(np.uint64) | np.uint64(256)) >> np.uint64(8 - bit))
        p = p[np.searchsorted(last.keys, node)]
        out += np.log10(np.where((byte >> (7 - bit)) & 1 == 1, p, 1 - p))
    return out


# ------------------------------------------------------------------------ Spark's stages


def pack_array(a: np.ndarray) -> bytes:
    """Length, then the bytes by place value, so that what sorted keys share is pressed out."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return len(a).to_bytes(4, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unpack_array(data: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(data[:4], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = pa.decompress(data[4:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).ravel()


def _keys(column) -> list[np.ndarray]:
    return [unpack_array(x, np.uint64) for x in column.to_pylist()]


def _counts(column) -> list[np.ndarray]:
    return [unpack_array(x, np.uint32).astype(np.int64) for x in column.to_pylist()]


def _roots(depth: int):
    """A bucket's share of the depth-1 nodes."""

    def run(t: pa.Table) -> pa.Table:
        keys, counts = add_up(_keys(t["keys"]), _counts(t["counts"]))
        found = []
        for _, levels in trees(keys, counts, depth, 2) if len(keys) else ():
            x = levels[2]
            k = (x.keys & _mask(1)).astype(np.int64)
            at, back = np.unique(k, return_inverse=True)
            found.append((at, *(np.bincount(back, weights=w) for w in (x.n0, x.n1, np.where(x.n0 + x.n1 > 0, x.weighted, 0.0)))))
        k, a, b, w = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0),) * 4
        return pa.table({"k": pa.array(k.astype(np.int32)), "n0": pa.array(a.astype(np.int64)), "n1": pa.array(b.astype(np.int64)), "w": pa.array(w.astype(np.float64))})

    return run


def _answers(depth: int, upper):
    """For each request of a bucket its keys' values: counts of words, log10 of grams."""

    def run(t: pa.Table) -> pa.Table:
        kind = t["kind"][0].as_py()
        asked = _keys(t["keys"])
        keys, counts = add_up(asked, _counts(t["counts"]))
        if kind == GRAMS:
            value = log_probabilities(keys, counts, upper.value, depth) if len(keys) else np.zeros(0)
        else:
            value = counts.astype(np.float64)
        kept = np.float32 if kind == GRAMS else np.uint32
        values = [pack_array(value[np.searchsorted(keys, a)].astype(kept)) for a in asked]
        n = len(asked)
        distinct, total = (int((counts > 0).sum()), int(counts.sum())) if kind == WORDS else (0, 0)
        return pa.table({"kind": pa.array([kind] * n, pa.int32()), "chunk": t["chunk"], "keys": t["keys"], "values": pa.array(values, pa.binary()), "distinct": pa.array([distinct] * n, pa.int64()), "total": pa.array([total] * n, pa.int64())})

    return run


class Lookup:
    """Values of 64-bit keys that are all there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = keys * _K
        order = np.argsort(h)
        self.bits = np.uint64(64 - max(8, len(keys).bit_length() + 1))
        self.first = np.searchsorted(h[order] >> self.bits, np.arange(1 << int(64 - self.bits), dtype=np.uint64)).astype(np.int32)
        self.keys, self.values = np.r_[keys[order], np.uint64(0)], np.r_[values[order], 0.0]

    def __call__(self, q: np.ndarray) -> np.ndarray:
        at = self.first[(q * _K) >> self.bits]
        wrong = np.flatnonzero(self.keys[at] != q)
        while len(wrong):
            at[wrong] += 1
            if (at[wrong] >= len(self.keys)).any():
                raise KeyError("a chunk holds a key that it has not asked for")
            wrong = wrong[self.keys[at[wrong]] != q[wrong]]
        return self.values[at]


SCORES = "doc_id long, learn boolean, n_tokens long, n_known long, train_words long, train_distinct long, base double, score double, bytes long"


def _scores(depth: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        kind = answers["kind"].to_numpy()
        look = []
        for k in (WORDS, GRAMS):
            mine = answers.filter(pa.array(kind == k))
            keys = np.concatenate([*_keys(mine["keys"]), np.zeros(0, np.uint64)])
            values = np.concatenate([*(unpack_array(x, np.float32 if k == GRAMS else np.uint32).astype(np.float64) for x in mine["values"].to_pylist()), np.zeros(0)])
            keys, at = np.unique(keys, return_index=True)
            look.append(Lookup(keys, values[at]))
        # a chunk gets one row of each bucket for each time it asked: count each bucket once
        asked = max(1, len(answers.filter(pa.array((kind == WORDS)))) // answers["_buckets"][0].as_py()) if len(answers) else 1
        distinct, total = (sum(answers[c].to_pylist()) // asked for c in ("distinct", "total"))
        whole, offsets = flat(docs["text"])
        n = len(docs)
        tokens, known, base, score, size = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        for a, b in slices(offsets):
            data, off = whole[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts, ends, counts = words(data, off)
            c = look[WORDS](word_hashes(data, starts, ends))
            doc = np.repeat(np.arange(b - a), counts)
            tokens[a:b] = counts
            known[a:b] = np.bincount(doc[c > 0], minlength=b - a)
            base[a:b] = np.bincount(doc, weights=np.log10(c + 0.1), minlength=b - a)
            s, begin = stream(data, starts, ends, counts)
            size[a:b] = np.diff(np.append(begin, len(s)))
            score[a:b] = np.add.reduceat(look[GRAMS](gram_keys(s, begin, depth)), begin)
        full = lambda x: pa.array(np.full(n, x, np.int64))
        return pa.table({"doc_id": docs["doc_id"], "learn": docs["learn"], "n_tokens": tokens, "n_known": known, "train_words": full(total), "train_distinct": full(distinct), "base": base, "score": score, "bytes": size})

    return run


def chunked(docs: DataFrame) -> tuple[DataFrame, int, bool]:
    """(chunk, learn, doc_id, text), the bytes of all texts, and whether they are files. Rows of a file fall into chunks by their place in it; rows
    of other sources by hash. Either way the chunk depends on nothing but the row."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    try:
        place = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        rows = max(1, int(CHUNK_BYTES / max(1, size / max(1, n))))
        chunk = F.xxhash64("_file", F.floor(F.col("_row") / rows))
        files = True
    except Exception as e:
        if "UNRESOLVED_COLUMN" not in str(e) and "_metadata" not in str(e):
            raise
        place, chunk, files = docs, F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, size // CHUNK_BYTES))), False
    out = place.select(chunk.alias("chunk"), (residue("doc_id", 10) != 0).alias("learn"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return out, int(size), files


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """SCORES for each row of docs (doc_id, text)."""
    if not 2 <= depth <= 7:
        raise ValueError("depth must be from 2 to 7")
    spark = docs.sparkSession
    d, size, files = chunked(docs)
    n = parallelism(spark, size, BUCKET_BYTES)
    source = d.select("chunk", "learn", "text")
    asks = materialize((source if files else source.repartition("chunk")).mapInArrow(_requests(n, depth), REQUEST), "lm-requests")
    grams = asks.filter(F.col("kind") == GRAMS)
    roots = grams.groupBy("bucket").applyInArrow(_roots(depth), "k int, n0 long, n1 long, w double")
    rows = roots.groupBy("k").agg(F.sum("n0"), F.sum("n1"), F.sum("w")).collect()  # at most 65,280
    upper = spark.sparkContext.broadcast(Upper(rows))
    answers = asks.groupBy("kind", "bucket").applyInArrow(_answers(depth, upper), ANSWER).withColumn("_buckets", F.lit(n))
    return d.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scores(depth), SCORES)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = table(spark, sf_dir, "documents").filter(residue("doc_id", 10) != 0).count()  # ends in training
    n, v = F.col("train_words") + docs, F.col("train_distinct") + (1 if docs else 0)
    bar = F.log10(n + F.lit(0.1) * (v + 1))
    return s.select(
        "doc_id", (~F.col("learn")).alias("held_out"), (F.col("n_tokens") + 1).alias("n_tokens"), (F.col("n_known") + (1 if docs else 0)).alias("n_known"), n.alias("train_tokens"),
        (F.col("base") + F.log10(F.lit(docs + 0.1)) - bar * (F.col("n_tokens") + 1)).alias("base_score"), "score",
        (F.col("score") * -math.log2(10) / F.col("bytes")).alias("bits_per_byte"),
    )
