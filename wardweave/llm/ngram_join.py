"""N-gram Jaccard join: prefix-tree join of word-shingle sets, exact, to connected components.

A set is its distinct 64-bit shingle hashes. A set of n shares at least a = ceil(T n / 100) with
any that it links with. Hence, exactly:

1. equal sets are one class, known by a fingerprint (`profile`);
2. each class sends its tokens to token buckets, where a token is live if another class of
   fitting size has it, and its frequency is counted; a class with fewer than a live tokens
   links with nothing (`survivors`);
3. the others keep their c live tokens, rarest first. In a wave each joins one block, led by the
   most central of the classes that share one of its `KEYS` least hashes, and links what does
   (`wave`). That is one row a class, whatever the group's size, and finds most links; it
   decides nothing against any;
4. step 2 again, over the survivors: now a token is live if another *component* has it. What is
   left of a group after a wave are classes that some other component may still hold;
5. of those, two that link share one of their c - a + 1 rarest live tokens. What is connected
   by these is a cluster, a small one a block; in a larger one, chunks of the largest component
   each meet the rest, once, and only the rest, if it is more than a block, meets itself in
   pairs of chunks (`cluster_blocks`).

A block puts its sets into a prefix tree, in one global order, walks it with each set, shares
overlaps along common paths, and prunes subtrees whose remaining lengths cannot reach the
threshold or that are in the set's component already (`TokenTrie`). Exact counts decide; a block
gives a spanning forest of its links, never all pairs.

Tokens that a good part of all documents have are found beforehand, from counts made slice by
slice; they are at most `MOST_HOT`, so they go to all tasks with their frequencies and are never
gathered in a bucket. Buckets and slices grow with the square root of the input, so that a row
between them keeps a fair number of tokens. Unequal shingles or sets count as equal with a
chance of 2**-64 a pair.

Texts with fewer than five words are one shingle of all; those without words, or null, have an
empty set and link with nothing. Repeated rows are rows of their own in one class. A null
doc_id names a component only if it has no other. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, flat, materialize, mix64, parallelism, slices, table, tidy, word_hashes, words

N, T = 5, 75
#: Text bytes a bucket stands for at least, sets of a block, sets that a leader meets in a task.
BUCKET_BYTES, BLOCK, CHUNK = 12 << 20, 1024, 256
#: Least hashes by which a wave groups; waves go on while more than `FEW` sets are left of it.
KEYS, FEW = 4, 20_000
#: Hot tokens: most of them, documents of which at least one in `HOT_SHARE` has one, least documents.
MOST_HOT, HOT_SHARE, HOT_LEAST = 100_000, 200, 1000
#: Edges that one task may join by itself (16 bytes each).
ONE_TASK_EDGES = 1 << 22
_STEP = np.uint64(0x9E3779B97F4A7C15)
SENT = "bucket int, fp binary, comp binary, n binary, count binary, tok binary, freq binary"
SURVIVOR = "fp long, comp long, n long, cent double, keys array<long>, toks array<long>"


# ------------------------------------------------------------------------------- sets


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sets, one after another, and their bounds."""
    starts, ends, counts = words(data, offsets)
    h = word_hashes(data, starts, ends)
    wins = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    stop = np.cumsum(counts)
    at = np.repeat(stop - counts - (np.cumsum(wins) - wins), wins) + np.arange(wins.sum())
    s = np.zeros(len(at), np.uint64)
    if len(at):
        last = np.repeat(stop, wins)
        for j in range(n):
            s = s * _STEP + np.where(at + j < last, h[np.minimum(at + j, len(h) - 1)], np.uint64(0))
    s = mix64(s)
    out, size, to = [], [], 0
    for k in wins.tolist():
        a = np.sort(s[to : to + k])
        to += k
        if k > 1:
            a = a[np.r_[True, a[1:] != a[:-1]]]
        out.append(a)
        size.append(len(a))
    return (np.concatenate(out) if out else s), np.concatenate(([0], np.cumsum(size))).astype(np.int64)


def fingerprints(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for an empty one."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)))
    n = np.diff(bounds).astype(np.uint64)
    return np.where(n > 0, mix64(sums[bounds[1:]] - sums[bounds[:-1]] + n * _STEP), np.uint64(0)).view(np.int64)


def _sets(batches, text: int, most: int = 4 << 20):
    """(rows, bytes, tokens, bounds, fingerprints) of slices of texts."""
    for batch in batches:
        whole, offsets = flat(batch.column(text))
        for a, b in slices(offsets, most):
            tokens, bounds = shingle_sets(whole[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield batch.slice(a, b - a), np.diff(offsets[a : b + 1]), tokens, bounds, fingerprints(tokens, bounds)


def _profile(batches):
    for rows, size, tokens, bounds, fp in _sets(batches, 1):
        tok, m = np.unique(tokens, return_counts=True)
        often = m >= max(8, len(fp) // HOT_SHARE)
        hot = [tok[often].tobytes() + m[often].astype(np.uint64).tobytes() if often.any() else None] + [None] * (len(fp) - 1)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(bounds)), pa.array(fp), rows.column(2), pa.array(size), pa.array(hot, pa.binary())], names=["doc_id", "n", "fp", "row", "bytes", "hot"])


def profile(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(doc_id, n, fp, row, bytes, hot): size and fingerprint of each document's set; row as given;
    bytes of the text; with a slice's first document, what many of the slice's have."""
    row = F.lit(None).cast("long") if row is None else row
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", row.alias("row")).mapInArrow(tidy(_profile), "doc_id long, n long, fp long, row long, bytes long, hot binary")


def _hot_counts(batches):
    for b in batches:
        for raw in b.column(0).to_pylist():
            both = np.frombuffer(raw, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.split(both, 2)], names=["tok", "m"])


def hot_tokens(base: DataFrame, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of many documents, ascending, and in how many slices' documents they were seen."""
    counts = base.select("hot").filter("hot is not null").mapInArrow(tidy(_hot_counts), "tok long, m long").groupBy("tok").agg(F.sum("m").alias("m"))
    rows = counts.filter(F.col("m") >= max(HOT_LEAST, docs // HOT_SHARE)).orderBy(F.desc("m"), "tok").limit(MOST_HOT).collect()
    tok, m = np.array([r["tok"] for r in rows], np.int64).view(np.uint64), np.array([r["m"] for r in rows], np.int64)
    order = np.argsort(tok)
    return tok[order], m[order]


# --------------------------------------------------------------------------- live tokens


def least_shared(n):
    """Of a set with n, at least so many are in any set that it links with."""
    return (T * n + 99) // 100


def _need(n: str = "n"):
    """The same as a column."""
    return F.floor((F.lit(T) * F.col(n) + 99) / 100)


def _pack(bucket, e, tok, freq, fp, comp, n) -> list[tuple]:
    """A row for each bucket: its entries e (fp, comp, n), and their tokens."""
    key = bucket * len(fp) + e
    order = np.argsort(key, kind="stable")
    key, tok = key[order], tok[order]
    freq = freq if freq is None else freq[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    of = np.r_[at, len(key)]
    b, d = np.divmod(key[at], max(1, len(fp)))
    which, first = np.unique(b, return_index=True)
    cut = np.r_[first, len(b)]
    out = []
    for k, x, y in zip(which.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        own, lo, hi = d[x:y], of[x], of[y]
        out.append((k, fp[own].tobytes(), comp if comp is None else comp[own].tobytes(), n[own].astype(np.uint32).tobytes(), np.diff(of[x : y + 1]).astype(np.uint32).tobytes(), tok[lo:hi].tobytes(), freq if freq is None else freq[lo:hi].tobytes()))
    return out


def _unpack(t: pa.Table):
    """(fp, comp, n, count, tok, freq) of packed rows; what they lack is None."""
    get = lambda c, kind: np.frombuffer(b"".join(x for x in t[c].to_pylist() if x is not None), kind)
    fp, comp, freq = get("fp", np.int64), get("comp", np.int64), get("freq", np.uint16)
    return fp, comp if len(comp) else None, get("n", np.uint32).astype(np.int64), get("count", np.uint32).astype(np.int64), get("tok", np.uint64), freq


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then those of the next."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _home(fp: np.ndarray, n: int) -> np.ndarray:
    return (mix64(fp.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def _deal(n_buckets: int, hot: tuple, blocks):
    """Packed rows for token buckets, from (fp, comp, n, tokens, bounds) of distinct sets. Hot tokens
    go, with their frequencies, to the bucket that stands for their class."""
    hot_tok, hot_m = hot
    kinds = [pa.int32(), *[pa.binary()] * 6]
    names = [x.split()[0] for x in SENT.split(", ")]
    for fp, comp, n, tokens, bounds in blocks:
        e = np.repeat(np.arange(len(fp)), np.diff(bounds))
        rows = []
        if len(hot_tok):
            at = np.minimum(np.searchsorted(hot_tok, tokens), len(hot_tok) - 1)
            is_hot = hot_tok[at] == tokens
            live = is_hot & (hot_m[at] > 1)  # a frequency of 1: known to be of one component
            rows = _pack(_home(fp, n_buckets)[e[live]], e[live], tokens[live], np.minimum(hot_m[at[live]], 65535).astype(np.uint16), fp, comp, n)
            tokens, e = tokens[~is_hot], e[~is_hot]
        rows += _pack(((tokens >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64), e, tokens, None, fp, comp, n)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _from_texts(n_buckets: int, most: int, hot: tuple):
    def distinct(batches):
        for _, _, tokens, bounds, fp in _sets(batches, 0, most):
            n = np.diff(bounds)
            _, first = np.unique(fp, return_index=True)
            first = first[n[first] > 0]
            yield fp[first], None, n[first], tokens[_runs(bounds[:-1][first], n[first])], np.concatenate(([0], np.cumsum(n[first])))

    return lambda batches: _deal(n_buckets, hot, distinct(batches))


def _from_survivors(n_buckets: int, hot: tuple):
    def each(batches):
        for b in batches:
            fp, comp, n, (tokens, bounds) = *(b.column(i).to_numpy() for i in range(3)), _lists(b.column(3))
            yield fp, comp, n, tokens, bounds

    return lambda batches: _deal(n_buckets, hot, each(batches))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    bounds = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]].view(np.uint64), bounds - bounds[0]


def _live(n_homes: int):
    """Of a bucket, for each class its tokens that another class (component, if known) of fitting
    size has, with their frequencies, packed by homes of classes."""

    def run(t: pa.Table) -> pa.Table:
        judged = pc.is_null(t["freq"])
        fp, comp, n, count, tok, _ = _unpack(t.filter(judged))
        known = _unpack(t.filter(pc.invert(judged)))
        # a class that came from several slices has the same tokens in each; smaller sets first
        _, own = np.unique(fp, return_index=True)
        own = own[np.argsort(n[own], kind="stable")]
        start = np.cumsum(count) - count
        tok, e = tok[_runs(start[own], count[own])], np.repeat(np.arange(len(own)), count[own])
        fp, n, comp = fp[own], n[own], None if comp is None else comp[own]
        order = np.argsort(tok, kind="stable")
        tok, e = tok[order], e[order]
        same = tok[1:] == tok[:-1]
        near = same & (100 * n[e[:-1]] >= T * n[e[1:]])
        live = np.r_[False, near] | np.r_[near, False] if len(tok) else np.zeros(0, bool)
        at = np.flatnonzero(np.r_[True, ~same]) if len(tok) else np.zeros(0, np.int64)
        m = np.diff(np.r_[at, len(tok)])
        if comp is not None and len(tok):
            c = comp[e]
            live &= np.repeat(np.minimum.reduceat(c, at) != np.maximum.reduceat(c, at), m)
        freq = np.minimum(np.repeat(m, m)[live], 65535).astype(np.uint16)
        rows = _pack(_home(fp, n_homes)[e[live]], e[live], tok[live], freq, fp, comp, n)
        fp, comp, n, count, tok, freq = known
        _, own = np.unique(fp, return_index=True)
        at = _runs((np.cumsum(count) - count)[own], count[own])
        e = np.repeat(np.arange(len(own)), count[own])
        rows += _pack(_home(fp[own], n_homes)[e], e, tok[at], freq[at], fp[own], None if comp is None else comp[own], n[own])
        names = [x.split()[0] for x in SENT.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, [pa.int32(), *[pa.binary()] * 6], strict=True)], names)

    return run


def _gather(t: pa.Table) -> pa.Table:
    """Of a home's classes those with enough live tokens, and these, rarest first."""
    fp, comp, n, count, tok, freq = _unpack(t)
    own, at, back = np.unique(fp, return_index=True, return_inverse=True)
    n, comp = n[at], own if comp is None else comp[at]
    cls = np.repeat(back, count)
    keep = np.bincount(cls, minlength=len(own)) >= least_shared(n)
    mine = keep[cls]
    cls, tok, freq = cls[mine], tok[mine], freq[mine]
    order = np.lexsort((tok, freq, cls))
    cls, tok, freq = cls[order], tok[order], freq[order]
    c = np.bincount(cls, minlength=len(own))[keep]
    bounds = np.concatenate(([0], np.cumsum(c))).astype(np.int32)
    hashes = [np.minimum.reduceat(mix64(tok + np.uint64((j + 1) * int(_STEP) % (1 << 64))), bounds[:-1]) if len(c) else np.zeros(0, np.uint64) for j in range(KEYS)]
    lists = lambda to, values: pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(values.view(np.int64)))
    cent = np.bincount(cls, np.log2(1.0 + freq), len(own))[keep] / n[keep]
    return pa.table({"fp": own[keep], "comp": comp[keep], "n": n[keep], "cent": cent, "keys": lists(np.arange(len(c) + 1) * KEYS, np.stack(hashes, 1).ravel()), "toks": lists(bounds, tok)})


def survivors(sent: DataFrame, n: int) -> DataFrame:
    """Classes with as many live tokens as a link needs."""
    return sent.groupBy("bucket").applyInArrow(_live(n), SENT).groupBy("bucket").applyInArrow(_gather, SURVIVOR)


def _hot_apart(hot_tok: np.ndarray):
    def run(batches):
        for b in batches:
            comp, (tokens, bounds) = b.column(0).to_numpy(), _lists(b.column(1))
            at = np.minimum(np.searchsorted(hot_tok, tokens), len(hot_tok) - 1)
            is_hot = hot_tok[at] == tokens
            at, c = at[is_hot], np.repeat(comp, np.diff(bounds))[is_hot]
            order = np.argsort(at, kind="stable")
            at, c = at[order], c[order]
            if len(at):
                cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hot_tok[at[cut]].view(np.int64), np.minimum.reduceat(c, cut), np.maximum.reduceat(c, cut), np.diff(np.r_[cut, len(at)]))], names=["tok", "lo", "hi", "m"])

    return run


def hot_apart(left: DataFrame, hot: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The hot tokens again, counted over left; those of one component get a frequency of 1."""
    if not len(hot[0]):
        return hot
    rows = left.select("comp", "toks").mapInArrow(_hot_apart(hot[0]), "tok long, lo long, hi long, m long").groupBy("tok").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("m").alias("m")).filter("lo <> hi").collect()
    m = np.ones(len(hot[0]), np.int64)
    m[np.searchsorted(hot[0], np.array([r["tok"] for r in rows], np.int64).view(np.uint64))] = [max(2, r["m"]) for r in rows]
    return hot[0], m


# --------------------------------------------------------------------------- prefix tree


class TokenTrie:
    """A block's sets as paths of ascending tokens; what paths share is stored once. A set may list
    only some of its tokens, those that others can share; its size counts all. Nodes lie level by
    level in arrays, children side by side, so that a walk takes a whole frontier at a time."""

    def __init__(self, sets: list[tuple[np.ndarray, int]], roots: np.ndarray):
        self.n = np.array([n for _, n in sets], np.int64)
        self.length = np.array([len(s) for s, _ in sets], np.int64)
        self.root = roots  # of each set, the component's least place
        names, ids = np.unique(np.concatenate([s for s, _ in sets]), return_inverse=True)
        self.ids = np.split(ids, np.cumsum(self.length)[:-1])
        self.flag = np.zeros(len(names), bool)
        self._build()
        self._bounds()
        self.relabel()

    def _build(self) -> None:
        order = sorted(range(len(self.ids)), key=lambda k: self.ids[k].astype(">u4").tobytes())
        lo, hi, up, owner, end = [0], [0], [-1], [0], np.zeros(len(order), np.int64)  # node 0: the root
        path, before = [0], None
        for k in order:
            s = self.ids[k]
            shared = 0
            if before is not None:
                m = min(len(s), len(before))
                off = np.flatnonzero(s[:m] != before[:m])
                shared = int(off[0]) if len(off) else m
            while len(path) > 1 and lo[path[-1]] >= shared:
                path.pop()
            top = path[-1]
            if hi[top] > shared:  # paths part within a node: its upper end becomes one of its own
                for column, value in ((lo, lo[top]), (hi, shared), (up, up[top]), (owner, owner[top])):
                    column.append(value)
                lo[top], up[top], path[-1] = shared, len(lo) - 1, len(lo) - 1
            if len(s) > shared:
                for column, value in ((lo, shared), (hi, len(s)), (up, path[-1]), (owner, k)):
                    column.append(value)
                path.append(len(lo) - 1)
            end[k], before = path[-1], s
        below: list[list[int]] = [[] for _ in lo]
        for node, parent in enumerate(up):
            if parent >= 0:
                below[parent].append(node)
        line = [0]
        for node in line:  # grows while it is read: level by level
            line += below[node]
        place = np.empty(len(line), np.int64)
        place[line] = np.arange(len(line))
        take = lambda column: np.array(column, np.int64)[line]
        self.top, self.deep = take(lo), take(hi)
        self.up = place[take(up)]
        self.kids = np.array([len(below[x]) for x in line], np.int64)
        self.first = np.cumsum(self.kids) - self.kids + 1
        self.part = np.concatenate([self.ids[o][a:b] for o, a, b in zip(take(owner).tolist(), self.top.tolist(), self.deep.tolist(), strict=True)])
        self.at = np.cumsum(self.deep - self.top) - (self.deep - self.top)
        self.end = place[end]

    def _rise(self, value: np.ndarray, what) -> np.ndarray:
        """Of each node, what (minimum or maximum) of the values of the sets below."""
        out = np.full(len(self.up), 1 << 60 if what is np.minimum else -1, np.int64)
        what.at(out, self.end, value)
        for a, b in reversed(self.levels):
            what.at(out, self.up[a:b], out[a:b])
        return out

    def _bounds(self) -> None:
        self.levels, a, b = [], 1, 1 + int(self.kids[0])
        while a < b:
            self.levels.append((a, b))
            a, b = b, b + int(self.kids[a:b].sum())
        self.least, self.most = self._rise(self.n, np.minimum), self._rise(self.n, np.maximum)
        self.longest = self._rise(self.length, np.maximum)
        self.last = np.where(self.deep > self.top, self.part[np.minimum(self.at + self.deep - self.top - 1, len(self.part) - 1)], -1)
        self.stop = np.argsort(self.end, kind="stable")  # sets, by the node that ends them
        self.stops = np.bincount(self.end, minlength=len(self.up))
        self.stop_at = np.cumsum(self.stops) - self.stops

    def relabel(self) -> None:
        """Note which nodes have sets of one component only."""
        self.one, most = self._rise(self.root, np.minimum), self._rise(self.root, np.maximum)
        self.mixed = self.one != most

    def join(self, i: int, j: int) -> bool:
        a, b = sorted((self.root[i], self.root[j]))
        self.root[self.root == b] = a
        return a != b

    def links(self, i: int):
        """Sets that link with set i, one at least of each other component that does."""
        s, n, flag = self.ids[i], int(self.n[i]), self.flag
        flag[s] = True
        nodes, shared = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(nodes):
            stops = self.stops[nodes]
            ends = self.stop[_runs(self.stop_at[nodes], stops)]
            both = np.repeat(shared, stops)
            for j in ends[100 * both >= T * (n + self.n[ends] - both)].tolist():
                if self.root[j] != self.root[i]:
                    yield j
                    self.join(i, j)
            kids = self.kids[nodes]
            shared, nodes = np.repeat(shared, kids), _runs(self.first[nodes], kids)
            go = (100 * self.most[nodes] >= T * n) & (100 * n >= T * self.least[nodes]) & (self.mixed[nodes] | (self.root[self.one[nodes]] != self.root[i]))
            nodes, shared = nodes[go], shared[go]
            if not len(nodes):
                break
            size = self.deep[nodes] - self.top[nodes]
            hits = flag[self.part[_runs(self.at[nodes], size)]]
            shared = shared + np.add.reduceat(hits, np.cumsum(size) - size, dtype=np.int64)
            rest = len(s) - np.searchsorted(s, self.last[nodes], "right")
            best = shared + np.minimum(rest, self.longest[nodes] - self.deep[nodes])
            go = (100 + T) * best >= T * (n + np.maximum(self.least[nodes], self.deep[nodes]))
            nodes, shared = nodes[go], shared[go]
        flag[s] = False


def link_block(names: list, sets: list[tuple[np.ndarray, int]], components: list | None = None) -> list[tuple]:
    """A spanning forest of the links among sets (tokens, size), beyond what the components have
    joined. The first set goes first: where it leads, most are joined at once."""
    some = [i for i, s in enumerate(sets) if len(s[0])]
    label: dict = {}
    roots = np.array([label.setdefault(components[i], k) if components else k for k, i in enumerate(some)], np.int64)
    if len(some) < 2 or (roots == roots[0]).all():
        return []
    trie, out, noted = TokenTrie([sets[i] for i in some], roots), [], 0
    for k in range(len(some)):
        out += [(names[some[k]], names[some[j]]) for j in trie.links(k)]
        if len(out) >= 2 * noted + 16:
            trie.relabel()
            noted = len(out)
            if not trie.mixed[0]:
                break
    return out


def _blocks(batches):
    """Rows (key, i, j, fp, comp, n, toks), sorted by block: links of each block."""
    key, names, comps, sets, out = None, [], [], [], []

    def flush():
        if len(names) > 1:
            out.extend(link_block(names, sets, comps))

    def rows():
        a, b = zip(*out, strict=True) if out else ((), ())
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        tokens, bounds = _lists(batch.column(6))
        for r, (*k, fp, comp, n) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True)):
            if k != key:
                flush()
                key, names, comps, sets = k, [], [], []
            if not names or names[-1] != fp:
                names.append(fp)
                comps.append(comp)
                sets.append((np.sort(tokens[bounds[r] : bounds[r + 1]]), n))
        yield rows()
    flush()
    yield rows()


def _links(blocks: DataFrame, left: DataFrame) -> DataFrame:
    """Links of blocks (key, i, j, fp, first); what is first leads its block."""
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, long work: not to be coalesced
    b = blocks.join(left.select("fp", "comp", "n", "toks"), "fp").repartition(tasks, "key", "i", "j")
    return b.sortWithinPartitions("key", "i", "j", F.desc("first"), "fp").select("key", "i", "j", "fp", "comp", "n", "toks").mapInArrow(tidy(_blocks), "a long, b long")


# --------------------------------------------------------------------------- components


def join_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and, for each, the least node of its component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    label = np.arange(len(nodes))
    x, y = np.split(at, 2)
    while len(x):
        hi, lo = np.maximum(x, y), np.minimum(x, y)
        order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
        first = np.r_[True, hi[1:] != hi[:-1]]
        label[hi[first]] = lo[first]  # roots hang on smaller ones, so there is no cycle
        while (label != (up := label[label])).any():
            label = up
        x, y = label[x], label[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[label]


def _one_task(batches):
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        nodes, comp = join_edges(*(np.concatenate(p) for p in zip(*parts, strict=True)))
        yield from pa.table({"fp": nodes, "comp": comp}).to_batches(max_chunksize=100_000)


def components(links: DataFrame) -> DataFrame:
    """(fp, comp) for every end of a link (a, b): the least end of its component. In each round every
    node goes to its least neighbour and the graph shrinks to the nodes that are left, until the
    edges are few enough, by count, for one task."""
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    names = None
    while edges.count() > ONE_TASK_EDGES:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("fp"), F.least("a", "b").alias("comp"))
        least = materialize(least, "steps")
        names = _renamed(names, least)
        a, b = (least.select(F.col("fp").alias(x), F.col("comp").alias(f"_{x}")) for x in "ab")
        edges = edges.join(a, "a").join(b, "b").filter("_a <> _b").select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")).distinct()
        edges = materialize(edges, "edges")
    return _renamed(names, materialize(edges.coalesce(1).mapInArrow(_one_task, "fp long, comp long"), "names"))


def _renamed(names: DataFrame | None, step: DataFrame) -> DataFrame:
    if names is None:
        return step
    step = step.select(F.col("fp").alias("comp"), F.col("comp").alias("to"))
    return materialize(names.join(step, "comp", "left").select("fp", F.coalesce("to", "comp").alias("comp")), "names")


# ---------------------------------------------------------------------------- the operator


def wave(left: DataFrame) -> DataFrame:
    """Links of each survivor's block: the others that follow the same leader, in chunks, each led
    by it. At most KEYS + 1 rows a survivor, before and after."""
    rows = left.select("fp", "cent", F.posexplode("keys").alias("j", "key"))
    leads = rows.groupBy("j", "key").agg(F.count("*").alias("m"), F.max(F.struct("cent", "fp")).alias("lead")).filter("m > 1")
    leads = materialize(leads.select("j", "key", F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks"), "lead"), "leads")
    best = F.max(F.struct("lead", "chunks", "j", "key")).alias("best")
    own = rows.join(leads, ["j", "key"]).groupBy("fp").agg(best).select("fp", "best.*")
    own = own.select("key", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int").alias("i"), "j", "fp", (F.col("fp") == F.col("lead.fp")).alias("first"))
    heads = leads.select("key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), "j", F.col("lead.fp").alias("fp"), F.lit(True).alias("first"))
    return _links(own.filter("not first").union(heads), left)


def cluster_blocks(left: DataFrame) -> DataFrame:
    """Blocks (key, i, j, fp, first) in which all pairs of survivors that may link, and are of
    different components, meet."""
    rows = left.select("fp", F.explode(F.slice("toks", F.lit(1), (F.size("toks") - _need() + 1).cast("int"))).alias("key"))
    heads = materialize(rows.groupBy("key").agg(F.count("*").alias("m"), F.min("fp").alias("head")).filter("m > 1").select("key", "head"), "heads")
    stars = rows.join(heads, "key").filter("fp <> head").select(F.col("fp").alias("a"), F.col("head").alias("b"))
    clusters = components(stars).withColumnRenamed("comp", "key").join(left.select("fp", "comp"), "fp")
    clusters = materialize(clusters, "clusters")
    parts = clusters.groupBy("key", "comp").agg(F.count("*").alias("k"))
    sizes = parts.groupBy("key").agg(F.sum("k").alias("m"), F.count("*").alias("comps"), F.max(F.struct("k", "comp")).alias("top"))
    # what is of one component has nothing left to find
    sizes = materialize(sizes.filter("comps > 1").select("key", "m", F.col("top.k").alias("k"), F.col("top.comp").alias("top")), "sizes")
    c = clusters.join(sizes, "key")
    hash_ = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    none, zero = F.lit(False).alias("first"), F.lit(0)
    small = c.filter(F.col("m") <= BLOCK).select("key", zero.alias("i"), zero.alias("j"), "fp", none)
    large = c.filter(F.col("m") > BLOCK)
    tops, rests = (F.greatest(F.lit(1), F.ceil(n * 2 / BLOCK)).cast("int") for n in (F.col("k"), F.col("m") - F.col("k")))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    large = large.withColumns({"tops": tops, "rests": rests})
    # chunk i of the largest component meets chunk j of the rest
    main = large.filter("comp = top").select("key", (hash_(F.col("tops")) + 1).alias("i"), F.explode(upto(F.col("rests"))).alias("j"), "fp", none)
    rest = large.filter("comp <> top").withColumn("c", hash_(F.col("rests")))
    meets = rest.select("key", F.explode(F.transform(upto(F.col("tops")), lambda x: x + 1)).alias("i"), F.col("c").alias("j"), "fp", none)
    # chunks of the rest meet each other
    pairs = rest.select("key", "c", F.explode(upto(F.col("rests"))).alias("o"), "fp")
    pairs = pairs.select("key", (-F.greatest("c", "o") - 1).alias("i"), F.least("c", "o").alias("j"), "fp", none)
    return small.union(main).union(meets).union(pairs)


def linked(docs: DataFrame, base: DataFrame) -> DataFrame:
    """(fp, comp) of all classes that link with another; base is docs' profile."""
    spark = docs.sparkSession
    size, count = base.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    hot = hot_tokens(base, count)
    n = parallelism(spark, size, max(BUCKET_BYTES, int(32 * size**0.5)))
    sent = docs.select("text").mapInArrow(tidy(_from_texts(n, max(4 << 20, 256 * n), hot)), SENT)
    left = materialize(survivors(sent, n), "survivors")
    count, links, names = left.count(), [], None
    while count:
        links.append(materialize(wave(left), "links"))
        names = components(_union(links))
        now = left.select("fp", "n", "toks").join(names, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
        now = materialize(now, "named")
        left = materialize(survivors(now.select("fp", "comp", "n", "toks").mapInArrow(tidy(_from_survivors(n, hot_apart(now, hot))), SENT), n), "survivors")
        before, count = count, left.count()
        if count <= FEW or 2 * count > before:
            break
    if count:
        links.append(materialize(_links(cluster_blocks(left), left), "links"))
        names = components(_union(links))
    return names if names is not None else left.select("fp", "comp")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each of docs (doc_id, text)."""
    base = materialize(profile(docs), "profile")
    names = linked(docs, base)
    classes = base.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    named = materialize(names.join(classes, "fp"), "named")
    least = materialize(named.groupBy("comp").agg(F.min("rep").alias("component_id")), "least")
    ids = named.join(least, "comp").select("fp", "component_id")
    ids = materialize(classes.join(ids, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "ids")
    return base.join(ids, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _row_hash(docs: DataFrame) -> Column:
    """A hash of the whole row; of maps, which have none, only the other columns count."""
    return F.xxhash64(*[docs[c] for c, t in docs.dtypes if "map<" not in t])


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: of the smallest doc_id (null only if there is no other), then of
    the least fingerprint and row hash; once if the row is repeated. Texts without words link
    with nothing and stay, those with an id once if the row is repeated. Rows are wrapped, so no
    column of docs can clash with those used here."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), _row_hash(docs).alias("row"), F.struct(*[docs[c] for c in docs.columns]).alias("whole"))
    bare = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    rest = rows.filter(~bare)
    base = materialize(profile(rest, F.col("row")), "profile")
    least = lambda *by: F.min(F.struct(*by)).alias("least")
    classes = base.filter("n > 0").groupBy("fp").agg(least(F.col("doc_id").isNull(), "doc_id", "fp", "row"))
    found = classes.join(linked(rest, base), "fp", "left").groupBy(F.coalesce("comp", "fp").alias("comp")).agg(F.min("least").alias("least"))
    keep = materialize(found.select(F.col("least.row").alias("row")).union(base.filter("n = 0").select("row")), "keep")
    once = rest.select("row", "whole").join(keep, "row", "left_semi").groupBy("row").agg(F.first("whole").alias("whole"))
    return once.select("whole").union(rows.filter(bare).select("whole")).select("whole.*")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
n AS (SELECT doc_id, CAST(coalesce(len(s), 0) AS BIGINT) AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM t a JOIN t b USING (t) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
