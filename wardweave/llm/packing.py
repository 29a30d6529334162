"""Hierarchical multi-length packing of tokenised documents.

A document's ids are those of the tokenizer, then one end id (a null text is empty: the end id
alone). Whole windows of the largest size are cut off first; what remains of a document is
routed to the smallest tier that holds it. Windows of a tier take one of its remainders; the
gap is filled from shorter tiers, largest fitting piece first, and closed by cutting a shorter
document. What the last window of a run lacks is avoided by splitting its content into powers
of two. So no sequence has padding. Sequences are dealt to step groups of about equal tokens,
longest first, so that groups mix lengths alike.

Runs are Arrow batches: memory is bounded by a batch, nothing is shuffled, no group is hot, and
a lost task repeats with the same pieces. Repeated rows are packed each on their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import Merges
from .common import flat, mix64, release, slices, table, tidy, word_hashes, words

TIERS = (2048, 1024, 512, 256)
END_ID = 1
STEP_TOKENS = 32 * 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long"


_MARKS = b".,;:!?"
_MARK = np.zeros(256, np.int64)
_MARK[list(_MARKS)] = np.arange(1, len(_MARKS) + 1)
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
_SMALL = np.zeros(256, bool)  # second bytes of Latin-1's small letters
_SMALL[0x9F:0xC0], _SMALL[0xB7] = True, False


class WordTokens:
    """Ids of texts, word by word. The tokenizer drops blanks and never joins what they part, so
    words are independent, those that hold its special tokens too; a mark after plain letters is a token run of its own, and the case of
    ASCII letters is dropped. Words are known by 64-bit hashes in a table of bounded size, which
    starts anew when it is full; what it lacks is encoded once a slice, plain words by `Merges`,
    others by the library."""

    SLOTS = 20

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(c.isspace() for t in self.specials for c in t):
            raise ValueError(f"an added token of {path} crosses words")
        self.merges = Merges(path)
        probe = [b"a", b"the", b"packing", b"sequences", b"stra\xc3\x9fe", b"\xc3\xa9t\xc3\xa9", b"zzzz", b"abababab", b"internationalisation"]
        if not self.merges.check(self._encode, probe):
            raise ValueError(f"the merges of {path} don't give its library's ids")
        self.fixed = self._encode([bytes([m]) for m in _MARKS])
        self._clear()

    def _clear(self) -> None:
        self.keys, self.entry = np.zeros(1 << self.SLOTS, np.uint64), np.full(1 << self.SLOTS, -1, np.int32)
        self.ids, self.size = np.frombuffer(b"".join(self.fixed), np.int32), np.array([len(x) // 4 for x in self.fixed], np.int64)

    def _encode(self, new: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(new), 4096):
            part = [w.decode() for w in new[at : at + 4096]]
            if any(t in w for w in part for t in self.specials):  # the library gives these no word's number
                out += [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.int32).tobytes() for w in part]
                continue
            e = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, np.int32)
            owner = np.array(e.word_ids, np.int64)
            cut = np.searchsorted(owner, np.arange(len(part) + 1)) * 4
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return out

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's entry, or -1."""
        at = (keys >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        out = self.entry[at]
        off = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(off):
            at[off] = (at[off] + 1) & ((1 << self.SLOTS) - 1)
            out[off] = self.entry[at[off]]
            off = off[(out[off] >= 0) & (self.keys[at[off]] != keys[off])]
        return out

    def _insert(self, keys: np.ndarray, entries: np.ndarray) -> None:
        """Distinct keys that are not there yet; of those that meet in a slot one stays."""
        at = (keys >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.entry[at[todo]] < 0]
            self.entry[at[free]] = entries[free]
            self.keys[at[free]] = keys[free]
            todo = todo[self.entry[at[todo]] != entries[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.SLOTS) - 1)

    def _entries(self, data: np.ndarray, starts, ends, keys, plain) -> np.ndarray:
        found = self._find(keys)
        lacks = np.flatnonzero(found < 0)
        if len(lacks):
            new, first = np.unique(keys[lacks], return_index=True)
            if len(self.size) + len(new) > (1 << self.SLOTS) * 6 // 10:
                self._clear()
                found = np.full(len(keys), -1, np.int32)
                new, first = np.unique(keys, return_index=True)
                lacks = np.arange(len(keys))
            at = lacks[first]
            blob = data.tobytes()
            text = [blob[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            is_plain = plain[at]
            ids = np.empty(len(text), object)
            ids[is_plain] = self.merges.encode([t.lower() for t, p in zip(text, is_plain.tolist(), strict=True) if p])
            ids[~is_plain] = self._encode([t for t, p in zip(text, is_plain.tolist(), strict=True) if not p])
            entries = np.arange(len(self.size), len(self.size) + len(new), dtype=np.int32)
            self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(ids.tolist()), np.int32)))
            self.size = np.concatenate((self.size, np.array([len(x) // 4 for x in ids], np.int64)))
            if len(self.size) <= (1 << self.SLOTS) * 9 // 10:
                self._insert(new, entries)
                found[lacks] = self._find(keys[lacks])
            else:  # a giant slice: used now, not kept
                found[lacks] = entries[np.searchsorted(new, keys[lacks])]
        return found.astype(np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids on end and where each text's begin; an end id closes each text."""
        starts, ends, counts = words(data, offsets)
        n = len(starts)
        small = np.zeros(len(data), bool)
        small[1:] = _SMALL[data[1:]] & (data[:-1] == 0xC3)
        bad = np.concatenate(([0], np.cumsum(~(_ASCII[data] | (data == 0xC3) | small))))
        mark = _MARK[data[ends - 1]] if n else np.zeros(0, np.int64)
        stem = ends - (mark > 0)
        plain = (bad[stem] == bad[starts]) & (stem > starts)
        mark[~plain] = 0
        stem[~plain] = ends[~plain]
        keys = np.empty(n, np.uint64)
        keys[plain] = word_hashes(data, starts[plain], stem[plain])
        keys[~plain] = mix64(word_hashes(data, starts[~plain], stem[~plain], lower=False) ^ np.uint64(0x5851F42D4C957F2D))
        entry = self._entries(data, starts, stem, keys, plain)
        # in order: each word, its mark, and each text's end
        place = np.arange(n) + np.cumsum(mark > 0) - (mark > 0) + np.repeat(np.arange(len(counts)), counts)
        total = n + int((mark > 0).sum()) + len(counts)
        row = np.full(total, len(self.size), np.int64)
        row[place] = entry
        row[place[mark > 0] + 1] = mark[mark > 0] - 1
        last = np.cumsum(counts + np.bincount(np.repeat(np.arange(len(counts)), counts)[mark > 0], minlength=len(counts)) + 1) - 1
        ids, size = np.append(self.ids, np.int32(end_id)), np.append(self.size, 1)
        begin = np.cumsum(size) - size
        k = size[row]
        to = np.cumsum(k)
        return ids[np.repeat(begin[row] - (to - k), k) + np.arange(to[-1] if total else 0)], np.concatenate(([0], to[last]))


def pack(lengths: list[int], tiers=TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, start, length). Every id lies in one piece; each
    sequence is as long as a tier, but the last ones, whose lengths are lower powers of two."""
    top = tiers[0]
    out: list[list[tuple[int, int, int]]] = []
    pool: list[list[tuple[int, int]]] = [[] for _ in range(top + 1)]
    mask = 0
    for d, n in enumerate(lengths):
        full = n - n % top
        out += [[(d, s, top)] for s in range(0, full, top)]
        if n > full:
            pool[n - full].append((d, full))
            mask |= 1 << (n - full)

    def take(size: int) -> tuple[int, int]:
        nonlocal mask
        got = pool[size].pop()
        if not pool[size]:
            mask ^= 1 << size
        return got

    for k, tier in enumerate(tiers):
        shorter = tiers[k + 1] if k + 1 < len(tiers) else 0
        own = mask >> (shorter + 1)
        while own:  # windows of this tier, the longest remainder first
            window, room = [], tier
            size = shorter + own.bit_length()
            while room:
                d, s = take(size)
                use = min(size, room)
                window.append((d, s, use))
                room -= use
                if use < size:
                    pool[size - use].append((d, s + use))
                    mask |= 1 << (size - use)
                if not room:
                    break
                fits = mask & ((1 << (min(room, shorter or room) + 1)) - 1) or mask & ((1 << (room + 1)) - 1)
                if fits:
                    size = fits.bit_length() - 1
                elif mask:  # cut the shortest
                    size = (mask & -mask).bit_length() - 1
                else:
                    break
            if not room:
                out.append(window)
            else:  # nothing is left: powers of two
                left = tier - room
                i = used = 0
                while left:
                    goal = 1 << (left.bit_length() - 1)
                    left -= goal
                    part = []
                    while goal:
                        d, s, n = window[i]
                        use = min(n - used, goal)
                        part.append((d, s + used, use))
                        used += use
                        goal -= use
                        if used == n:
                            i, used = i + 1, 0
                    out.append(part)
            own = mask >> (shorter + 1)
    return out


def step_groups(sizes: list[int], budget: int = STEP_TOKENS) -> list[int]:
    """A group for each sequence: longest first, dealt to and fro, so sums and mixes are even."""
    n = max(1, round(sum(sizes) / budget))
    groups = [0] * len(sizes)
    for nth, i in enumerate(sorted(range(len(sizes)), key=lambda i: -sizes[i])):
        lap, at = divmod(nth, n)
        groups[i] = at if lap % 2 == 0 else n - 1 - at
    return groups


_READY: dict[str, WordTokens] = {}


def packer(path: str, tiers=TIERS, end_id: int = END_ID, with_ids: bool = False):
    """A function for mapInArrow over (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if path not in _READY:
            _READY[path] = WordTokens(path)
        tokens = _READY[path]
        context = TaskContext.get()
        sequence = group = (context.partitionId() if context else 0) << 36
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = flat(batch.column(1))
            ids, begin, at = [], [np.zeros(1, np.int64)], 0
            for a, b in slices(offsets, 1 << 20):
                one, first = tokens.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], end_id)
                ids.append(one)
                begin.append(first[1:] + at)
                at += len(one)
            del data
            ids, begin = np.concatenate(ids), np.concatenate(begin)
            n = np.diff(begin)
            packed = pack(n.tolist(), tiers)
            sizes = [sum(p[2] for p in x) for x in packed]
            groups = step_groups(sizes)
            raw = memoryview(ids.astype("<i4", copy=False)).cast("B")
            rows = [(d, s, k, sequence + q, sum_, sizes[q], group + groups[q]) for q, x in enumerate(packed) for (d, s, k), sum_ in zip(x, _starts(x), strict=True)]
            d, s, k, q, o, z, g = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            lo = (begin[d] + s) * 4
            crc = np.fromiter((zlib.crc32(raw[x:y]) for x, y in zip(lo.tolist(), (lo + 4 * k).tolist(), strict=True)), np.int64, len(d))
            columns = [batch.column(0).take(pa.array(d)), s, k, crc, n[d], q, o, z, g]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(raw[x:y], np.int32) for x, y in zip(lo.tolist(), (lo + 4 * k).tolist(), strict=True)], pa.list_(pa.int32())))
                names.append("ids")
            sequence += len(packed)
            group += max(groups) + 1
            table_ = pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)
            del ids, raw, rows
            yield from table_.to_batches(max_chunksize=20_000)
            release()

    return run


def _starts(pieces) -> list[int]:
    out, at = [], 0
    for p in pieces:
        out.append(at)
        at += p[2]
    return out


def pack_documents(docs: DataFrame, path: str | None = None, tiers=TIERS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece; with_ids adds the ids themselves."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return d.mapInArrow(tidy(packer(path, tiers, end_id, with_ids)), SCHEMA + (", ids array<int>" if with_ids else ""))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
