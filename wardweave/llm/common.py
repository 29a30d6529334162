"""Shared helpers of the training-data operators: session folders, crc residues and
vectorised word handling on Arrow string columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: anything but the ASCII blanks 0x20 and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local master may go without one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.wardweave.scratch", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="wardweave-")
    spark.conf.set("spark.wardweave.scratch", at)
    return at


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/wardweave/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write to the shared folder, with Parquet's options, and read again."""
    spark = df.sparkSession
    at = new_folder(spark, name)
    df.write.options(**options).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def residue(doc_id: str, m: int) -> Column:
    """crc32(doc_id as text) mod m; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % m


def parallelism(spark: SparkSession, size: int, each: int) -> int:
    """Buckets for `size` units at `each` a bucket, at least one for each shuffle partition."""
    return int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each), 1))


# ---------------------------------------------------------------- words of Arrow columns

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(BLANKS)] = True
_M, _SLICE = 0x9E3779B97F4A7C15 | 1, 1 << 21
_MASK = (1 << 64) - 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (xor-shift and multiply, modulo 2**64)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_SLICE, 1 << max(1, n - 1).bit_length())
    if size not in _POWERS:
        both = []
        for m in (_M, pow(_M, -1, 1 << 64)):
            steps = np.full(size, m, dtype=np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        if size > _SLICE:  # a giant word: not worth keeping
            return tuple(both)
        _POWERS[size] = tuple(both)
    return _POWERS[size]


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] :], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many each text has. No word crosses texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_BLANK[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin = inside & first[:-1]
    begin[1:] |= inside[1:] & ~inside[:-1]
    end = inside & first[1:]
    end[:-1] |= inside[:-1] & ~inside[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, by prefix sums of a polynomial: no loop over words."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _SLICE, "right")))
        part = data[base : ends[to - 1]]
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(((_LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        at = to
    return mix64(out)


def release() -> None:
    """Give freed memory back to the system: a worker lives on through other operators' stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def tidy(run):
    """A function over Arrow batches that leaves no freed memory behind."""

    def over_batches(batches):
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return over_batches


def slices(offsets: np.ndarray, most: int = 4 << 20):
    """Ranges of texts that hold about `most` bytes; a longer text stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def group_sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.add.reduceat(values, at)
