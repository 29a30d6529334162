"""WARC archives and an external merge of their capture indexes.

`write_archives` puts a record for each page into gzipped WARC files in the shared folder: the
first of equal payloads, that with the smallest page_id, as a response, the others as revisits
that refer to it. `read_index` reads the files back, checks digests, and gives each file's
captures as a run, sorted by URL key and time. `merge_runs` cuts runs at common key bounds and
merges the pieces of each range with a loser tree, so (range_id, range_pos) is the global order
of captures and each URL's history stands together but at a bound.

Bounds come from a sample of at most `MOST_SAMPLES` files' keys; they balance ranges and change
no row. A range takes the full key (URL, time, page), so a URL with a third of all captures
spreads over ranges. Files roll at `FILE_BYTES`, which bounds memory; names hold the attempt, and
only those that a finished task has listed are read. Null html is an empty payload; a null url
has the empty key; a null page_id is never first unless alone, and is kept as null; repeated
rows are records of their own, and those equal to the first in page_id too are responses.
Empty tables give no rows; other columns are ignored. Capture times count seconds by page_id
from `EPOCH`, as pages have none.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_folder, parallelism, table

FILE_BYTES, RANGE_ROWS, MOST_SAMPLES, EPOCH = 48 << 20, 50_000, 2048, datetime(2020, 1, 1, tzinfo=UTC)
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
NAME = "urn:wardweave:page:"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: four letters for each five hex digits."""
    hexes = F.sha1(payload)
    letters = []
    for i in range(8):
        v = F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query, all in lower case."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip().lower())
        host, port = (u.hostname or ""), u.port
    except ValueError:
        return url.strip().lower()
    labels = [x for x in host.split(".") if x]
    if labels[:1] == ["www"]:
        labels = labels[1:]
    return ",".join(reversed(labels)) + (f":{port}" if port else "") + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def captured(page_id: int | None) -> datetime:
    return EPOCH + timedelta(seconds=(page_id or 0) % (10**10))


def classify(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses."""
    p = pages.select(pages["page_id"].cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", base32_sha1(F.col("payload")))
    many = p.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).filter("n > 1").select(F.col("digest").alias("_d"), "first")
    p = p.join(many, p["digest"] == many["_d"], "left").drop("_d")
    return p.withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


# ------------------------------------------------------------------------------- writing


def _clean(text: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def _name(page_id: int | None) -> str:
    return f"<{NAME}{'' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {captured(page_id):%Y-%m-%dT%H:%M:%SZ}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


#: Hadoop's names of stores beside those that Arrow knows.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def arrow_uri(uri: str) -> str:
    """A Hadoop folder as Arrow names it; a bare path stays a path."""
    scheme, sep, rest = uri.partition("://")
    return SCHEMES.get(scheme, scheme) + sep + rest


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(arrow_uri(uri))


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        t = TaskContext.get()
        stem = f"captures-{t.partitionId():06d}-{t.taskAttemptId()}"
        made, out, raw, n, samples = [], None, 0, 0, []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                made.append((f"{stem}-{len(made):04d}.warc.gz", n, samples[:: max(1, len(samples) // 16)]))
                out = None

        for batch in batches:
            for page_id, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out, raw, n, samples = fs.open_output_stream(f"{root}/{stem}-{len(made):04d}.warc.gz", compression=None), 0, 0, []
                data = record(page_id, url, payload, digest, refers)
                c = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(c.compress(data) + c.flush())
                raw, n = raw + len(data), n + 1
                if n % 64 == 1:
                    samples.append(json.dumps([url_key(None if url is None else _clean(url)), f"{captured(page_id):%Y-%m-%dT%H:%M:%SZ}", -1 if page_id is None else page_id]))
                if raw >= FILE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.list_(pa.string()))], names=["file", "records", "samples"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """The folder and its files (file, records, samples)."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    p = classify(pages).select("page_id", "url", "payload", "digest", "refers_to")
    return folder, materialize(p.mapInArrow(_write(folder), "file string, records long, samples array<string>"), "warc-files")


# ------------------------------------------------------------------------------- reading


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member."""
    view, at = memoryview(data), 0
    while at < len(data):
        d, parts, p = zlib.decompressobj(31), [], at
        while not d.eof:
            if p >= len(data):
                raise ValueError("an archive ends within a record")
            parts.append(d.decompress(view[p : p + 16384]))
            p += min(16384, len(data) - p)
        p -= len(d.unused_data)
        yield at, p - at, b"".join(parts)
        at = p


def parse(content: bytes) -> dict:
    """A record's fields; response payloads are checked against their digest."""
    head, _, body = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    f = dict(x.split(": ", 1) for x in lines[1:])
    body = body[: int(f["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(next(x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
    if f["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of {f['WARC-Record-ID']} differs from its digest")
    number = lambda x: int(x[len(NAME) + 1 : -1]) if x and len(x) > len(NAME) + 2 else None
    return {"url": f.get("WARC-Target-URI"), "time": f["WARC-Date"], "page_id": number(f["WARC-Record-ID"]), "type": f["WARC-Type"], "digest": digest, "bytes": size, "refers_to": number(f.get("WARC-Refers-To"))}


def _read(folder: str, bounds):
    """One sorted run a file, cut at the bounds; a capture is a tuple, its key first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bisect
        import pickle

        fs, root = _open(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{file}", compression=None) as f:
                    data = f.read()
                found = []
                for at, n, content in members(data):
                    r = parse(content)
                    found.append(((url_key(r["url"]), r["time"], r["page_id"] if r["page_id"] is not None else -1), r["bytes"], r["digest"], r["type"], r["refers_to"], file, at, n))
                found.sort()
                cut = [0, *(bisect.bisect_left(found, (b,)) for b in bounds.value), len(found)]
                rows = [(i, pickle.dumps(found[a:b])) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["range_id", "run"])

    return run


def key_bounds(files: DataFrame, ranges: int) -> list[tuple]:
    """Bounds of about equal ranges, from the keys sampled in a bounded number of files."""
    keys = sorted(tuple(json.loads(k)) for r in files.orderBy(F.xxhash64("file")).limit(MOST_SAMPLES).select("samples").collect() for k in r[0])
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


# ------------------------------------------------------------------------------- merging


class LoserTree:
    """Merges sorted runs: inner nodes hold the losers of their matches, so each step replays
    one path."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, k = runs, [0] * len(runs), len(runs)
        self.tree = [-1] * max(1, k)
        for i in range(k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.at[a], self.at[b]
        if x >= len(self.runs[a]) or y >= len(self.runs[b]):
            return y >= len(self.runs[b]) and (x < len(self.runs[a]) or a < b)
        x, y = self.runs[a][x], self.runs[b][y]
        return x[0] < y[0] or x[0] == y[0] and a < b

    def _play(self, i: int) -> None:
        tree, node = self.tree, (i + len(self.runs)) >> 1
        while node:
            if tree[node] < 0:  # the first to come here waits
                tree[node] = i
                return
            if self._beats(tree[node], i):
                tree[node], i = i, tree[node]
            node >>= 1
        tree[0] = i

    def __iter__(self):
        left = sum(map(len, self.runs))
        for _ in range(left):
            i = self.tree[0]
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self._play(i)


MERGED = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured_at string, range_id int, range_pos long, warc_file string, warc_offset long, warc_length long"


def _merge(t: pa.Table) -> pa.Table:
    import pickle

    number = t["range_id"][0].as_py()
    names = [f.split()[0] for f in MERGED.split(", ")]
    rows = [(None if k[2] < 0 else k[2], size, digest, kind, refers, k[0], k[1], number, pos, file, at, n) for pos, (k, size, digest, kind, refers, file, at, n) in enumerate(LoserTree([pickle.loads(r) for r in t["run"].to_pylist()]))]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.table([pa.array(c, kinds[f.split()[1]]) for c, f in zip(zip(*rows, strict=True), MERGED.split(", "), strict=True)], names)


def merged_index(folder: str, files: DataFrame) -> DataFrame:
    """All captures of the files, read back and in global order by (range_id, range_pos)."""
    spark = files.sparkSession
    total = files.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    bounds = spark.sparkContext.broadcast(key_bounds(files, parallelism(spark, total, RANGE_ROWS)))
    n = max(1, files.count())
    runs = files.select("file").repartition(min(n, 4 * spark.sparkContext.defaultParallelism + n // 8)).mapInArrow(_read(folder, bounds), "range_id int, run binary")
    return runs.groupBy("range_id").applyInArrow(_merge, MERGED)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_index(*write_archives(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM h
"""
