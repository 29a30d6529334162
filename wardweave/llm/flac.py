"""FLAC: bytes as 8-bit mono samples, encoded, decoded and checked, many frames abreast.

The decoder reads frame headers (CRC-8 verified), constant, verbatim, fixed and linear-predictor
subframes with Rice residuals in partitions (CRC-16 of each frame verified) and gives PCM blocks
with their first sample. Bits are read for all frames of a batch in step, one residual of each
at a time. Frames are found by a seek table that lists all of them, or one after another.
The encoder picks, for each frame of `BLOCK` samples, the predictor of least residual among
fixed orders 0 to 2 and a 4-tap linear one, and writes a seek point for each frame. Its
arithmetic is exact integers up to the taps, so equal texts give equal streams.

The payload of a text (null: empty) is its UTF-8 padded with blanks to a positive multiple of
192. The query writes the streams to the shared folder and digests what it reads back. Memory is
bounded by a slice of texts, or one longer text. Corrupt streams raise FlacError. Repeated rows
are coded each on their own; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import flat, materialize, slices, table

BLOCK, UNIT, RATE, TAPS, PRECISION, SHIFT = 1152, 192, 8000, 4, 10, 8
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class FlacError(ValueError):
    """A stream that cannot be decoded or fails a check."""


def _crc_table(bits: int, poly: int) -> np.ndarray:
    t = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        t = np.where(t >> (bits - 1) & 1, (t << 1) ^ poly, t << 1) & ((1 << bits) - 1)
    return t


_CRC8 = _crc_table(8, 0x07)
_CRC16 = _crc_table(16, 0x8005)
_X = np.arange(65536)
_PAIR = ((_X << 8) & 0xFFFF) ^ _CRC16[_X >> 8]
_PAIR = (((_PAIR << 8) & 0xFFFF) ^ _CRC16[_PAIR >> 8]).astype(np.uint16)


def _crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def _crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each range; zeros before a range leave a CRC that starts at zero as it is."""
    wide = int((ends - starts).max()) + 1 & ~1
    c = np.zeros(len(starts), np.uint16)
    for back in range(wide, 0, -2):
        a, b = ends - back, ends - back + 1
        w = (np.where(a >= starts, data[np.maximum(a, 0)], 0).astype(np.uint16) << 8) | np.where(b >= starts, data[np.maximum(b, 0)], 0)
        c = _PAIR[c ^ w]
    return c.astype(np.int64)


# ------------------------------------------------------------------------------ encoding


def _number(n: int) -> bytes:
    """A frame number in FLAC's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    size = 2
    while n >= 1 << (5 * size + 1):
        size += 1
    out = [0x80 | (n >> (6 * k)) & 0x3F for k in range(size - 1)]
    return bytes([(0xFF00 >> size) & 0xFF | n >> (6 * (size - 1)), *reversed(out)])


_HEADERS: dict[tuple[int, int], bytes] = {}


def _header(number: int, n: int) -> bytes:
    if (number, n) not in _HEADERS:
        h = b"\xff\xf8\x70\x02" + _number(number) + (n - 1).to_bytes(2, "big")
        if len(_HEADERS) > 100_000:
            return h + bytes([_crc8(h)])
        _HEADERS[number, n] = h + bytes([_crc8(h)])
    return _HEADERS[number, n]


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def _linear(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Quantised taps of each frame, by Levinson's recursion on exact autocorrelations."""
    r = np.stack([(x[:, k:] * x[:, : x.shape[1] - k]).sum(1, dtype=np.int64) for k in range(TAPS + 1)]).astype(np.float64)
    error = r[0] * 1.0001 + 1
    a = np.zeros((TAPS, len(n)))
    for i in range(TAPS):
        k = (r[i + 1] - sum((a[j] * r[i - j] for j in range(i)), np.zeros(len(n)))) / error
        new = a.copy()
        new[i] = k
        for j in range(i):
            new[j] = a[j] - k * a[i - 1 - j]
        a, error = new, error * (1 - k * k)
    top = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << SHIFT)), -top - 1, top).astype(np.int32)


def _residual(x: np.ndarray, taps: np.ndarray, shift: int) -> np.ndarray:
    """taps: order x frames. The first `order` samples are kept as they are."""
    p = np.zeros_like(x)
    order = len(taps)
    for j in range(order):
        p[:, order:] += taps[j][:, None] * x[:, order - 1 - j : x.shape[1] - 1 - j]
    return x - (p >> shift)


def encode(payloads: np.ndarray, begin: np.ndarray, size: np.ndarray) -> list[bytes]:
    """A stream for each payload, of `size` bytes from `begin` in payloads."""
    frames = -(-size // BLOCK)
    owner = np.repeat(np.arange(len(size)), frames)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(frames) - frames, frames)
    start = begin[owner] + number * BLOCK
    n = np.minimum(BLOCK, size[owner] - number * BLOCK)
    wide = int(n.max())
    t = np.arange(wide)
    live = t < n[:, None]
    raw = payloads[np.minimum(start[:, None] + t, len(payloads) - 1)]
    x = np.where(live, raw.astype(np.int32) - 128, 0)
    taps = _linear(x, n)
    options = [(np.array(f, np.int32)[:, None] * np.ones((1, len(n)), np.int32), 0) for f in FIXED[:3]] + [(taps, SHIFT)]
    orders = np.array([len(o[0]) for o in options])
    residuals = [_residual(x, *o) for o in options]
    cost = np.stack([np.where(live, np.abs(r), 0)[:, 2:].sum(1) for r in residuals])
    pick = cost.argmin(0)
    r = np.choose(pick[:, None], residuals)
    order = orders[pick]
    coded = live & (t >= order[:, None])
    u = np.where(coded, (r << 1) ^ (r >> 31), 0).astype(np.uint32)
    m = n - order
    guess = np.maximum(0, np.floor(np.log2(np.maximum(1, u.sum(1) / m))).astype(np.int64))
    best, k = np.full(len(n), 1 << 60), guess
    for step in (-1, 0, 1):
        g = np.clip(guess + step, 0, 14)
        total = (u >> g[:, None].astype(np.uint32)).sum(1).astype(np.int64) + (g + 1) * m
        k = np.where(total < best, g, k)
        best = np.minimum(best, total)
    linear = pick == 3
    body = 8 + 8 * order + np.where(linear, 9 + PRECISION * TAPS, 0) + 10 + best
    constant = (np.where(live, x, x[:, :1]) == x[:, :1]).all(1)
    verbatim = ~constant & (body > 8 + 8 * n)
    rice = ~constant & ~verbatim
    body = np.where(constant, 16, np.where(verbatim, 8 + 8 * n, body))
    heads = [_header(a, b) for a, b in zip(number.tolist(), n.tolist(), strict=True)]
    h = np.array([len(b) for b in heads])
    bytes_ = h + (body + 7) // 8 + 2
    end = np.cumsum(bytes_)
    at = end - bytes_
    bits = np.zeros(int(end[-1]) * 8, np.uint8)
    p = (at + h) * 8
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(linear, 32 + TAPS - 1, 8 + order)))
    _put(bits, p, kind << 1, 8)
    p = p + 8
    _put(bits, p[constant], x[constant, 0] & 255, 8)
    for row in np.flatnonzero(verbatim):
        bits[p[row] : p[row] + 8 * n[row]] = np.unpackbits((x[row, : n[row]] & 255).astype(np.uint8))
    for j in range(TAPS):
        w = rice & (order > j)
        _put(bits, p[w] + 8 * j, x[w, j] & 255, 8)
    p = p + 8 * order
    w = rice & linear
    _put(bits, p[w], np.full(int(w.sum()), (PRECISION - 1) << 5 | SHIFT), 9)
    for j in range(TAPS):
        _put(bits, p[w] + 9 + PRECISION * j, taps[j][w] & ((1 << PRECISION) - 1), PRECISION)
    p = p + np.where(linear, 9 + PRECISION * TAPS, 0)
    _put(bits, p[rice], k[rice], 10)
    p = p + 10
    coded &= rice[:, None]
    f, _ = np.nonzero(coded)
    v, kk = u[coded], k[f].astype(np.uint32)
    length = (v >> kk).astype(np.int64) + 1 + kk
    stop = np.cumsum(length)
    before = np.concatenate(([0], stop))[np.searchsorted(f, np.arange(len(n)))]
    stop = stop - before[f] + p[f]  # behind each code
    bits[stop - 1 - kk] = 1
    for j in range(int(kk.max()) if len(kk) else 0):
        w = kk > j
        bits[(stop - 1 - j)[w]] = (v[w] >> j) & 1
    data = np.packbits(bits)
    flat_heads = np.frombuffer(b"".join(heads), np.uint8)
    data[np.repeat(at - (np.cumsum(h) - h), h) + np.arange(len(flat_heads))] = flat_heads
    crc = _crc16(data, at, end - 2)
    data[end - 2], data[end - 1] = crc >> 8, crc & 255
    blob, out, first = data.tobytes(), [], 0
    whole = payloads.tobytes()
    for d, c in enumerate(frames.tolist()):
        a, b = int(at[first]), int(end[first + c - 1])
        sizes = bytes_[first : first + c]
        total = int(size[d])
        samples = (np.frombuffer(whole, np.uint8, total, int(begin[d])) ^ 0x80).tobytes()
        info = b"".join((min(BLOCK, total).to_bytes(2, "big"), min(BLOCK, total).to_bytes(2, "big"), int(sizes.min()).to_bytes(3, "big"), int(sizes.max()).to_bytes(3, "big"),
                         (RATE << 44 | 7 << 36 | total).to_bytes(8, "big"), hashlib.md5(samples).digest()))
        seek = np.zeros(c, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        seek["sample"], seek["offset"], seek["n"] = number[first : first + c] * BLOCK, at[first : first + c] - a, n[first : first + c]
        seek = seek.tobytes()
        out.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + blob[a:b])
        first += c
    return out


# ------------------------------------------------------------------------------ decoding


class _Bits:
    """Reads at many bit positions at once."""

    def __init__(self, data: bytes):
        padded = np.frombuffer(data + bytes(16), np.uint8)
        self.size = len(data) * 8
        self.words = np.ndarray((len(data) + 9,), ">u8", padded, 0, (1,))

    def window(self, at: np.ndarray) -> np.ndarray:
        """64 bits from each place, at least 57 of them right."""
        if len(at) and at.max() > self.size:
            raise FlacError("a frame runs beyond its stream")
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width: int) -> np.ndarray:
        return (self.window(at) >> np.uint64(64 - width)).astype(np.int64)


def _signed(v: np.ndarray, width) -> np.ndarray:
    half = np.int64(1) << (np.asarray(width) - 1)
    return (v ^ half) - half


def _frame_head(data: bytes, at: int) -> tuple[int, int, int]:
    """Number, samples and length of a frame's header."""
    if data[at : at + 2] != b"\xff\xf8":
        raise FlacError(f"no frame of fixed size at byte {at}")
    size, rate = data[at + 2] >> 4, data[at + 2] & 15
    if data[at + 3] not in (0x00, 0x02):
        raise FlacError("only mono with 8 bits a sample is read")
    first, p = data[at + 4], at + 5
    more = 0 if first < 0x80 else 8 - (first ^ 0xFF).bit_length() - 1
    number = first & (0x7F >> (more + 1) if more else 0x7F)
    for _ in range(more):
        number, p = number << 6 | data[p] & 0x3F, p + 1
    if size in (6, 7):
        n = int.from_bytes(data[p : p + size - 5], "big") + 1
        p += size - 5
    elif size:
        n = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    else:
        raise FlacError("reserved block size")
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if _HEADERS.get((number, n)) != data[at : p + 1] and _crc8(data[at:p]) != data[p]:
        raise FlacError(f"frame header at byte {at} fails its CRC-8")
    return number, n, p + 1 - at


def decode_frames(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Samples (frames x longest), numbers, sizes and ends of the frames that start there."""
    heads = np.array([_frame_head(data, s) for s in starts.tolist()], np.int64).reshape(-1, 3)
    rank = np.argsort(-heads[:, 1], kind="stable")  # longest first: live frames are a prefix
    number, n, h = heads[rank].T
    at = starts[rank]
    bits = _Bits(data)
    p = (at + h) * 8
    kind = bits.take(p, 8)
    if (kind & 0x81).any():
        raise FlacError("wasted bits or a damaged subframe header")
    kind >>= 1
    p = p + 8
    constant, verbatim, fixed, linear = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | linear).all():
        raise FlacError("reserved subframe type")
    order = np.where(linear, kind - 31, np.where(fixed, kind - 8, 0))
    top = int(order.max())
    out = np.zeros((int(n.max()), len(n)), np.int64)  # one row a step
    for j in range(top):
        w = order > j
        out[j, w] = _signed(bits.take(p[w] + 8 * j, 8), 8)
    p = p + 8 * order
    taps, shift = np.zeros((top, len(n)), np.int64), np.zeros(len(n), np.int64)
    for o in range(1, min(4, top) + 1):
        w = fixed & (order == o)
        for j, c in enumerate(FIXED[o]):
            taps[j, w] = c
    if linear.any():
        w = np.flatnonzero(linear)
        both = bits.take(p[w], 9)
        width, shift[w] = (both >> 5) + 1, _signed(both & 31, 5)
        q = p[w] + 9
        for j in range(top):
            has = order[w] > j
            v = (bits.window(q[has]) >> (64 - width[has]).astype(np.uint64)).astype(np.int64)
            taps[j, w[has]] = _signed(v, width[has])
            q = q + np.where(has, width, 0)
        p[w] = q
    rice = fixed | linear
    for row in np.flatnonzero(constant):
        out[: n[row], row] = _signed(bits.take(p[row : row + 1], 8), 8)
    for row in np.flatnonzero(verbatim):
        a = int(p[row])
        raw = np.frombuffer(data, np.uint8, int(n[row]) + 1, a >> 3) if not a & 7 else np.packbits(np.unpackbits(np.frombuffer(data, np.uint8, int(n[row]) + 1, a >> 3))[a & 7 :])
        out[: n[row], row] = raw[: n[row]].view(np.int8)
    p = np.where(constant, p + 8, np.where(verbatim, p + 8 * n, p))
    if rice.any():
        p = _residuals(bits, p, rice, n, order, out)
        _restore(out, taps, shift, order, n, rice)
    end = (p + 7) // 8
    raw = np.frombuffer(data, np.uint8)
    if (end + 2 > len(raw)).any():
        raise FlacError("a frame runs beyond its stream")
    if (_crc16(raw, at, end) != (raw[end].astype(np.int64) << 8 | raw[end + 1])).any():
        raise FlacError("a frame fails its CRC-16")
    back = np.argsort(rank)
    return out.T[back], number[back], n[back], end[back] + 2


def _residuals(bits: _Bits, p, rice, n, order, out) -> np.ndarray:
    """Rice codes of all frames in step, into the rows of out from each frame's order on."""
    w = np.flatnonzero(rice)
    p, stop, t0 = p.copy(), n[w], order[w]
    at = p[w]
    head = bits.take(at, 6)
    at = at + 6
    method, parts = head >> 4, head & 15
    if (method > 1).any():
        raise FlacError("reserved residual coding")
    wide = 4 + method
    part = stop >> parts
    k = np.zeros(len(w), np.int64)
    raw = np.full(len(w), -1, np.int64)  # width of an escaped partition
    turn = np.zeros(len(w), np.int64)  # the step where the next partition begins; the first at 0
    live, offset = len(w), 0
    for t in range(len(out)):
        while live and stop[live - 1] <= t:
            live -= 1
        if not live:
            break
        if (turn[:live] == t).any():
            new = np.flatnonzero(turn[:live] == t)
            k[new] = (bits.window(at[new]) >> (64 - wide[new]).astype(np.uint64)).astype(np.int64)
            at[new] += wide[new]
            escaped = k[new] == (1 << wide[new]) - 1
            raw[new] = -1
            if escaped.any():
                e = new[escaped]
                raw[e] = bits.take(at[e], 5)
                at[e] += 5
            turn[new] += part[new]
        here = slice(0, live)
        mine = None
        if t < 32 and (t0[here] > t).any() or (raw[here] >= 0).any():
            mine = np.flatnonzero((t0[here] <= t) & (raw[here] < 0))
            e = np.flatnonzero((t0[here] <= t) & (raw[here] >= 0))
            if len(e):
                v = (bits.window(at[e]) >> np.uint64(1)) >> (63 - raw[e]).astype(np.uint64)
                out[t, w[e]] = np.where(raw[e] > 0, _signed(v.astype(np.int64), np.maximum(1, raw[e])), 0)
                at[e] += raw[e]
            if not len(mine):
                continue
        a, kk = (at[here], k[here]) if mine is None else (at[mine], k[mine])
        win = bits.window(a)
        lead = win >> np.uint64(11)
        q = 1075 - (lead.astype(np.float64).view(np.int64) >> 52)
        if q.max() > 40:
            a, q = _long_unary(bits, a, q)
            win = bits.window(a)
            rest = win
        else:
            a = a + q + 1
            rest = win << (q + 1).astype(np.uint64)
        if mine is None:
            u = ((rest >> np.uint64(1)) >> (63 - kk).astype(np.uint64)).astype(np.int64) | q << kk
            out[t, w[here]] = (u >> 1) ^ -(u & 1)
            at[here] = a + kk
        else:
            u = ((rest >> np.uint64(1)) >> (63 - kk).astype(np.uint64)).astype(np.int64) | q << kk
            out[t, w[mine]] = (u >> 1) ^ -(u & 1)
            at[mine] = a + kk
    p[w] = at
    return p


def _long_unary(bits: _Bits, a: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places behind the unary parts and their values, however long."""
    q, a = np.zeros(len(a), np.int64), a.copy()
    todo = np.arange(len(a))
    while len(todo):
        lead = bits.window(a[todo]) >> np.uint64(11)
        none = lead == 0
        step = np.where(none, 53, 1075 - (np.maximum(lead, np.uint64(1)).astype(np.float64).view(np.int64) >> 52))
        q[todo] += step
        a[todo] += step + ~none
        todo = todo[none]
    return a, q


def _restore(out, taps, shift, order, n, rice) -> None:
    """Adds the predictions, step by step for all frames."""
    top = len(taps)
    for t in range(1, len(out)):
        live = int(np.searchsorted(-n, -t, "left"))  # n falls: those with n > t
        use = min(top, t)
        if not use:
            continue
        s = sum(taps[j, :live] * out[t - 1 - j, :live] for j in range(use)) >> shift[:live]
        if t < top:
            s = np.where(order[:live] <= t, s, 0)
        out[t, :live] += np.where(rice[:live], s, 0) if t < top else s
    return


def decode(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """For each stream its PCM blocks: first sample and unsigned 8-bit samples, all checked."""
    base, spots, infos = 0, [], []
    for s in streams:
        if s[:4] != b"fLaC":
            raise FlacError("no FLAC stream")
        p, last, info, seek = 4, False, b"", None
        while not last:
            last, kind, size = bool(s[p] & 0x80), s[p] & 0x7F, int.from_bytes(s[p + 1 : p + 4], "big")
            if kind == 0:
                info = s[p + 4 : p + 4 + size]
            elif kind == 3:
                seek = np.frombuffer(s, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]), size // 18, p + 4)
            p += 4 + size
        total = int.from_bytes(info[10:18], "big") & ((1 << 36) - 1)
        full = seek is not None and int(seek["n"].sum()) == total and (np.cumsum(seek["n"].astype(np.int64)) - seek["n"] == seek["sample"]).all()
        infos.append((base + len(s), total, info[18:34], int.from_bytes(info[:2], "big")))
        spots.append(base + p + (seek["offset"].astype(np.int64) if full else np.zeros(1, np.int64)))
        base += len(s)
    data = b"".join(streams)
    found: list[list[tuple[int, bytes]]] = [[] for _ in streams]
    owner = np.repeat(np.arange(len(streams)), [len(x) for x in spots])
    todo = np.concatenate(spots) if spots else np.zeros(0, np.int64)
    done = np.zeros(len(streams), np.int64)
    while len(todo):
        x, number, n, end = decode_frames(data, todo)
        u = (x + 128).astype(np.uint8)
        for i, d in enumerate(owner.tolist()):
            found[d].append((int(number[i]) * infos[d][3], u[i, : n[i]].tobytes()))
        np.add.at(done, owner, n)
        more = np.array([len(spots[d]) == 1 and done[d] < infos[d][1] and int(e) < infos[d][0] for d, e in zip(owner.tolist(), end.tolist(), strict=True)], bool)
        owner, todo = owner[more], end[more]
    for blocks, (_, total, md5, _) in zip(found, infos, strict=True):
        blocks.sort()
        pcm = b"".join(b for _, b in blocks)
        if len(pcm) != total or md5 != bytes(16) and hashlib.md5((np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes()).digest() != md5:
            raise FlacError("the samples differ from the stream's count or MD5")
    return found


# ----------------------------------------------------------------------- Spark's operators


def payloads(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The padded bytes of all texts, where each begins, and how many it has."""
    n = np.diff(offsets)
    size = np.maximum(1, -(-n // UNIT)) * UNIT
    begin = np.cumsum(size) - size
    out = np.full(int(size.sum()), 32, np.uint8)
    out[np.repeat(begin - offsets[:-1], n) + np.arange(len(data))] = data
    return out, begin, size


def _encode(batches):
    for batch in batches:
        whole, offsets = flat(batch.column(1))
        for a, b in slices(offsets, 1 << 20):
            p, begin, size = payloads(whole[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            media = encode(p, begin, size)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def encode_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as a FLAC stream."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def _batches(batch: pa.RecordBatch, most: int = 4 << 20):
    media = batch.column(batch.schema.get_field_index("media")).to_pylist()
    a = 0
    while a < len(media):
        b, size = a, 0
        while b < len(media) and (b == a or size + len(media[b]) <= most):
            size += len(media[b])
            b += 1
        yield batch.slice(a, b - a), media[a:b], decode(media[a:b])
        a = b


def _decode(batches):
    for batch in batches:
        for part, _, found in _batches(batch):
            rows = [(d, i, first, pcm) for d, blocks in zip(part.column(0).to_pylist(), found, strict=True) for i, (first, pcm) in enumerate(blocks)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "block", "first_sample", "pcm"])


def decode_media(media: DataFrame) -> DataFrame:
    """(doc_id, block, first_sample, pcm) of (doc_id, media)."""
    return media.select("doc_id", "media").mapInArrow(_decode, "doc_id long, block int, first_sample long, pcm binary")


def feature(blocks: list[tuple[int, bytes]]) -> str:
    """Blocks, mean level, energy and zero crossings, as integers."""
    x = np.frombuffer(b"".join(b for _, b in blocks), np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"blocks={len(blocks)};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches):
    names = [f.split()[0] for f in DIGEST.split(", ")]
    for batch in batches:
        for part, media, found in _batches(batch):
            pcm = [b"".join(b for _, b in x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(map(len, pcm), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in pcm]), pa.array([zlib.crc32(x[-16:]) for x in pcm], pa.int64()),
                 pa.array(map(len, media), pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(map(feature, found))],
                names=names,
            )


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # headers, seek points and repeated frames still shrink, by about a tenth
    stored = materialize(media, "flac", **{"compression": "zstd", "parquet.compression.codec.zstd.level": "9"})
    return stored.mapInArrow(_digest, DIGEST)
