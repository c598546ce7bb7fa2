"""FLAC media: an encoder and a decoder whose inner loops run over many frames at once.

A stream is mono with 4 to 8 bits a sample as the format has them; the query stores bytes as 8-bit samples (byte - 128).
The decoder reads constant, verbatim, fixed-predictor and linear-predictor subframes and both kinds of Rice coding with
partitions and escapes. It checks the CRC-8 of each frame header, that a frame has the number its place in the stream asks for, the CRC-16 of each
frame and the MD5 of all samples. The encoder takes for each frame the shortest of these but for escapes: fixed predictors of
orders 0 to 2, a linear one of TAPS taps, one Rice partition or PARTS.
A seek table with a point for each frame gives the sample offset of every block; with it all frames of a batch are
decoded side by side, one numpy step a sample. Streams without a full seek table are decoded frame after frame.

Frames are coded and read in groups of GROUP, so that memory follows the text by a few bytes a byte, however long it is.

Defined cases: a null or empty text is the padding alone; a broken checksum, a bad code or a stream that ends early raises
ValueError; equal texts give equal bytes and features.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as X
from .common import documents

BLOCK, RATE, PAD = 1024, 8000, 64
_BATCH = 2 << 20
#: Frames that are coded or read side by side.
GROUP = 2048
#: Taps of the linear predictor and their bits; Rice partitions of a frame.
TAPS, PRECISION, PARTS = 4, 12, 8
LINEAR = 9


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, (out << 1) ^ poly, out << 1) & ((1 << bits) - 1)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CRC8_LIST = _CRC8.tolist()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8_LIST[c ^ b]
    return c


def crc16(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of many ranges of a buffer, one step a byte over all of them."""
    n = ends - starts
    order = np.argsort(-n, kind="stable")
    s, live = starts[order], np.searchsorted(-n[order], -np.arange(int(n.max(initial=0))), "left")
    crc = np.zeros(len(n), np.uint32)
    for t, m in enumerate(live.tolist()):
        c = crc[:m]
        crc[:m] = ((c << np.uint32(8)) & np.uint32(0xFFFF)) ^ _CRC16[(c >> np.uint32(8)) ^ buf[s[:m] + t]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


@lru_cache(maxsize=1 << 16)
def _header(number: int, n: int) -> bytes:
    """Frame header of block ``number`` with n samples, CRC-8 included."""
    if number < 0x80:
        coded = bytes([number])
    else:
        size = next(k for k in range(2, 8) if number < 1 << (5 * k + 1))
        tail = [0x80 | (number >> (6 * i)) & 0x3F for i in range(size - 2, -1, -1)]
        coded = bytes([(0xFF00 >> size) & 0xFF | number >> (6 * (size - 1)), *tail])
    kind, extra = (0xA, b"") if n == 1024 else (0x7, (n - 1).to_bytes(2, "big"))
    body = b"\xff\xf8" + bytes([kind << 4, 0x02]) + coded + extra
    return body + bytes([crc8(body)])


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """Big-endian bits of each value, as rows."""
    return (values[:, None] >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8)


def encode(payload: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A stream for each range of the payload bytes, in frames of BLOCK samples."""
    sizes = np.diff(offsets)
    per = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    at = offsets[:-1][owner] + number * BLOCK
    n = np.minimum(BLOCK, offsets[1:][owner] - at)
    frames: list[bytes] = []
    for g in range(0, len(at), GROUP):
        low, high = int(at[g]), int(at[min(g + GROUP, len(at)) - 1] + n[min(g + GROUP, len(at)) - 1])
        frames += _frames(payload[low:high], at[g : g + GROUP] - low, n[g : g + GROUP], number[g : g + GROUP])
    out, i = [], 0
    signed = payload ^ np.uint8(0x80)
    for d, m in enumerate(per.tolist()):
        own = frames[i : i + m]
        points, position = [], 0
        for j, f in enumerate(own):
            points.append((j * BLOCK).to_bytes(8, "big") + position.to_bytes(8, "big") + int(n[i + j]).to_bytes(2, "big"))
            position += len(f)
        total = int(sizes[d])
        packed_info = RATE << 44 | 0 << 41 | 7 << 36 | total
        info = BLOCK.to_bytes(2, "big") * 2 + bytes(6) + packed_info.to_bytes(8, "big") + hashlib.md5(signed[offsets[d] : offsets[d + 1]].tobytes()).digest()
        out.append(b"".join([b"fLaC\x00" + len(info).to_bytes(3, "big") + info, *_tables(points), *own]))
        i += m
    return out


def _tables(points: list[bytes]) -> list[bytes]:
    """Seek tables of as many points as a block of metadata holds; the last block is marked."""
    most = ((1 << 24) - 1) // 18
    parts = [b"".join(points[i : i + most]) for i in range(0, max(1, len(points)), most)]
    return [bytes([3 | 0x80 * (i == len(parts) - 1)]) + len(t).to_bytes(3, "big") + t for i, t in enumerate(parts)]


def _predictors(wave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised taps of a linear predictor of TAPS for each row, and their shift: autocorrelation and Levinson's recursion."""
    x = wave.astype(np.float32)
    auto = np.stack([np.einsum("ij,ij->i", x[:, lag:], x[:, : x.shape[1] - lag], dtype=np.float64) for lag in range(TAPS + 1)], axis=1)
    taps, error = np.zeros((len(x), TAPS)), np.maximum(auto[:, 0] * (1 + 1e-9), 1e-9)
    for i in range(TAPS):
        k = (auto[:, i + 1] - (taps[:, :i] * auto[:, i:0:-1]).sum(1)) / error
        before = taps[:, :i].copy()
        taps[:, i] = k
        taps[:, :i] = before - k[:, None] * before[:, ::-1]
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = np.abs(taps).max(1, initial=0)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(np.maximum(most, 1e-9))), 0, 14).astype(np.int64)
    top = 1 << (PRECISION - 1)
    return np.clip(np.rint(taps * (1 << shift)[:, None]), -top, top - 1).astype(np.int32), shift


def _rice(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A good Rice parameter for codes of a sum."""
    return np.clip(np.floor(np.log2(np.maximum(total / np.maximum(count, 1) * 0.6931, 1e-9) + 1e-9)), 0, 14).astype(np.int32)


def _frames(payload: np.ndarray, at: np.ndarray, n: np.ndarray, number: np.ndarray) -> list[bytes]:
    """The frames of blocks that begin ``at`` and have n samples and a number in their stream: constant, verbatim, or coded
    with the shortest of three fixed predictors and a linear one, in one Rice partition or PARTS."""
    samples = payload.astype(np.int32) - 128
    grid = np.arange(BLOCK, dtype=np.int32)
    inside = grid < n[:, None]
    wave = np.where(inside, samples[np.minimum(at[:, None] + grid, max(0, len(samples) - 1))], 0) if len(samples) else np.zeros((0, BLOCK), np.int32)
    constant = ((wave == wave[:, :1]) | ~inside).all(1)
    best, choice = np.full(len(n), np.inf), np.zeros(len(n), np.int64)  # choice: the order of a fixed predictor, or LINEAR
    codes, kept = np.zeros_like(wave), np.zeros(len(n), np.int32)
    taps, shift = _predictors(wave)
    residual = wave.copy()
    for option in (0, 1, 2, LINEAR):
        order = TAPS if option == LINEAR else option
        if option == LINEAR:
            guess = np.zeros_like(wave)
            for j in range(TAPS):
                guess[:, TAPS:] += taps[:, j : j + 1] * wave[:, TAPS - 1 - j : BLOCK - 1 - j]
            residual = wave - (guess >> shift[:, None].astype(np.int32))
        elif order:
            residual[:, order:] = residual[:, order:] - residual[:, order - 1 : -1]
            residual[:, :order] = 0
        u = ((residual << 1) ^ (residual >> 31)) * (inside & (grid >= order))
        count = np.maximum(n - order, 1)
        k = _rice(u.sum(1, dtype=np.int64), count)
        bits = (u >> k[:, None]).sum(1, dtype=np.int64) + count * (1 + k) + 18 + 8 * order + (9 + PRECISION * TAPS if option == LINEAR else 0)
        better = (bits < best) & (n > order)
        best, choice, kept = np.where(better, bits, best), np.where(better, option, choice), np.where(better, k, kept)
        codes[better] = u[better]
    order, linear = np.where(choice == LINEAR, TAPS, choice), choice == LINEAR
    # PARTS partitions of equal size, each with its own parameter, where that is shorter
    size = np.where(n % PARTS == 0, n // PARTS, 0)
    ends = np.minimum(size[:, None] * np.arange(1, PARTS + 1), BLOCK) - 1
    sums = np.diff(np.take_along_axis(np.cumsum(codes, 1, dtype=np.int32), np.maximum(ends, 0), 1), axis=1, prepend=0)
    count = size[:, None] - np.where(np.arange(PARTS) == 0, order[:, None], 0)
    ks = _rice(sums, count)
    steps = np.diff(ks, axis=1, prepend=0)
    each = np.zeros_like(codes)
    rows = np.arange(len(n))
    for i in range(PARTS):
        each[rows, np.minimum(size * i, BLOCK - 1)] += steps[:, i]
    each = np.cumsum(each, axis=1, dtype=np.int32)
    live = inside & (grid >= order[:, None])
    split = (codes >> each).sum(1, dtype=np.int64) + (count * (1 + ks)).sum(1) + 4 * PARTS + 14 + 8 * order + np.where(linear, 9 + PRECISION * TAPS, 0)
    several = (size > order) & (split < best)
    best = np.where(several, split, best)
    each = np.where(several[:, None], each, kept[:, None])
    plain = ~constant & (best >= 8 + 8 * n)
    rice = ~constant & ~plain
    bits = np.where(constant, 16, np.where(plain, 8 + 8 * n, best)).astype(np.int64)
    body = -(-bits // 8)
    edge = np.r_[0, np.cumsum(body)]
    stream = np.zeros(int(edge[-1]) * 8, np.uint8)
    base = edge[:-1] * 8
    kind = np.where(constant, 0, np.where(plain, 2, np.where(linear, 64 + 2 * (TAPS - 1), 16 + 2 * order)))
    stream[(base[:, None] + np.arange(8))] = _bits(kind, 8)
    for i in range(TAPS):  # warm-up samples, or the constant
        has = np.flatnonzero((rice & (order > i)) | (constant & (i == 0)))
        stream[(base[has, None] + 8 + 8 * i + np.arange(8))] = _bits(wave[has, i] & 0xFF, 8)
    start = base + 8 + 8 * order
    has = np.flatnonzero(rice & linear)
    stream[(start[has, None] + np.arange(4))] = _bits(np.full(len(has), PRECISION - 1), 4)
    stream[(start[has, None] + 4 + np.arange(5))] = _bits(shift[has], 5)
    for j in range(TAPS):
        stream[(start[has, None] + 9 + PRECISION * j + np.arange(PRECISION))] = _bits(taps[has, j] & ((1 << PRECISION) - 1), PRECISION)
    start = start + np.where(linear, 9 + PRECISION * TAPS, 0)
    has = np.flatnonzero(rice)
    stream[(start[has, None] + 2 + np.arange(4))] = _bits(np.where(several[has], PARTS.bit_length() - 1, 0), 4)
    live &= rice[:, None]
    counts = live.sum(1)
    first = (grid == order[:, None]) | (several[:, None] & (grid % np.maximum(size, 1)[:, None] == 0))
    u, k, head = codes[live], each[live], np.where(first[live], 4, 0)
    q = u >> k
    length = (q + 1 + k + head).astype(np.int64)
    run = np.cumsum(length)
    run0 = np.r_[0, run][np.cumsum(counts) - counts]
    place = np.repeat(start + 6 - run0, counts) + (run - length)
    opens = np.flatnonzero(head)
    stream[(place[opens, None] + np.arange(4))] = _bits(k[opens], 4)
    stop = place + head + q
    stream[stop] = 1
    for j in range(int(k.max(initial=0))):
        has = k > j
        spot = stop[has] + 1 + j
        stream[spot] = (u[has] >> (k[has] - 1 - j)) & 1
    packed = np.packbits(stream)
    for i in np.flatnonzero(plain):
        packed[edge[i] + 1 : edge[i + 1]] = (samples[at[i] : at[i] + n[i]] & 0xFF).astype(np.uint8)
    heads = [_header(a, b) for a, b in zip(number.tolist(), n.tolist(), strict=True)]
    raw = packed.tobytes()
    frames = [h + raw[a:b] for h, a, b in zip(heads, edge.tolist(), edge[1:].tolist(), strict=False)]
    ends = np.cumsum([len(f) for f in frames]).astype(np.int64)
    joined = np.frombuffer(b"".join(frames), np.uint8)
    crcs = crc16(joined, np.r_[0, ends[:-1]] if len(ends) else ends, ends).tolist()
    return [f + c.to_bytes(2, "big") for f, c in zip(frames, crcs, strict=True)]


class Stream:
    """Header of a stream: sample count, bits a sample, checksum, seek points, and where the frames begin."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.points = 4, False, []
        while not last:
            last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            if kind == 0:
                word = int.from_bytes(body[10:18], "big")
                self.block, self.bits, self.channels, self.total, self.md5 = int.from_bytes(body[2:4], "big"), (word >> 36 & 31) + 1, (word >> 41 & 7) + 1, word & ((1 << 36) - 1), body[18:34]
            elif kind == 3:
                self.points += [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
            at += 4 + size
        self.start = at
        if self.channels != 1 or not 4 <= self.bits <= 8:
            raise ValueError("only mono streams of 4 to 8 bits are stored here")


_SIZES = {1: 192, **{i: 576 << (i - 2) for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}


def _frame_head(data: bytes, at: int) -> tuple[int, int, int]:
    """Where the subframe begins, the number of samples, and the frame or sample number."""
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise ValueError("no frame here")
    i = at + 4
    first = data[i]
    more = 0 if first < 0x80 else 8 - (first ^ 0xFF).bit_length() - 1
    number = first if not more else first & ((1 << (6 - more)) - 1)
    for j in range(more):
        number = number << 6 | data[i + 1 + j] & 0x3F
    i += 1 + more
    kind = data[at + 2] >> 4
    if kind in (6, 7):
        n = int.from_bytes(data[i : i + kind - 5], "big") + 1
        i += kind - 5
    else:
        n = _SIZES[kind]
    i += {12: 1, 13: 2, 14: 2}.get(data[at + 2] & 15, 0)
    if _crc8_of(bytes(data[at:i])) != data[i]:
        raise ValueError("the CRC-8 of a frame header is wrong")
    return i + 1, n, number


_crc8_of = lru_cache(maxsize=1 << 16)(crc8)


def decode_frames(data: bytes, starts: list[int], depth: list[int], firsts: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples of frames that begin at the given bytes, as rows; their lengths; and the byte where each ends. One step of
    the loops is one sample of every frame. ``firsts``: the sample each should begin with, and its stream's block size."""
    lanes = len(starts)
    heads = [_frame_head(data, s) for s in starts]
    for s, (_, _, number), (first, block) in zip(starts, heads, firsts or [], strict=False):
        if number * (1 if data[s + 1] & 1 else block) != first:
            raise ValueError("a frame is not the one that its place is for")
    n = np.array([h[1] for h in heads], np.int64)
    longest = int(n.max(initial=0))
    buf = np.frombuffer(data + bytes(16), np.uint8)
    words = np.ndarray((len(buf) - 7,), ">u8", buffer=buf.data, strides=(1,))
    kind, order, pos = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    width, wasted, wide = np.array(depth, np.int64), np.zeros(lanes, np.int64), np.zeros(lanes, bool)
    size, shift, taps = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), {}
    out = np.zeros((longest, lanes), np.int32)

    def read(bit: int, k: int) -> int:
        return int.from_bytes(data[bit >> 3 : (bit + k + 7) >> 3], "big") >> (-(bit + k) & 7) & ((1 << k) - 1)

    def signed(v: int, k: int) -> int:
        return v - (1 << k) if v >> (k - 1) else v

    for i, (at, m, _) in enumerate(heads):
        bit = at * 8
        code = read(bit + 1, 6)
        bit += 8
        if data[at] & 1:
            while not read(bit, 1):
                wasted[i] += 1
                bit += 1
            wasted[i] += 1
            bit += 1
        w = int(width[i] - wasted[i])
        if code == 0:
            out[:m, i] = signed(read(bit, w), w)
            kind[i], pos[i] = 0, bit + w
            continue
        if code == 1:
            if w == 8 and bit % 8 == 0:
                out[:m, i] = np.frombuffer(data, np.int8, m, bit >> 3)
            else:
                out[:m, i] = [signed(read(bit + t * w, w), w) for t in range(m)]
            kind[i], pos[i] = 1, bit + m * w
            continue
        if 8 <= code <= 12:
            kind[i], order[i] = 2, code - 8
        elif code >= 32:
            kind[i], order[i] = 3, code - 31
        else:
            raise ValueError("a reserved subframe")
        for t in range(int(order[i])):
            out[t, i] = signed(read(bit, w), w)
            bit += w
        if kind[i] == 3:
            precision, shift[i] = read(bit, 4) + 1, signed(read(bit + 4, 5), 5)
            bit += 9
            taps[i] = [signed(read(bit + j * precision, precision), precision) for j in range(int(order[i]))]
            bit += precision * int(order[i])
        wide[i], parts = read(bit, 2) == 1, read(bit + 2, 4)
        size[i] = m >> parts
        pos[i] = bit + 6
    coded = np.flatnonzero(kind >= 2)
    if len(coded):
        lane = coded[np.argsort(-n[coded], kind="stable")]
        live = np.searchsorted(-n[lane], -np.arange(longest), "left").tolist()
        p, o, z = pos[lane], order[lane], size[lane]
        k, raw = np.zeros(len(lane), np.int64), np.full(len(lane), -1, np.int64)
        if (z * ((n[lane] + z - 1) // np.maximum(z, 1)) < n[lane]).any() or (z < o).any():
            raise ValueError("a bad partition order")
        marks = {int(t) for t in np.unique(o)} | {int(t) for s in np.unique(z) for t in range(int(s), longest, max(1, int(s)))}
        most, residual = int(o.max()), np.zeros((longest, len(lane)), np.int32)
        escaped = False
        for t in range(longest):
            m = live[t]
            if t in marks:
                for i in np.flatnonzero((o[:m] == t) | ((t > o[:m]) & (t % z[:m] == 0))).tolist():
                    bits = 5 if wide[lane[i]] else 4
                    k[i], raw[i] = read(int(p[i]), bits), -1
                    p[i] += bits
                    if k[i] == (1 << bits) - 1:
                        raw[i] = read(int(p[i]), 5)
                        p[i] += 5
                        escaped = True
            some = slice(0, m) if t >= most and not escaped else np.flatnonzero((o[:m] <= t) & (raw[:m] < 0))
            a, ks = p[some], k[some]
            w = words[a >> 3].astype(np.uint64) << (a & 7).astype(np.uint64)
            q = 52 - ((w >> np.uint64(11)).astype(np.float64).view(np.int64) >> 52) + 1023
            far = q + ks > 55
            if far.any():
                for i in np.flatnonzero(far).tolist():  # a long unary part; rare
                    bit, zeros = int(a[i]), 0
                    while not read(bit, 1):
                        zeros += 1
                        bit += 1
                        if zeros > 1 << 24 or bit > len(data) * 8:
                            raise ValueError("a Rice code without an end")
                    q[i] = zeros
                    kk = int(ks[i])
                    w[i] = (read(bit + 1, kk) if kk else 0) << (64 - kk) if kk else 0
                qs = np.where(far, 0, q + 1).astype(np.uint64)
            else:
                qs = (q + 1).astype(np.uint64)
            rest = ((w << qs) >> np.uint64(1)) >> (63 - ks).astype(np.uint64)
            u = (q << ks) | rest.astype(np.int64)
            residual[t, some] = (u >> 1) ^ -(u & 1)
            p[some] = a + q + 1 + ks
            if escaped:
                for i in np.flatnonzero((o[:m] <= t) & (raw[:m] >= 0)).tolist():
                    r = int(raw[i])
                    residual[t, i] = signed(read(int(p[i]), r), r) if r else 0
                    p[i] += r
        pos[lane] = p
        for c in range(5):
            here = np.flatnonzero((kind[lane] == 2) & (o == c))
            if len(here):
                x, warm = residual[c:, here], out[:c, lane[here]]
                for i in range(c, 0, -1):
                    head = np.diff(warm[:i], n=i - 1, axis=0)[-1:]
                    x = np.cumsum(np.concatenate([head, x]), axis=0, dtype=np.int32)
                out[c:, lane[here]] = x[c:] if c else x
        for c in np.unique(o[kind[lane] == 3]).tolist():  # linear predictors of c taps side by side, a sample at a step
            here = np.flatnonzero((kind[lane] == 3) & (o == c))
            column, rest, s = out[:, lane[here]], residual[:, here], shift[lane[here]].astype(np.int32)
            weights, one = np.array([taps[i] for i in lane[here].tolist()], np.int32).T.copy(), np.empty(len(here), np.int32)
            for t in range(c, longest):
                guess = column[t - 1] * weights[0]
                for j in range(1, c):
                    np.multiply(column[t - 1 - j], weights[j], out=one)
                    guess += one
                guess >>= s
                np.add(rest[t], guess, out=column[t])
            out[:, lane[here]] = column
    if wasted.any():
        out <<= wasted.astype(np.int32)
    end = (pos + 7) >> 3
    got = crc16(buf, np.array(starts, np.int64), end)
    if (got != (buf[end].astype(np.uint32) << 8 | buf[end + 1])).any():
        raise ValueError("the CRC-16 of a frame is wrong")
    return out.T, n, end + 2


def decode(streams: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int, int]]]]:
    """Samples of each stream and its blocks: first sample and number of samples. Checksums are verified."""
    try:
        return _decode(streams)
    except IndexError as e:
        raise ValueError("a stream ends early") from e


def _decode(streams: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int, int]]]]:
    heads = [Stream(s) for s in streams]
    out: list[tuple[np.ndarray, list[tuple[int, int]]]] = [(np.zeros(0, np.int8), [])] * len(streams)
    starts, depth, whose, firsts, base = [], [], [], [], 0
    for d, (h, s) in enumerate(zip(heads, streams, strict=True)):
        if sum(p[2] for p in h.points) == h.total and h.points:
            starts += [base + h.start + p[1] for p in h.points]
            depth += [h.bits] * len(h.points)
            whose += [d] * len(h.points)
            firsts += [(p[0], h.block) for p in h.points]
        base += len(s)
    if starts:
        data, parts = b"".join(streams), []
        for g in range(0, len(starts), GROUP):
            samples, n, _ = decode_frames(data, starts[g : g + GROUP], depth[g : g + GROUP], firsts[g : g + GROUP])
            parts += [row[:m].astype(np.int8) for row, m in zip(samples, n.tolist(), strict=True)]
        at = 0
        while at < len(whose):
            d, m = whose[at], len(heads[whose[at]].points)
            out[d] = (np.concatenate(parts[at : at + m]), [(p[0], p[2]) for p in heads[d].points])
            at += m
    for d, (h, s) in enumerate(zip(heads, streams, strict=True)):
        if not out[d][1] and h.total:
            at, parts, blocks_, done = h.start, [], [], 0
            while done < h.total:
                samples, n, end = decode_frames(s, [at], [h.bits], [(done, h.block)])
                parts.append(samples[0, : n[0]])
                blocks_.append((done, int(n[0])))
                done, at = done + int(n[0]), int(end[0])
            out[d] = (np.concatenate(parts).astype(np.int8), blocks_)
        if any(h.md5) and hashlib.md5(out[d][0].tobytes()).digest() != h.md5:
            raise ValueError("the MD5 of the samples is wrong")
    return out


def padded(buf: np.ndarray, offsets: np.ndarray, to: int = PAD) -> tuple[np.ndarray, np.ndarray]:
    """Each range with zeros up to a positive multiple of ``to`` bytes."""
    sizes = np.diff(offsets)
    full = np.maximum(-(-sizes // to), 1) * to
    edge = np.r_[0, np.cumsum(full)]
    out = np.zeros(int(edge[-1]), np.uint8)
    for a, z, to in zip(offsets[:-1].tolist(), offsets[1:].tolist(), edge[:-1].tolist(), strict=True):
        out[to : to + z - a] = buf[a:z]
    return out, edge


def describe(samples: np.ndarray, blocks_: list[tuple[int, int]]) -> str:
    """Blocks, peak, mean square and sign changes of a signal."""
    peak = power = turns = 0
    for a in range(0, len(samples), 1 << 20):
        x = samples[max(0, a - 1) : a + (1 << 20)].astype(np.int32)  # one sample of the part before, for its sign
        turns += int(((x[1:] < 0) != (x[:-1] < 0)).sum())
        own = x[a > 0 :].astype(np.int64)
        peak, power = max(peak, int(np.abs(own).max(initial=0))), power + int((own * own).sum())
    return f"blocks={len(blocks_)};peak={peak};power={power};turns={turns}"


def media(docs: DataFrame) -> DataFrame:
    """doc_id and media: the stored stream of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batches, most=_BATCH):
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(encode(*padded(*X.buffer_of(block.column("text")))), pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, media binary")


def pcm(stored: DataFrame) -> DataFrame:
    """The PCM blocks of stored streams: doc_id, block, first_sample, n_samples and the signed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batches, "media", _BATCH):
            ids, rows = block.column("doc_id").to_pylist(), []
            held = [(i, m) for i, m in zip(ids, block.column("media").to_pylist(), strict=True) if m is not None]
            for (i, _), (samples, parts) in zip(held, decode([m for _, m in held]), strict=True):
                rows += [(i, j, a, n, samples[a : a + n].tobytes()) for j, (a, n) in enumerate(parts)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["doc_id", "block", "first_sample", "n_samples", "pcm"])

    return stored.select("doc_id", "media").mapInArrow(run, "doc_id bigint, block int, first_sample bigint, n_samples int, pcm binary")


_OUT = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def digest(docs: DataFrame) -> DataFrame:
    """Store each text as a stream, read the stored bytes back, and describe what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for block in X.blocks(batches, most=_BATCH):
            buf, offsets = X.buffer_of(block.column("text"))
            stored, rows = encode(*padded(buf, offsets)), []
            for size, stream, (samples, parts) in zip(np.diff(offsets).tolist(), stored, decode(stored), strict=True):
                back = (samples.view(np.uint8) ^ np.uint8(0x80)).tobytes()
                rows.append((size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(stream), hashlib.sha256(stream).hexdigest(), describe(samples, parts)))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *[pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
