"""A FLAC codec in numpy: many frames of many streams are encoded, or decoded in step, at once.

Encoder: 8-bit mono, blocks of 4096 samples, constant, verbatim, fixed (order 0 to 2) and linear (order 8) predictors,
one Rice partition; a seek point for every frame.  Decoder: 1 to 8 channels with left/side, right/side and mid/side, up
to 24 bits, all predictors, all Rice partitions with escapes, wasted bits; CRC-8 of headers, CRC-16 of frames and the MD5
of a whole stream are verified.

Decoding in step: within a partition, code i + 1 begins where code i ends, so partitions of all frames advance together,
one code of each a step, through a table of the next set bit; linear predictors likewise, one sample of each a step.
"""
from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK, ORDER, PRECISION, GROUP = 4096, 8, 10, 384
#: Samples that are encoded at once; the arrays of so many stay in a core's cache.
SAMPLES = 1 << 17
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


class Damaged(ValueError):
    """A stream that is cut short or whose checksums do not match."""


def _table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        out = np.where(out & (1 << (bits - 1)), (out << 1) ^ poly, out << 1) & ((1 << bits) - 1)
    return out


_CRC8 = _table(0x07, 8).tolist()
_CRC16 = [_table(0x8005, 16).astype(np.uint16)]  # [d]: of a byte with d bytes after it
_far = np.stack(_CRC16)


def _crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def _crc16(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start : start + size], each: the checksum is linear, so every byte counts by its distance from the end."""
    global _far
    most = int(size.max()) if len(size) else 0
    if most > len(_far):
        rows = [_far[-1]]
        for _ in range(max(most, 2 * len(_far)) - len(_far)):
            rows.append((rows[-1] << np.uint16(8)) ^ _CRC16[0][rows[-1] >> np.uint16(8)])
        _far = np.concatenate((_far, np.stack(rows[1:])))
    at = np.concatenate(([0], np.cumsum(size)))
    inside = np.arange(at[-1]) - np.repeat(at[:-1], size)
    away = np.repeat(size - 1, size) - inside
    return np.bitwise_xor.reduceat(_far[away, data[inside + np.repeat(start, size)]], at[:-1]) if len(size) else np.zeros(0, np.uint16)


def _utf8(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    out = []
    first = 0x3F
    while n > first:
        out.append(0x80 | n & 0x3F)
        n >>= 6
        first >>= 1
    return bytes([(~first << 1) & 0xFF | n, *reversed(out)])


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors (frames, ORDER) and shifts of the rows of x, by autocorrelation and Levinson's recursion."""
    frames, wide = x.shape
    r = np.zeros((frames, ORDER + 1))
    for lag in range(min(ORDER + 1, wide)):  # below 2^31: 4096 products of 8-bit samples
        r[:, lag] = np.einsum("ij,ij->i", x[:, lag:], x[:, : wide - lag])
    r[:, 0] = r[:, 0] * (1 + 1e-9) + 1
    a = np.zeros((frames, ORDER))
    error = r[:, 0].copy()
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        old = a[:, :i].copy()
        a[:, i] = k
        a[:, :i] = old - k[:, None] * old[:, ::-1]
        error *= 1 - k * k
    top = np.abs(a).max(1)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(np.maximum(top, 1e-9) * 1.002)), 0, 15).astype(np.int32)
    limit = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit - 1).astype(np.int32), shift


def _candidates(x: np.ndarray, coefs: np.ndarray, shift: np.ndarray):
    """(order, residuals) of each predictor, one after another; a row's first ``order`` values mean nothing."""
    yield 0, x
    e = x.copy()
    for order in (1, 2):
        e[:, order:] = e[:, order:] - e[:, order - 1: -1]
        yield order, e
    total, term = np.zeros_like(x), np.empty_like(x)
    for j in range(ORDER):  # below 2^31: 10-bit taps, 8-bit samples
        np.multiply(x[:, : x.shape[1] - j - 1], coefs[:, j: j + 1], out=term[:, j + 1:])
        total[:, j + 1:] += term[:, j + 1:]
    total >>= shift[:, None]
    yield ORDER, np.subtract(x, total, out=total)


def encode_frames(x: np.ndarray, n: np.ndarray, number: np.ndarray) -> list[bytes]:
    """Frames of 8-bit samples: row i of x holds n[i] of them, then zeros."""
    frames, wide = x.shape
    coefs, shift = _predictors(x)
    inside = np.arange(wide, dtype=np.int32)
    beyond = None if (n == wide).all() else inside >= n[:, None]
    kind, param, size_bits = np.full(frames, 4), np.zeros(frames, np.int32), 8 * n.astype(np.int64)  # verbatim
    order_of, chosen = np.zeros(frames, np.int32), np.zeros_like(x)
    for c, (order, e) in enumerate(_candidates(x, coefs, shift)):
        u = (e << 1) ^ (e >> 31)
        u[:, :order] = 0
        if beyond is not None:
            u[beyond] = 0
        codes = np.maximum(n - order, 1)
        k = np.clip(np.floor(np.log2(np.maximum(u.sum(1) / n * 0.85, 1e-9))), 0, 7).astype(np.int32)
        bits = (u >> k[:, None]).sum(1) + codes * (k + 1) + 8 * order + 10 + (9 + ORDER * PRECISION if c == 3 else 0)
        better = (bits < size_bits) & (n > order)
        kind[better], param[better], size_bits[better], order_of[better] = c, k[better], bits[better], order
        chosen[better] = u[better]
    same = np.ptp(x if beyond is None else np.where(beyond, x[:, :1], x), 1) == 0
    size_bits[same] = 8
    heads, lead = [], np.zeros(frames, np.int64)
    for i, (num, size, flat) in enumerate(zip(number.tolist(), n.tolist(), same.tolist())):
        head = b"\xff\xf8\x70\x02" + _utf8(num) + struct.pack(">H", size - 1)
        c, order = int(kind[i]), int(order_of[i])
        head += bytes([_crc8(head), (0 if flat else (8, 9, 10, 32 + ORDER - 1, 1)[c]) << 1])
        if flat or c == 4:
            heads.append(head + (x[i, : 1 if flat else size] & 0xFF).astype(np.uint8).tobytes())
            continue
        field, width = int.from_bytes((x[i, :order] & 0xFF).astype(np.uint8).tobytes(), "big"), 8 * order
        if c == 3:
            field, width = field << 9 | (PRECISION - 1) << 5 | int(shift[i]), width + 9
            for tap in coefs[i].tolist():
                field, width = field << PRECISION | tap & ((1 << PRECISION) - 1), width + PRECISION
        field, width = field << 10 | int(param[i]), width + 10  # method 0, one partition, its parameter
        lead[i] = 8 * len(head) + width
        fill = -width % 8
        heads.append(head + (field << fill).to_bytes((width + fill) // 8, "big"))
    whole = same | (kind == 4)
    head_size = np.array([len(h) for h in heads])
    # the residuals, as codes of up to 8 bits behind q zeros; rows that have none write nothing
    width = chosen >> param[:, None]
    value = (chosen & ((1 << param) - 1)[:, None]) | (1 << param)[:, None]
    value[inside < order_of[:, None]] = 0
    width += param[:, None] + 1
    width[inside < order_of[:, None]] = 0
    if beyond is not None:
        value[beyond], width[beyond] = 0, 0
    value[whole], width[whole] = 0, 0
    ends = np.cumsum(width, 1)
    total = np.where(whole, head_size, (lead + ends[:, -1] + 7) >> 3) + 2
    start = np.concatenate(([0], np.cumsum(total)))
    out = np.zeros(start[-1] + 2, np.uint8)
    for i, head in enumerate(heads):
        out[start[i]: start[i] + len(head)] = np.frombuffer(head, np.uint8)
    length = (param + 1)[:, None]
    pos = ends + (8 * start[:-1] + lead)[:, None].astype(np.int32) - length  # of a code's set bit
    pos[whole] = 0
    word = (value << (16 - length - (pos & 7))).ravel()
    byte = (pos >> 3).ravel()
    live = word != 0
    if not live.all():
        word, byte = word[live], byte[live]
    if len(byte):
        first = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
        word, byte = np.bitwise_or.reduceat(word, first), byte[first]
        out[byte] |= (word >> 8).astype(np.uint8)
        out[byte + 1] |= (word & 0xFF).astype(np.uint8)
    flat = out[: start[-1]]
    crc = _crc16(flat, start[:-1], total - 2)
    flat[start[1:] - 2], flat[start[1:] - 1] = crc >> 8, crc & 0xFF
    raw_bytes = flat.tobytes()
    return [raw_bytes[a:b] for a, b in zip(start[:-1].tolist(), start[1:].tolist())]


def encode(payloads: list[np.ndarray], rate: int = 8000) -> list[bytes]:
    """A FLAC stream for each payload of unsigned bytes (not empty), byte b as the sample b - 128."""
    parts: list[list[bytes]] = [[b""] * -(-len(p) // BLOCK) for p in payloads]
    todo = sorted(((min(BLOCK, len(p) - b), i, b) for i, p in enumerate(payloads) for b in range(0, len(p), BLOCK)), reverse=True)
    first = 0
    while first < len(todo):  # blocks of like size together
        wide = todo[first][0]
        group = todo[first: first + max(1, SAMPLES // wide)]
        first += len(group)
        x = np.zeros((len(group), wide), np.int32)
        for row, (n, i, b) in enumerate(group):
            x[row, :n] = payloads[i][b: b + n]
            x[row, :n] -= 128
        for (_, i, b), frame in zip(group, encode_frames(x, np.array([n for n, _, _ in group]), np.array([b // BLOCK for _, _, b in group]))):
            parts[i][b // BLOCK] = frame
    out = []
    for payload, frames in zip(payloads, parts):
        sizes = [len(f) for f in frames]
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += ((rate << 44) | (0 << 41) | (7 << 36) | len(payload)).to_bytes(8, "big") + hashlib.md5((payload ^ 0x80).tobytes()).digest()
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        seek = b"".join(struct.pack(">QQH", k * BLOCK, offsets[k], min(BLOCK, len(payload) - k * BLOCK)) for k in range(len(frames)))
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(frames))
    return out


class Stream:
    """Metadata of a stream: rate, channels, bits, samples, MD5, seek points and where the frames begin."""

    def __init__(self, media: bytes) -> None:
        if media[:4] != b"fLaC":
            raise Damaged("no FLAC stream")
        at, last, self.points = 4, False, []
        while not last:
            head, size = media[at], int.from_bytes(media[at + 1: at + 4], "big")
            body, last, at = media[at + 4: at + 4 + size], head >> 7, at + 4 + size
            if len(body) < size:
                raise Damaged("metadata cut short")
            if head & 127 == 0:
                bits = int.from_bytes(body[10:18], "big")
                self.block = int.from_bytes(body[2:4], "big")
                self.rate, self.channels, self.bits, self.samples = bits >> 44, (bits >> 41 & 7) + 1, (bits >> 36 & 31) + 1, bits & ((1 << 36) - 1)
                self.md5 = body[18:34]
            elif head & 127 == 3:
                self.points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
        self.start = at


def _header(data: bytes, at: int, stream: Stream) -> tuple[int, int, int, int]:
    """Block size, channel code, bits, and where the subframes begin; the CRC-8 is verified."""
    if data[at: at + 1] != b"\xff" or len(data) < at + 7 or data[at + 1] & 0xFE != 0xF8:
        raise Damaged(f"no frame at {at}")
    size_code, rate_code = data[at + 2] >> 4, data[at + 2] & 15
    channels, bit_code = data[at + 3] >> 4, data[at + 3] >> 1 & 7
    p = at + 4
    extra = 0
    while extra < 7 and data[p] << extra & 0x80:
        extra += 1
    p += max(1, extra)
    if size_code == 6:
        size, p = data[p] + 1, p + 1
    elif size_code == 7:
        size, p = int.from_bytes(data[p: p + 2], "big") + 1, p + 2
    else:
        size = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else 256 << (size_code - 8)
    p += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if _crc8(data[at:p]) != data[p]:
        raise Damaged(f"header checksum at {at}")
    return size, channels, (stream.bits, 8, 12, 0, 16, 20, 24, 32)[bit_code], p + 1


class _Bits:
    """Random access to the bits of a buffer: fields up to 25 bits wide, and the next set bit."""

    def __init__(self, raw: np.ndarray) -> None:
        b = np.concatenate((raw, np.zeros(8, np.uint8)))
        w = b.astype(np.uint32)
        self.win = (w[:-3] << np.uint32(24)) | (w[1:-2] << np.uint32(16)) | (w[2:-1] << np.uint32(8)) | w[3:]
        self.end = 8 * len(b) - 1
        at = np.arange(self.end + 1, dtype=np.int32)
        at[np.unpackbits(b) == 0] = self.end
        self.next = np.ascontiguousarray(np.minimum.accumulate(at[::-1])[::-1])

    def get(self, pos: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        pos = np.minimum(pos, self.end - 32)
        wide = self.win[pos >> 3].astype(np.int64)
        return (wide >> (32 - (pos & 7) - width)) & ((np.int64(1) << width) - 1)

    def one(self, pos: int, width: int) -> int:
        if width > 25:
            high = self.one(pos, width - 16)
            return high << 16 | self.one(pos + width - 16, 16)
        return int(self.win[min(pos, self.end - 32) >> 3]) >> (32 - (pos & 7) - width) & ((1 << width) - 1) if width else 0


def _signed(v, width):
    return v - ((v >> (width - 1)) << width)


def _codes(bits: _Bits, pos: np.ndarray, k: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """n[i] Rice codes with parameter k[i] from pos[i] on: the residuals of each, and the ends."""
    order = np.argsort(-n, kind="stable")
    k, n = k[order], n[order]
    p, jump = pos[order].astype(np.int64), (k + 1).astype(np.int64)
    begin = p.copy()
    steps = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(steps), side="left")
    ends = np.zeros((steps, len(n)), np.int32)
    for t, a in enumerate(active.tolist()):
        one = ends[t, :a]
        bits.next.take(p[:a], out=one, mode="clip")  # what is cut short stays at the end, and is seen below
        np.add(one, jump[:a], out=p[:a])
    if len(p) and int(p.max()) > bits.end:
        raise Damaged("residuals cut short")
    one = np.ascontiguousarray(ends.T)
    q = np.empty_like(one)
    q[:, 1:] = one[:, 1:] - one[:, :-1] - jump[:, None].astype(np.int32)
    q[:, :1] = one[:, :1] - begin[:, None].astype(np.int32)
    wide = k[:, None].astype(np.int32)
    at = np.minimum(one + 1, bits.end - 32)
    low = (bits.win.take(at >> 3) << (at & 7).astype(np.uint32)) >> (32 - np.maximum(wide, 1)).astype(np.uint32)
    u = (q << wide) | np.where(wide > 0, low, 0).astype(np.int32) if int(k.max(initial=0)) < 24 else (q.astype(np.int64) << wide) | bits.get(one + 1, k[:, None])
    values = ((u >> 1) ^ -(u & 1)).astype(np.int64)
    back = np.argsort(order)
    return [values[i, : n[i]] for i in back.tolist()], p[back]


def _residuals(bits: _Bits, pos: list[int], size: list[int], order: list[int]) -> tuple[list[np.ndarray], list[int]]:
    """Residuals of subframes whose coded residual begins at pos; partition by partition, all subframes in step."""
    count = len(pos)
    out: list[list[np.ndarray]] = [[] for _ in range(count)]
    at = list(pos)
    method = [bits.one(p, 2) for p in pos]
    parts = [bits.one(p + 2, 4) for p in pos]
    if any(m > 1 for m in method):
        raise Damaged("reserved residual coding")
    at = [p + 6 for p in at]
    part = 0
    while live := [i for i in range(count) if part < 1 << parts[i]]:
        n = {i: (size[i] >> parts[i]) - (order[i] if part == 0 else 0) for i in live}
        if min(n.values()) < 0:
            raise Damaged("partition shorter than its predictor")
        coded = []
        for i in live:
            wide = 5 if method[i] else 4
            k = bits.one(at[i], wide)
            at[i] += wide
            if k == (1 << wide) - 1:  # escape: raw numbers
                width = bits.one(at[i], 5)
                where = at[i] + 5 + width * np.arange(n[i])
                out[i].append(_signed(bits.get(where, width), width) if width else np.zeros(n[i], np.int64))
                at[i] += 5 + width * n[i]
            else:
                coded.append((i, k))
        if coded:
            sizes = np.array([n[i] for i, _ in coded])
            values, ends = _codes(bits, np.array([at[i] for i, _ in coded]), np.array([k for _, k in coded]), sizes)
            for (i, _), piece, end in zip(coded, values, ends.tolist()):
                out[i].append(piece)
                at[i] = end
        part += 1
    return [o[0] if len(o) == 1 else np.concatenate(o) for o in out], at


def _restore(warm: list[np.ndarray], coefs: list[list[int]], shift: list[int], residual: list[np.ndarray]) -> list[np.ndarray]:
    """Samples from warm-up samples, predictors and residuals; streams of one order run in step."""
    out: list = [None] * len(warm)
    for order in sorted({len(c) for c in coefs}):
        mine = sorted((i for i in range(len(warm)) if len(coefs[i]) == order), key=lambda i: -len(residual[i]))
        if not order:
            for i in mine:
                out[i] = residual[i]
            continue
        fixed = [i for i in mine if not shift[i] and coefs[i] == FIXED.get(order)]
        for i in fixed:  # a fixed predictor is a repeated sum
            y = residual[i]
            for level in range(order, 0, -1):
                start = np.diff(warm[i], level - 1)[-1] if level > 1 else warm[i][-1]
                y = start + np.cumsum(y)
            out[i] = np.concatenate((warm[i], y))
        mine = [i for i in mine if i not in set(fixed)]
        if not mine:
            continue
        n = np.array([len(residual[i]) for i in mine])
        x = np.zeros((order + int(n[0]), len(mine)), np.int64)
        for c, i in enumerate(mine):
            x[:order, c] = warm[i]
            x[order: order + n[c], c] = residual[i]
        taps = np.array([coefs[i][::-1] for i in mine], np.int64).T.copy()
        down = np.array([shift[i] for i in mine], np.int64)
        for t, a in enumerate(np.searchsorted(-n, -np.arange(int(n[0])), side="left").tolist()):
            x[t + order, :a] += np.einsum("of,of->f", taps[:, :a], x[t: t + order, :a]) >> down[:a]
        for c, i in enumerate(mine):
            out[i] = x[: order + n[c], c].copy()
    return out


def decode_frames(data: bytes, starts: list[int], streams: list[Stream]) -> tuple[list[np.ndarray], list[int]]:
    """Samples (n, channels) of the frames at starts, and where each ends; all checksums of frames are verified."""
    raw = np.frombuffer(data, np.uint8)
    low = min(starts, default=0)
    bits = _Bits(raw[low:])
    heads = [_header(data, s, m) for s, m in zip(starts, streams)]
    pos = [8 * (h[3] - low) for h in heads]
    found: list[list[np.ndarray]] = [[] for _ in starts]
    for channel in range(max((h[1] + 1 if h[1] < 8 else 2 for h in heads), default=0)):
        work: list[tuple] = []
        for i, (size, code, depth, _) in enumerate(heads):
            if channel >= (code + 1 if code < 8 else 2):
                continue
            depth += (code == 8 and channel == 1) or (code == 9 and channel == 0) or (code == 10 and channel == 1)
            head = bits.one(pos[i], 8)
            kind, p, wasted = head >> 1 & 63, pos[i] + 8, 0
            if head & 1:
                stop = int(bits.next[p])
                wasted, p = stop - p + 1, stop + 1
            depth -= wasted
            if kind == 0:
                found[i].append(np.full(size, _signed(bits.one(p, depth), depth), np.int64) << wasted)
                pos[i] = p + depth
            elif kind == 1:
                where = p + depth * np.arange(size)
                found[i].append(_signed(bits.get(where, depth), depth) << wasted)
                pos[i] = p + depth * size
            elif 8 <= kind <= 12 or kind >= 32:
                order = kind - 8 if kind < 32 else kind - 31
                warm = np.array([_signed(bits.one(p + depth * j, depth), depth) for j in range(order)], np.int64)
                p += depth * order
                taps, down = FIXED.get(order, []), 0
                if kind >= 32:
                    wide, down = bits.one(p, 4) + 1, _signed(bits.one(p + 4, 5), 5)
                    taps = [_signed(bits.one(p + 9 + wide * j, wide), wide) for j in range(order)]
                    p += 9 + wide * order
                work.append((i, size, order, warm, taps, down, wasted, p))
            else:
                raise Damaged("reserved subframe")
        if work:
            residual, ends = _residuals(bits, [w[7] for w in work], [w[1] for w in work], [w[2] for w in work])
            for w, x, end in zip(work, _restore([w[3] for w in work], [w[4] for w in work], [w[5] for w in work], residual), ends):
                found[w[0]].append(x << w[6])
                pos[w[0]] = end
    size = np.array([((p + 7) >> 3) + low - s for p, s in zip(pos, starts)], np.int64)
    if any(s + n + 2 > len(data) for s, n in zip(starts, size.tolist())):
        raise Damaged("frame cut short")
    crc = _crc16(raw, np.array(starts, np.int64), size)
    out = []
    for i, (s, n) in enumerate(zip(starts, size.tolist())):
        if int.from_bytes(data[s + n: s + n + 2], "big") != int(crc[i]):
            raise Damaged(f"frame checksum at {s}")
        x, code = found[i], heads[i][1]
        if code == 8:
            x = [x[0], x[0] - x[1]]
        elif code == 9:
            x = [x[0] + x[1], x[1]]
        elif code == 10:
            mid = (x[0] << 1) | (x[1] & 1)
            x = [(mid + x[1]) >> 1, (mid - x[1]) >> 1]
        out.append(np.stack(x, 1))
    return out, [s + n + 2 for s, n in zip(starts, size.tolist())]


def decode(medias: list[bytes]) -> list[list[np.ndarray]]:
    """The PCM blocks of each stream, frame by frame; sizes and MD5 are verified."""
    streams = [Stream(m) for m in medias]
    base = np.concatenate(([0], np.cumsum([len(m) for m in medias]))).astype(int).tolist()
    blocks: list[dict[int, np.ndarray]] = [{} for _ in medias]
    todo: list[tuple[int, int, int, bool]] = []  # stream, first sample, offset, whether the next start is known
    for i, s in enumerate(streams):
        whole = sum(p[2] for p in s.points) == s.samples
        todo += [(i, first, s.start + offset, True) for first, offset, _ in s.points] if whole else [(i, 0, s.start, False)]
    while todo:
        group, todo = todo[:GROUP], todo[GROUP:]
        used = sorted({i for i, *_ in group})
        lows = {i: min(o for j, _, o, _ in group if j == i) for i in used}
        # the group's part of each stream: up to the next known start, else to the end
        tops = {}
        for i in used:
            later = [o for j, _, o, known in todo if j == i and known]
            tops[i] = min(later) if later else len(medias[i])
        data = b"".join(medias[i][lows[i]: tops[i]] for i in used)
        shift, p = {}, 0
        for i in used:
            shift[i], p = p - lows[i], p + tops[i] - lows[i]
        found, ends = decode_frames(data, [o + shift[i] for i, _, o, _ in group], [streams[i] for i, *_ in group])
        for (i, first, _, known), x, end in zip(group, found, ends):
            blocks[i][first] = x
            if not known and first + len(x) < streams[i].samples:
                todo.append((i, first + len(x), end - shift[i], False))
    out = []
    for s, b in zip(streams, blocks):
        pcm = [b[k] for k in sorted(b)]
        if sum(map(len, pcm)) != s.samples:
            raise Damaged("samples are missing")
        if any(s.md5) and hashlib.md5(b"".join(pcm_bytes(x, s.bits) for x in pcm)).digest() != s.md5:
            raise Damaged("MD5 of the samples")
        out.append(pcm)
    return out


def pcm_bytes(x: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian signed PCM."""
    wide = (bits + 7) // 8
    return x.astype("<i8").reshape(-1, 1).view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def read_samples(media: bytes, start: int, count: int) -> np.ndarray:
    """Samples start .. start + count, decoding only the frames that hold them, by the seek points."""
    s = Stream(media)
    wanted = [p for p in s.points if p[0] < start + count and p[0] + p[2] > start]
    if sum(p[2] for p in s.points) != s.samples or not wanted:
        return np.concatenate(decode([media])[0])[start: start + count]
    found, _ = decode_frames(media, [s.start + p[1] for p in wanted], [s] * len(wanted))
    return np.concatenate(found)[start - wanted[0][0]:][:count]
