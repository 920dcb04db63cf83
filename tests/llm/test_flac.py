"""The FLAC codec: exact round trips, the parts of the format that the encoder does not write, and damage."""
import struct

import numpy as np
import pytest

from postern.llm import flac


def payloads():
    rng = np.random.default_rng(0)
    text = np.frombuffer(("The quick brown fox jumps over the lazy dog. " * 400).encode(), np.uint8)
    return [np.zeros(64, np.uint8), text[: 64 * 100].copy(), rng.integers(0, 256, 64 * 150).astype(np.uint8), (np.sin(np.arange(64 * 130) / 7) * 120 + 128).astype(np.uint8), np.tile(np.array([0, 255], np.uint8), 2080), np.full(4096 * 2, 200, np.uint8), text[:128].copy()]


def test_round_trip():
    ps = payloads()
    medias = flac.encode(ps)
    for p, blocks in zip(ps, flac.decode(medias)):
        assert ((np.concatenate(blocks)[:, 0] + 128).astype(np.uint8) == p).all()
    assert len(medias[3]) < len(ps[3]) / 2  # the linear predictor works


def test_seek():
    p = payloads()[2]
    media = flac.encode([p])[0]
    for start, count in ((0, 5), (4090, 20), (len(p) - 3, 3), (0, len(p))):
        assert (flac.read_samples(media, start, count)[:, 0] + 128 == p[start: start + count]).all()


def test_without_seek_points():
    p = payloads()[2]
    media = flac.encode([p])[0]
    s = flac.Stream(media)
    bare = media[:4] + bytes([media[4] | 0x80]) + media[5: 42] + media[s.start:]
    assert ((np.concatenate(flac.decode([bare])[0])[:, 0] + 128) == p).all()


@pytest.mark.parametrize("at", [-1, -40, 300])
def test_damage(at):
    media = bytearray(flac.encode([payloads()[1]])[0])
    media[at] ^= 0x10
    with pytest.raises((flac.Damaged, IndexError)):
        flac.decode([bytes(media)])


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, width):
        self.bits += format(value & ((1 << width) - 1), f"0{width}b") if width else ""

    def done(self):
        self.bits += "0" * (-len(self.bits) % 8)
        return int(self.bits, 2).to_bytes(len(self.bits) // 8, "big")


def stream(subframes, channel_code, n, bits, channels):
    head = b"\xff\xf8\x70" + bytes([channel_code << 4 | {8: 1, 16: 4}[bits] << 1]) + b"\x00" + struct.pack(">H", n - 1)
    frame = head + bytes([flac._crc8(head)]) + subframes
    frame += int(flac._crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")
    info = struct.pack(">HH", n, n) + bytes(6) + (8000 << 44 | (channels - 1) << 41 | (bits - 1) << 36 | n).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame


def rice(w, values, k):
    for v in values:
        u = (v << 1) ^ (v >> 63)
        w.put(1, (u >> k) + 1)
        w.put(u, k)


def test_stereo_partitions_escapes_and_wasted_bits():
    """Mid and side: a fixed predictor of order 3 over two partitions (one of them raw), and verbatim with a wasted bit."""
    rng = np.random.default_rng(1)
    n = 16
    left = np.cumsum(rng.integers(-3, 4, n))
    side = 2 * rng.integers(-5, 6, n)
    right = left - side
    mid = (left + right) >> 1
    w = Writer()
    w.put((8 + 3) << 1, 8)
    for v in mid[:3]:
        w.put(int(v), 16)
    residual = np.diff(mid, 3)
    w.put(1, 2)  # 5-bit parameters
    w.put(1, 4)  # two partitions
    w.put(2, 5)
    rice(w, residual[:5].tolist(), 2)
    w.put(31, 5)
    w.put(9, 5)
    for v in residual[5:]:
        w.put(int(v), 9)
    w.put(1 << 1 | 1, 8)
    w.put(1, 1)  # one wasted bit
    for v in side:
        w.put(int(v) >> 1, 16)
    got = flac.decode([stream(w.done(), 10, n, 16, 2)])[0][0]
    assert (got[:, 0] == left).all() and (got[:, 1] == right).all()


def test_quantised_predictor():
    n, taps, shift = 40, [7, -3], 2
    rng = np.random.default_rng(2)
    residual = rng.integers(-4, 5, n - 2)
    x = [3, 5]
    for r in residual.tolist():
        x.append(((taps[0] * x[-1] + taps[1] * x[-2]) >> shift) + r)
        x[-1] = max(-100, min(100, x[-1]))
    residual = [x[i] - ((taps[0] * x[i - 1] + taps[1] * x[i - 2]) >> shift) for i in range(2, n)]
    w = Writer()
    w.put((32 + 1) << 1, 8)
    for v in x[:2]:
        w.put(v, 8)
    w.put(5, 4)
    w.put(shift, 5)
    for c in taps:
        w.put(c, 6)
    w.put(0, 6)
    w.put(3, 4)
    rice(w, residual, 3)
    got = flac.decode([stream(w.done(), 0, n, 8, 1)])[0][0]
    assert got[:, 0].tolist() == x
