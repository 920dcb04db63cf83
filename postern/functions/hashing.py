"""Hashes and sketches: FNV-1a, MurmurHash3, MinHash, LSH band keys, SimHash."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

PERMUTATIONS, BANDS = 64, 16


def utf16_units(c: Column) -> Column:
    """The UTF-16 code units of a text."""
    points = F.transform(F.split(c, ""), lambda ch: F.ascii(ch).cast("long"))
    pairs = F.transform(points, lambda x: F.when(x < 65536, F.array(x)).otherwise(F.array(F.shiftright(x - 65536, 10) + 0xD800, (x - 65536) % 1024 + 0xDC00)))
    return F.when(F.length(c) > 0, F.flatten(pairs)).otherwise(F.array().cast("array<bigint>"))


def fnv1a32(c: Column) -> Column:
    """FNV-1a over the UTF-16 code units, 32 bits."""
    return F.aggregate(utf16_units(c), F.lit(2166136261).cast("long"), lambda h, x: F.pmod(h.bitwiseXOR(x) * F.lit(16777619), F.lit(4294967296)))


def times32(a: Column, by: Column | int) -> Column:
    """The low 32 bits of a product of two numbers below 2^32, by halves so that nothing overflows."""
    by = F.lit(by) if isinstance(by, int) else by
    high = F.shiftright(a, 16) * by % 65536
    return ((a % 65536) * by + high * 65536) % F.lit(4294967296)


def cyrb53(c: Column) -> Column:
    """A 53-bit hash over the UTF-16 code units, as 14 hex digits."""
    units = utf16_units(c)
    run = lambda start, by: F.aggregate(units, F.lit(start).cast("long"), lambda h, x: times32(h.bitwiseXOR(x), by))
    one, two = run(0xDEADBEEF, 2654435761), run(0x41C6CE57, 1597334677)
    first = times32(one.bitwiseXOR(F.shiftright(one, 16)), 2246822507).bitwiseXOR(times32(two.bitwiseXOR(F.shiftright(two, 13)), 3266489909))
    second = times32(two.bitwiseXOR(F.shiftright(two, 16)), 2246822507).bitwiseXOR(times32(first.bitwiseXOR(F.shiftright(first, 13)), 3266489909))
    return F.lpad(F.lower(F.hex(second % 2097152 * F.lit(4294967296) + first)), 14, "0")


def _fnv(texts: pa.Array, *starts: int) -> list[np.ndarray]:
    """FNV-1a over the UTF-16 units of every text, from each starting point: one unit of all texts a step."""
    texts = texts.cast(pa.large_string()).fill_null("") if len(texts) else pa.array([], pa.large_string())
    if not len(texts):
        return [np.zeros(0, np.uint32) for _ in starts]
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = (data.to_pybytes() if data is not None else b"")[at[0]: at[-1]]
    at = at - at[0]
    if raw.isascii():
        units = np.frombuffer(raw, np.uint8)
    else:
        lead = np.frombuffer(raw, np.uint8)
        at = np.concatenate(([0], np.cumsum((lead & 0xC0 != 0x80).astype(np.int64) + (lead >= 0xF0))))[at]
        units = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-16-le", "surrogatepass"), np.uint16)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    first, active = at[:-1][order], np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left").tolist()
    out = []
    for start in starts:
        h = np.full(len(texts), start, np.uint32)
        for step, n in enumerate(active):
            h[:n] ^= units[first[:n] + step]
            h[:n] *= np.uint32(16777619)
        back = np.empty_like(h)
        back[order] = h
        out.append(back)
    return out


def _rows(features: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All strings of a column of string lists, the number in each row, and the rows that have any."""
    n = features.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return features.flatten(), n, np.flatnonzero(n)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


#: The starting points of the 64 permutations follow from two constants.
SEEDS = _mix(np.uint32(0x9E3779B9) + np.arange(PERMUTATIONS, dtype=np.uint32) * np.uint32(0x632BE5AB))


@F.arrow_udf(T.ArrayType(T.LongType()))
def minhash(features: pa.Array) -> pa.Array:
    """64 minima for each array of strings; zeros for an empty or null one."""
    flat, n, some = _rows(features)
    out = np.zeros((len(n), PERMUTATIONS), np.int64)
    if len(some):
        base, first = _fnv(flat, 2166136261)[0], (np.cumsum(n) - n)[some]
        for j, seed in enumerate(SEEDS):
            out[some, j] = np.minimum.reduceat(_mix(base ^ seed), first)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * PERMUTATIONS), pa.array(out.ravel()))


@F.arrow_udf(T.StringType())
def simhash(features: pa.Array) -> pa.Array:
    """64-bit SimHash as 16 hex digits, the high half first."""
    flat, n, some = _rows(features)
    halves = np.zeros((len(n), 2), np.uint32)
    if len(some):
        first = (np.cumsum(n) - n)[some]
        for half, h in enumerate(_fnv(flat, 0x01000193 ^ 0x5BD1E995, 2166136261)):
            for bit in range(32):
                ones = np.add.reduceat((h >> np.uint32(bit)) & np.uint32(1), first, dtype=np.int64)
                halves[some, half] |= (2 * ones > n[some]).astype(np.uint32) << np.uint32(bit)
    return pa.array([f"{a:08x}{b:08x}" for a, b in halves.tolist()])


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86, 32 bits."""
    h = seed
    for i in range(0, len(data) - 3, 4):
        k = int.from_bytes(data[i: i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        k = ((k << 15) | (k >> 17)) & 0xFFFFFFFF
        h ^= k * 0x1B873593 & 0xFFFFFFFF
        h = (((h << 13) | (h >> 19)) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    tail = data[len(data) & ~3:]
    if tail:
        k = int.from_bytes(tail, "little") * 0xCC9E2D51 & 0xFFFFFFFF
        k = ((k << 15) | (k >> 17)) & 0xFFFFFFFF
        h ^= k * 0x1B873593 & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ (h >> 16)


@F.pandas_udf(T.LongType())
def murmur3(text: pd.Series) -> pd.Series:
    return text.map(lambda t: murmur3_32((t or "").encode()))


def same_share(a: Column, b: Column) -> Column:
    """Share of equal slots of two sketches; 0 if either is all zeros."""
    zero = lambda x: ~F.exists(x, lambda v: v != 0)
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(PERMUTATIONS))
    return F.when(zero(a) | zero(b), F.lit(0.0)).otherwise(equal)


def band_keys(sketch: Column) -> Column:
    rows = PERMUTATIONS // BANDS
    keys = F.array(*[F.concat(F.lit(f"lsh:{b}:"), F.substring(F.sha2(F.array_join(F.slice(sketch, b * rows + 1, rows), "."), 256), 1, 14)) for b in range(BANDS)])
    return F.when(F.exists(sketch, lambda v: v != 0), keys).otherwise(F.array().cast("array<string>"))


def simhash_similarity(a: Column, b: Column) -> Column:
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    distance = F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))
    return F.lit(1.0) - distance / 64


def set_id(ids: Column, prefix: str = "CL-", digits: int = 8) -> Column:
    """A name that follows from a set of ids."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(F.array_join(F.array_sort(ids), "|"), 256), 1, digits)))
