"""MurmurHash3 (x86, 32 bits), CRC-32 and the bloom filter, vectorized."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_C1, _C2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint32(n)) | (x >> np.uint32(32 - n))


def murmur3_32(keys: Iterable[bytes], seed: int | np.ndarray = 0) -> np.ndarray:
    """Signed 32-bit hashes, four bytes at a time. Keys of about the same length go together, so that one long key costs only itself."""
    keys = list(keys)
    size = np.array([len(k) for k in keys], np.int64)
    seeds = np.broadcast_to(np.asarray(seed).astype(np.int64).astype(np.uint32), (len(keys),))
    out = np.zeros(len(keys), np.int32)
    group = np.ceil(np.log2(size + 1)).astype(np.int64)
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        for k in range(0, len(at), some := max(1, (1 << 24) >> int(g))):
            mine = at[k : k + some]
            out[mine] = _murmur([keys[i] for i in mine], size[mine], seeds[mine].copy())
    return out


def _murmur(keys: list[bytes], size: np.ndarray, h: np.ndarray) -> np.ndarray:
    n, most = len(keys), int(size.max(initial=0))
    words = -(-most // 4) + 1
    raw = np.zeros((n, words * 4), np.uint8)
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    raw[np.repeat(np.arange(n), size), nth] = np.frombuffer(b"".join(keys), np.uint8)
    k = raw.view("<u4").astype(np.uint32) * _C1
    k = _rotated(k, 15) * _C2
    full = size // 4
    if n == 1:  # a long key alone: its words one after the other
        x = int(h[0])
        for w in k[0, : full[0]].tolist():
            x ^= w
            x = (((x << 13) & 0xFFFFFFFF | x >> 19) * 5 + 0xE6546B64) & 0xFFFFFFFF
        h = np.array([x], np.uint32)
    for i in range(words if n > 1 else 0):
        on = full > i
        h = np.where(on, _rotated(h ^ k[:, i], 13) * np.uint32(5) + np.uint32(0xE6546B64), h)
    # bytes after the last full word are zero, so the tail's product is zero for none
    h ^= np.where(size % 4 > 0, k[np.arange(n), full], np.uint32(0))
    h ^= size.astype(np.uint32)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(by)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def murmur3(col: Column) -> Column:
    """MurmurHash3 of a binary column; Spark's hash() differs on tails of 1 to 3 bytes."""

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        ok = s.notna()
        out = pd.Series(np.nan, index=s.index, dtype="object")
        out[ok] = murmur3_32([bytes(x) for x in s[ok]])
        return out

    return run(col)


def crc32(col: Column) -> Column:
    """Unsigned CRC-32 of a binary column, in the JVM."""
    return F.crc32(col)


class BloomFilter:
    """m bits and k probes at h1 + i * h2 in wrapping 32-bit arithmetic, h2 seeded with h1."""

    def __init__(self, expected: int, fpp: float = 0.01) -> None:
        n = max(1, expected)
        p = fpp if 0.0 < fpp < 1.0 else 0.01
        self.bits = int(max(64, min((1 << 31) - 1 - 64, int(-n * math.log(p) / math.log(2) ** 2))))
        self.probes = max(1, min(30, math.floor(self.bits / n * math.log(2) + 0.5)))
        self.words = np.zeros(-(-self.bits // 64), np.uint64)

    def _places(self, keys: list[bytes]) -> np.ndarray:
        h1 = murmur3_32(keys)
        h2 = murmur3_32(keys, h1)
        i = np.arange(self.probes, dtype=np.int64)
        mixed = (h1.astype(np.int64)[:, None] + i * h2.astype(np.int64)[:, None]).astype(np.int32)
        return np.mod(mixed.astype(np.int64), self.bits)

    def add(self, keys: Iterable[bytes]) -> BloomFilter:
        at = self._places(list(keys)).ravel()
        np.bitwise_or.at(self.words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        return self

    def might_contain(self, keys: Iterable[bytes]) -> np.ndarray:
        at = self._places(list(keys))
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(1)

    def union(self, other: BloomFilter) -> BloomFilter:
        self.words |= other.words
        return self

    def to_bytes(self) -> bytes:
        return self.bits.to_bytes(4, "big") + self.probes.to_bytes(4, "big") + self.words.astype(">u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BloomFilter:
        out = cls.__new__(cls)
        out.bits, out.probes = int.from_bytes(data[:4], "big"), int.from_bytes(data[4:8], "big")
        out.words = np.frombuffer(data, ">u8", -(-out.bits // 64), 8).astype(np.uint64)
        return out


#: Words of a filter that travel as a row.
_PIECE = 1 << 13


def build_bloom(keys: DataFrame, expected: int, fpp: float = 0.01, key: str = "key") -> BloomFilter:
    """A filter over all keys of a frame. Each partition sends only the pieces it touched; equal pieces are or-ed by tasks, and the driver gets one of each."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = BloomFilter(expected, fpp)
        for pdf in it:
            b.add([bytes(x) for x in pdf[key]])
        for k in range(0, len(b.words), _PIECE):
            if (w := b.words[k : k + _PIECE]).any():
                yield pd.DataFrame({"piece": [k], "w": [w.view(np.int64)]})

    out = BloomFilter(expected, fpp)
    pieces = keys.select(key).mapInPandas(run, "piece long, w array<long>")
    at = pieces.select("piece", F.posexplode("w").alias("i", "x")).filter("x <> 0").groupBy("piece", "i").agg(F.bit_or("x").alias("x"))
    whole = at.groupBy("piece").agg(F.collect_list(F.struct("i", "x")).alias("w"))
    for r in whole.toLocalIterator():
        for i, x in r.w:
            out.words[r.piece + i] = np.int64(x).astype(np.uint64)
    return out


def might_contain(bloom: BloomFilter, col: Column) -> Column:
    """Whether a filter may have a key. The filter is broadcast, 256 MiB at most by its number of bits."""
    shared = SparkSession.active().sparkContext.broadcast(bloom.to_bytes())

    @F.pandas_udf("boolean")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        b = BloomFilter.from_bytes(shared.value)
        for s in it:
            yield pd.Series(b.might_contain([bytes(x) for x in s]), index=s.index)

    return run(col)
