"""Codecs of ascending integer lists, and Bloom filters of segments.

Parquet's own encodings do this for tables; these are for lists that travel as binaries.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.columns import ColumnLike, col


def encode_plain(values: np.ndarray) -> bytes:
    return np.asarray(values, "<u8").tobytes()


def decode_plain(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8").astype(np.uint64)


#: Lists up to this length, which most terms have, are coded by Python's integers; numpy's calls take longer.
SHORT = 16


def _packed(bits: str) -> bytes:
    size = -(-len(bits) // 8)
    return int(bits.ljust(8 * size, "0"), 2).to_bytes(size, "big") if size else b""


def _bits(raw: bytes) -> str:
    return f"{int.from_bytes(raw, 'big'):0{8 * len(raw)}b}" if raw else ""


def _encode_short(v: list[int]) -> bytes:
    n = len(v)
    if any(b < a for a, b in zip(v, v[1:])):
        raise ValueError("the values descend")
    width = max(0, (max(v[-1], 1) // n).bit_length() - 1)
    low = "".join(f"{x & ((1 << width) - 1):0{width}b}"[::-1] for x in v) if width else ""
    high = "".join("0" * ((b >> width) - (a >> width)) + "1" for a, b in zip([0, *v], v))
    return struct.pack("<QB", n, width) + _packed(low) + _packed(high)


def _decode_short(raw: bytes, n: int, width: int, size: int) -> np.ndarray:
    low, high, at, out = _bits(raw[9 : 9 + size]), _bits(raw[9 + size :]), -1, []
    for i in range(n):
        at = high.index("1", at + 1)
        out.append((at - i) << width | (int(low[i * width : (i + 1) * width][::-1], 2) if width else 0))
    return np.array(out, np.uint64)


def encode_elias_fano(values: np.ndarray) -> bytes:
    """Low bits packed, high bits in unary; the values must not descend."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    if 0 < n <= SHORT:
        return _encode_short(v.tolist())
    if (v[1:] < v[:-1]).any():
        raise ValueError("the values descend")
    top = int(v[-1]) if n else 0
    width = max(0, (max(top, 1) // max(n, 1)).bit_length() - 1) if n else 0
    low = ((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    places = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
    high[places] = 1
    return struct.pack("<QB", n, width) + np.packbits(low).tobytes() + np.packbits(high).tobytes()


def decode_elias_fano(raw: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<QB", raw)
    size = -(-n * width // 8)
    if 0 < n <= SHORT:
        return _decode_short(raw, n, width, size)
    low = np.unpackbits(np.frombuffer(raw, np.uint8, size, 9))[: n * width].reshape(n, width).astype(np.uint64)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, -1, 9 + size)))[:n] - np.arange(n)
    return (high.astype(np.uint64) << np.uint64(width)) | (low << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64)


_CODECS = {"plain": (encode_plain, decode_plain), "elias_fano": (encode_elias_fano, decode_elias_fano)}


def encode_list(values: ColumnLike, codec: str = "elias_fano") -> Column:
    put = _CODECS[codec][0]

    @F.pandas_udf("binary")
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else put(v))

    return encode(col(values))


def decode_list(raw: ColumnLike, codec: str = "elias_fano") -> Column:
    take = _CODECS[codec][1]

    @F.pandas_udf("array<long>")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else take(b).astype(np.int64))

    return decode(col(raw))


class BloomFilter:
    """Blocks of 512 bits; a key sets `hashes` bits in one block. There are no false negatives."""

    def __init__(self, expected: int, false_positives: float = 0.01, bits: np.ndarray | None = None):
        per_key = -np.log(false_positives) / np.log(2) ** 2
        self.hashes = max(1, round(per_key * np.log(2)))
        self.blocks = max(1, int(np.ceil(expected * per_key * 1.3 / 512)))
        self.bits = np.zeros(self.blocks * 512, bool) if bits is None else bits

    def _places(self, keys: np.ndarray) -> np.ndarray:
        h = np.asarray(keys).astype(np.uint64)
        out = []
        for _ in range(self.hashes + 1):
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            h += np.uint64(0x9E3779B97F4A7C15)
            out.append(h)
        block = (out[0] % np.uint64(self.blocks)) * np.uint64(512)
        return np.stack([block + o % np.uint64(512) for o in out[1:]], axis=1).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.bits[self._places(keys).ravel()] = True

    def may_contain(self, keys: np.ndarray) -> np.ndarray:
        return self.bits[self._places(keys)].all(axis=1)
