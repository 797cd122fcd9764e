"""Words, lines and hashes of many texts at once, over their UTF-8 bytes, for use inside Arrow tasks."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins (one more at the end); null texts have none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data and data.size else np.empty(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] |= 32
    return out


def tokens_between(is_gap: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of bytes that are no gap, in order; runs end where a text ends."""
    inside = ~is_gap
    first = inside.copy()
    first[1:] &= is_gap[:-1]
    last = inside.copy()
    last[:-1] &= is_gap[1:]
    edge = starts[1:-1]
    edge = edge[(edge > 0) & (edge < len(is_gap))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def white(raw: np.ndarray) -> np.ndarray:
    """Bytes 20 and 09 to 0D."""
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=8)
def _symbols(seed: int) -> np.ndarray:
    """A random 64-bit number for each byte."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64((seed + 1) * int(_BASE) & ((1 << 64) - 1)))


_powers: dict[bool, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The base's powers 0 to n - 1 modulo 2^64, or those of its inverse."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), _INVERSE if inverse else _BASE, np.uint64)
        steps[0] = 1
        have = _powers[inverse] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def prefix_hashes(raw: np.ndarray, seed: int = 0) -> np.ndarray:
    """S with S[i] the sum of the symbols of bytes before i, each times the base to the power of its place."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_symbols(seed)[raw] * powers(len(raw)), dtype=np.uint64, out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Polynomial hash of each byte range, the same wherever the range stands; ranges of other lengths differ too."""
    return mixed((prefix[hi] - prefix[lo]) * powers(len(prefix), inverse=True)[lo] + (hi - lo).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


#: Words of more bytes than this are hashed one by one.
_LONG_WORD = 64


def word_codes(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit code of each byte range, its eight-byte blocks mixed in one after another, so that no structure of a word makes codes meet; ranges of
    the same length up to 8 never share one."""
    blocks = np.ndarray(len(raw) + 1, "<u8", np.append(raw, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
    size = (hi - lo).astype(np.uint64)
    codes = size * np.uint64(0xA0761D6478BD642F)
    which = np.flatnonzero(size <= _LONG_WORD)
    for k in range(0, _LONG_WORD, 8):
        which = which[size[which] > k]
        if not len(which):
            break
        left = np.minimum(size[which] - np.uint64(k), np.uint64(8))
        part = blocks[lo[which] + k] & (np.uint64((1 << 64) - 1) >> (np.uint64(64) - left * np.uint64(8)))
        codes[which] = mixed(codes[which] ^ part)
    for w in np.flatnonzero(size > _LONG_WORD).tolist():
        codes[w] = int.from_bytes(hashlib.blake2b(raw[lo[w] : hi[w]].tobytes(), digest_size=8).digest(), "little")
    return codes


def run_codes(codes: np.ndarray, size: int) -> np.ndarray:
    """A code of each ``size`` consecutive codes (a power of two), halves mixed into one, level by level."""
    k = 1
    while k < size:
        codes = mixed(codes[:-k] * np.uint64(0x9FB21C651E98DF25) + codes[k:]) if len(codes) > k else codes[:0]
        k *= 2
    return codes


def word_hashes(raw: np.ndarray, starts: np.ndarray, gap=white) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code, begin and end of every word, and the number of the first word of each text (one more at the end)."""
    lo, hi = tokens_between(gap(raw), starts)
    return word_codes(raw, lo, hi), lo, hi, np.searchsorted(lo, starts)
