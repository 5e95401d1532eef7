"""Word and shingle hashes of many texts at once, from the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
STEP = U(0x9E3779B97F4A7C15)
#: Bytes hashed at once; a longer word makes the tables grow.
PIECE = 1 << 18

_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: A number for each byte, the same for A-Z as for a-z.
_OF_BYTE = np.random.default_rng(64).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_OF_BYTE[65:91] = _OF_BYTE[97:123]
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        out = np.full(max(n, PIECE), U(base))
        out[0] = 1
        _powers[base] = np.cumprod(out)
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def _words(data: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word; heads: where texts begin, in order."""
    blank = _BLANK[data]
    before = np.ones(len(data), bool)
    before[1:] = blank[:-1]
    before[heads] = True
    after = np.ones(len(data), bool)
    after[:-1] = blank[1:]
    after[heads[heads > 0] - 1] = True
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    out, i = [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        lo, hi = starts[i], ends[j - 1]
        sums = np.zeros(hi - lo + 1, U)
        np.cumsum(_OF_BYTE[data[lo:hi]] * _power(_BASE, hi - lo), out=sums[1:])
        out.append((sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * _power(_BASE_INVERSE, hi - lo)[starts[i:j] - lo])
        i = j
    return mixed(np.concatenate(out)) if out else np.empty(0, U), starts


def _joined(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    h = np.full(max(n, 0), U(size))
    for i in range(size):
        h = (h * STEP) ^ words[i : i + n]
        h ^= h >> U(31)
    return mixed(h)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lowered. Fewer words than k are one shingle; a
    null text, or one without words, has none.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        begins = offsets[i : j + 1] - offsets[i]
        part = data[offsets[i] : offsets[j]]
        words, starts = _words(part, begins[:-1][begins[:-1] < len(part)])
        cut = np.searchsorted(starts, begins)
        every = _joined(words, k)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            n = b - a
            yield np.unique(every[a : b - k + 1]) if n >= k else _joined(words[a:b], n) if n else np.empty(0, U)
        i = j
