"""Words of texts and their hashes, computed for many texts at once in numpy.

A word is a run of bytes other than space and 0x09 to 0x0D. Hashes are
polynomials modulo 2**64 from prefix sums, finished by a bit mixer; they find
candidates, and exact comparisons follow where a result depends on them.
"""

from __future__ import annotations

import numpy as np

_BASE, _BASE_INV = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_tables: dict[str, np.ndarray] = {}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers of the base (or of its inverse) modulo 2**64, at least n of them."""
    name = "inv" if inverse else "pow"
    have = _tables.get(name)
    if have is None or len(have) < n:
        base = np.full(1 << max(16, (n - 1).bit_length()), _BASE_INV if inverse else _BASE, np.uint64)
        base[0] = 1
        have = _tables[name] = np.multiply.accumulate(base)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value * base**position; with `spans` they give the hash of any span."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * _powers(len(values)), out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), the same for equal content wherever it stands."""
    h = (sums[ends] - sums[starts]) * _powers(len(sums), True)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k consecutive items."""
    n = max(0, len(hashes) - k + 1)
    at = np.arange(n)
    return spans(prefix(hashes), at, at + k)


def split(texts: list) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes of `texts` (None: empty), start and end of each word in
    them, and the index of the first word of each text (with one index at the end)."""
    flat = b" ".join(t or b"" for t in texts)
    buf = np.frombuffer(flat, np.uint8)
    edge = np.diff(~SPACE[buf], prepend=False, append=False).nonzero()[0]
    starts, ends = edge[::2], edge[1::2]
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t or b"") + 1 for t in texts], out=at[1:])
    return flat, starts, ends, np.searchsorted(starts, at)


def leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value in each window of `width` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(values[a] <= values[b], a, b)
        have += step
    return best[:n]
