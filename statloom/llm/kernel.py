"""Vectorised word and n-gram hashing over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Fixed odd multipliers and a fixed seed: hashes must agree between executors and runs.
_R, _Q, _SEED = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93, 20240229
_BYTES = np.random.RandomState(_SEED).randint(1, 2**63 - 1, size=256, dtype=np.int64).astype(_U) | _U(1)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _sep(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


#: ASCII white space, and all ASCII but digits and letters.
SPACE = _sep(b" \t\n\v\f\r")
NOT_ALNUM = _sep(bytes(c for c in range(128) if not chr(c).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; grown on demand."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, dtype=_U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _tables[base] = (both[0], both[1])
    return have


def lowered(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and per text the number of words before it (one entry more than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~sep[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def totals(data: np.ndarray, base: int = _R) -> tuple[np.ndarray, np.ndarray]:
    """What ``spans`` takes from the bytes, for several sets of spans of the same data."""
    power, inverse = _powers(base, len(data))
    total = np.empty(len(data) + 1, _U)
    total[0] = 0
    np.cumsum(_BYTES[data] * power[: len(data)], out=total[1:])
    return total, inverse


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _R, summed: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A 64-bit hash of each byte span; another odd base gives an independent hash. ``summed``: totals(data, base), if at hand."""
    if not len(starts):
        return np.zeros(0, _U)
    total, inverse = summed or totals(data, base)
    at = np.minimum(starts, len(data) - 1)
    return mix((total[ends] - total[starts]) * inverse[at] + (ends - starts).astype(_U))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k hashes from each position on; k - 1 fewer entries. Windows may cross texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    power, inverse = _powers(_Q, len(hashes))
    total = np.empty(len(hashes) + 1, _U)
    total[0] = 0
    np.cumsum(hashes * power[: len(hashes)], out=total[1:])
    return mix((total[k:] - total[:n]) * inverse[:n])


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by doubling."""
    out, span = values, 1
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def sorted_digest(sets: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(sets.tobytes(), digest_size=16).digest()
