"""Vectorised hashes of byte runs and word runs, equal on every machine."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(1, 1 << 62)) * 4 + 5
INVERSE = pow(BASE, -1, 1 << 64)
ODD = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base % (1 << 64), np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums that run_hash() takes differences of."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] that doesn't depend on where the run stands."""
    inverse = powers(INVERSE, len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * ODD[0])


def word_runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of data, A-Z lower-cased, in order."""
    raw = LOWER[np.frombuffer(data, np.uint8)]
    word = ~BLANK[raw]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start, end, run_hash(prefix(BYTE[raw]), start, end)


def shingle_hashes(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """Each text's shingles of `width` words in order (fewer words: one shingle of all; none: none)."""
    parts = [x.encode("utf-8", "surrogatepass") for x in texts]
    start, _, words = word_runs(b" ".join(parts))
    at = np.searchsorted(start, np.cumsum([0] + [len(x) + 1 for x in parts]))
    n = max(0, len(words) - width + 1)
    joined = np.zeros(n, np.uint64)
    for k in range(width):
        joined += words[k : k + n] * ODD[k + 1]
    joined = mix(joined)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            out.append(joined[a : b - width + 1])
        elif b > a:
            out.append(mix((words[a:b] * ODD[1 : b - a + 1]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(joined[:0])
    return out


def slices(texts: list[str | None], chars: int = 500_000):
    """(from, to) over texts, so that few or one long text are handled at once."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= chars):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end
