"""Words of a text buffer and their 64-bit hashes, computed for a whole batch at once."""

from __future__ import annotations

import numpy as np

SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True  # the separators [\x20\x09-\x0D]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
BYTE_KEYS = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(1, 2 ** 62)) * 8 + 5  # odd, so invertible modulo 2^64
_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # doubling: the first half times base^done
        more = min(done, n - done)
        out[done:done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


_UP, _DOWN = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0..BASE^n and the inverses; kept up to 8 M entries, made anew beyond."""
    global _UP, _DOWN
    if n >= len(_UP):
        up, down = _powers(BASE, n + 1), _powers(_INVERSE, n + 1)
        if n > 8 << 20:
            return up, down
        _UP, _DOWN = up, down
    return _UP, _DOWN


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (in place)."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Weighted prefix sums of a byte buffer, from which any span's hash follows."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_KEYS[buf] * powers(len(buf))[0][:len(buf)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span: equal bytes have equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def words(buf: np.ndarray, off: np.ndarray, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number of words per text); words end at their text's end."""
    is_word = ~spaces[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[:-1] = is_word
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    first[heads] = is_word[heads]  # a text starts a new word
    start = np.flatnonzero(first)
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    tails = off[1:][off[:-1] < off[1:]] - 1
    last[tails] = is_word[tails]
    end = np.flatnonzero(last) + 1
    return start, end, np.diff(np.searchsorted(start, off))


def sequence_hashes(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n consecutive word hashes inside a text: (first word, hash)."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    acc = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        acc *= np.uint64(BASE)
        acc += h[k:len(h) - n + 1 + k]
    left = np.repeat(np.cumsum(counts), counts)[:len(acc)] - np.arange(len(acc))  # words left in the text
    at = np.flatnonzero(left >= n)
    return at, mix(acc[at])
