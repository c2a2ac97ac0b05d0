"""Word shingles of whole texts as sorted sets of 64-bit hashes, from the texts' bytes in numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_P, _Q = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_P_INVERSE = _U(pow(int(_P), -1, 1 << 64))
#: Every byte's character for hashing: 0 for what separates words, lower case for A-Z.
_BYTES = np.zeros(256, np.uint64)
for _c in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _BYTES[_c] = _c
for _c in range(0x41, 0x5B):
    _BYTES[_c] = _c + 32

#: Powers of each kind that a worker keeps: for texts of a million bytes, longer ones make their own.
KEPT_POWERS = 1 << 20

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _power(which: str, n: int) -> np.ndarray:
    """The first ``n`` powers; a worker keeps at most ``KEPT_POWERS`` of them."""
    have = _powers[which]
    if len(have) < n:
        factor = np.full(max(n, min(2 * len(have), KEPT_POWERS)), _P if which == "up" else _P_INVERSE, np.uint64)
        factor[0] = 1
        have = np.cumprod(factor, dtype=np.uint64)
        if len(have) <= KEPT_POWERS:
            _powers[which] = have
    return have[:n]


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word, in order: runs of digits, letters and non-ASCII bytes, A-Z lower-cased."""
    chars = _BYTES[np.frombuffer(text, np.uint8)]
    inside = np.zeros(len(chars) + 2, np.int8)
    inside[1:-1] = chars != 0
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(chars * _power("up", len(chars)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", len(chars))[starts])


def shingle_set(text: bytes | None, words: int = 5) -> np.ndarray:
    """The distinct shingles of ``words`` words, sorted. Fewer words, but not none, are one shingle."""
    hashes = word_hashes(text) if text else np.zeros(0, np.uint64)
    n = min(words, len(hashes))
    if not n:
        return hashes
    total = np.full(len(hashes) - n + 1, n, np.uint64)
    for i in range(n):
        total = total * _Q + hashes[i : len(hashes) - n + 1 + i]
    return np.unique(mix(total))
