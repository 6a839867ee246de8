"""Vectorised words and word shingles over the UTF-8 bytes of many texts at once.

A word is a run of bytes other than space and the control characters 9 to 13; A-Z count as a-z. Words and shingles are
64-bit hashes: equal words have equal hashes in every process, so they can be shuffled and compared anywhere.
"""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _P), ("down", _P_INVERSE)):
            x = np.full(max(n, 1 << 16), base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def lower_ascii(b: np.ndarray) -> np.ndarray:
    return b | (((b >= 65) & (b <= 90)).view(np.uint8) << 5)


def is_space(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


def spans(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end byte of every word; no word crosses from one row to the next. at[0] is 0."""
    inside = ~is_space(b)
    before = np.empty(len(b), bool)
    after = np.empty(len(b), bool)
    if len(b):
        before[0] = after[-1] = True
        np.logical_not(inside[:-1], out=before[1:])
        np.logical_not(inside[1:], out=after[:-1])
        before[at[:-1][at[:-1] < len(b)]] = True
        after[at[1:][at[1:] > 0] - 1] = True
    return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1


def hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each b[start:end]."""
    up, down = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def shingles(raw: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles; a row of fewer words has one of them all, one without words none."""
    base, at = raw[at[0] : at[-1]], at - at[0]
    b = lower_ascii(base)
    start, end = spans(b, at)
    h = hashes(b, start, end)
    first = np.searchsorted(start, at)
    out = []
    if len(h) >= k:
        roll = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            roll = (roll * np.uint64(0xD6E8FEB86659FD93)) ^ h[j : j + len(roll)]
            roll ^= roll >> np.uint64(32)
        roll = mix(roll)
    for i in range(len(at) - 1):
        lo, hi = first[i], first[i + 1]
        if hi - lo >= k:
            x = np.sort(roll[lo : hi - k + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif hi > lo:
            x = np.full(1, hi - lo, np.uint64)
            for j in range(lo, hi):
                x = mix((x * np.uint64(0xD6E8FEB86659FD93)) ^ h[j : j + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
