"""Similarity self-join of a bounded block of token sets by a signature tree.

Leaves are the sets, in order of size and smallest hash. Every node holds the OR of its leaves' token bitmaps, its range of sizes
and the largest excess of a leaf's size over its set bits. Two nodes are traversed together from the roots; a pair is pruned when
the maximum possible overlap, (bits in common) + (excess), or the size range, rules out every pair of sets below it, or when all
leaves below both already belong to one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FANOUT = 8
#: Pairs of nodes tested at a time, and bytes of bitmaps that they may have on one side: wide bitmaps are tested in fewer pairs.
CHUNK, CHUNK_BYTES = 1 << 14, 1 << 22


def chunks(n: int, row_bytes: int) -> Iterator[slice]:
    """Ranges of n pairs whose bitmaps of row_bytes each are compared at a time."""
    step = max(1, min(CHUNK, CHUNK_BYTES // max(row_bytes, 1)))
    return (slice(k, k + step) for k in range(0, n, step))


def _levels(bits, low, high, excess, comp):
    """From the leaves up: per level the arrays (bits, smallest size, largest size, largest excess, component or -1)."""
    out = [(bits, low, high, excess, comp)]
    while len(out[-1][1]) > 1:
        b, lo, hi, ex, c = out[-1]
        cuts = np.arange(0, len(lo), FANOUT)
        first, last = np.minimum.reduceat(c, cuts), np.maximum.reduceat(c, cuts)
        out.append((np.bitwise_or.reduceat(b, cuts, axis=0), np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts), np.maximum.reduceat(ex, cuts), np.where(first == last, first, -1)))
    return out


def _possible(level, i, j, percent, exact=False):
    """Which node pairs may hold a link between different components; exact: which leaf pairs are one, with bits in common exact."""
    bits, low, high, excess, comp = level
    ok = np.ones(len(i), bool)
    ok &= ~((comp[i] == comp[j]) & (comp[i] >= 0))
    ok &= (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
    at = np.flatnonzero(ok)
    for c in chunks(len(at), bits.shape[1] * 8):
        part = at[c]
        a, b = i[part], j[part]
        most = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64) + np.minimum(excess[a], excess[b])
        ok[part] = (100 + percent) * most >= percent * (low[a] + low[b]) if exact else 100 * most >= percent * np.maximum(low[a], low[b])
    return ok


def _children(i, j, size):
    """All pairs of children of the node pairs, each unordered pair once."""
    step = np.arange(FANOUT)
    a = (i[:, None, None] * FANOUT + step[None, :, None] + np.zeros((1, 1, FANOUT), np.int64)).ravel()
    b = (j[:, None, None] * FANOUT + step[None, None, :] + np.zeros((1, FANOUT, 1), np.int64)).ravel()
    ok = (a < size) & (b < size) & (a <= b)
    return a[ok], b[ok]


def bitmap(x: np.ndarray, width: int) -> np.ndarray:
    """The token bitmap of a set of hashes, in words of 64 bits. Halves laid over each other give that of half the width."""
    out = np.zeros(width // 64, np.uint64)
    place = (x >> np.uint64(17)) & np.uint64(width - 1)
    np.bitwise_or.at(out, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out


def width_for(n: int) -> int:
    """Bits for a set of n tokens: a power of two from n, within bounds."""
    return min(max(64, 1 << (n - 1).bit_length()), 1 << 14)


def tree_pairs(bits: np.ndarray, sizes: np.ndarray, near: np.ndarray, comp: np.ndarray, percent: int, excess: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that the dual traversal of the tree over the bitmaps can't rule out. near: alike for alike sets. No pair of one
    component comes out, and every pair that links two does. excess: tokens of a set beyond its set bits; 0 makes the test exact."""
    order = np.lexsort((near, sizes))
    if len(order) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n, leaves = sizes[order], bits[order]
    over = n - np.bitwise_count(leaves).sum(axis=1, dtype=np.int64) if excess is None else excess[order]
    levels = _levels(leaves, n, n, over, comp[order])
    i = j = np.zeros(1, np.int64)
    ok = _possible(levels[-1], i, j, percent)
    i, j = i[ok], j[ok]
    for depth in range(len(levels) - 2, -1, -1):
        # children are tested as they are made: only those that may hold a link are kept
        found = []
        for k in range(0, len(i), CHUNK // FANOUT):
            a, b = _children(i[k : k + CHUNK // FANOUT], j[k : k + CHUNK // FANOUT], len(levels[depth][1]))
            if depth == 0:
                a, b = a[a < b], b[a < b]
            ok = _possible(levels[depth], a, b, percent, exact=depth == 0 and excess is not None)
            found.append((a[ok], b[ok]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (i, j)
    return order[i], order[j]


#: Bytes of the exact bitmaps of one block.
EXACT_BYTES = 1 << 25


def _exact_bitmaps(sets: list[np.ndarray]) -> np.ndarray | None:
    """Bitmaps over the tokens that at least two of the sets hold: bits in common are tokens in common. None if they are too large."""
    every = np.concatenate(sets)
    tokens, place, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count > 1
    width = -(-int(shared.sum()) // 64)
    if width * 8 * len(sets) > EXACT_BYTES:
        return None
    slot = np.where(shared, np.cumsum(shared) - 1, -1)[place]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[slot >= 0]
    slot = slot[slot >= 0]
    bits = np.zeros((len(sets), max(width, 1)), np.uint64)
    np.bitwise_or.at(bits, (row, slot >> 6), np.uint64(1) << (slot & 63).astype(np.uint64))
    return bits


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the labels of all pairs (i, j): each label becomes the smallest that it is joined with."""
    small = np.arange(label.max() + 1)
    a, b = label[i], label[j]
    while True:
        low = np.minimum(small[a], small[b])
        before = small.copy()
        np.minimum.at(small, small[a], low)
        np.minimum.at(small, small[b], low)
        np.minimum.at(small, a, low)
        np.minimum.at(small, b, low)
        small = small[small]
        if (small == before).all():
            return small[label]


def tree_labels(sets: list[np.ndarray], comp: np.ndarray, percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """Component labels of the sets (sorted distinct hashes) by the links with 100 * |A and B| >= percent * |A or B|, from the given ones
    (whole numbers from 0). With side, only links between different sides are sought."""
    have = np.flatnonzero([len(x) > 0 for x in sets])
    if len(have) < 2:
        return comp
    some = [sets[k] for k in have]
    sizes, near = np.array([len(x) for x in some], np.int64), np.array([x[0] for x in some])
    bits = _exact_bitmaps(some)
    if bits is not None:
        i, j = tree_pairs(bits, sizes, near, comp[have], percent, np.zeros(len(some), np.int64))
    else:
        width = width_for(4 * int(sizes.max()))
        i, j = tree_pairs(np.stack([bitmap(x, width) for x in some]), sizes, near, comp[have], percent)
    i, j = have[i], have[j]
    if side is not None:
        i, j = i[side[i] != side[j]], j[side[i] != side[j]]
    if bits is not None:
        return _merge(comp, i, j)
    label = comp.copy()
    while len(i):
        for a, b in zip(i[:512].tolist(), j[:512].tolist(), strict=True):
            if label[a] != label[b]:
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    label[label == label[b]] = label[a]
        rest = label[i[512:]] != label[j[512:]]
        i, j = i[512:][rest], j[512:][rest]
    return label
