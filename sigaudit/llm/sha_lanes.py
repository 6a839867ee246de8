"""SHA-256 over many lanes at once, with the state after every block at hand.

hashlib can copy a state but not store or send it; here a state is eight 32-bit words a lane, so a parent in a table can keep the states
before its child slots. A digest as hex text is exactly one block of the hash.
"""

from __future__ import annotations

import numpy as np


def _primes(n: int) -> list[int]:
    found: list[int] = []
    x = 2
    while len(found) < n:
        if all(x % p for p in found):
            found.append(x)
        x += 1
    return found


def _root_bits(p: int, k: int) -> int:
    """The first 32 bits of the fraction of the k-th root of p."""
    low, high = 0, p << 32
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if mid**k <= p << (32 * k) else (low, mid)
    return low & 0xFFFFFFFF


#: The state before any block, and the constants of the rounds, by the standard's rule.
START = np.array([_root_bits(p, 2) for p in _primes(8)], np.uint32)
ROUND = [np.uint32(_root_bits(p, 3)) for p in _primes(64)]
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def start(lanes: int) -> np.ndarray:
    """The state of so many lanes before any block, as (8, lanes)."""
    return np.repeat(START[:, None], lanes, axis=1)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (8, lanes) after one more block (16, lanes) of 32-bit words each."""
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        if t >= 16:
            x, y = w[t - 15], w[t - 2]
            w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
        t1 = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[t] + w[t]
        t2 = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = t1 + t2, a, b, c, d + t1, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digests (8, lanes) of lanes that have absorbed so many whole blocks."""
    last = np.zeros((16, state.shape[1]), np.uint32)
    last[0] = 0x80000000
    bits = np.asarray(blocks).astype(np.uint64) * np.uint64(512)
    last[14], last[15] = (bits >> np.uint64(32)).astype(np.uint32), bits.astype(np.uint32)
    return absorb(state, last)


def as_block(digest: np.ndarray) -> np.ndarray:
    """Digests (8, lanes) as hex text: one block (16, lanes) each."""
    raw = np.ascontiguousarray(digest.T.astype(">u4")).view(np.uint8)
    text = np.empty((len(raw), 64), np.uint8)
    text[:, 0::2], text[:, 1::2] = _HEX[raw >> 4], _HEX[raw & 15]
    return np.ascontiguousarray(text.view(">u4").astype(np.uint32).T)


def to_bytes(digest: np.ndarray) -> bytes:
    """Lanes one after another, 32 bytes each, as the standard writes them."""
    return np.ascontiguousarray(digest.T.astype(">u4")).tobytes()


def from_bytes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, ">u4").reshape(-1, 8).T.astype(np.uint32))


def hex_of(digest: np.ndarray) -> list[str]:
    raw = to_bytes(digest).hex()
    return [raw[i : i + 64] for i in range(0, len(raw), 64)]
