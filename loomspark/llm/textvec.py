"""Words of whole texts as numpy arrays: places, 64-bit hashes, shingles.

Works on UTF-8 bytes. Only the six ASCII white-space bytes separate words. Hashes are the
same in every process and on every machine.
"""

from __future__ import annotations

import numpy as np

#: Bytes of one pass; longer texts are cut at white space and their arrays joined.
PIECE = 1 << 21
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def _piece(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    return start, end, mix64(h ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word of a byte string."""
    if len(data) <= PIECE:
        return _piece(data)
    parts, at = [], 0
    while at < len(data):
        stop = min(len(data), at + PIECE)
        while stop < len(data) and data[stop] not in b" \t\n\x0b\x0c\r":
            stop += 1
        s, e, h = _piece(data[at:stop])
        parts.append((s + at, e + at, h))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def batches(texts: list[bytes], limit: int = PIECE):
    """Index ranges of texts whose bytes together stay near limit."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (order counts); empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    c = 1
    for j in range(k):
        c = c * 0xA24BAED4963EE407 % (1 << 64) | 1
        out += h[j : j + n] * np.uint64(c)
    return mix64(out)


def shingle_set(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingles; a shorter sequence is one shingle, none gives none."""
    if not len(h):
        return np.zeros(0, np.uint64)
    return np.unique(grams(h, min(k, len(h)))) if len(h) >= k else grams(h, len(h)) ^ np.uint64(len(h))
