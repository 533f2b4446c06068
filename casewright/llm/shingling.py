"""Hashes of words and of word windows, over many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20   # text hashed at a time; a worker needs about forty times as much
KEPT_POWERS = 3 << 19   # numbers a worker keeps, twice; longer texts compute theirs anew
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS: list[np.ndarray] = []

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64; those for ordinary slices are kept."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    size = max(n, min(KEPT_POWERS, n + (1 << 18)))
    steps = np.ones(size, np.uint64)
    steps[1:] = np.uint64(_BASE)
    back = np.ones(size, np.uint64)
    back[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
    made = [np.multiply.accumulate(steps), np.multiply.accumulate(back)]
    if size <= KEPT_POWERS:
        _POWERS[:] = made
    return made[0][:n], made[1][:n]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all white-space separated words, and the bounds of each text's among them."""
    encoded = [t.encode() if t else b"" for t in texts.to_pylist()]
    sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
    data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(encoded) + 1, np.int64)
    space = _IS_SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=1)
    starts, ends = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    forward, back = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[: len(data)], out=prefix[1:])
    hashes = mix((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    forward, back = _powers(len(hashes) + 1)
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * forward[: len(hashes)], out=prefix[1:])
    return mix((prefix[size:] - prefix[:n]) * back[:n])


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct window hashes of each text; a shorter text is one window, an empty one none."""
    every = windows(hashes, size)
    found = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            found.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            found.append(windows(hashes[a:b], b - a))
        else:
            found.append(np.zeros(0, np.uint64))
    return found
