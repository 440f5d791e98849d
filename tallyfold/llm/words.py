"""Words of many texts as numpy arrays: their bounds, 64-bit hashes, and hashes of windows of words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_32, _29 = np.uint64(32), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over a 64-bit number."""
    x = x ^ (x >> _32)
    x *= _B
    x ^= x >> _29
    x *= _B
    x ^= x >> _32
    return x


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One hash of an ordered pair of hashes."""
    x = left * _A
    x += right
    return mix(x)


@dataclass
class Words:
    """Hashes of all words of some texts; text i has those from ``first[i]`` to ``first[i + 1]``."""

    hashes: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def read(texts: list[bytes], seed: int = 0) -> Words:
    joined = np.frombuffer(b" ".join(texts) + b" " * 9, np.uint8)
    space = _SPACE[joined]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if space.size and not space[0] and (not starts.size or starts[0] != 0):
        starts = np.insert(starts, 0, 0)
    length = ends - starts
    eights = np.ndarray((joined.size - 7,), "<u8", joined, strides=(1,))
    hashes = mix(length.astype(np.uint64) * _A + np.uint64(seed))
    left, step = np.arange(starts.size), 0
    while left.size:
        rest = length[left] - 8 * step
        chunk = eights[starts[left] + 8 * step]
        chunk &= np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(rest, 8)) * 8).astype(np.uint64)
        hashes[left] = pair(hashes[left], chunk)
        left, step = left[rest > 8], step + 1
    at = np.cumsum([0, *(len(x) + 1 for x in texts)])
    return Words(hashes, np.searchsorted(starts, at))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words from each word on, put together from windows of doubled lengths."""
    if hashes.size < size:
        return hashes[:0]
    n, found, at, power, width = hashes.size - size + 1, None, 0, hashes, 1
    while True:
        if size & width:
            part = power[at : at + n]
            found = part if found is None else pair(found, part)
            at += width
        if at == size:
            return found
        power = pair(power[:-width], power[width:])
        width *= 2


def owners(first: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(first.size - 1), np.diff(first))


def least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of the ``size`` values from each place on."""
    if values.size < size:
        return values[:0]
    n, width, low = values.size - size + 1, 1, values
    while 2 * width <= size:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[:n], low[size - width : size - width + n])
