"""Word hashes, shingle hashes and MinHash signatures of many texts at once, with numpy inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of ``base`` and of its inverse, as many as the longest batch so far needs."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up, self.down = np.ones(1, U), np.ones(1, U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            for name, factor in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, factor, U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings or binaries, and where each text begins and the last one ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and the number of words before each text and in all."""
    data, offsets = buffers(texts)
    solid = ~IS_SPACE[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cuts], ends[cuts - 1] = solid[cuts], solid[cuts - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    up, down = powers.of(len(data) + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[: len(data)])])
    hashes = mix((sums[last + 1] - sums[first]) * down[first] + (last - first).astype(U))
    return hashes, np.searchsorted(first, offsets)


def shingle_hashes(texts: pa.Array, n: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` words, repeats included, and their places by text.

    A text of fewer words has one shingle of all of them, a text without words none.
    """
    words, at = word_hashes(texts, powers)
    count = np.diff(at)
    weights = mix(np.arange(1, n + 1, dtype=U) * U(BASE)) | U(1)
    rolled = np.zeros(max(0, len(words) - n + 1), U)
    for k in range(n):
        rolled += words[k : k + len(rolled)] * weights[k]
    here = np.maximum(count - n + 1, np.minimum(count, 1))
    places = np.concatenate([[0], np.cumsum(here)])
    start = np.repeat(at[:-1] - places[:-1], here) + np.arange(places[-1])
    out = np.zeros(places[-1], U)
    full = np.repeat(count >= n, here)
    out[full] = rolled[start[full]]
    for i in np.flatnonzero((count > 0) & (count < n)).tolist():
        own = words[at[i] : at[i + 1]]
        out[places[i]] = (own * weights[: len(own)]).sum(dtype=U) + U(len(own))
    return mix(out), places


def permutations(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, k, dtype=np.uint32)


def signatures(hashes: np.ndarray, places: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """MinHash values of each text; texts without shingles have a row of the largest number."""
    found = np.full((len(places) - 1, len(factors)), 2**32 - 1, np.uint32)
    some = np.diff(places) > 0
    if some.any():
        high, starts = (hashes >> U(32)).astype(np.uint32), places[:-1][some]
        for k, (a, b) in enumerate(zip(factors, shifts, strict=True)):
            found[some, k] = np.minimum.reduceat(high * a + b, starts)
    return found
