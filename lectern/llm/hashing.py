"""Vectorised 64-bit hashing shared by the text operators."""

from __future__ import annotations

import re

import numpy as np

U = np.uint64
WORD = re.compile(r"[a-z0-9]+")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise: a bijection that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def rolling(symbols: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all windows of `width` symbols, by doubling block lengths."""
    n = len(symbols)
    if n < width:
        return np.empty(0, U)
    base, block = 0x9E3779B97F4A7C15 | 1, mix(symbols.astype(U) + U(0x51ED27))
    out, out_len, size = None, 0, 1
    left = width
    while True:
        if left & 1:
            if out is None:
                out, out_len = block, size
            else:  # append the block after what is there
                m = min(len(out), len(block) - out_len)
                out = out[:m] * U(pow(base, size, 1 << 64)) + block[out_len : out_len + m]
                out_len += size
        left >>= 1
        if not left:
            return mix(out[: n - width + 1])
        m = len(block) - size
        block = block[:m] * U(pow(base, size, 1 << 64)) + block[size : size + m]
        size *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of `width` values, in log2(width) passes."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    size, low = 1, values
    while size * 2 <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    return np.minimum(low[:n], low[width - size : width - size + n])


class WordIds:
    """64-bit ids of words, remembered per task and forgotten when there are too many of them."""

    def __init__(self, most: int = 500_000):
        self.most, self.known = most, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        import xxhash

        known, hash64 = self.known, xxhash.xxh64_intdigest
        if len(known) > self.most:
            known.clear()
        get = known.get
        out = [get(w) for w in words]
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    w = words[i]
                    out[i] = known[w] = hash64(w)
        return np.array(out, dtype=U)


def shingles(ids: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of `width` consecutive word ids, ascending."""
    return np.unique(rolling(ids, width))
