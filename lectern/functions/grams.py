"""Hashes of consecutive words, vectorised."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.matching import plain_words


def rolled(ids: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of `width` ids: a polynomial over mixed ids, mixed again."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out.view(np.int64)


class Ids:
    """64-bit ids of words, remembered within a batch of texts."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, row: list[str]) -> np.ndarray:
        from hashlib import blake2b

        known = self.known
        for w in row:
            if w not in known:
                known[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return np.array([known[w] for w in row], np.uint64)


def word_hashes(text: Column, width: int, most: int | None = None) -> Column:
    """Hashes of every `width` words (T3) of the first `most` words of a text, in order."""

    @F.pandas_udf("array<bigint>")
    def hashed(texts: pd.Series) -> pd.Series:
        ids = Ids()
        return texts.map(lambda t: rolled(ids(list(plain_words(t))[:most]), width) if t else [])

    return hashed(text)


def array_hashes(row: Column, width: int) -> Column:
    """Distinct hashes of every `width` elements of an array of words."""

    @F.pandas_udf("array<bigint>")
    def hashed(rows: pd.Series) -> pd.Series:
        ids = Ids()
        return rows.map(lambda r: np.unique(rolled(ids(list(r)), width)) if r is not None else [])

    return hashed(row)
