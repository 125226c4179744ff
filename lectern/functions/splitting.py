"""Cut texts recursively at paragraphs, lines and spaces into overlapping chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", " ", "")


def packed(pieces: list[str], limit: int, overlap: int) -> list[str]:
    """Consecutive pieces joined up to `limit`; each chunk starts with the last pieces of the one before that fit
    into `overlap` and leave room for the next piece. Chunks are stripped, empty ones dropped."""
    out: list[str] = []
    first = size = 0
    for k, piece in enumerate(pieces):
        if k > first and size + len(piece) > limit:
            out.append("".join(pieces[first:k]))
            while size > overlap or (size and size + len(piece) > limit):
                size -= len(pieces[first])
                first += 1
        size += len(piece)
    if first < len(pieces):
        out.append("".join(pieces[first:]))
    return [x for x in map(str.strip, out) if x]


def recursive_chunks(text: str, limit: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most `limit` characters. The first separator present cuts the text (and stays at the start of
    the piece after it); pieces that are still too long are cut by the separators after it."""
    level = next((k for k, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark = separators[level]
    if mark:
        head, *rest = text.split(mark)
        pieces = [x for x in (head, *(mark + r for r in rest)) if x]
    else:
        pieces = list(text)
    out: list[str] = []
    held: list[str] = []
    for piece in pieces:
        if len(piece) < limit:
            held.append(piece)
            continue
        if held:
            out += packed(held, limit, overlap)
            held = []
        deeper = separators[level + 1 :]
        out += recursive_chunks(piece, limit, overlap, deeper) if deeper else [piece]
    return out + packed(held, limit, overlap) if held else out


def chunked(text: Column, limit: int = 1000, overlap: int = 200) -> Column:
    """The chunks of a text column as an array; a null text has none."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: recursive_chunks(t, limit, overlap) if t else [])

    return cut(text)
