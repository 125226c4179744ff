"""Problem 5: cut oversized texts at natural boundaries, with a fixed overlap between neighbours.

Every position of a text gets the strength of the boundary there (paragraph, line, sentence, clause, space,
none). A sparse table over (strength, position) answers "strongest cut in this range, the rightmost of equals"
in two look-ups, so a text is cut in one pass whatever its length. Strengths and table are made over stretches of
the text, each longer than a piece, so a text of any size needs no more than one stretch of them at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.hashing import code_points

PARAGRAPH, LINE, SENTENCE, CLAUSE, SPACE, NONE = 5, 4, 3, 2, 1, 0
STRETCH = 1 << 16


def boundary_strengths(codes: np.ndarray) -> np.ndarray:
    """strength[c]: of a cut between characters c - 1 and c, for c in 0..n."""
    n = len(codes)
    out = np.zeros(n + 1, np.int64)
    if not n:
        return out
    newline = codes == 10
    blank = newline | (codes == 32) | (codes == 9) | (codes == 13) | (codes == 160)
    out[1:][blank] = SPACE
    for marks, strength in (((44, 58, 59), CLAUSE), ((46, 33, 63), SENTENCE)):
        ends = np.isin(codes[:-1], marks) & blank[1:]
        out[2:][ends] = strength
    out[1:][newline] = LINE
    # a newline after a newline, with nothing but blanks between
    solid = np.where(blank & ~newline, -1, np.arange(n))
    last = np.maximum.accumulate(solid)
    before = np.concatenate(([-1], last[:-1]))
    empty = newline & (before >= 0)
    empty[empty] = newline[before[empty]]
    out[1:][empty] = PARAGRAPH
    return out


def strengths_between(text: str, a: int, b: int) -> np.ndarray:
    """`boundary_strengths(text)[a:b]`, reading from the last character before that is no blank."""
    s = a
    while s > 0 and text[s - 1] in " \t\r\n\u00a0":
        s -= 1
    s = max(0, min(s - 1, a - 2))
    return boundary_strengths(code_points(text[s:b]))[a - s : b - s]


class StrongestCut:
    """Sparse table of range maxima over strength * 2**40 + position."""

    def __init__(self, strengths: np.ndarray, offset: int, widest: int):
        rows = [(strengths.astype(np.int64) << 40) + np.arange(offset, offset + len(strengths))]
        size = 1
        while size * 2 <= min(widest, len(strengths)):
            low = rows[-1]
            rows.append(np.maximum(low[:-size], low[size:]))
            size *= 2
        self.rows, self.offset, self.end = rows, offset, offset + len(strengths)

    def __call__(self, a: int, b: int) -> int:
        """Position of the strongest cut in a..b (both included)."""
        k = (b - a + 1).bit_length() - 1
        row = self.rows[k]
        return int(max(row[a - self.offset], row[b - self.offset - (1 << k) + 1])) & ((1 << 40) - 1)


def cut_points(text: str, limit: int = 1000, overlap: int = 200) -> list[tuple[int, int]]:
    """(start, end) of the pieces: each at most `limit` long, each starting `overlap` before the end of the last.

    A cut is looked for in the second half of the piece (beyond the overlap in any case), so pieces never
    become crumbs. A text within the limit is one piece; an empty text is none.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    out, start, find = [], 0, None
    while n - start > limit:
        a, b = start + max(overlap + 1, limit // 2), start + limit
        if find is None or b >= find.end:
            end = min(n + 1, a + max(STRETCH, 2 * limit))
            find = StrongestCut(strengths_between(text, a, end), a, limit)
        end = find(a, b)
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


def _cut(keys: int, limit: int, overlap: int, with_text: bool):
    def work(batches):
        for batch in batches:
            take, numbers, starts, ends, pieces = [], [], [], [], []
            for row, text in enumerate(batch.column(keys).to_pylist()):
                for number, (a, b) in enumerate(cut_points(text, limit, overlap), 1):
                    take.append(row)
                    numbers.append(number)
                    starts.append(a)
                    ends.append(b)
                    if with_text:
                        pieces.append(text[a:b])
            rows = pa.array(take, pa.int64())
            columns = [batch.column(k).take(rows) for k in range(keys)] + [pa.array(x, pa.int32()) for x in (numbers, starts, ends)]
            names = [*batch.schema.names[:keys], "piece_no", "piece_start", "piece_end"]
            if with_text:
                columns.append(pa.array(pieces, pa.string()))
                names.append("piece")
            yield pa.RecordBatch.from_arrays(columns, names)

    return work


def cut_items(df: DataFrame, keys: list[str], text_col: str, limit: int = 1000, overlap: int = 200, with_text: bool = True, only_oversized: bool = False) -> DataFrame:
    """Keys, piece_no (from 1), piece_start, piece_end (code points, half-open) and piece.

    Null and empty texts have no pieces, a text within the limit one (none with `only_oversized`). Neighbours
    overlap by exactly `overlap` characters, and the pieces put together without it are the text. Rows are cut
    as they come, without a shuffle: drop repeated rows before, or compare keys after. Further columns are not
    read. Key columns may not be called like the columns this adds.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be below half the limit")
    taken = {"piece_no", "piece_start", "piece_end", "piece"} & set(keys)
    if taken:
        raise ValueError(f"rename key columns {sorted(taken)}")
    texts = df.select(*keys, F.col(text_col).alias("_text")).where(F.length("_text") > (limit if only_oversized else 0))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1]) + ", piece_no int, piece_start int, piece_end int" + ", piece string" * with_text
    return texts.mapInArrow(_cut(len(keys), limit, overlap, with_text), shape)
