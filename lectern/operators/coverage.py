"""Q14: which words of a text were judged, and which were flagged."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.matching import WORD
from lectern.operators.integrity import numbered_words, union_length


def token_spans(text: str, tokenizer: str | None):
    """Offsets of a text's tokens: of a tokenizer file (`tokenizers` library), else of words and single marks."""
    import re

    if tokenizer is None:
        return [m.span() for m in re.finditer(r"\w+|[^\w\s]", text)]
    from tokenizers import Tokenizer

    return [s for s in Tokenizer.from_file(tokenizer).encode(text, add_special_tokens=False).offsets if s[1] > s[0]]


def split_windows(text: str, spans: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, str]]:
    """(start, end, tokens, reason) of windows of at most `capacity` tokens that end between words.

    A word that alone has more tokens is a window of its own with a reason, and is not judged.
    """
    words = [m.span() for m in WORD.finditer(text)]
    out, i, w = [], 0, 0
    while i < len(spans):
        stop = min(i + capacity, len(spans))
        if stop < len(spans):
            end = spans[stop - 1][1]
            while w < len(words) and words[w][1] <= end:
                w += 1
            if w < len(words) and words[w][0] < end:  # inside a word: back to its start
                back = stop
                while back > i and spans[back - 1][1] > words[w][0]:
                    back -= 1
                if back == i:
                    a, b = spans[i][0], words[w][1]
                    while i < len(spans) and spans[i][0] < b:
                        i += 1
                    out.append((a, b, 0, "word exceeds the window"))
                    continue
                stop = back
        out.append((spans[i][0], spans[stop - 1][1], stop - i, ""))
        i = stop
    return out


def windows(texts: DataFrame, id_col: str, text_col: str, capacity: int = 510, most: int | None = 200, tokenizer: str | None = None) -> DataFrame:
    """(id, window, start, end, tokens, skipped): the windows of each text; beyond `most` they are skipped too."""

    @F.pandas_udf("array<struct<start: int, `end`: int, tokens: int, skipped: string>>")
    def cut(column: pd.Series) -> pd.Series:
        return column.map(lambda t: split_windows(t, token_spans(t, tokenizer), capacity))

    rows = texts.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col).dropDuplicates([id_col])
    out = rows.select(id_col, F.posexplode(cut(F.col(text_col))).alias("window", "w")).select(id_col, "window", "w.*")
    return out.withColumn("skipped", F.when(F.col("skipped") != "", F.col("skipped")).when(F.lit(False) if most is None else F.col("window") >= most, "beyond the passage limit"))


def word_coverage(texts: DataFrame, spans: DataFrame, id_col: str, text_col: str, flagged: Column) -> DataFrame:
    """Words lying whole inside spans (id, start, end): judged, flagged, and the flagged share of the
    judged in percent (null if none was judged: not computed is not zero).

    Words and spans of one text meet on its id; overlapping spans count a word once.
    """
    words = numbered_words(texts, id_col, text_col).select(id_col, "position", "start", "end")
    inside = spans.select(id_col, F.col("start").alias("_a"), F.col("end").alias("_b"), flagged.alias("_flag"))
    met = words.join(inside, id_col).where((F.col("_a") <= F.col("start")) & (F.col("end") <= F.col("_b"))).groupBy(id_col, "position").agg(F.bool_or("_flag").alias("flagged"))
    judged = met.groupBy(id_col).agg(F.count(F.lit(1)).alias("judged"), F.count_if("flagged").alias("flagged"))
    totals = words.groupBy(id_col).agg(F.count(F.lit(1)).alias("words"))
    rows = totals.join(judged, id_col, "left").fillna({"judged": 0, "flagged": 0})
    return rows.select(id_col, "words", "judged", "flagged", F.try_divide(100.0 * F.col("flagged"), F.nullif(F.col("judged"), F.lit(0))).alias("flagged_percentage"))


def aligned(texts: DataFrame, passages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Passages (id, passage, flag) with the place where they stand, if they stand there exactly once."""
    rows = passages.join(texts.select(id_col, text_col).dropDuplicates([id_col]), id_col)
    first = F.expr(f"locate(passage, `{text_col}`)")
    again = F.expr(f"locate(passage, `{text_col}`, locate(passage, `{text_col}`) + 1)")
    fine = (F.length("passage") > 0) & (first > 0) & (again == 0)
    start = F.when(fine, first - 1)
    return rows.select(id_col, "passage", "flag", start.cast("int").alias("start"), (start + F.length("passage")).cast("int").alias("end"))


def provider_percentage(coverage: DataFrame, unaligned: DataFrame, id_col: str) -> DataFrame:
    """The flagged share only where every word was judged and every passage found its place."""
    rows = coverage.join(unaligned, id_col, "left").fillna({"unaligned": 0})
    complete = (F.col("words") > 0) & (F.col("judged") == F.col("words")) & (F.col("unaligned") == 0)
    return rows.withColumn("percentage", F.when(complete, 100.0 * F.col("flagged") / F.col("words")))


def span_words(spans: DataFrame, by: str) -> DataFrame:
    """Characters in the union of spans."""
    return union_length(spans, [by], "start", "end")
