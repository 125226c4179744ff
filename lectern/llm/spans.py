"""Problem 1: long stretches of text that stand verbatim in more than one record.

Super-k-mer partitioning. A window is `length` consecutive characters; its minimiser is the smallest hash of
the `seed`-character strings inside it. Equal windows have equal minimisers, and consecutive windows mostly
share theirs, so a run of windows with one minimiser travels as a single packed string to that minimiser's
bucket: about five characters shuffled per character of text where one row per window would need two hundred.

The runs are made once and stored. From their narrow columns follows which buckets more than one record has and
how many windows of different strings they hold; the others are dropped. In a bucket equal packed strings are
first counted once (a partial aggregate, so a text copied a million times leaves one row per map task), and the
windows are sorted and compared as strings. A bucket with more than `bucket_windows` windows is not given to one
task: its strings are cut again by the minimisers of another hash, and so on; what `LEVELS` rounds leave too
large (windows that repeat one seed) is counted by an aggregate over the windows themselves. Windows are compared
as strings on every way; a packed string that goes back to its records is named by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.hashing import code_points, mix, rolling, sliding_min
from lectern.session import cut, spread, stored

RUNS = "k1 bigint, k2 bigint, low bigint, high bigint, bucket bigint, at int, packed string"
LEVELS = 3
LONGEST_RUN = 4096  # windows in one packed string; a longer run (a text repeating itself) is several


def window_runs(text: str, length: int, seed: int, level: int = 0) -> Iterator[tuple[int, int, int]]:
    """(minimiser, first window, one past the last window) for each run of windows with one minimiser."""
    hashes = rolling(code_points(text), seed)
    low = sliding_min(mix(hashes ^ np.uint64(level)) if level else hashes, length - seed + 1)
    if not len(low):
        return
    cuts = np.flatnonzero(low[1:] != low[:-1]) + 1
    starts = np.concatenate(([0], cuts))
    ends = np.concatenate((cuts, [len(low)]))
    for bucket, a, b in zip(low[starts].view(np.int64).tolist(), starts.tolist(), ends.tolist(), strict=True):
        for c in range(a, b, LONGEST_RUN):
            yield bucket, c, min(b, c + LONGEST_RUN)


def _runs(length: int, seed: int, level: int):
    def packed(batch, rows, out):
        keys = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(4)]
        return pa.RecordBatch.from_arrays([*keys, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], ["k1", "k2", "low", "high", "bucket", "at", "packed"])

    def work(batches):
        for batch in batches:
            rows, out, size = [], ([], [], []), 0
            for row, text in enumerate(batch.column(4).to_pylist()):
                for bucket, a, b in window_runs(text, length, seed, level):
                    rows.append(row)
                    for column, value in zip(out, (bucket, a, text[a : b + length - 1]), strict=True):
                        column.append(value)
                    size += b - a + length
                    if size > 4_000_000:
                        yield packed(batch, rows, out)
                        rows, out, size = [], ([], [], []), 0
            if rows:
                yield packed(batch, rows, out)

    return work


def shared_in_bucket(rows: list[tuple[str, int, int]], length: int) -> list[tuple[str, int, int]]:
    """(packed, first, one past the last) runs of windows that belong to two records.

    `rows` are the different packed strings of one bucket with the smallest and largest record holding each.
    Windows are counted by sorting them: equal neighbours in the order are the same string.
    """
    where = [(packed[i : i + length], low, high, n, i) for n, (packed, low, high) in enumerate(rows) for i in range(len(packed) - length + 1)]
    where.sort(key=lambda x: x[0])
    shared: list[list[int]] = [[] for _ in rows]
    a = 0
    while a < len(where):
        b = a + 1
        window, low, high = where[a][0], where[a][1], where[a][2]
        while b < len(where) and where[b][0] == window:
            low, high = min(low, where[b][1]), max(high, where[b][2])
            b += 1
        if low != high:
            for x in where[a:b]:
                shared[x[3]].append(x[4])
        a = b
    out = []
    for (packed, _, _), hits in zip(rows, shared, strict=True):
        hits.sort()
        first = None
        for k, i in enumerate(hits):
            if first is None:
                first = i
            if k + 1 == len(hits) or hits[k + 1] != i + 1:
                out.append((packed, first, i + 1))
                first = None
    return out


MARKS = "h1 bigint, h2 bigint, a int, b int"


def _count_windows(length: int):
    """Buckets arrive one after another (the partition is sorted by bucket); one bucket is held at a time."""

    def flush(names, rows, out):
        of = dict(zip((r[0] for r in rows), names, strict=True))
        for packed, a, b in shared_in_bucket(rows, length):
            out.append((*of[packed], a, b))

    def work(batches):
        held, names, rows, out = None, [], [], []
        for batch in batches:
            for bucket, packed, h1, h2, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != held and rows:
                    flush(names, rows, out)
                    names, rows = [], []
                held = bucket
                names.append((h1, h2))
                rows.append((packed, low, high))
            if len(out) > 20_000:
                yield _table(out)
                out = []
        if rows:
            flush(names, rows, out)
        if out:
            yield _table(out)

    def _table(out):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["h1", "h2", "a", "b"])

    return work


def _shared(texts: DataFrame, length: int, seed: int, bucket_windows: int, level: int = 0) -> DataFrame:
    """(k1, k2, a, b): runs of windows a..b of `texts` (k1, k2, low, high, text) that two records hold.

    `low` and `high` are the smallest and largest record holding a text. Every join names its strategy: the planner
    knows of what Python returns, and of what is stored, no true size.
    """
    names = [F.xxhash64("packed").alias("h1"), F.xxhash64(F.lit(1), F.col("packed")).alias("h2")]
    runs = stored(texts.select("k1", "k2", "low", "high", "text").mapInArrow(_runs(length, seed, level), RUNS).select("*", *names, (F.length("packed") - length + 1).alias("windows")))
    different = runs.groupBy("bucket", "h1", "h2").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("windows").alias("windows"))
    live = cut(different.groupBy("bucket").agg(F.sum("windows").alias("windows"), F.min("low").alias("lo"), F.max("high").alias("hi")).where("lo < hi").select("bucket", "windows"))
    strings = runs.groupBy("bucket", "packed", "h1", "h2").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    large = not live.where(F.col("windows") > bucket_windows).isEmpty()
    strings = strings.join(live.hint("merge"), "bucket")
    if large:
        strings = stored(strings)
    columns = ("bucket", "packed", "h1", "h2", "low", "high")
    small = strings.where(F.col("windows") <= bucket_windows).select(*columns)
    marks = small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count_windows(length), MARKS)
    if large and level < LEVELS:
        again = strings.where(F.col("windows") > bucket_windows).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "low", "high", F.col("packed").alias("text"))
        marks = marks.unionByName(_shared(again, length, seed, bucket_windows, level + 1).withColumnsRenamed({"k1": "h1", "k2": "h2"}))
    elif large:
        windows = strings.where(F.col("windows") > bucket_windows).select("h1", "h2", "low", "high", "packed", F.explode(F.sequence(F.lit(0), F.length("packed") - length)).alias("a"))
        windows = windows.select("h1", "h2", "low", "high", "a", F.substring("packed", F.col("a") + 1, F.lit(length)).alias("window"))
        both = windows.groupBy("window").agg(F.min("low").alias("lo"), F.max("high").alias("hi")).where("lo < hi").select("window")
        marks = marks.unionByName(windows.join(both.hint("merge"), "window").select("h1", "h2", "a", (F.col("a") + 1).alias("b")))
    # A string in many records meets its own short list of marks, which adaptive skew joins split.
    return runs.select("k1", "k2", "h1", "h2", "at").join(marks.hint("merge"), ["h1", "h2"]).select("k1", "k2", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b"))


def shared_spans(df: DataFrame, id_col: str, text_col: str, length: int = 200, seed: int = 64, bucket_windows: int = 200_000) -> DataFrame:
    """(record, span_start, span_end): maximal stretches made of strings of `length` characters found in another record.

    Offsets are code points, half-open. Null ids and null, empty or short texts give no rows; a record sent
    twice is still one record (spans are counted over distinct ids); an empty table gives an empty result.
    Other columns are never read. `seed` must be below `length`.
    """
    if not 0 < seed < length:
        raise ValueError("seed must lie between 1 and length - 1")
    record = F.col(id_col).cast("bigint")
    texts = spread(df).select(record.alias("k1"), F.lit(0).cast("bigint").alias("k2"), record.alias("low"), record.alias("high"), F.col(text_col).alias("text")).where(F.col("k1").isNotNull() & (F.length("text") >= length))
    spans = _shared(texts, length, seed, bucket_windows).select(F.col("k1").alias("record"), F.col("a").alias("s"), (F.col("b") + length - 1).alias("e"))
    return merge_intervals(spans.distinct(), "record", "s", "e").select(F.col("record").alias(id_col), F.col("s").alias("span_start").cast("int"), F.col("e").alias("span_end").cast("int"))


def merge_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Union of half-open intervals per key; overlapping or touching ones become one."""
    order = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened: Column = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    marked = df.select(key, start, end, opened.alias("_new"))
    island = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def share_report(df: DataFrame, id_col: str, text_col: str, spans: DataFrame) -> DataFrame:
    """For each record the characters of its text, those shared elsewhere and their share (0.0 for empty texts)."""
    size = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.coalesce(F.length(text_col), F.lit(0))).alias("chars"))
    shared = spans.groupBy(id_col).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count(F.lit(1)).alias("stretches"))
    part = F.coalesce(F.col("shared_chars"), F.lit(0))
    return size.join(shared.hint("merge"), id_col, "left").select(id_col, "chars", part.cast("bigint").alias("shared_chars"), F.coalesce("stretches", F.lit(0)).alias("stretches"), F.when(F.col("chars") > 0, part / F.col("chars")).otherwise(F.lit(0.0)).alias("share"))


def page_report(df: DataFrame, id_col: str, spans_col: str, spans: DataFrame) -> DataFrame:
    """Shared characters of each page, through the page offsets of the record (range join inside one record)."""
    pages = df.where(F.col(id_col).isNotNull()).select(id_col, F.explode(spans_col).alias("p")).select(id_col, F.col("p.span_start").alias("page_start"), F.col("p.span_end").alias("page_end"), F.col("p.page_number").alias("page_number")).distinct()
    meets = (F.col("page_start") < F.col("span_end")) & (F.col("page_end") > F.col("span_start"))
    shared = F.greatest(F.lit(0), F.least("page_end", "span_end") - F.greatest("page_start", "span_start"))
    joined = pages.join(spans.withColumnRenamed(id_col, "_record").hint("merge"), (F.col(id_col) == F.col("_record")) & meets, "left")
    return joined.groupBy(id_col, "page_number", "page_start", "page_end").agg(F.sum(F.when(F.col("span_start").isNotNull(), shared).otherwise(0)).alias("shared_chars"))
