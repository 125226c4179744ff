import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import hashing, spans, terms


def test_rolling_hashes_and_minima_match_their_definitions():
    rng = np.random.RandomState(1)
    symbols = rng.randint(0, 3, 200)
    for width in (1, 2, 5, 8, 13, 64):
        seen = {}
        got = hashing.rolling(symbols, width)
        assert len(got) == 200 - width + 1
        for i, h in enumerate(got.tolist()):
            assert seen.setdefault(tuple(symbols[i : i + width]), h) == h
        assert len(set(got.tolist())) == len(seen)
    values = rng.randint(0, 1000, 120)
    for width in (1, 2, 7, 64):
        assert hashing.sliding_min(values, width).tolist() == [values[i : i + width].min() for i in range(121 - width)]
    assert len(hashing.rolling(symbols[:3], 5)) == 0 and len(hashing.sliding_min(values[:3], 5)) == 0


def brute_spans(texts, length):
    where = {}
    for record, text in texts:
        for i in range(len(text or "") - length + 1):
            where.setdefault(text[i : i + length], set()).add(record)
    out = set()
    for record, text in {(r, t) for r, t in texts if r is not None and t}:
        marks = [any(len(where[text[j : j + length]] - {None}) > 1 for j in range(max(0, i - length + 1), min(i, len(text) - length) + 1)) for i in range(len(text))]
        i = 0
        while i < len(text):
            if marks[i]:
                j = i
                while j < len(text) and marks[j]:
                    j += 1
                out.add((record, i, j))
                i = j
            else:
                i += 1
    return out


@pytest.mark.parametrize("bucket_windows", [200_000, 40, 1])
def test_shared_spans_equal_brute_force(spark, rows, bucket_windows):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdé😀 ") for _ in range(60))
    texts = [(1, "x" * 5 + passage + "y" * 9), (2, passage[10:50] + "zz" + passage[:30]), (3, passage[:19]), (4, "x" * 40), (5, "x" * 45), (6, None), (7, ""), (1, "x" * 5 + passage + "y" * 9), (8, passage * 3), (None, passage)]
    df = spark.createDataFrame(texts, "id bigint, text string").withColumn("bucket", F.lit(1)).withColumn("packed", F.lit("clash"))
    got = rows(spans.shared_spans(df, "id", "text", length=20, seed=8, bucket_windows=bucket_windows))
    assert got == brute_spans([t for t in texts if t[0] is not None], 20)
    assert rows(spans.shared_spans(df.limit(0), "id", "text", length=20, seed=8)) == set()


def test_long_runs_of_one_minimiser_are_several_strings(spark, rows):
    line = "the same line over and over. "
    runs = list(spans.window_runs(line * 500, 60, 20))
    assert max(b - a for _, a, b in runs) <= spans.LONGEST_RUN and [a for _, a, _ in runs[1:]] == [b for _, _, b in runs[:-1]]
    df = spark.createDataFrame([(1, line * 500), (2, "x" + line * 400)], "id bigint, text string")
    assert rows(spans.shared_spans(df, "id", "text", length=60, seed=20)) == {(1, 0, len(line) * 500), (2, 1, len(line) * 400 + 1)}


def test_one_record_sent_twice_shares_nothing(spark, rows):
    df = spark.createDataFrame([(1, "abcdefghij" * 5)] * 2, "id bigint, text string")
    assert rows(spans.shared_spans(df, "id", "text", length=20, seed=8)) == set()
    report = spans.share_report(df, "id", "text", spans.shared_spans(df, "id", "text", length=20, seed=8)).first()
    assert tuple(report) == (1, 50, 0, 0, 0.0)


def test_shares_reach_the_pages(spark):
    text = "q" * 3 + "abcdefghijklmnopqrst" + "w" * 7
    df = spark.createDataFrame([(1, text, [(0, 10, 1), (10, 30, 2)]), (2, text, None)], "id bigint, text string, spans array<struct<span_start: int, span_end: int, page_number: int>>")
    got = {r.page_number: r.shared_chars for r in spans.page_report(df, "id", "spans", spans.shared_spans(df, "id", "text", length=20, seed=8)).collect()}
    assert got == {1: 10, 2: 20}


def test_radix_counter_spills_and_recurses(tmp_path):
    rng = random.Random(5)
    words = [f"t{int(rng.paretovariate(0.6)) % 900}" for _ in range(6000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(words[i : i + 500]), pa.array([2] * 500, pa.int64()), pa.array([1] * 500, pa.int64())], schema=terms.COUNTS) for i in range(0, 6000, 500)]
    counter = terms.RadixCounter(str(tmp_path), part_rows=20, block_rows=700)
    got = {t: (a, b) for batch in counter.counts(iter(batches)) for t, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
    assert got == {t: (2 * n, n) for t, n in Counter(words).items()}
    assert not list(tmp_path.glob("p*"))


def test_marks_and_odd_rows(spark, rows):
    data = [(1, {"a": 2, "b": 1}), (1, {"a": 2, "b": 1}), (2, {"a": 1, "c": None}), (3, None), (4, {}), (None, {"z": 1}), (5, {"a": 1, "d": 3}), (6, {"d": 1})]
    df = spark.createDataFrame(data, "chunk_row bigint, term_frequencies map<string, int>").withColumn("term", F.lit("clash"))
    got = rows(terms.marked_terms(df, "chunk_row", "term_frequencies", part_rows=2, block_rows=3), "term", "total", "rows", "mark")
    assert got == {("a", 4, 3, "common"), ("b", 1, 1, "rare"), ("c", 0, 1, "rare"), ("d", 4, 2, "common")}
    assert rows(terms.marked_terms(df.limit(0), "chunk_row", "term_frequencies")) == set()
