import datetime as dt
import random

from pyspark.sql import functions as F

from lectern.llm import boilerplate, cutting
from lectern.llm.hashing import code_points


def test_pieces_hold_the_limit_the_overlap_and_the_text():
    rng = random.Random(1)
    for n in (0, 1, 50, 51, 120, 1000, 70_000):
        text = "".join(rng.choice("abc .,\n") for _ in range(n))
        cuts = cutting.cut_points(text, 50, 10)
        assert all(0 < b - a <= 50 for a, b in cuts)
        assert all(c == b - 10 for (_, b), (c, _) in zip(cuts, cuts[1:], strict=False))
        assert "".join(text[a:b] if k == 0 else text[a + 10 : b] for k, (a, b) in enumerate(cuts)) == text
        assert (len(cuts) > 1) == (n > 50)


def brute_cut(strengths, a, b):
    return max(range(a, b + 1), key=lambda c: (strengths[c], c))


def test_the_strongest_cut_is_taken_rightmost_of_equals():
    rng = random.Random(2)
    text = "".join(rng.choice("ab. \n") for _ in range(400))
    strengths = cutting.boundary_strengths(code_points(text))
    find = cutting.StrongestCut(strengths, 0, 60)
    for _ in range(200):
        a = rng.randrange(0, 340)
        b = a + rng.randrange(0, 60)
        assert find(a, b) == brute_cut(strengths, a, b)
    s = cutting.boundary_strengths(code_points("a, b. c\nd\n\ne f"))
    assert [s[3], s[6], s[8], s[11], s[13], s[1]] == [cutting.CLAUSE, cutting.SENTENCE, cutting.LINE, cutting.PARAGRAPH, cutting.SPACE, cutting.NONE]


def test_strengths_of_a_stretch_are_those_of_the_text():
    rng = random.Random(6)
    text = "".join(rng.choice("ab.,! \t\r\n\n") for _ in range(600)) + "\n" + " " * 90 + "\nend"
    whole = cutting.boundary_strengths(code_points(text)).tolist()
    for _ in range(300):
        a = rng.randrange(0, len(text))
        b = rng.randrange(a + 1, len(text) + 2)
        assert cutting.strengths_between(text, a, b).tolist() == whole[a:b]


def test_items_keep_their_keys(spark, rows):
    df = spark.createDataFrame([("a", "x" * 25), ("b", "short"), ("c", None), ("d", ""), ("a", "x" * 25)], "key string, text string").withColumn("_text", F.lit("clash"))
    got = cutting.cut_items(df, ["key"], "text", limit=20, overlap=4, with_text=True)
    assert rows(got, "key", "piece_no", "piece") == {("a", 1, "x" * 20), ("a", 2, "x" * 9), ("b", 1, "short")}
    assert rows(cutting.cut_items(df, ["key"], "text", 20, 4, only_oversized=True), "key") == {("a",)}
    assert rows(cutting.cut_items(df.limit(0), ["key"], "text")) == set()


def corpus(spark):
    day = lambda n: dt.datetime(2024, 1, 1 + n)
    records = [(f"d{n}", "P", day(n)) for n in range(8)] + [("d0", "P", day(9)), ("x", None, day(0)), ("e", "Q", day(0)), ("nopages", "P", day(0))]
    pages = [(f"d{n}", 1, f"Share  THIS {n}\r\nown line {chr(97 + n)}\n\n" + ("footer" if n < 2 else "")) for n in range(8)]
    pages += [pages[0], ("x", 1, "Share this 1"), ("e", 1, "Share this 1"), ("d1", 2, None), (None, 1, "Share this 1"), ("d2", 2, "")]
    return spark.createDataFrame(pages, "document_id string, page_number int, page_text string"), spark.createDataFrame(records, "document_id string, publisher string, uploaded_at timestamp")


def test_lines_of_one_source(spark, rows):
    pages, records = corpus(spark)
    found = boilerplate.boilerplate_lines(pages, records)
    assert rows(found) == {(f"d{n}", 1, 1) for n in range(8)}
    clean = {r.document_id: r.clean_text for r in boilerplate.without_lines(pages, found).where("page_number = 1 and document_id is not null").collect()}
    assert clean["d0"] == "own line a\n\nfooter" and clean["x"] == "Share this 1"
    assert rows(boilerplate.boilerplate_lines(pages.limit(0), records)) == set()
    assert rows(boilerplate.boilerplate_lines(pages, records.limit(0))) == set()


def test_copies_count_as_documents_or_as_one_cluster(spark):
    day = dt.datetime(2024, 1, 1)
    pages = spark.createDataFrame([(f"d{n}", 1, "the same article\nand its line") for n in range(6)], "document_id string, page_number int, page_text string")
    records = spark.createDataFrame([(f"d{n}", "P", day) for n in range(6)], "document_id string, publisher string, uploaded_at timestamp")
    assert {r.units for r in boilerplate.frequent_lines(pages, records).collect()} == {6}
    assert boilerplate.frequent_lines(pages, records, unit="clusters").count() == 0
