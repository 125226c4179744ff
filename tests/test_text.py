from pyspark.sql import functions as F

from lectern.functions import responses, splitting
from lectern.functions import text as t
from lectern.functions.matching import citations, dates, entities, matches, quotes, words


def one(spark, column, **values):
    shape = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], shape).select(column).first()[0]


def test_tokens_and_terms(spark):
    assert one(spark, t.lexical_tokens(F.col("x")), x="Directive 17-B, 2028-04-15 über JADC2.") == ["directive", "17-b", "2028-04-15", "ber", "jadc2"]
    assert one(spark, t.evidence_terms(F.col("x")), x="The 5 of an act AB a1 act") == ["5", "act", "a1"]


def test_modality_and_topics(spark):
    assert one(spark, t.positive_modality(F.col("x")), x="It is permitted.") is True
    assert one(spark, t.positive_modality(F.col("x")), x="It is not permitted.") is False
    assert one(spark, t.negative_modality(F.col("x")), x="Entry is PROHIBITED") is True
    assert one(spark, t.topics(F.col("x")), x="The mandate may cost $5") == ["Dates / Deadlines", "Financial / Monetary Amounts"]
    assert one(spark, t.topics(F.col("x")), x="Nothing here") == ["General Provisions"]
    assert one(spark, t.event_type(F.col("x")), x="Issued, effective now") == "Publication"


def test_entities_are_cleaned(spark):
    assert one(spark, t.clean_entity(F.col("x")), x=" The  Harbour Act, ") == "Harbour Act"
    assert one(spark, t.canonical(F.col("x")), x="₹5 Crore") == "5 crore"
    assert one(spark, t.refined_category(F.lit("Organizations"), F.col("x")), x="Army Council") == "Defence organizations"


def test_links_dois_and_numbers(spark):
    assert one(spark, t.safe_link(F.col("x")), x="https://example.org/a") == "https://example.org/a"
    for bad in ("ftp://example.org", "https://u:p@example.org", "javascript:x", "https://", "https://a\nb"):
        assert one(spark, t.safe_link(F.col("x")), x=bad) == ""
    assert one(spark, t.dois(F.col("x")), x="see 10.1234/AB.c). and 10.1234/ab.c") == ["10.1234/ab.c"]
    assert one(spark, t.doi_link(F.col("x")), x="10.1/a b") == "https://doi.org/10.1/a%20b"
    assert one(spark, t.number_group(F.col("x")), x="1, 3–5, 3") == [1, 3, 4, 5]
    assert one(spark, t.number_group(F.col("x")), x="9-3") == []
    assert one(spark, t.number_group(F.col("x")), x="1-500") == []


def test_ids_marks_and_cells(spark):
    ids = t.allowed_ids(F.split("x", ","), F.array(F.lit("E1"), F.lit("E2")))
    assert one(spark, ids, x=" e2,E9,E1,E2") == ["E2", "E1"]
    assert one(spark, t.cited_ids(F.col("x")), x="as e1 and E12, E1") == ["E1", "E12"]
    assert one(spark, t.marked_html(F.col("x"), F.lit(True)), x="a<b & 'c'") == "<mark>a&lt;b &amp; &#x27;c&#x27;</mark>"
    assert one(spark, t.excerpt(F.col("x"), 9), x="one two three") == "one two"
    assert one(spark, t.excerpt(F.col("x"), 4), x="abcdefgh") == "abcd"
    assert one(spark, t.table_cell(F.col("x"), 6), x="a|b\ncdefg") == "a\\|b …"
    assert one(spark, t.half_even(F.col("x").cast("double"), 1), x="12.25") == 12.2


def test_dates_and_their_sentences():
    got = list(dates("Issued on 5th March 2024. Due within 30 days! FY 2019-20 and April 2021; 2024/1/2."))
    assert [(d, p) for d, p, _ in got] == [("2024/1/2", "exact"), ("5th March 2024", "exact"), ("FY 2019-20", "fiscal"), ("April 2021", "month"), ("within 30 days", "relative")]
    assert got[1][2] == "Issued on 5th March 2024."


def test_entity_patterns():
    got = {(c, raw) for _, _, _, c, raw, _ in entities("The Ministry of Ports told the Harbour Safety Board, based in New Vale, on 1 May 2020 to pay $5 million or 7 percent.")}
    assert ("Ministries", "Ministry of Ports") in got
    assert ("Organizations", "Harbour Safety Board") in got
    assert ("Locations", "New Vale") in got
    assert ("Dates", "1 May 2020") in got
    assert ("Monetary amounts", "$5 million") in got
    assert ("Percentages", "7 percent") in got


def test_words_quotes_citations(spark):
    assert [w for w, _, _ in words("Straße o’clock re-do ﬁne")] == ["strasse", "o’clock", "re-do", "fine"]
    text = 'He said "a b" and “c”.\n> quoted'
    assert [text[a:b].strip() for a, b in quotes(text)] == ['"a b"', "“c”", "> quoted"]
    got = [(s, m, target) for s, m, target, _, _, _ in citations("As [1, 3–4] and (Smith, 2020) or Jones 2021 say; doi 10.1000/X1.")]
    assert got == [("numeric", "[1]", "1"), ("numeric", "[3]", "3"), ("numeric", "[4]", "4"), ("author-year", "Smith, 2020)", "smith"), ("DOI", "10.1000/X1.", "10.1000/x1")]
    df = spark.createDataFrame([(None,), ("",), ("a b",)], "x string")
    assert [len(r[0]) for r in df.select(matches("words", F.col("x"))).collect()] == [0, 0, 2]


def test_chunks_keep_the_limit_and_the_text():
    text = "para one.\n\n" + "word " * 500 + "\n\n" + "x" * 2500
    chunks = splitting.recursive_chunks(text, 1000, 200)
    assert all(0 < len(c) <= 1000 for c in chunks)
    assert set(" ".join(chunks).split()) >= {"para", "one.", "word"}
    assert splitting.recursive_chunks("short") == ["short"]
    assert splitting.recursive_chunks("  \n ") == []


def test_answers_and_errors(spark):
    whole = responses.answer_of(F.col("x"))
    assert one(spark, whole["answer"], x='noise {"answer": "A", "evidence_ids": ["E1"]} more') == "A"
    assert one(spark, whole["evidence_ids"], x='{"answer": "see E7", "suffi') == ["E7"]
    assert one(spark, whole, x="nothing") is None
    assert one(spark, responses.retry_after(F.lit(None).cast("string"), F.col("x")), x="'retryDelay': '3.5s'") == 3.5
    assert "abc" not in one(spark, responses.sanitized(F.col("x")), x="api_key=abc failed")
    item = '{"title": ["T"], "author": [{"given": "A", "family": "B"}, {"family": "C"}], "issued": {"date-parts": [[2020, 1]]}, "DOI": "10.1/X"}'
    assert tuple(one(spark, responses.work_metadata(F.col("x")), x=item)) == ("T", "A B, C", "2020", "10.1/x", "https://doi.org/10.1/x")
    assert tuple(one(spark, responses.work_metadata(F.col("x")), x="{}")) == ("", "", "", "", "")
