"""Queries of rules whose inputs the tables lack: stated for every row of a table, by its id."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import responses
from lectern.functions import text as t
from lectern.functions.matching import matches
from lectern.operators import comparison, corpus, coverage, integrity, reports
from lectern.plans.common import CHUNKS, PAPERS, chunks, papers, records, views
from lectern.plans.registry import query
from lectern.sources.files import resolved_references

VIEWS = "v AS (SELECT DISTINCT view_id FROM source_views WHERE view_id IS NOT NULL)"


def said(column, number=None):
    """A text with the number of the row put in for `#`."""
    parts = column.split("#")
    number = F.col("view_id") if number is None else number
    out = [F.lit(parts[0])]
    for part in parts[1:]:
        out += [number.cast("string"), F.lit(part)]
    return F.concat(*out)


@query("s3_raster_dpi", """
    WITH x AS (SELECT document_id, filename, 400.0::DOUBLE + coalesce(file_size, 0) % 3000 AS w, 500.0::DOUBLE + coalesce(page_count, 0) * 40 AS h FROM doc_records), p AS (SELECT *, (w / 72 * 200) * (h / 72 * 200) AS p FROM x)
    SELECT document_id, filename, CAST(CASE WHEN p <= 20000000 THEN 200 ELSE greatest(100, floor(200 * sqrt(20000000 / p))) END AS INTEGER) AS dpi FROM p""")
def s3_raster_dpi(spark, d):
    """Page sizes that follow from file size and page count."""
    width, height = F.lit(400.0) + F.coalesce("file_size", F.lit(0)) % 3000, F.lit(500.0) + F.coalesce("page_count", F.lit(0)) * 40
    return records(spark, d).select("document_id", "filename", t.raster_dpi(width, height).alias("dpi"))


@query("t39_embedding_batches", f"WITH {CHUNKS}, n AS (SELECT document_id, count(*) * 40 AS n FROM c GROUP BY document_id) SELECT document_id, CASE WHEN n > 2000 THEN 4 WHEN n > 500 THEN 8 ELSE 16 END AS batch FROM n")
def t39_embedding_batches(spark, d):
    """Documents as if they had forty times their chunks."""
    return chunks(spark, d).groupBy("document_id").agg((F.count(F.lit(1)) * 40).alias("n")).select("document_id", t.embedding_batch(F.col("n")).alias("batch"))


@query("t38_prompt_blocks", f"""WITH {CHUNKS} SELECT document_id, chunk_id, md5('<evidence id="E1" file="' || replace(source_filename, '"', '''') || '" page="' || page_number || '" chunk="' || chunk_id || '">' || chr(10) || regexp_replace(coalesce(text, ''), '(?i)</?evidence', '&lt;evidence', 'g') || chr(10) || '</evidence>') AS digest FROM c""")
def t38_prompt_blocks(spark, d):
    block = responses.prompt_block(F.lit("E1"), F.col("source_filename"), F.col("page_number"), F.col("chunk_id"), F.col("text"))
    return chunks(spark, d).select("document_id", "chunk_id", F.md5(block.cast("binary")).alias("digest"))


@query("t26_byte_costs", f"WITH {CHUNKS} SELECT document_id, chunk_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM c WHERE text IS NOT NULL")
def t26_byte_costs(spark, d):
    return chunks(spark, d).where("text is not null").select("document_id", "chunk_id", t.utf8_cost(F.col("text")).cast("bigint").alias("bytes"))


@query("t24_quotes", f"""WITH {PAPERS} SELECT paper_id, len(regexp_extract_all(body, '“[^”]+”|"[^"\\n]+"|«[^»]+»|(?m:^\\s*>[^\\n]+)')) AS quotes FROM pp WHERE body IS NOT NULL""")
def t24_quotes(spark, d):
    return papers(spark, d).where("body is not null").select("paper_id", F.size(matches("quotes", F.col("body"))).cast("bigint").alias("quotes"))


@query("t34_cited_ids", f"WITH {VIEWS} SELECT view_id, CASE WHEN view_id = 2 THEN 'E2' WHEN view_id = 12 THEN 'E2,E12' ELSE 'E2,E' || view_id || ',E12' END AS ids FROM v")
def t34_cited_ids(spark, d):
    answer = said("See e2 and [E#], not FE9 or E; again E2 (e12).")
    plain = F.when(F.col("view_id").isin(2, 12), F.when(F.col("view_id") == 2, F.lit("Only e2, E2.")).otherwise(F.lit("See e2 and [E12]."))).otherwise(answer)
    return views(spark, d).select("view_id", F.array_join(t.cited_ids(plain), ",").alias("ids"))


@query("f12_safe_links", f"WITH {VIEWS} SELECT view_id, CASE view_id % 6 WHEN 0 THEN 'https://host.example/p/' || view_id WHEN 1 THEN 'HTTP://host.example' ELSE '' END AS link FROM v")
def f12_safe_links(spark, d):
    kind = F.col("view_id") % 6
    link = F.when(kind == 0, said("https://host.example/p/#")).when(kind == 1, F.lit("HTTP://host.example")).when(kind == 2, F.lit("https://user:word@host.example/")).when(kind == 3, F.lit("javascript:alert(1)")).when(kind == 4, F.lit("https:///nohost")).otherwise(F.lit("ftp://host.example/x"))
    return views(spark, d).select("view_id", t.safe_link(link).alias("link"))


def findings(spark, d):
    """A finding for every view, citing both sides, one or none, of a known relationship or another."""
    n = F.col("view_id")
    a = F.when(n % 5 == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit(" a1"), F.lit("A9"), F.lit("A1")))
    b = F.when(n % 5 >= 3, F.array(F.lit("B7"))).otherwise(F.array(F.lit("B2")))
    relation = F.element_at(F.array(*map(F.lit, [*comparison.RELATIONSHIPS, "SOMETHING ELSE"])), (F.floor(n / 5) % 5 + 1).cast("int"))
    return views(spark, d).select(
        n.alias("finding_id"), F.when(n % 7 == 0, F.lit(" ")).otherwise(said(" topic # ")).alias("topic"), said("states #").alias("document_a_statement"), F.when(n % 2 == 0, F.lit("")).otherwise(F.lit("other")).alias("document_b_statement"),
        relation.alias("relationship"),
        a.alias("document_a_evidence_ids"), b.alias("document_b_evidence_ids"), F.array(F.lit("A1")).alias("allowed_a"), F.array(F.lit("B2")).alias("allowed_b"),
    )


@query("f13_findings", f"""
    WITH {VIEWS}, x AS (SELECT view_id AS finding_id, view_id % 5 <> 4 AS a, view_id % 5 < 3 AS b, {[*comparison.RELATIONSHIPS, 'SOMETHING ELSE']}[CAST(view_id // 5 % 5 + 1 AS INTEGER)] AS r FROM v)
    SELECT finding_id, CASE WHEN finding_id % 7 = 0 THEN 'Unspecified topic' ELSE 'topic ' || finding_id END AS topic, CASE WHEN a THEN 'states ' || finding_id ELSE '{comparison.NOT_STATED}' END AS document_a_statement,
    CASE WHEN b AND finding_id % 2 = 1 THEN 'other' ELSE '{comparison.NOT_STATED}' END AS document_b_statement, CASE WHEN a AND b AND r <> 'SOMETHING ELSE' THEN r ELSE 'INSUFFICIENT EVIDENCE' END AS relationship FROM x WHERE a OR b""")
def f13_findings(spark, d):
    return comparison.validated_findings(findings(spark, d)).select("finding_id", "topic", "document_a_statement", "document_b_statement", "relationship")


@query("a13_conflicts", f"WITH {VIEWS}, x AS (SELECT view_id, view_id // 5 % 5 = 2 AS p FROM v) SELECT count(*) FILTER (p) AS conflicts, 'd0.pdf,d1.pdf,d2.pdf,d3.pdf' AS documents FROM x")
def a13_conflicts(spark, d):
    """Findings as read, each between two of four documents."""
    rows = findings(spark, d).withColumn("document_a", F.concat(F.lit("d"), (F.col("finding_id") % 4).cast("string"), F.lit(".pdf"))).withColumn("document_b", F.concat(F.lit("d"), ((F.col("finding_id") + 1) % 4).cast("string"), F.lit(".pdf")))
    return corpus.conflict_totals(rows).select("conflicts", F.array_join("documents", ",").alias("documents"))


@query("f15_summary_points", f"WITH {VIEWS} SELECT view_id AS point_id, 'point ' || view_id AS text, CASE WHEN view_id % 4 = 2 THEN 'S1' ELSE 'S3,S1' END AS ids FROM v WHERE view_id % 4 >= 2")
def f15_summary_points(spark, d):
    n = F.col("view_id")
    ids = F.when(n % 4 == 1, F.array(F.lit("S8"))).when(n % 4 == 2, F.array(F.lit("s1"), F.lit("S1"))).otherwise(F.array(F.lit("S3"), F.lit("S9"), F.lit("S1")))
    points = views(spark, d).select(n.alias("point_id"), F.lit("overview").alias("section"), F.when(n % 4 == 0, F.lit("  ")).otherwise(said(" point # ")).alias("text"), ids.alias("evidence_ids"), F.array(F.lit("S1"), F.lit("S3")).alias("allowed"))
    return comparison.summary_points(points).select("point_id", "text", F.array_join("evidence_ids", ",").alias("ids"))


@query("f14_comparison_points", f"""
    WITH {VIEWS}, x AS (SELECT view_id AS point_id, ['similarities', 'differences', 'document_a', 'document_b', 'unique_a', 'unique_b', 'overview'][CAST(view_id % 7 + 1 AS INTEGER)] AS section, ['A', 'B', 'AB'][CAST(view_id // 7 % 3 + 1 AS INTEGER)] AS sides FROM v)
    SELECT point_id, section, CASE section WHEN 'unique_a' THEN 'Document B: {comparison.NOT_STATED} ' WHEN 'unique_b' THEN 'Document A: {comparison.NOT_STATED} ' ELSE '' END || 'says ' || point_id AS text FROM x
    WHERE CASE section WHEN 'similarities' THEN sides = 'AB' WHEN 'differences' THEN sides = 'AB' WHEN 'document_a' THEN sides = 'A' WHEN 'document_b' THEN sides = 'B' WHEN 'unique_a' THEN sides = 'A' WHEN 'unique_b' THEN sides = 'B' ELSE true END""")
def f14_comparison_points(spark, d):
    """Points of every section citing one side, the other or both."""
    n = F.col("view_id")
    section = F.element_at(F.array(*map(F.lit, ["similarities", "differences", "document_a", "document_b", "unique_a", "unique_b", "overview"])), (n % 7 + 1).cast("int"))
    side = F.floor(n / 7) % 3
    ids = F.when(side == 0, F.array(F.lit("A1"))).when(side == 1, F.array(F.lit("b1"))).otherwise(F.array(F.lit("A1"), F.lit("B1"), F.lit("B4")))
    points = views(spark, d).select(n.alias("point_id"), section.alias("section"), said(" says #").alias("text"), ids.alias("evidence_ids"), F.array(F.lit("A1"), F.lit("B1")).alias("allowed"), F.lit("stated").alias("comparison_status"), F.lit(None).cast("string").alias("not_stated_for"))
    return comparison.validated_points(points).select("point_id", "section", "text")


@query("k8_cited_points", f"WITH {VIEWS} SELECT view_id AS point_id, '- point ' || view_id || ' ([E2] b.pdf, p. 4; [E1] a.pdf, p. 3)' AS line FROM v")
def k8_cited_points(spark, d):
    points = views(spark, d).select(F.lit("overview").alias("section"), F.col("view_id").alias("point_id"), said("point #").alias("text"), F.array(F.lit("E2"), F.lit("E1"), F.lit("E7")).alias("evidence_ids"))
    evidence = spark.sql("SELECT * FROM VALUES ('E1', 'a.pdf', 3), ('E2', 'b.pdf', 4) AS v(evidence_id, source_filename, page_number)")
    return reports.cited_points(points, evidence).select("point_id", "line")


@query("t40_work_metadata", f"WITH {VIEWS} SELECT view_id, 'Title ' || view_id AS title, CASE WHEN view_id % 2 = 0 THEN 'Ann Lee, Roe' ELSE '' END AS authors, CASE WHEN view_id % 3 = 0 THEN '' ELSE '2001' END AS year, '10.5555/x' || view_id AS doi, 'https://doi.org/10.5555/x' || view_id AS link FROM v")
def t40_work_metadata(spark, d):
    n = F.col("view_id")
    authors = F.when(n % 2 == 0, F.lit('[{"given": "Ann", "family": "Lee"}, {"family": "Roe"}, {"given": ""}]')).otherwise(F.lit("[]"))
    year = F.when(n % 3 == 0, F.lit("{}")).when(n % 3 == 1, F.lit('{"date-parts": [[2001, 5]]}')).otherwise(F.lit('{"date-parts": [[2001]]}'))
    place = F.when(n % 3 == 1, F.lit("published")).otherwise(F.lit("issued"))
    item = F.concat(said('{"title": ["Title #", "other"], "DOI": "10.5555/X#", "author": '), authors, F.lit(', "'), place, F.lit('": '), year, F.lit("}"))
    return views(spark, d).select("view_id", responses.work_metadata(item).alias("w")).select("view_id", "w.*")


@query("s9_lookup_limits", f"""
    WITH {PAPERS}, r AS (SELECT paper_id, unnest(range(1, 46)) AS k FROM pp), p AS (SELECT *, k % 3 <> 0 AS parsed, sum(CASE WHEN k % 3 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY k) AS place FROM r)
    SELECT paper_id, CAST(k AS INTEGER) AS position, CASE WHEN NOT parsed THEN 'Not checked: unparsed' WHEN place > 25 THEN 'Not checked: limit' WHEN k % 5 = 0 THEN 'Unverified: no DOI' WHEN k % 2 = 0 THEN 'Verified by DOI' ELSE 'Not found' END AS status FROM p""")
def s9_lookup_limits(spark, d):
    """Forty-five references of every paper: every third unreadable, every fifth without a DOI, odd ones unknown."""
    k = F.col("position")
    rows = papers(spark, d).select("paper_id", F.explode(F.sequence(F.lit(1), F.lit(45))).alias("position")).select("paper_id", "position", (k % 3 != 0).alias("parsed"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("10.5555/r"), k.cast("string"))).alias("doi"))
    works = spark.range(2, 46, 2).select(F.concat(F.lit("10.5555/R"), F.col("id").cast("string")).alias("doi"), F.lit("a work").alias("title"), F.lit("2020").alias("year"), F.lit(True).alias("open_access"))
    return resolved_references(rows, works, consent=True).select("paper_id", "position", "status")


def ranges(spark, d):
    """Six overlapping ranges of words for every paper, some cited and some quoted."""
    n = F.col("n")
    rows = papers(spark, d).select("paper_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("n"))
    start = n * 11 + F.pmod("paper_id", F.lit(7))
    return rows.select("paper_id", start.cast("bigint").alias("word_start"), (start + 8 + F.pmod(F.col("paper_id") + n, F.lit(9))).cast("bigint").alias("word_end"), (n % 2 == 0).alias("cited"), (n % 3 == 0).alias("quoted"))


@query("a17_unattributed", f"""
    WITH {PAPERS}, r AS (SELECT paper_id, unnest(range(0, 6)) AS n FROM pp), x AS (SELECT paper_id, n, n * 11 + paper_id % 7 AS a, n * 11 + paper_id % 7 + 8 + (paper_id + n) % 9 AS b FROM r),
    w AS (SELECT paper_id, n, unnest(range(a, b)) AS i FROM x), p AS (SELECT paper_id, i, bool_or(n % 2 = 0) AS cited, bool_or(n % 6 = 0) AS both_ FROM w GROUP BY ALL)
    SELECT paper_id, count(*) AS covered, count(*) FILTER (cited) AS cited_words, count(*) FILTER (both_) AS quoted_cited_words, count(*) FILTER (NOT cited) AS unattributed_words FROM p GROUP BY paper_id""")
def a17_unattributed(spark, d):
    return integrity.unattributed_words(ranges(spark, d), "paper_id").select("paper_id", "covered", "cited_words", "quoted_cited_words", "unattributed_words")


@query("a19_provider_percentage", f"WITH {VIEWS}, x AS (SELECT view_id, 10 + view_id % 3 AS words, CASE WHEN view_id % 4 = 0 THEN 9 ELSE 10 + view_id % 3 END AS judged, view_id % 5 AS flagged, view_id % 6 = 0 AS lost FROM v) SELECT view_id, CASE WHEN judged = words AND NOT lost THEN round(100.0::DOUBLE * flagged / words, 6) END AS percentage FROM x")
def a19_provider_percentage(spark, d):
    n = F.col("view_id")
    rows = views(spark, d).select("view_id", (n % 3 + 10).alias("words"), F.when(n % 4 == 0, 9).otherwise(n % 3 + 10).alias("judged"), (n % 5).alias("flagged"))
    lost = views(spark, d).where("view_id % 6 = 0").select("view_id", F.lit(1).alias("unaligned"))
    return coverage.provider_percentage(rows, lost, "view_id").select("view_id", F.round("percentage", 6).alias("percentage"))
