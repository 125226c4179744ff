"""Queries of timelines, entities, topics, summaries, papers and word coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import responses
from lectern.functions import text as t
from lectern.functions.matching import matches
from lectern.operators import bibliography as bib
from lectern.operators import comparison, corpus, coverage, entities, integrity, summary, timeline
from lectern.plans.common import CHUNKS, PAGES, PAPERS, chunks, pages, papers, records, views
from lectern.plans.corpus_queries import DOCUMENT_ROWS
from lectern.plans.recognised import CITATIONS, EVENTS, REFERENCES, WINDOWS
from lectern.plans.registry import query
from lectern.sources.files import resolved_references
from lectern.sources.tables import table

NEG = "(" + " OR ".join(f"contains(low, '{x}')" for x in t.NEGATIVE_PHRASES) + ")"


def _any(words):
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


@query("q7_timeline", f"WITH {CHUNKS}, {EVENTS} SELECT 'T' || row_number() OVER (ORDER BY key, source_filename, page_number, chunk_id, event, document_id) AS evidence_id, date, date_precision, event_type, event, source_filename, document_id, page_number, chunk_id FROM events")
def q7_timeline(spark, d):
    rows = timeline.timeline(chunks(spark, d))
    return rows.select("evidence_id", "date", "date_precision", "event_type", "event", "source_filename", "document_id", "page_number", "chunk_id")


def _dates(spark, d, precision, pattern):
    rows = timeline.events(chunks(spark, d)).where(F.col("date_precision") == precision)
    # Ignoring case, a long s is an s to the recogniser; the result is written with an s, as in the SQL.
    return rows.where(F.col("date").rlike(pattern)).select("document_id", F.replace(F.lower("date"), F.lit("ſ"), F.lit("s")).alias("date")).distinct()


@query("t6_iso_dates", f"WITH {CHUNKS} SELECT DISTINCT document_id, unnest(regexp_extract_all(replace(text, 'ſ', 's'), '\\b(?:19|20)\\d{{2}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}\\b')) AS date FROM c")
def t6_iso_dates(spark, d):
    return _dates(spark, d, "exact", "^(?:19|20)\\d{2}[-/]")


@query("t6_fiscal_dates", f"WITH {CHUNKS} SELECT DISTINCT document_id, lower(unnest(regexp_extract_all(replace(text, 'ſ', 's'), '(?i)\\b(?:FY|Fiscal Year)\\s*(?:19|20)\\d{{2}}(?:\\s*[-–/]\\s*\\d{{2,4}})?\\b'))) AS date FROM c")
def t6_fiscal_dates(spark, d):
    return _dates(spark, d, "fiscal", ".")


@query("t6_relative_dates", f"WITH {CHUNKS} SELECT DISTINCT document_id, lower(unnest(regexp_extract_all(replace(text, 'ſ', 's'), '(?i)\\b(?:within|no later than|not later than)\\s+\\d+\\s+(?:calendar\\s+|business\\s+|working\\s+)?(?:day|days|week|weeks|month|months|year|years)\\b'))) AS date FROM c")
def t6_relative_dates(spark, d):
    return _dates(spark, d, "relative", ".")


@query("a12_timeline_summary", f"WITH {CHUNKS}, {EVENTS} SELECT document_id, count(*) AS events, arg_min(date, {{'k': key, 'd': date}}) FILTER (date_precision <> 'relative') AS earliest, arg_max(date, {{'k': key, 'd': date}}) FILTER (date_precision <> 'relative') AS latest FROM events GROUP BY document_id")
def a12_timeline_summary(spark, d):
    return timeline.timeline_summary(timeline.events(chunks(spark, d)))


@query("t7_iso_date_keys", f"""
    WITH {CHUNKS}, x AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\b((?:19|20)\\d{{2}}-\\d{{1,2}}-\\d{{1,2}})\\b', 1)) AS date FROM c),
    y AS (SELECT date, try_strptime(date, '%Y-%m-%d') AS ts FROM x)
    SELECT date, CAST(coalesce(year(ts), 9999) AS INTEGER) AS y, CAST(coalesce(month(ts), 12) AS INTEGER) AS m, CAST(coalesce(day(ts), 31) AS INTEGER) AS d, CASE WHEN ts IS NULL THEN 3 ELSE 0 END AS rank FROM y""")
def t7_iso_date_keys(spark, d):
    found = F.regexp_extract_all("text", F.lit(r"\b((?:19|20)\d{2}-\d{1,2}-\d{1,2})\b"), F.lit(1))
    rows = chunks(spark, d).select(F.explode(found).alias("date")).distinct()
    key = timeline.sort_key(F.col("date"), F.lit("exact"))
    return rows.select("date", key["year"].alias("y"), key["month"].alias("m"), key["day"].alias("d"), key["rank"].alias("rank"))


@query("t8_event_types", f"WITH {CHUNKS}, x AS (SELECT lower(text) AS low FROM c), y AS (SELECT CASE " + " ".join(f"WHEN {_any(w)} THEN '{k}'" for k, w in t.EVENT_TYPES.items()) + f" ELSE '{t.OTHER_EVENT}' END AS event_type FROM x) SELECT event_type, count(*) AS chunks FROM y GROUP BY event_type")
def t8_event_types(spark, d):
    return chunks(spark, d).groupBy(t.event_type(F.col("text")).alias("event_type")).agg(F.count(F.lit(1)).alias("chunks"))


@query("q8_entities", f'WITH {CHUNKS}, {REFERENCES} SELECT category, entity, canonical, "references", documents FROM merged')
def q8_entities(spark, d):
    return entities.merged(entities.references(chunks(spark, d)))


@query("w5_facts", f"WITH {CHUNKS}, {REFERENCES}, named2 AS (SELECT refs.* EXCLUDE (entity), merged.entity AS entity FROM refs JOIN merged USING (category, canonical)) SELECT 'F' || row_number() OVER (ORDER BY list_position({entities.CATEGORIES}, category), lower(entity), canonical, source_filename, page_number, chunk_id, a, context, document_id) AS evidence_id, category, entity, canonical, source_filename, page_number, chunk_id, context, document_id FROM named2")
def w5_facts(spark, d):
    return entities.facts(entities.references(chunks(spark, d)))


@query("a8_entity_counts", f"WITH {CHUNKS}, {REFERENCES} SELECT category, count(*) AS entities, CAST(list_position({entities.CATEGORIES}, category) AS BIGINT) AS position FROM merged GROUP BY category")
def a8_entity_counts(spark, d):
    return entities.counts(entities.merged(entities.references(chunks(spark, d))))


@query("a7_percentages", f"""
    WITH {CHUNKS}, x AS (SELECT document_id, unnest(regexp_extract_all(text, '(?i)\\b\\d+(?:\\.\\d+)?\\s*(?:%|percent|per cent)\\b')) AS raw FROM c)
    SELECT trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) AS canonical, count(DISTINCT document_id) AS documents FROM x GROUP BY canonical""")
def a7_percentages(spark, d):
    return entities.merged(entities.references(chunks(spark, d))).where("category = 'Percentages'").select("canonical", "documents")


def _entities_sql(tail):
    phrase = "[A-Z][A-Za-z0-9&''’.-]*(?:\\s+(?:[A-Z][A-Za-z0-9&''’.-]*|of|the|and|for|to|in)){0,8}"
    return f"""WITH {CHUNKS}, x AS (SELECT document_id, unnest(regexp_extract_all(text, '\\b{phrase}\\s+{tail}\\b')) AS raw FROM c),
    y AS (SELECT document_id, regexp_replace(regexp_replace(regexp_replace(raw, '\\s+', ' ', 'g'), '^[ ,.;:()\\[\\]]+|[ ,.;:()\\[\\]]+$', '', 'g'), '^The\\s+', '') AS e FROM x)
    SELECT trim(regexp_replace(lower(e), '[^a-z0-9]+', ' ', 'g')) AS canonical, count(DISTINCT document_id) AS documents FROM y WHERE length(e) BETWEEN 1 AND 180 GROUP BY canonical"""


@query("q8_acts", _entities_sql("Act(?:,?\\s+(?:19|20)\\d{2})?"))
def q8_acts(spark, d):
    return entities.merged(entities.references(chunks(spark, d))).where("category = 'Acts'").select("canonical", "documents")


@query("q8_policies", _entities_sql("(?:Policy|Directive|Doctrine|Strategy)"))
def q8_policies(spark, d):
    return entities.merged(entities.references(chunks(spark, d))).where("category = 'Policies'").select("canonical", "documents")


@query("q8_rules", _entities_sql("(?:Rules?|Regulations?)(?:,?\\s+(?:19|20)\\d{2})?"))
def q8_rules(spark, d):
    return entities.merged(entities.references(chunks(spark, d))).where("category = 'Rules/regulations'").select("canonical", "documents")


@query("a10_documents_with_facts", f"""{DOCUMENT_ROWS}, {EVENTS}, {REFERENCES},
    es AS (SELECT document_id, count(DISTINCT (category, canonical)) AS entities FROM refs GROUP BY document_id), vs AS (SELECT document_id, count(*) AS events FROM events GROUP BY document_id)
    SELECT rows_.document_id, filename, publisher, status, pages, chunks, native_pages, ocr_pages, CAST(round_even(share, 1) AS DOUBLE) AS coverage, warning, coalesce(es.entities, 0) AS entities, coalesce(vs.events, 0) AS events FROM rows_ LEFT JOIN es ON es.document_id = rows_.document_id LEFT JOIN vs ON vs.document_id = rows_.document_id""")
def a10_documents_with_facts(spark, d):
    rows = chunks(spark, d)
    return corpus.document_rows(corpus.distinct_documents(records(spark, d)), pages(spark, d), rows, entities.references(rows), timeline.events(rows))


@query("a25_topic_totals", f"WITH {CHUNKS}, x AS (SELECT document_id, lower(text) AS low FROM c), y AS (" + " UNION ALL ".join(f"SELECT document_id, '{k}' AS topic FROM x WHERE {_any(w)}" for k, w in t.TOPICS.items()) + f" UNION ALL SELECT document_id, '{t.OTHER_TOPIC}' FROM x WHERE NOT ({' OR '.join(_any(w) for w in t.TOPICS.values())})) SELECT topic, count(*) AS chunks, count(DISTINCT document_id) AS documents FROM y GROUP BY topic")
def a25_topic_totals(spark, d):
    return comparison.topic_totals(chunks(spark, d).where("text is not null"))


POSITIVE = "list_has_any(regexp_extract_all(low, '[a-z0-9]+(?:[./-][a-z0-9]+)*'), ['" + "', '".join(t.POSITIVE_MODALITIES) + "'])"


@query("t13_modality", f"WITH {CHUNKS}, x AS (SELECT document_id, lower(text) AS low FROM c WHERE text IS NOT NULL) SELECT document_id, count(*) FILTER ({NEG}) AS negative, count(*) FILTER ({POSITIVE} AND NOT {NEG}) AS positive FROM x GROUP BY document_id")
def t13_modality(spark, d):
    rows = chunks(spark, d).where("text is not null")
    return rows.groupBy("document_id").agg(F.count_if(t.negative_modality(F.col("text"))).alias("negative"), F.count_if(t.positive_modality(F.col("text"))).alias("positive"))


@query("t4_sentences", f"WITH {CHUNKS} SELECT document_id, chunk_id, len(string_split(regexp_replace(regexp_replace(text, '\\n+', chr(1), 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS sentences FROM c WHERE text IS NOT NULL AND NOT contains(text, chr(13)) AND NOT regexp_matches(text, '[.!?]\\s*\\n')")
def t4_sentences(spark, d):
    """Chunks in which no sentence ends at a line's end, where the two boundaries cannot meet."""
    rows = chunks(spark, d).where(F.col("text").isNotNull() & ~F.col("text").contains("\r") & ~F.col("text").rlike(r"[.!?]\s*\n"))
    return rows.select("document_id", "chunk_id", F.size(t.sentences(F.col("text"))).cast("bigint").alias("sentences"))


@query("t4_sentences_all")
def t4_sentences_all(spark, d):
    """All chunks with text; SQL without a lookbehind cannot say where the two boundaries meet."""
    return chunks(spark, d).where("text is not null").select("document_id", "chunk_id", F.size(t.sentences(F.col("text"))).cast("bigint").alias("sentences"))


@query("t17_cited_numbers", f"""
    WITH {PAPERS}, g AS (SELECT paper_id, unnest(regexp_extract_all(body, '\\[(\\d{{1,9}}(?:\\s*[,;–\\-]\\s*\\d{{1,9}})*)\\]', 1)) AS grp FROM pp),
    parts AS (SELECT paper_id, unnest(regexp_split_to_array(grp, '[,;]')) AS part FROM g),
    ends AS (SELECT paper_id, [CAST(trim(x) AS BIGINT) FOR x IN regexp_split_to_array(trim(part), '[–\\-]')] AS e FROM parts)
    SELECT DISTINCT paper_id, unnest(CASE WHEN len(e) = 2 THEN CASE WHEN e[2] >= e[1] AND e[2] - e[1] <= 100 THEN range(e[1], e[2] + 1) ELSE [] END ELSE [e[1]] END) AS number FROM ends""")
def t17_cited_numbers(spark, d):
    return papers(spark, d).select("paper_id", F.explode(F.flatten(t.cited_numbers(F.col("body")))).alias("number")).distinct()


def stated_references(spark, d):
    """References stood in for: each paper has R1..R20 with these labels, every fifth label twice."""
    ids = papers(spark, d).select("paper_id")
    one = ids.select("paper_id", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("label"))
    two = one.where("label % 5 = 0").withColumn("n", F.lit("b"))
    rows = one.withColumn("n", F.lit("")).unionByName(two)
    return rows.select("paper_id", F.concat(F.lit("R"), F.col("label").cast("string"), "n").alias("reference_id"), F.col("label").cast("bigint").alias("label"), F.lit(None).cast("string").alias("surname"), F.lit(None).cast("string").alias("year"), F.lit(None).cast("string").alias("doi"))


STATED = """l AS (SELECT paper_id, unnest(range(1, 21)) AS label FROM pp), refs AS (SELECT paper_id, label, 'R' || label AS reference_id FROM l UNION ALL SELECT paper_id, label, 'R' || label || 'b' FROM l WHERE label % 5 = 0)"""
MAPPED = f"""{STATED}, mapped AS (SELECT c.paper_id, style, marker, a, n, list_sort(list(reference_id) FILTER (reference_id IS NOT NULL)) AS ids FROM (SELECT DISTINCT * FROM cites) c LEFT JOIN refs ON refs.paper_id = c.paper_id AND style = 'numeric' AND CAST(refs.label AS VARCHAR) = target GROUP BY c.paper_id, style, marker, target, year, a, n)"""


@query("j7_citation_status", f"WITH {PAPERS}, {CITATIONS}, {MAPPED} SELECT paper_id, style, marker, CAST(a AS INTEGER) AS start, CAST(a + n AS INTEGER) AS end_, coalesce(array_to_string(ids, ','), '') AS reference_ids, CASE coalesce(len(ids), 0) WHEN 0 THEN '{integrity.MISSING}' WHEN 1 THEN '{integrity.MATCHED}' ELSE '{integrity.AMBIGUOUS}' END AS status FROM mapped")
def j7_citation_status(spark, d):
    found = integrity.matched_citations(integrity.markers(papers(spark, d)), stated_references(spark, d))
    return found.select("paper_id", "style", "marker", "start", F.col("end").alias("end_"), F.array_join("reference_ids", ",").alias("reference_ids"), "status")


@query("j7_numeric_status", f"""
    WITH {PAPERS}, g AS (SELECT paper_id, unnest(regexp_extract_all(body, '\\[(\\d{{1,9}}(?:\\s*[,;–\\-]\\s*\\d{{1,9}})*)\\]', 1)) AS grp FROM pp),
    parts AS (SELECT paper_id, unnest(regexp_split_to_array(grp, '[,;]')) AS part FROM g),
    ends AS (SELECT paper_id, [CAST(trim(x) AS BIGINT) FOR x IN regexp_split_to_array(trim(part), '[–\\-]')] AS e FROM parts),
    n AS (SELECT DISTINCT paper_id, unnest(CASE WHEN len(e) = 2 THEN CASE WHEN e[2] >= e[1] AND e[2] - e[1] <= 100 THEN range(e[1], e[2] + 1) ELSE [] END ELSE [e[1]] END) AS number FROM ends)
    SELECT paper_id, '[' || number || ']' AS marker, CASE WHEN number NOT BETWEEN 1 AND 20 THEN '{integrity.MISSING}' WHEN number % 5 = 0 THEN '{integrity.AMBIGUOUS}' ELSE '{integrity.MATCHED}' END AS status FROM n""")
def j7_numeric_status(spark, d):
    rows = integrity.matched_citations(integrity.markers(papers(spark, d)).where("style = 'numeric'"), stated_references(spark, d))
    return rows.select("paper_id", "marker", "status").distinct()


@query("w6_reference_use", f"""
    WITH {PAPERS}, g AS (SELECT paper_id, unnest(regexp_extract_all(body, '\\[(\\d{{1,9}}(?:\\s*[,;–\\-]\\s*\\d{{1,9}})*)\\]', 1)) AS grp FROM pp),
    parts AS (SELECT paper_id, unnest(regexp_split_to_array(grp, '[,;]')) AS part FROM g),
    ends AS (SELECT paper_id, [CAST(trim(x) AS BIGINT) FOR x IN regexp_split_to_array(trim(part), '[–\\-]')] AS e FROM parts),
    n AS (SELECT DISTINCT paper_id, unnest(CASE WHEN len(e) = 2 THEN CASE WHEN e[2] >= e[1] AND e[2] - e[1] <= 100 THEN range(e[1], e[2] + 1) ELSE [] END ELSE [e[1]] END) AS number FROM ends),
    l AS (SELECT paper_id, unnest(range(1, 21)) AS label FROM pp), refs AS (SELECT paper_id, label, 'R' || label AS reference_id FROM l UNION ALL SELECT paper_id, label, 'R' || label || 'b' FROM l WHERE label % 5 = 0)
    SELECT refs.paper_id, reference_id, number IS NOT NULL AND label % 5 <> 0 AS cited, number IS NOT NULL AND label % 5 = 0 AS ambiguous_citation FROM refs LEFT JOIN n ON n.paper_id = refs.paper_id AND n.number = refs.label""")
def w6_reference_use(spark, d):
    references = stated_references(spark, d)
    used = integrity.reference_use(integrity.matched_citations(integrity.markers(papers(spark, d)), references), references)
    return used.select("paper_id", "reference_id", "cited", "ambiguous_citation")


@query("j11_citation_pages", f"""
    WITH {PAPERS}, {CITATIONS}, s AS (SELECT DISTINCT paper_id, unnest(page_spans) AS s FROM papers)
    SELECT c.paper_id, style, marker, CAST(a AS INTEGER) AS start, coalesce(array_to_string(list_sort(list(DISTINCT s.page_number) FILTER (s.page_number IS NOT NULL)), ','), '') AS pages FROM cites c LEFT JOIN s ON s.paper_id = c.paper_id AND a < s.span_end AND a + n > s.span_start GROUP BY c.paper_id, style, marker, a, n, target, year""")
def j11_citation_pages(spark, d):
    rows = papers(spark, d)
    found = integrity.page_of(integrity.markers(rows), rows)
    return found.select("paper_id", "style", "marker", "start", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


@query("j11_middle_pages", """
    WITH x AS (SELECT paper_id, any_value(body) AS body, any_value(page_spans) AS s FROM papers GROUP BY paper_id), m AS (SELECT paper_id, length(body) // 2 AS a, s FROM x WHERE body IS NOT NULL AND length(body) > 0)
    SELECT paper_id, CAST(a AS INTEGER) AS start, coalesce(array_to_string(list_sort(list_distinct([q.page_number FOR q IN s IF a < q.span_end AND a + 1 > q.span_start AND q.page_number IS NOT NULL])), ','), '') AS pages FROM m""")
def j11_middle_pages(spark, d):
    """The page of the middle character of every paper."""
    rows = papers(spark, d)
    middle = rows.where(F.length("body") > 0).select("paper_id", F.floor(F.length("body") / 2).cast("int").alias("start"))
    found = integrity.page_of(middle.withColumn("end", F.col("start") + 1), rows)
    return found.select("paper_id", "start", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


def paper_pages(spark, d):
    """The pages of all papers, each with a running title, and a last one with a bibliography of known entries.

    The test tables have no bibliographies, so every paper gets some, laid out in four ways: year in brackets and
    over two lines, initials first and quoted, year standing alone, and one that cannot be read.
    """
    at = (F.col("page_index") + 1).cast("string")
    shown = bib.pages_of(papers(spark, d)).withColumn("text", F.concat(F.lit("Collected papers of the year\nHere begins page "), at, F.lit(" of it\n"), "text", F.lit("\nHere ends page "), at, F.lit(" of it\n"), at)).withColumn("page_number", at.cast("int"))
    ids = papers(spark, d).select("paper_id", F.explode(F.sequence(F.lit(1), F.lit(4) + F.pmod("paper_id", F.lit(3)).cast("int"))).alias("k"))
    name = F.element_at(F.array(*map(F.lit, SURNAMES)), (F.pmod(F.col("paper_id") + F.col("k"), F.lit(len(SURNAMES))) + 1).cast("int"))
    year, number = (F.lit(1990) + F.pmod(F.col("paper_id") * 7 + F.col("k"), F.lit(30))).cast("string"), F.concat(F.lit("no"), "paper_id", F.lit(" part "), "k")
    laid = F.when(F.col("k") % 4 == 1, F.concat(F.lit("["), "k", F.lit("] "), name, F.lit(", J. ("), year, F.lit("). Study number\n"), number, F.lit(". Journal 12. doi:10.5555/p"), "paper_id", F.lit("."), "k"))
    laid = laid.when(F.col("k") % 4 == 2, F.concat(F.lit("["), "k", F.lit("] A. M. "), name, F.lit(", “Quoted study "), number, F.lit("”, Reports 61, 117 ("), year, F.lit(").")))
    laid = laid.when(F.col("k") % 4 == 3, F.concat(name, F.lit(" J "), year, F.lit(" A standing study "), number, F.lit(", Phys. Rev. 10, 12.")))
    laid = laid.otherwise(F.concat(F.lit("["), "k", F.lit("] an entry that names nobody, number "), "k"))
    entries = ids.select("paper_id", F.struct("k", laid.alias("text")).alias("e")).groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["text"]), "\n").alias("all"))
    last = entries.select("paper_id", F.lit(999).alias("page_index"), F.lit(999).alias("page_number"), F.concat(F.lit("Collected papers of the year\nHere begins page 999 of it\nOne more line of text.\nReferences\n"), "all", F.lit("\nHere ends page 999 of it\n999")).alias("text"))
    return shown.unionByName(last)


SURNAMES = ["Smith", "Jones", "Becker", "Doe", "Roe", "Steane", "Lee", "Kim"]
ENTRIES = f"""{PAPERS}, k AS (SELECT paper_id, unnest(range(1, 5 + CAST(paper_id % 3 AS INTEGER))) AS k FROM pp),
    e AS (SELECT *, {SURNAMES}[CAST((paper_id + k) % 8 + 1 AS INTEGER)] AS name, CAST(1990 + (paper_id * 7 + k) % 30 AS VARCHAR) AS y, 'no' || paper_id || ' part ' || k AS num FROM k),
    entries AS (SELECT paper_id, 'R' || k AS reference_id, CASE WHEN k % 4 <> 3 THEN CAST(k AS BIGINT) END AS label, k % 4 <> 0 AS parsed,
      CASE k % 4 WHEN 1 THEN name || ', J.' WHEN 2 THEN 'A. M. ' || name WHEN 3 THEN name || ' J' ELSE '' END AS authors, CASE WHEN k % 4 = 0 THEN '' ELSE y END AS year,
      CASE k % 4 WHEN 1 THEN 'Study number ' || num WHEN 2 THEN 'Quoted study ' || num WHEN 3 THEN 'A standing study ' || num ELSE '' END AS title,
      CASE WHEN k % 4 = 0 THEN '' ELSE lower(name) END AS surname, CASE WHEN k % 4 = 1 THEN '10.5555/p' || paper_id || '.' || k ELSE '' END AS doi FROM e)"""


@query("q11_references", f"WITH {ENTRIES} SELECT paper_id, reference_id, label, authors, title, year, surname, parsed, doi FROM entries")
def q11_references(spark, d):
    """Margins dropped, the bibliography found, its lines put together as entries and the entries read."""
    return bib.papers_from(paper_pages(spark, d))[1].select("paper_id", "reference_id", "label", "authors", "title", "year", "surname", "parsed", "doi")


@query("q11_notes", f"WITH {PAPERS} SELECT paper_id, true AS found FROM pp")
def q11_notes(spark, d):
    return bib.papers_from(paper_pages(spark, d))[2].select("paper_id", "found")


@query("q11_bodies", f"""
    WITH x AS (SELECT paper_id, any_value(body) AS body, any_value(page_spans) AS s FROM papers WHERE paper_id IS NOT NULL GROUP BY paper_id),
    p AS (SELECT paper_id, coalesce(q.page_number, 0) AS page_number, body[q.span_start + 1:q.span_end] AS t FROM (SELECT paper_id, body, unnest(CASE WHEN len(s) > 0 THEN s ELSE [{{'span_start': 0, 'span_end': length(body), 'page_number': 1}}] END) AS q FROM x WHERE body IS NOT NULL)),
    y AS (SELECT paper_id, count(*) AS pages, sum(len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+'))) AS words FROM p GROUP BY paper_id)
    SELECT x.paper_id, CAST(coalesce(words + 5, 16) AS BIGINT) AS words FROM x LEFT JOIN y USING (paper_id)""")
def q11_bodies(spark, d):
    """Words left in the body: those of the paper and of the line before its bibliography, and no running title (which a paper of one page keeps)."""
    bodies = bib.papers_from(paper_pages(spark, d))[0]
    return bodies.select("paper_id", F.size(F.regexp_extract_all("body", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).cast("bigint").alias("words"))


@query("q12_citations", f"""
    WITH {ENTRIES}, c AS (SELECT paper_id, unnest(range(1, 5)) AS k FROM pp),
    asked AS (SELECT paper_id, 'numeric' AS style, CAST(k + 2 AS VARCHAR) AS target, '' AS year FROM c UNION ALL SELECT paper_id, 'author-year', lower({SURNAMES}[CAST((paper_id + k) % 8 + 1 AS INTEGER)]), CAST(1990 + (paper_id * 7 + k) % 30 AS VARCHAR) FROM c UNION ALL SELECT paper_id, 'DOI', '10.5555/p' || paper_id || '.' || k, '' FROM c),
    met AS (SELECT a.paper_id, a.style, a.target, a.year, list_sort(list(reference_id) FILTER (reference_id IS NOT NULL)) AS ids FROM asked a LEFT JOIN entries e ON e.paper_id = a.paper_id
      AND CASE a.style WHEN 'numeric' THEN CAST(e.label AS VARCHAR) = a.target WHEN 'author-year' THEN e.surname = a.target AND e.year = a.year AND e.parsed ELSE e.doi = a.target END GROUP BY ALL)
    SELECT paper_id, style, target, year, coalesce(array_to_string(ids, ','), '') AS reference_ids, CASE coalesce(len(ids), 0) WHEN 0 THEN '{integrity.MISSING}' WHEN 1 THEN '{integrity.MATCHED}' ELSE '{integrity.AMBIGUOUS}' END AS status FROM met""")
def q12_citations(spark, d):
    """Markers of all three styles in a sentence put to every paper, mapped to the references read from its pages."""
    ids = papers(spark, d).select("paper_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"))
    name = F.element_at(F.array(*map(F.lit, SURNAMES)), (F.pmod(F.col("paper_id") + F.col("k"), F.lit(len(SURNAMES))) + 1).cast("int"))
    cite = F.concat(F.lit("As shown ["), (F.col("k") + 2).cast("string"), F.lit("] and by ("), name, F.lit(", "), (F.lit(1990) + F.pmod(F.col("paper_id") * 7 + F.col("k"), F.lit(30))).cast("string"), F.lit("), see 10.5555/p"), "paper_id", F.lit("."), "k", F.lit(" ."))
    texts = ids.groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list(cite)), "\n").alias("body"))
    references = bib.papers_from(paper_pages(spark, d))[1]
    found = integrity.matched_citations(integrity.markers(texts), references.withColumn("surname", F.nullif("surname", F.lit(""))).withColumn("doi", F.nullif("doi", F.lit(""))))
    return found.select("paper_id", "style", F.when(F.col("style") == "numeric", F.regexp_extract("marker", r"\d+", 0)).when(F.col("style") == "DOI", F.lower("marker")).otherwise(F.lower(F.regexp_extract("marker", r"^\w+", 0))).alias("target"), F.when(F.col("style") == "author-year", F.regexp_extract("marker", r"\d{4}", 0)).otherwise("").alias("year"), F.array_join("reference_ids", ",").alias("reference_ids"), "status")


@query("a21_margins", r"""
    WITH {PAGES}, l AS (SELECT document_id, page_number, unnest(range(0, len(x))) AS line_no, unnest(x) AS line FROM (SELECT document_id, page_number, regexp_split_to_array(regexp_replace(page_text, '\n\z', ''), '\r?\n') AS x FROM p WHERE coalesce(page_text, '') <> '')),
    t AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160)) AS bare FROM l),
    o AS (SELECT *, sum(CASE WHEN bare <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page_number ORDER BY line_no) AS top, sum(CASE WHEN bare <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page_number) AS solid FROM t),
    k AS (SELECT *, CASE WHEN bare <> '' AND solid >= 4 AND (top <= 2 OR top > solid - 2) AND NOT regexp_matches(bare, '^(?:\[(\d+)\]|(\d+)[.)])\s+(.+)')
      AND NOT regexp_matches(bare, '^(?:[A-ZÀ-ÖØ-Þ][\p{L}\p{N}_’''\-]+,\s*(?:[A-Z]\.|[A-Z][a-z]+)|(?:[A-Z]\.\s*)+[A-Z][\p{L}\p{N}_’''\-]+)')
      AND NOT regexp_matches(bare, '^[A-ZÀ-ÖØ-Þ][\p{L}\p{N}_’''\-]+(?:\s+[a-z]+)?\s+[A-Z](?:\s+[A-Z])?(?:\s+(?:and|&|[A-Z][\p{L}\p{N}_’''\-]+)|\s+(?:18|19|20)\d{2})')
      AND NOT regexp_matches(line, '(?i)^\s*(?:(?:\d+(?:\.\d+)*|[IVX]+)[.)]?\s+)?(?:references(?: and notes)?|bibliography|works cited|literature cited|reference list)\s*$')
      AND regexp_replace(bare, '\d+', '#', 'g') <> '#' THEN lower(regexp_replace(bare, '\d+', '#', 'g')) END AS key FROM o),
    often AS (SELECT document_id, key FROM k WHERE key IS NOT NULL GROUP BY ALL HAVING count(DISTINCT page_number) >= 2)
    SELECT document_id, page_number, CAST(line_no AS INTEGER) AS line_no FROM k WHERE bare = CAST(page_number AS VARCHAR) OR (key IS NOT NULL AND (document_id, key) IN (SELECT (document_id, key) FROM often))""".replace("{PAGES}", PAGES))
def a21_margins(spark, d):
    """Running titles, footers and page numbers of all documents, as they are left out of papers."""
    rows = pages(spark, d).select(F.col("document_id").alias("paper_id"), "page_number", F.col("page_text").alias("text"))
    return bib.with_margins(bib.lines_of(rows)).where("margin").select(F.col("paper_id").alias("document_id"), "page_number", "line_no")


def last_pages(spark, d):
    """(paper_id, text): the pages with the bibliographies of `paper_pages`."""
    return paper_pages(spark, d).where("page_number = 999").select("paper_id", "text")


@query("t19_heading_lines", f"WITH {PAPERS} SELECT paper_id, CAST(4 AS INTEGER) AS line_no, 'References' AS line FROM pp")
def t19_heading_lines(spark, d):
    return integrity.heading_lines(last_pages(spark, d), "paper_id", "text")


@query("t15_dois", f"WITH {ENTRIES} SELECT paper_id, doi FROM entries WHERE doi <> ''")
def t15_dois(spark, d):
    return last_pages(spark, d).select("paper_id", F.explode(t.dois(F.col("text"))).alias("doi"))


@query("s8_resolved_references", f"WITH {ENTRIES} SELECT paper_id, doi, CASE WHEN length(doi) % 2 = 0 THEN 'Verified by DOI' ELSE 'Not found' END AS status FROM entries WHERE doi <> ''")
def s8_resolved_references(spark, d):
    """DOIs of the bibliographies, looked up in a table of works that has those of even length."""
    rows = last_pages(spark, d).select("paper_id", F.posexplode(t.dois(F.col("text"))).alias("position", "doi")).withColumn("parsed", F.lit(True))
    works = rows.select("doi").distinct().where(F.length("doi") % 2 == 0).select("doi", F.lit("a work").alias("title"), F.lit("2020").alias("year"), F.lit(True).alias("open_access"))
    return resolved_references(rows, works, consent=True).select("paper_id", "doi", "status")


@query("t3_words", f"WITH {PAPERS} SELECT paper_id, len(regexp_extract_all(body, '[\\p{{L}}\\p{{N}}_]+(?:[''’\\-][\\p{{L}}\\p{{N}}_]+)*')) AS words FROM pp WHERE body IS NOT NULL")
def t3_words(spark, d):
    return papers(spark, d).where("body is not null").select("paper_id", F.size(matches("plain_words", F.col("body"))).cast("bigint").alias("words"))


RUNS = """
    a AS (SELECT doc_id, [lower(x) FOR x IN regexp_extract_all(text, '[\\p{L}\\p{N}_]+(?:[''’\\-][\\p{L}\\p{N}_]+)*')] AS w FROM documents), b AS (SELECT item_id, [lower(x) FOR x IN regexp_extract_all(text, '[\\p{L}\\p{N}_]+(?:[''’\\-][\\p{L}\\p{N}_]+)*')] AS w FROM eval_items),
    ga AS (SELECT doc_id, unnest(range(0, len(w) - 7)) AS i, unnest([array_to_string(w[i:i + 7], chr(1)) FOR i IN range(1, len(w) - 6)]) AS g FROM a WHERE len(w) >= 8),
    gb0 AS (SELECT item_id, unnest(range(0, len(w) - 7)) AS j, unnest([array_to_string(w[i:i + 7], chr(1)) FOR i IN range(1, len(w) - 6)]) AS g FROM b WHERE len(w) >= 8),
    gb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, g ORDER BY j) AS n FROM gb0) WHERE n <= 20),
    met AS (SELECT doc_id, item_id, i, i - j AS d, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS island FROM ga JOIN gb USING (g)),
    runs AS (SELECT doc_id, item_id, d, min(i) AS a, max(i) + 8 AS b FROM met GROUP BY doc_id, item_id, d, island),
    walk AS (SELECT DISTINCT doc_id, item_id, CAST(0 AS BIGINT) AS at_, CAST(NULL AS STRUCT(s BIGINT, b BIGINT, d BIGINT)) AS run FROM runs
      UNION ALL SELECT doc_id, item_id, run.b, run FROM (SELECT w.doc_id, w.item_id, arg_min({'s': greatest(r.a, w.at_), 'b': r.b, 'd': r.d}, {'s': greatest(r.a, w.at_), 'b': -r.b, 'd': -r.d}) AS run
        FROM walk w JOIN runs r ON r.doc_id = w.doc_id AND r.item_id = w.item_id AND r.b - 8 >= greatest(r.a, w.at_) GROUP BY w.doc_id, w.item_id)),
    greedy AS (SELECT doc_id, item_id, run.s AS word_start, run.b AS word_end, run.s - run.d AS source_start, run.b - run.d AS source_end FROM walk WHERE run IS NOT NULL)"""


@query("q13_exact_runs", f"WITH RECURSIVE {RUNS} SELECT * FROM greedy")
def q13_exact_runs(spark, d):
    return integrity.exact_runs(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query("j8_seed_pairs", """
    WITH a AS (SELECT doc_id, [lower(x) FOR x IN regexp_extract_all(text, '[\\p{L}\\p{N}_]+(?:[''’\\-][\\p{L}\\p{N}_]+)*')] AS w FROM documents), b AS (SELECT item_id, [lower(x) FOR x IN regexp_extract_all(text, '[\\p{L}\\p{N}_]+(?:[''’\\-][\\p{L}\\p{N}_]+)*')] AS w FROM eval_items),
    ga AS (SELECT doc_id, unnest([array_to_string(w[i:i + 7], chr(1)) FOR i IN range(1, len(w) - 6)]) AS g FROM a WHERE len(w) >= 8), gb AS (SELECT item_id, unnest([array_to_string(w[i:i + 7], chr(1)) FOR i IN range(1, len(w) - 6)]) AS g FROM b WHERE len(w) >= 8)
    SELECT DISTINCT doc_id, item_id FROM ga JOIN gb USING (g)""")
def j8_seed_pairs(spark, d):
    return integrity.exact_runs(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


@query("a16_overlap", f"""WITH RECURSIVE {RUNS}, covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(word_start, word_end)) AS i FROM greedy) GROUP BY doc_id)
    SELECT a.doc_id, CAST(len(w) AS BIGINT) AS words, coalesce(n, 0) AS overlapping_words, CASE WHEN len(w) > 0 THEN 100.0::DOUBLE * coalesce(n, 0) / len(w) ELSE 0.0 END AS overlap_percentage FROM a LEFT JOIN covered USING (doc_id)""")
def a16_overlap(spark, d):
    documents = table(spark, d, "documents")
    totals = documents.select("doc_id", F.size(matches("plain_words", F.col("text"))).cast("bigint").alias("words"))
    return integrity.overlap_report(integrity.exact_runs(documents, table(spark, d, "eval_items")), totals, "doc_id")


@query("q13_matches")
def q13_matches(spark, d):
    """Exact runs, and nearly equal windows in none of them, of every document and item."""
    return integrity.compared_sources(table(spark, d, "documents"), table(spark, d, "eval_items")).drop("ranges")


@query("q13_report")
def q13_report(spark, d):
    documents = table(spark, d, "documents")
    totals = documents.select("doc_id", F.size(matches("plain_words", F.col("text"))).cast("bigint").alias("words"))
    return integrity.comparison_report(integrity.compared_sources(documents, table(spark, d, "eval_items")), totals, "doc_id")


@query("q13_exact_items", """
    WITH a AS (SELECT doc_id, [lower(x) FOR x IN regexp_extract_all(text, '[\\p{L}\\p{N}_]+(?:[''’\\-][\\p{L}\\p{N}_]+)*')] AS w FROM documents), b AS (SELECT item_id, [lower(x) FOR x IN regexp_extract_all(text, '[\\p{L}\\p{N}_]+(?:[''’\\-][\\p{L}\\p{N}_]+)*')] AS w FROM eval_items),
    ga AS (SELECT doc_id, unnest(range(0, len(w) - 7)) AS i, unnest([array_to_string(w[i:i + 7], chr(1)) FOR i IN range(1, len(w) - 6)]) AS g FROM a WHERE len(w) >= 8), gb AS (SELECT item_id, unnest([array_to_string(w[i:i + 7], chr(1)) FOR i IN range(1, len(w) - 6)]) AS g FROM b WHERE len(w) >= 8)
    SELECT doc_id, item_id, CAST(min(i) AS BIGINT) AS first_word FROM ga JOIN gb USING (g) GROUP BY ALL""")
def q13_exact_items(spark, d):
    """Where the first exact run of each document and item begins."""
    found = integrity.compared_sources(table(spark, d, "documents"), table(spark, d, "eval_items")).where(F.col("match_type") == integrity.EXACT)
    return found.groupBy("doc_id", "item_id").agg(F.min("word_start").alias("first_word"))


@query("w12_windows", f"WITH {PAPERS}, x AS (SELECT paper_id, len(regexp_extract_all(body, '[\\p{{L}}\\p{{N}}_]+(?:[''’\\-][\\p{{L}}\\p{{N}}_]+)*')) AS n FROM pp WHERE body IS NOT NULL), w AS (SELECT paper_id, n, unnest(range(0, (n + 59) // 60)) AS i FROM x) SELECT paper_id, CAST(i AS INTEGER) AS window_no, CAST(least(60, n - 60 * i) AS INTEGER) AS words FROM w WHERE least(60, n - 60 * i) >= 8")
def w12_windows(spark, d):
    return integrity.windows(papers(spark, d), "paper_id", "body").select("paper_id", F.col("window").alias("window_no"), F.size("words").alias("words"))


@query("j9_near_exact")
def j9_near_exact(spark, d):
    return integrity.near_exact(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query("j12_attribution", f"""
    WITH {PAPERS}, {CITATIONS}, {MAPPED}, m AS (SELECT DISTINCT paper_id, a, n FROM cites WHERE style = 'author-year'),
    q AS (SELECT DISTINCT m.* FROM m JOIN quotes o ON o.paper_id = m.paper_id AND o.a <= m.a AND m.a + m.n <= o.a + o.n),
    k AS (SELECT DISTINCT m.* FROM m JOIN mapped c ON c.paper_id = m.paper_id AND len(c.ids) = 1 AND c.a <= m.a + m.n + 180 AND c.a + c.n >= m.a - 80 JOIN texts t ON t.paper_id = m.paper_id
      WHERE list_has_any(c.ids, ['R' || i FOR i IN range(1, 21)]) AND NOT contains(t.text[least(c.a + c.n, m.a + m.n) + 1:greatest(c.a, m.a)], chr(10) || chr(10)))
    SELECT m.paper_id, CAST(m.a AS INTEGER) AS start, CAST(m.a + m.n AS INTEGER) AS end_, q.a IS NOT NULL AS quoted, k.a IS NOT NULL AS cited FROM m LEFT JOIN q ON q.paper_id = m.paper_id AND q.a = m.a AND q.n = m.n LEFT JOIN k ON k.paper_id = m.paper_id AND k.a = m.a AND k.n = m.n""")
def j12_attribution(spark, d):
    """Every author-year citation of a paper held against its quotations and uniquely matched citations."""
    rows = papers(spark, d)
    cited = integrity.matched_citations(integrity.markers(rows), stated_references(spark, d))
    found = integrity.markers(rows).where("style = 'author-year'").select("paper_id", "start", "end", F.xxhash64("paper_id", "start", "end").alias("match_id"), F.array(*[F.lit(f"R{n}") for n in range(1, 21)]).alias("source_ids")).distinct()
    quoted = rows.select("paper_id", F.explode(matches("quotes", F.col("body"))).alias("q")).select("paper_id", "q.*")
    return integrity.attribution(found, quoted, cited, rows).select("paper_id", "start", F.col("end").alias("end_"), "quoted", "cited")


@query("a20_observations", f"""
    WITH {PAPERS}, s AS (SELECT paper_id, unnest(string_split(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM pp WHERE body IS NOT NULL),
    n AS (SELECT paper_id, len(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]+(?:[''’\\-][\\p{{L}}\\p{{N}}_]+)*')) AS n FROM s)
    SELECT paper_id, count(*) AS sentences, CAST(min(n) AS INTEGER) AS least_words, CAST(max(n) AS INTEGER) AS most_words FROM n WHERE n >= 4 GROUP BY paper_id""")
def a20_observations(spark, d):
    return integrity.writing_observations(papers(spark, d), "paper_id", "body").drop("average_words")


@query("a20_openings", f"""
    WITH {PAPERS}, s AS (SELECT paper_id, unnest(string_split(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM pp WHERE body IS NOT NULL),
    w AS (SELECT paper_id, regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]+(?:[''’\\-][\\p{{L}}\\p{{N}}_]+)*') AS w FROM s)
    SELECT paper_id, lower(array_to_string(w[1:3], ' ')) AS opening, count(*) AS sentences FROM w WHERE len(w) >= 4 GROUP BY ALL HAVING count(*) > 1""")
def a20_openings(spark, d):
    return integrity.repeated_openings(papers(spark, d), "paper_id", "body")


@query("a21_edge_lines", f"""
    WITH {PAGES}, x AS (SELECT document_id, page_number, list_filter(string_split(page_text, chr(10)), lambda l: trim(l, ' ') <> '') AS l FROM p WHERE page_text IS NOT NULL),
    e AS (SELECT document_id, page_number, unnest(l[1:2] || l[-2:]) AS line FROM x WHERE len(l) >= 4),
    y AS (SELECT DISTINCT document_id, page_number, lower(regexp_replace(trim(replace(line, chr(13), ''), ' '), '\\d+', '#', 'g')) AS line FROM e)
    SELECT document_id, line, count(*) AS pages FROM y GROUP BY ALL HAVING count(*) >= 2 AND line <> '#'""")
def a21_edge_lines(spark, d):
    return integrity.edge_lines(pages(spark, d))


@query("u5_source_status", """
    WITH x AS (SELECT paper_id, any_value(digest) AS digest FROM papers WHERE paper_id IS NOT NULL GROUP BY paper_id), y AS (SELECT *, row_number() OVER (PARTITION BY paper_id // 25 ORDER BY paper_id) AS position FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY paper_id // 25, digest ORDER BY position) AS again FROM y)
    SELECT paper_id AS source_id, CASE WHEN digest IS NULL THEN 'Unavailable' WHEN position > 10 THEN 'Not checked: limit' WHEN again > 1 THEN 'Not checked: duplicate' ELSE 'Checked' END AS status FROM z""")
def u5_source_status(spark, d):
    """All papers as sources, those of 25 ids in a row of one submitted paper."""
    sources = papers(spark, d).select(F.col("paper_id").alias("source_id"), "digest", F.floor(F.col("paper_id") / 25).alias("paper_id"))
    return integrity.deduplicated_sources(sources, None, ["source_id"]).select("source_id", "status")


@query("t27_bounded_chunks", f"WITH {CHUNKS} SELECT document_id, chunk_id, length(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) AS chars FROM c WHERE text IS NOT NULL AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]')")
def t27_bounded_chunks(spark, d):
    return summary.bounded(chunks(spark, d)).select("document_id", "chunk_id", F.length("text").cast("bigint").alias("chars"))


@query("t27_bounded_pieces", f"""
    WITH {CHUNKS}, x AS (SELECT document_id, chunk_id, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS x FROM c WHERE text IS NOT NULL AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]')),
    p AS (SELECT *, unnest(CASE WHEN octet_length(encode(x)) + 100 <= 1000 THEN [0] ELSE range(0, length(x), 225) END) AS o, octet_length(encode(x)) + 100 <= 1000 AS fits FROM x)
    SELECT document_id, CASE WHEN fits THEN chunk_id ELSE chunk_id || ':' || o END AS chunk_id, CASE WHEN fits THEN x ELSE x[o + 1:o + 225] END AS text FROM p""")
def t27_bounded_pieces(spark, d):
    """Under a budget of 1000 bytes most chunks are cut."""
    return summary.bounded(chunks(spark, d), 1000).select("document_id", "chunk_id", "text")


@query("w15_summary_groups", f"""
    WITH RECURSIVE {CHUNKS}, x AS (SELECT document_id, page_number, chunk_ord, chunk_id, CAST(octet_length(encode(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)))) + 100 AS BIGINT) AS cost FROM c WHERE text IS NOT NULL AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]')),
    o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number, chunk_ord, chunk_id) AS n FROM x),
    g AS (SELECT document_id, n, CAST(1 AS BIGINT) AS group_no, CAST(1 AS BIGINT) AS held, cost AS total FROM o WHERE n = 1
      UNION ALL SELECT o.document_id, o.n, CASE WHEN held >= 20 OR total + cost > 10000 THEN group_no + 1 ELSE group_no END, CASE WHEN held >= 20 OR total + cost > 10000 THEN 1 ELSE held + 1 END, CASE WHEN held >= 20 OR total + cost > 10000 THEN cost ELSE total + cost END FROM g JOIN o ON o.document_id = g.document_id AND o.n = g.n + 1)
    SELECT document_id, page_number, chunk_ord, chunk_id, CAST(0 AS INTEGER) AS "offset", cost, group_no FROM g JOIN o USING (document_id, n)""")
def w15_summary_groups(spark, d):
    return summary.grouped(summary.bounded(chunks(spark, d)), ["page_number", "chunk_ord", "chunk_id", "offset"])


@query("q4_extractive_summary", f"""
    WITH {CHUNKS}, b AS (SELECT document_id, page_number, chunk_id, chunk_ord, string_split(regexp_replace(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)) AS parts FROM c WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]')),
    s0 AS (SELECT document_id, page_number, chunk_id, chunk_ord, unnest(range(0, len(parts))) AS n, trim(unnest(parts)) AS sentence FROM b),
    s AS (SELECT *, [lower(x) FOR x IN regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}_]{{4,}}')] AS w FROM s0 WHERE length(sentence) >= 25 AND regexp_matches(sentence, '[\\p{{L}}\\p{{N}}]')),
    o AS (SELECT document_id, chunk_id, n, unnest(w) AS word FROM s), f AS (SELECT document_id, word, count(*) AS f FROM o GROUP BY ALL),
    g AS (SELECT o.document_id, o.chunk_id, o.n, sum(f) AS weight FROM o JOIN f USING (document_id, word) GROUP BY ALL),
    x AS (SELECT s.*, coalesce(weight, 0)::DOUBLE / greatest(1, length(sentence)) AS score FROM s LEFT JOIN g USING (document_id, chunk_id, n)),
    t AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY score DESC, chunk_ord, chunk_id, n) AS turn, max(score) OVER (PARTITION BY document_id, page_number) AS best FROM x),
    u AS (SELECT *, row_number() OVER (PARTITION BY document_id, sentence ORDER BY turn, best DESC, page_number) AS seen FROM t),
    v AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY turn, best DESC, page_number) AS position FROM u WHERE seen = 1)
    SELECT document_id, position, page_number, chunk_id, sentence FROM v WHERE position <= 8""")
def q4_extractive_summary(spark, d):
    return summary.extractive(summary.bounded(chunks(spark, d)), ["document_id"], ["chunk_ord"]).drop("score")


@query("w18_token_windows", f"WITH RECURSIVE {PAPERS}, {WINDOWS} SELECT paper_id, window_no, start, end_, tokens, CASE WHEN window_no >= 200 THEN 'beyond the passage limit' END AS skipped FROM wins")
def w18_token_windows(spark, d):
    return coverage.windows(papers(spark, d), "paper_id", "body", capacity=128).withColumnsRenamed({"window": "window_no", "end": "end_"})


@query("a18_word_coverage", f"""
    WITH RECURSIVE {PAPERS}, {WINDOWS}, j AS (SELECT w.paper_id, w.a, bool_or(window_no % 2 = 1) AS flagged FROM words w JOIN wins s ON s.paper_id = w.paper_id AND s.start <= w.a AND w.a + w.n <= s.end_ AND window_no < 200 GROUP BY ALL),
    k AS (SELECT paper_id, count(*) AS judged, count(*) FILTER (flagged) AS flagged FROM j GROUP BY paper_id), t AS (SELECT paper_id, count(*) AS words FROM words GROUP BY paper_id)
    SELECT paper_id, words, coalesce(judged, 0) AS judged, coalesce(flagged, 0) AS flagged, round(100.0::DOUBLE * flagged / judged, 6) AS flagged_percentage FROM t LEFT JOIN k USING (paper_id)""")
def a18_word_coverage(spark, d):
    """Windows stand in as flagged where their number is odd: a detector is a pluggable input."""
    rows = papers(spark, d)
    spans = coverage.windows(rows, "paper_id", "body", capacity=128).where("skipped is null")
    covered = coverage.word_coverage(rows, spans, "paper_id", "body", F.col("window") % 2 == 1)
    return covered.withColumn("flagged_percentage", F.round("flagged_percentage", 6))


@query("a19_aligned_passages", """
    WITH p AS (SELECT document_id, page_number, min(page_text) AS body FROM doc_pages WHERE page_text IS NOT NULL GROUP BY ALL), v AS (SELECT view_id, any_value(document_id) AS document_id, any_value(page_number) AS page_number, any_value(passage) AS passage FROM source_views GROUP BY view_id),
    x AS (SELECT view_id, body, passage, instr(body, passage) AS a FROM v JOIN p USING (document_id, page_number) WHERE length(passage) > 0)
    SELECT view_id, CAST(CASE WHEN a > 0 AND instr(body[a + 1:], passage) = 0 THEN a - 1 END AS INTEGER) AS start FROM x""")
def a19_aligned_passages(spark, d):
    seen = views(spark, d).where("length(passage) > 0").select("view_id", "passage", "document_id", "page_number")
    text = pages(spark, d).where("page_text is not null").select("document_id", "page_number", F.col("page_text").alias("body"))
    rows = seen.join(text, ["document_id", "page_number"])
    return coverage.aligned(rows.select("view_id", "body"), rows.select("view_id", "passage", F.lit(None).cast("boolean").alias("flag")), "view_id", "body").select("view_id", "start")


@query("t35_marked_html", f"WITH {CHUNKS} SELECT document_id, chunk_id, length('<mark>' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') || '</mark>') AS chars FROM c WHERE text IS NOT NULL")
def t35_marked_html(spark, d):
    return chunks(spark, d).where("text is not null").select("document_id", "chunk_id", F.length(t.marked_html(F.col("text"), F.lit(True))).cast("bigint").alias("chars"))


@query("t36_excerpts", f"WITH {CHUNKS}, x AS (SELECT document_id, chunk_id, text, text[1:120] AS h FROM c WHERE text IS NOT NULL) SELECT document_id, chunk_id, CASE WHEN length(text) <= 120 THEN text WHEN trim(regexp_extract(h, '(?s)^(.*)\\s\\S*$', 1), ' ') <> '' THEN regexp_extract(h, '(?s)^(.*)\\s\\S*$', 1) ELSE h END AS excerpt FROM x")
def t36_excerpts(spark, d):
    return chunks(spark, d).where("text is not null").select("document_id", "chunk_id", t.excerpt(F.col("text"), 120).alias("excerpt"))


@query("t33_error_categories", """
    WITH x AS (SELECT document_id, filename, CAST(coalesce(file_size, 0) % 8 AS INTEGER) + 1 AS k FROM doc_records)
    SELECT document_id, filename, ['authentication', 'rate_limit', 'quota_exhausted', 'service', 'model_configuration', 'invalid_input', 'timeout', 'unknown'][k] AS category, k IN (2, 4, 7) AS transient FROM x""")
def t33_error_categories(spark, d):
    """A log in which every upload met one of eight errors."""
    kinds = [(403, "denied"), (429, "rate limit"), (429, "quota exceeded per day"), (503, "unavailable"), (400, "Model not found"), (400, "bad field"), (None, "read timeout"), (418, "teapot")]
    k = (F.coalesce("file_size", F.lit(0)) % 8 + 1).cast("int")
    rows = records(spark, d).select("document_id", "filename", F.element_at(F.array(*[F.lit(c).cast("int") for c, _ in kinds]), k).alias("code"), F.element_at(F.array(*[F.lit(m) for _, m in kinds]), k).alias("message"))
    category = responses.error_category(F.col("code"), F.col("message"))
    return rows.select("document_id", "filename", category.alias("category"), responses.is_transient(category).alias("transient"))


@query("t30_answers", """
    WITH v AS (SELECT DISTINCT view_id FROM source_views WHERE view_id IS NOT NULL)
    SELECT view_id, CASE view_id % 4 WHEN 0 THEN 'Yes ' || view_id WHEN 1 THEN 'Fenced' WHEN 2 THEN 'Cut E4 and E' || view_id END AS answer, CASE view_id % 4 WHEN 0 THEN 'E' || view_id WHEN 1 THEN 'E2,E3' WHEN 2 THEN CASE WHEN view_id = 4 THEN 'E4' ELSE 'E4,E' || view_id END END AS ids FROM v""")
def t30_answers(spark, d):
    """A response for every view: whole, fenced, truncated or unreadable by its id."""
    n, fence = F.col("view_id").cast("string"), "`" * 3
    kind = F.col("view_id") % 4
    text = F.when(kind == 0, F.concat(F.lit('{"answer": "Yes '), n, F.lit('", "evidence_ids": ["E'), n, F.lit('"], "sufficient_evidence": true}'))).when(kind == 1, F.lit(f'Here: {fence}json\n{{"answer": "Fenced", "evidence_ids": ["E2", "E3"]}}\n{fence}')).when(kind == 2, F.concat(F.lit('{"answer": "Cut E4 and E'), n, F.lit('", "suffic'))).otherwise("no object")
    rows = views(spark, d).select("view_id", responses.answer_of(text).alias("a"))
    return rows.select("view_id", F.col("a.answer").alias("answer"), F.array_join("a.evidence_ids", ",").alias("ids"))


@query("t32_response_states", "SELECT DISTINCT view_id, view_id % 3 = 0 AS at_limit FROM source_views WHERE view_id IS NOT NULL")
def t32_response_states(spark, d):
    reason = F.when(F.col("view_id") % 3 == 0, "FinishReason.MAX_TOKENS").when(F.col("view_id") % 3 == 1, "STOP")
    return views(spark, d).select("view_id", responses.finished_at_limit(reason).alias("at_limit"))


@query("x3_corpus_health", f"WITH {PAGES}, e AS (SELECT document_id, bool_or(extraction_method = 'Failed') AS failed FROM p GROUP BY document_id) SELECT coalesce(failed, false) AS failed, count(*) AS documents FROM e GROUP BY ALL")
def x3_corpus_health(spark, d):
    rows = pages(spark, d).groupBy("document_id").agg(F.coalesce(F.bool_or(F.col("extraction_method") == "Failed"), F.lit(False)).alias("failed"))
    return rows.groupBy("failed").agg(F.count(F.lit(1)).alias("documents"))
