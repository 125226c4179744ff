"""Queries of retrieval and evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions.text import evidence_terms, lexical_tokens
from lectern.operators import comparison, evidence, retrieval
from lectern.plans.common import ASKED, CHUNKS, QUERIES, STOP, TOKEN, chunks
from lectern.plans.registry import query
from lectern.sources.tables import table

KEY = ["document_id", "chunk_id"]
TERMS = f"{CHUNKS}, t AS (SELECT document_id, chunk_id, [lower(x) FOR x IN regexp_extract_all(text, {TOKEN})] AS w FROM c)"
POST = f"{TERMS}, o AS (SELECT document_id, chunk_id, len(w) AS length, unnest(w) AS term FROM t), post AS (SELECT document_id, chunk_id, length, term, count(*) AS tf FROM o GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term), tot AS (SELECT count(*)::DOUBLE AS n, greatest(1.0, avg(len(w))) AS average FROM t)"
SCORED = f"""{POST}, {ASKED}, asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, lower(unnest(regexp_extract_all(query, {TOKEN}))) AS term FROM q) GROUP BY ALL),
    kw AS (SELECT query_id, document_id, chunk_id, sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / average))) AS keyword_score
      FROM post JOIN df USING (term) JOIN asked USING (term), tot GROUP BY ALL)"""
UNITS = """u AS (SELECT vec_id, any_value(document_id) AS document_id, any_value(chunk_id) AS chunk_id, any_value(CAST(embedding AS DOUBLE[])) AS e FROM chunk_vectors WHERE len(embedding) = 64 GROUP BY vec_id),
    units AS (SELECT * FROM u WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    qv AS (SELECT row_number() OVER (ORDER BY vec_id) AS query_id, e AS qe FROM (SELECT * FROM units ORDER BY vec_id LIMIT 3)),
    sem AS (SELECT query_id, vec_id, document_id, chunk_id, list_cosine_similarity(e, qe) AS similarity FROM units, qv)"""


def stated(spark, rows):
    """Literal (query_id, query) rows as a local relation: the planner knows its size, and so how to join it."""
    values = ", ".join(f"({n}, '{text}')" for n, text in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS v(query_id, query)")


def queries_of(spark, units=None):
    """The stated queries; with `units`, each with one of the three first vectors as its vector."""
    asked = stated(spark, QUERIES)
    if units is None:
        return asked
    first = units.select("vec_id", "unit").orderBy("vec_id").limit(3)
    return asked.join(first.select(F.row_number().over(Window.orderBy("vec_id")).alias("query_id"), F.col("unit").alias("query_vector")), "query_id")


@query("t1_tokens", f"WITH {TERMS} SELECT document_id, chunk_id, len(w) AS tokens FROM t")
def t1_tokens(spark, d):
    return chunks(spark, d).select(*KEY, F.size(lexical_tokens(F.col("text"))).cast("bigint").alias("tokens"))


@query("a1_index_terms", f"WITH {POST} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM post GROUP BY term")
def a1_index_terms(spark, d):
    return retrieval.postings(retrieval.chunk_terms(chunks(spark, d))).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


@query("a1_index_totals", f"WITH {TERMS} SELECT count(*) AS chunks, round(greatest(1.0, avg(len(w))), 6) AS average_length FROM t")
def a1_index_totals(spark, d):
    rows = retrieval.index_totals(retrieval.chunk_terms(chunks(spark, d)))
    return rows.select("chunks", F.round("average_length", 6).alias("average_length"))


@query("a2_keyword_topk", f"WITH {SCORED} SELECT query_id, document_id, chunk_id, rank, round(keyword_score, 6) AS keyword_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(keyword_score, 9) DESC, document_id, chunk_id) AS rank FROM kw) WHERE rank <= 12")
def a2_keyword_topk(spark, d):
    scores = retrieval.keyword_scores(retrieval.chunk_terms(chunks(spark, d)), queries_of(spark)).withColumn("keyword_score", F.round("keyword_score", 9))
    return retrieval.top_ranked(scores, 12, "keyword_score", KEY).select("query_id", *KEY, "rank", F.round("keyword_score", 6).alias("keyword_score"))


@query("f1_keyword_one_document", f"WITH {SCORED}, one AS (SELECT min(document_id) AS m FROM c) SELECT query_id, document_id, chunk_id, round(keyword_score, 6) AS keyword_score FROM kw, one WHERE document_id = m")
def f1_keyword_one_document(spark, d):
    """Scores within the first document; frequencies and lengths stay those of the corpus."""
    rows = chunks(spark, d)
    scope = F.col("document_id") == rows.agg(F.min("document_id")).scalar()
    scores = retrieval.keyword_scores(retrieval.chunk_terms(rows), queries_of(spark), scope=scope)
    return scores.withColumn("keyword_score", F.round("keyword_score", 6))


@query("a2_indexed_topk", f"""
    WITH {ASKED}, asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, lower(unnest(regexp_extract_all(query, {TOKEN}))) AS term FROM q) GROUP BY ALL),
    b AS (SELECT chunk_row, any_value(term_frequencies) AS m, any_value(document_length) AS length FROM bm25_rows WHERE term_frequencies IS NOT NULL GROUP BY chunk_row),
    tot AS (SELECT count(*)::DOUBLE AS n, greatest(1.0, coalesce(avg(length), 0)) AS average FROM b),
    post AS (SELECT chunk_row, length, unnest(map_keys(m)) AS term, unnest(map_values(m)) AS tf FROM b), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    s AS (SELECT query_id, chunk_row, round(sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / average))), 9) AS score FROM post JOIN df USING (term) JOIN asked USING (term), tot GROUP BY ALL)
    SELECT query_id, chunk_row, rank, round(score, 6) AS keyword_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, chunk_row) AS rank FROM s) WHERE rank <= 12""")
def a2_indexed_topk(spark, d):
    scores = retrieval.indexed_scores(table(spark, d, "bm25_rows"), queries_of(spark)).withColumn("keyword_score", F.round("keyword_score", 9))
    return retrieval.top_ranked(scores, 12, "keyword_score", ["chunk_row"]).select("query_id", "chunk_row", "rank", F.round("keyword_score", 6).alias("keyword_score"))


@query("j4_cosine_topk", f"WITH {UNITS} SELECT query_id, vec_id, rank, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM sem) WHERE rank <= 10")
def j4_cosine_topk(spark, d):
    units = retrieval.usable_vectors(table(spark, d, "chunk_vectors"))
    scores = retrieval.semantic_scores(units, queries_of(spark, units)).withColumn("similarity", F.round("similarity", 9))
    return retrieval.top_ranked(scores, 10, "similarity", ["vec_id"]).select("query_id", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


EACH = f"{UNITS}, every AS (SELECT q.vec_id AS query_id, x.vec_id, list_cosine_similarity(x.e, q.e) AS similarity FROM units x, units q WHERE q.vec_id % 20 = 0)"


def each_twentieth(units):
    """Every vector whose id is divisible by 20 as a query."""
    return units.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("unit").alias("query_vector"))


@query("j4_cosine_topk_twentieth", f"WITH {EACH} SELECT query_id, vec_id, rank, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM every) WHERE rank <= 10")
def j4_cosine_topk_twentieth(spark, d):
    units = retrieval.usable_vectors(table(spark, d, "chunk_vectors"))
    scores = retrieval.semantic_blocks(units, each_twentieth(units), retrieval.best_of(10)).withColumn("similarity", F.round("similarity", 9))
    return retrieval.top_ranked(scores, 10, "similarity", ["vec_id"]).select("query_id", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


HYBRID = f"""WITH {SCORED}, {UNITS},
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, document_id, chunk_id) AS kr FROM kw) WHERE kr <= 16),
    s0 AS (SELECT query_id, document_id, chunk_id, max(similarity) AS similarity FROM sem GROUP BY ALL),
    s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, document_id, chunk_id) AS sr FROM s0) WHERE sr <= 16),
    f AS (SELECT query_id, document_id, chunk_id, s.similarity AS semantic_similarity, coalesce(s.similarity, 0) AS similarity, keyword_score,
      CASE WHEN sr IS NOT NULL AND kr IS NOT NULL THEN 'Both' WHEN sr IS NOT NULL THEN 'Semantic' ELSE 'Keyword' END AS retrieval_source,
      coalesce(1.0::DOUBLE / (60 + sr), 0) + coalesce(1.0::DOUBLE / (60 + kr), 0) AS rrf FROM s FULL JOIN k USING (query_id, document_id, chunk_id)),
    h AS (SELECT *, rrf / (2.0::DOUBLE / 61) AS hybrid, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, source_filename, page_number, chunk_id, document_id) AS rank FROM f JOIN c USING (document_id, chunk_id))"""


def hybrid_rows(spark, d):
    rows = chunks(spark, d)
    units = retrieval.usable_vectors(table(spark, d, "chunk_vectors"))
    return retrieval.hybrid(rows, retrieval.chunk_terms(rows), units, queries_of(spark, units))


@query("q1_hybrid_retrieval", f"{HYBRID} SELECT query_id, document_id, chunk_id, page_number, retrieval_source, rank, round(hybrid, 6) AS hybrid_score FROM h WHERE rank <= 4")
def q1_hybrid_retrieval(spark, d):
    return hybrid_rows(spark, d).select("query_id", *KEY, "page_number", "retrieval_source", "rank", F.round("hybrid_score", 6).alias("hybrid_score"))


@query("a4_semantic_only", f"WITH {UNITS}, s0 AS (SELECT query_id, document_id, chunk_id, max(similarity) AS similarity FROM sem GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, document_id, chunk_id) AS sr FROM s0) SELECT query_id, document_id, chunk_id, 'Semantic' AS retrieval_source, round(61.0::DOUBLE / (60 + sr), 6) AS hybrid_score FROM s WHERE sr <= 4")
def a4_semantic_only(spark, d):
    units = retrieval.usable_vectors(table(spark, d, "chunk_vectors"))
    scored = retrieval.semantic_scores(units, queries_of(spark, units)).groupBy("query_id", *KEY).agg(F.max("similarity").alias("similarity"))
    found = retrieval.semantic_only(retrieval.top_ranked(scored, 4, "similarity", KEY, name="semantic_rank"))
    return found.select("query_id", *KEY, "retrieval_source", F.round("hybrid_score", 6).alias("hybrid_score"))


@query("o4_query_pool", f"""{HYBRID}, n AS (SELECT *, row_number() OVER (PARTITION BY document_id, chunk_id ORDER BY query_id, rank) AS i FROM h WHERE rank <= 4 AND NOT (retrieval_source = 'Semantic' AND similarity < 0.25))
    SELECT document_id, chunk_id, query_id, rank, round(hybrid, 6) AS hybrid_score FROM n WHERE i = 1 ORDER BY hybrid DESC, query_id, rank, document_id, chunk_id LIMIT 18""")
def o4_query_pool(spark, d):
    return retrieval.pooled(hybrid_rows(spark, d)).select(*KEY, "query_id", "rank", F.round("hybrid_score", 6).alias("hybrid_score"))


def pool_sql(queries):
    """The pools of all documents for these queries, by words alone."""
    asked = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, '{text}')" for n, text in enumerate(queries, 1)) + ") AS v(query_id, query))"
    return f"""{SCORED.replace(ASKED, asked)},
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY round(keyword_score, 9) DESC, chunk_id) AS kr FROM kw),
    h AS (SELECT k.*, c.* EXCLUDE (document_id, chunk_id), (1.0::DOUBLE / (60 + kr)) / (2.0::DOUBLE / 61) AS hybrid, row_number() OVER (PARTITION BY query_id, k.document_id ORDER BY kr, source_filename, page_number, k.chunk_id) AS rank FROM k JOIN c USING (document_id, chunk_id) WHERE kr <= 16),
    n AS (SELECT *, row_number() OVER (PARTITION BY document_id, chunk_id ORDER BY query_id, rank) AS i FROM h WHERE rank <= 4),
    pool AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY hybrid DESC, query_id, rank, chunk_id) AS position FROM n WHERE i = 1)"""


def pools(spark, d, queries):
    rows = chunks(spark, d)
    return retrieval.document_pools(rows, retrieval.chunk_terms(rows), stated(spark, enumerate(queries, 1)))


@query("q5_comparison_pools", f"WITH {pool_sql(comparison.COMPARISON_QUERIES)} SELECT document_id, chunk_id, query_id, position, round(hybrid, 6) AS hybrid_score FROM pool WHERE position <= 18")
def q5_comparison_pools(spark, d):
    """For every document what the seven queries of a comparison find in it."""
    return pools(spark, d, comparison.COMPARISON_QUERIES).select(*KEY, "query_id", "position", F.round("hybrid_score", 6).alias("hybrid_score"))


@query("q6_conflict_pools", f"WITH {pool_sql(comparison.CONFLICT_QUERIES)} SELECT document_id, chunk_id, query_id, position FROM pool WHERE position <= 18")
def q6_conflict_pools(spark, d):
    """For every document what the six queries of a conflict analysis find in it."""
    return pools(spark, d, comparison.CONFLICT_QUERIES).select(*KEY, "query_id", "position")


@query("f5_selected_evidence", f"{HYBRID}, w AS (SELECT *, max(hybrid) OVER (PARTITION BY query_id) AS top FROM h WHERE rank <= 4) SELECT query_id, document_id, chunk_id, rank, retrieval_source FROM w WHERE hybrid >= greatest(0.28, top - 0.25) OR retrieval_source IN ('Keyword', 'Both')")
def f5_selected_evidence(spark, d):
    return evidence.selected_hybrid(hybrid_rows(spark, d)).select("query_id", *KEY, "rank", "retrieval_source")


@query("f6_selected_by_cosine", f"WITH {UNITS}, w AS (SELECT *, max(similarity) OVER (PARTITION BY query_id) AS top FROM sem) SELECT query_id, vec_id, round(similarity, 6) AS similarity FROM w WHERE top >= 0.28 AND similarity >= greatest(0.25, top - 0.15)")
def f6_selected_by_cosine(spark, d):
    units = retrieval.usable_vectors(table(spark, d, "chunk_vectors"))
    rows = evidence.selected_semantic(retrieval.semantic_scores(units, queries_of(spark, units)))
    return rows.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("f6_selected_by_cosine_twentieth", f"WITH {EACH}, w AS (SELECT *, max(similarity) OVER (PARTITION BY query_id) AS top FROM every) SELECT query_id, vec_id, round(similarity, 6) AS similarity FROM w WHERE top >= 0.28 AND similarity >= greatest(0.25, top - 0.15)")
def f6_selected_by_cosine_twentieth(spark, d):
    units = retrieval.usable_vectors(table(spark, d, "chunk_vectors"))
    rows = evidence.selected_semantic(retrieval.semantic_blocks(units, each_twentieth(units), retrieval.near_best()))
    return rows.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("w2_evidence_ids", f"{HYBRID} SELECT query_id, document_id, chunk_id, 'E' || row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, rank) AS evidence_id FROM h WHERE rank <= 4")
def w2_evidence_ids(spark, d):
    return evidence.numbered(hybrid_rows(spark, d), "E", [F.desc("hybrid_score"), "rank"], ["query_id"]).select("query_id", *KEY, "evidence_id")


@query("a5_strength", f"{HYBRID}, g AS (SELECT query_id, max(similarity) AS best, avg(similarity) AS average FROM h WHERE rank <= 4 GROUP BY query_id) SELECT query_id, round(best, 6) AS best, round(average, 6) AS average, CASE WHEN best >= 0.60 AND average >= 0.50 THEN 'High' WHEN best >= 0.40 AND average >= 0.32 THEN 'Moderate' ELSE 'Low' END AS strength FROM g")
def a5_strength(spark, d):
    g = hybrid_rows(spark, d).groupBy("query_id").agg(F.max("similarity").alias("best"), F.avg("similarity").alias("average"))
    return g.select("query_id", F.round("best", 6).alias("best"), F.round("average", 6).alias("average"), evidence.strength(F.col("best"), F.col("average")).alias("strength"))


TERMSET = f"list_distinct(list_filter([lower(x) FOR x IN regexp_extract_all({{}}, {TOKEN})], lambda x: NOT list_contains({STOP}, x) AND (length(x) >= 3 OR regexp_matches(x, '[0-9]'))))"


@query("t2_query_terms", f"WITH {ASKED} SELECT query_id, array_to_string(list_sort({TERMSET.format('query')}), ' ') AS terms FROM q")
def t2_query_terms(spark, d):
    return queries_of(spark).select("query_id", F.array_join(F.array_sort(evidence_terms(F.col("query"))), " ").alias("terms"))


@query("a6_confidence", f"""{HYBRID}, e AS (SELECT h.*, query, {TERMSET.format('query')} AS qt, {TERMSET.format('coalesce(h.text, $$$$)')} AS tt FROM h JOIN q USING (query_id) WHERE rank <= 4),
    g AS (SELECT query_id, count(*) AS support, count(DISTINCT document_id) AS documents, len(list_distinct(flatten(list(list_intersect(tt, qt))))) / len(any_value(qt))::DOUBLE AS term_coverage,
      avg(CASE WHEN retrieval_source = 'Both' THEN 1.0 ELSE 0.0 END) AS agreement, coalesce(max(semantic_similarity), 0) AS top FROM e GROUP BY query_id)
    SELECT query_id, support, documents, round(term_coverage, 6) AS term_coverage, round(agreement, 6) AS agreement, round(top, 6) AS top FROM g""")
def a6_confidence(spark, d):
    facts = evidence.confidence(confidence_queries(spark), confidence_rows(spark, d))
    return facts.select("query_id", "support", "documents", F.round("term_coverage", 6).alias("term_coverage"), F.round("agreement", 6).alias("agreement"), F.round("top", 6).alias("top"))


def confidence_queries(spark):
    return queries_of(spark).withColumn("selected_count", F.lit(4)).withColumn("sufficient", F.lit(True))


def confidence_rows(spark, d):
    return evidence.numbered(hybrid_rows(spark, d), "E", [F.desc("hybrid_score"), "rank"], ["query_id"])


@query("q2_grounded", f"""{HYBRID}, w AS (SELECT *, 'E' || row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, rank) AS evidence_id, max(hybrid) OVER (PARTITION BY query_id) AS best FROM h WHERE rank <= 4),
    chosen AS (SELECT * FROM w WHERE hybrid >= greatest(0.28, best - 0.25) OR retrieval_source IN ('Keyword', 'Both')),
    e AS (SELECT h.*, query, {TERMSET.format('query')} AS qt, {TERMSET.format('coalesce(h.text, $$$$)')} AS tt FROM h JOIN q USING (query_id) WHERE rank <= 4),
    g AS (SELECT query_id, len(list_distinct(flatten(list(list_intersect(tt, qt))))) / len(any_value(qt))::DOUBLE AS tc, coalesce(max(semantic_similarity), 0) AS top, bool_or(keyword_score IS NOT NULL) AS lexical FROM e GROUP BY query_id),
    tops AS (SELECT query_id, max(similarity) AS best, avg(similarity) AS average, list(evidence_id) AS ids FROM chosen GROUP BY query_id),
    gate AS (SELECT query_id, NOT (top < 0.2 AND NOT lexical AND tc < 0.2) AS enough FROM g)
    SELECT query_id, CASE WHEN enough THEN 'Answer to ' || query_id || ' [E2].' ELSE 'I could not find sufficient evidence in the indexed documents to answer this question reliably.' END AS answer,
    CASE WHEN enough THEN array_to_string(list_filter(['E2', 'E1'], lambda x: list_contains(ids, x)), ',') ELSE '' END AS cited,
    CASE WHEN best >= 0.60 AND average >= 0.50 THEN 'High' WHEN best >= 0.40 AND average >= 0.32 THEN 'Moderate' ELSE 'Low' END AS strength FROM tops JOIN gate USING (query_id)""")
def q2_grounded(spark, d):
    """Questions answered from retrieved evidence; the responses of a model are a pluggable input, stated here."""
    text = F.concat(F.lit('{"answer": "Answer to '), F.col("query_id").cast("string"), F.lit(' [E2].", "evidence_ids": ["E2", "E9", "E1", "E2"], "sufficient_evidence": true}'))
    answers, _ = evidence.grounded(queries_of(spark), hybrid_rows(spark, d), queries_of(spark).select("query_id", text.alias("response")))
    return answers.select("query_id", "answer", F.array_join("evidence_ids", ",").alias("cited"), "strength")


MODAL = "['must','shall','required','mandatory','permitted','allowed']"
FORBIDS = "(" + " OR ".join(f"contains(low, '{x}')" for x in ("must not", "shall not", "not permitted", "not allowed", "prohibited", "forbidden")) + ")"


@query("a6_confidence_levels", f"""{HYBRID}, e AS (SELECT h.*, lower(coalesce(h.text, '')) AS low, {TERMSET.format('query')} AS qt, {TERMSET.format("lower(coalesce(h.text, ''))")} AS tt FROM h JOIN q USING (query_id) WHERE rank <= 4),
    m AS (SELECT *, {FORBIDS} AS neg, list_has_any(tt, {MODAL}) AND NOT {FORBIDS} AS pos FROM e),
    clash AS (SELECT DISTINCT a.query_id FROM m a JOIN m b ON a.query_id = b.query_id AND a.pos AND b.neg WHERE list_has_any(list_filter(list_intersect(a.tt, b.tt), lambda x: NOT list_contains({MODAL}, x)), a.qt)),
    g AS (SELECT query_id, count(*) AS support, count(DISTINCT document_id) AS documents, len(list_distinct(flatten(list(list_intersect(tt, qt))))) / len(any_value(qt))::DOUBLE AS tc,
      avg(CASE WHEN retrieval_source = 'Both' THEN 1.0 ELSE 0.0 END) AS agreement, coalesce(max(semantic_similarity), 0) AS top, bool_or(keyword_score IS NOT NULL) AS lexical FROM e GROUP BY query_id),
    p AS (SELECT *, CASE WHEN top >= 0.6 THEN 2 WHEN top >= 0.4 THEN 1 ELSE 0 END + CASE WHEN support >= 3 THEN 2 WHEN support >= 2 THEN 1 ELSE 0 END + CASE WHEN documents >= 2 THEN 1 ELSE 0 END
      + CASE WHEN support / 4.0 >= 0.75 THEN 2 WHEN support / 4.0 >= 0.5 THEN 1 ELSE 0 END + CASE WHEN tc >= 0.6 THEN 1 ELSE 0 END + CASE WHEN agreement >= 0.5 THEN 1 ELSE 0 END AS points, query_id IN (SELECT query_id FROM clash) AS conflict FROM g)
    SELECT query_id, CASE WHEN top < 0.2 AND NOT lexical AND tc < 0.2 THEN 'INSUFFICIENT' WHEN conflict THEN 'LOW' WHEN points >= 7 THEN 'HIGH' WHEN points >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS level, points, conflict FROM p""")
def a6_confidence_levels(spark, d):
    return evidence.confidence(confidence_queries(spark), confidence_rows(spark, d)).select("query_id", "level", "points", "conflict")


@query("f8_valid_citations", f"{HYBRID}, e AS (SELECT query_id, list('E' || rank) AS ids FROM h WHERE rank <= 4 GROUP BY query_id) SELECT query_id, array_to_string(list_filter(['E2', 'E1', 'E9'], lambda x: list_contains(ids, x)), ' ') AS cited FROM e")
def f8_valid_citations(spark, d):
    """Each answer proposes the same ids, one of them twice, one in lower case and one that does not exist."""
    rows = evidence.numbered(hybrid_rows(spark, d), "E", ["rank"], ["query_id"])
    answers = queries_of(spark).select("query_id", F.array(*map(F.lit, (" e2", "E1", "E2", "E9"))).alias("proposed_ids"))
    return evidence.valid_citations(answers, rows).select("query_id", F.array_join("evidence_ids", " ").alias("cited"))


@query("f18_sources", f"{HYBRID} SELECT query_id, 'E' || rank AS evidence_id, source_filename, document_id, page_number, chunk_id, extraction_method FROM h WHERE rank IN (1, 2)")
def f18_sources(spark, d):
    rows = evidence.numbered(hybrid_rows(spark, d), "E", ["rank"], ["query_id"])
    cited = queries_of(spark).select("query_id", F.array(F.lit("E2"), F.lit("E1")).alias("evidence_ids"))
    return evidence.verified_sources(cited, rows).drop("position")
