"""Queries over documents, pages and chunks as a corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.splitting import chunked
from lectern.operators import corpus, evidence, reports
from lectern.plans.common import CHUNKS, FIRST, PAGES, chunks, pages, records, views
from lectern.plans.registry import query
from lectern.sources.tables import table


@query("u1_distinct_documents", f"WITH {FIRST} SELECT document_id, filename, publisher, status FROM r")
def u1_distinct_documents(spark, d):
    return corpus.distinct_documents(records(spark, d)).select("document_id", "filename", "publisher", "status")


@query("u1_repeated_documents", "SELECT document_id, filename FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY uploaded_at, filename) AS n FROM doc_records) WHERE n > 1")
def u1_repeated_documents(spark, d):
    return corpus.first_uploads(records(spark, d), ["uploaded_at", "filename"])[1].select("document_id", "filename")


@query("f2_processed_chunks", f"WITH {CHUNKS} SELECT document_id, chunk_id, page_number FROM c WHERE document_id IN (SELECT document_id FROM doc_records WHERE status = 'Processed')")
def f2_processed_chunks(spark, d):
    return corpus.processed(chunks(spark, d), records(spark, d)).select("document_id", "chunk_id", "page_number")


@query("f11_safeguards", "SELECT document_id, filename, CASE WHEN coalesce(file_size > 104857600 OR page_count > 500, false) THEN 'rejected' WHEN coalesce(file_size > 26214400 OR page_count > 75, false) THEN 'warned' ELSE 'accepted' END AS verdict FROM doc_records")
def f11_safeguards(spark, d):
    return corpus.safeguarded(records(spark, d)).select("document_id", "filename", "verdict")


@query("k10_quarantine", "SELECT document_id, filename, file_size, coalesce(error, 'unknown') AS error, 'extraction' AS failure_stage FROM doc_records WHERE status = 'Failed'")
def k10_quarantine(spark, d):
    return corpus.quarantined(records(spark, d))


@query("f19_relabelled_pages", f"WITH {PAGES}, l AS (SELECT document_id, max_by(filename, (uploaded_at, filename)) AS filename FROM doc_records GROUP BY document_id) SELECT document_id, page_number, coalesce(filename, source_filename) AS source_filename FROM p LEFT JOIN l USING (document_id)")
def f19_relabelled_pages(spark, d):
    labels = records(spark, d).groupBy("document_id").agg(F.max_by("filename", F.struct("uploaded_at", "filename")).alias("filename"))
    return corpus.relabelled(pages(spark, d), labels).select("document_id", "page_number", "source_filename")


@query("s2_page_policy", f"""
    WITH {PAGES}, s AS (SELECT *, CASE WHEN extraction_method = 'OCR' THEN NULL ELSE page_text END AS native, CASE WHEN extraction_method = 'OCR' THEN page_text END AS ocr FROM p)
    SELECT document_id, page_number, CASE WHEN length(regexp_replace(coalesce(native, ''), '\\s', '', 'g')) >= 40 THEN 'Native text' WHEN length(trim(coalesce(ocr, ''), ' ')) > 0 THEN 'OCR' WHEN length(regexp_replace(coalesce(native, ''), '\\s', '', 'g')) > 0 THEN 'Native text' ELSE 'Failed' END AS method FROM s""")
def s2_page_policy(spark, d):
    scanned = F.col("extraction_method") == "OCR"
    rows = pages(spark, d).withColumn("native_text", F.when(F.coalesce(scanned, F.lit(False)), None).otherwise(F.col("page_text"))).withColumn("ocr_text", F.when(scanned, F.col("page_text")))
    return corpus.page_policy(rows).select("document_id", "page_number", F.col("extraction_method").alias("method"))


@query("f20_preview", f"""
    WITH {PAGES}, s AS (SELECT document_id, page_number, page_text, greatest(0, 150000 - coalesce(sum(length(page_text)) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS room FROM p WHERE page_text IS NOT NULL)
    SELECT document_id, page_number, CAST(least(length(page_text), room) AS BIGINT) AS preview_chars FROM s WHERE room > 0""")
def f20_preview(spark, d):
    return corpus.preview(pages(spark, d)).select("document_id", "page_number", F.length("preview").cast("bigint").alias("preview_chars"))


@query("a26_method_totals", f"""
    WITH {PAGES} SELECT document_id, count(*) AS pages, count(*) FILTER (extraction_method = 'Native text') AS native_pages, count(*) FILTER (extraction_method = 'OCR') AS ocr_pages, count(*) FILTER (extraction_method = 'Failed') AS failed_pages,
    CAST(coalesce(sum(length(page_text)), 0) AS BIGINT) AS characters, count(ocr_error) AS ocr_errors FROM p GROUP BY document_id""")
def a26_method_totals(spark, d):
    return corpus.method_totals(pages(spark, d), ["document_id"])


@query("w8_recent_views", """
    WITH v AS (SELECT view_id, any_value(evidence_id) AS evidence_id, any_value(resolved_at) AS resolved_at, any_value(extraction_method) AS extraction_method FROM source_views GROUP BY view_id),
    t AS (SELECT * FROM v ORDER BY resolved_at DESC, view_id LIMIT 10) SELECT view_id, evidence_id, resolved_at FROM t WHERE extraction_method = 'Native text'""")
def w8_recent_views(spark, d):
    keep = F.col("extraction_method") == "Native text"
    return corpus.recent(views(spark, d), keep, [F.desc("resolved_at"), F.col("view_id")]).select("view_id", "evidence_id", "resolved_at")


@query("w19_listing_page", f"WITH {CHUNKS} SELECT document_id, chunk_id, position FROM (SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, chunk_ord, chunk_id) AS position FROM c) WHERE position > 20 AND position <= 40")
def w19_listing_page(spark, d):
    return corpus.paged(chunks(spark, d), ["page_number", "chunk_ord", "chunk_id"], 2, by=["document_id"]).select("document_id", "chunk_id", "position")


@query("a22_fingerprints", f"WITH {CHUNKS} SELECT document_id, sha256(string_agg(coalesce(text, '') || chr(0), '' ORDER BY page_number, chunk_ord, chunk_id)) AS fingerprint, count(*) AS chunks FROM c GROUP BY document_id")
def a22_fingerprints(spark, d):
    return corpus.fingerprints(chunks(spark, d), ["page_number", "chunk_ord", "chunk_id"])


@query("f9_valid_records", "SELECT document_id, filename FROM doc_records WHERE regexp_matches(document_id, '^[0-9a-f]{64}$') AND status IN ('Processed', 'Failed') AND filename IS NOT NULL")
def f9_valid_records(spark, d):
    return corpus.valid_cache_rows(records(spark, d).withColumn("cache_version", F.lit(1))).select("document_id", "filename")


@query("j16_chunks_without_vector", f"WITH {CHUNKS} SELECT document_id, chunk_id FROM c WHERE NOT EXISTS (SELECT 1 FROM chunk_vectors v WHERE v.document_id = c.document_id AND v.chunk_id = c.chunk_id AND v.embedding IS NOT NULL)")
def j16_chunks_without_vector(spark, d):
    done = table(spark, d, "chunk_vectors").where("embedding is not null")
    return corpus.missing_from(chunks(spark, d), done, ["document_id", "chunk_id"]).select("document_id", "chunk_id")


DOCUMENT_ROWS = f"""
    WITH {FIRST}, {PAGES}, {CHUNKS},
    ps AS (SELECT document_id, count(*) AS pages, count(*) FILTER (extraction_method = 'Native text') AS native_pages, count(*) FILTER (extraction_method = 'OCR') AS ocr_pages, bool_or(ocr_error IS NOT NULL) AS page_error FROM p GROUP BY document_id),
    cs AS (SELECT document_id, count(*) AS chunks FROM c GROUP BY document_id),
    rows_ AS (SELECT r.document_id, filename, publisher, status, coalesce(pages, 0) AS pages, coalesce(chunks, 0) AS chunks, coalesce(native_pages, 0) AS native_pages, coalesce(ocr_pages, 0) AS ocr_pages,
      coalesce(chunks, 0) * 100.0 / (SELECT count(*) FROM c) AS share, coalesce(safeguard_warning IS NOT NULL OR status <> 'Processed' OR coalesce(page_error, false), true) AS warning
      FROM r LEFT JOIN ps USING (document_id) LEFT JOIN cs USING (document_id))"""


@query("a10_document_rows", f"{DOCUMENT_ROWS} SELECT document_id, filename, publisher, status, pages, chunks, native_pages, ocr_pages, warning FROM rows_")
def a10_document_rows(spark, d):
    rows = corpus.document_rows(corpus.distinct_documents(records(spark, d)), pages(spark, d), chunks(spark, d))
    return rows.drop("entities", "events", "coverage")


@query("a11_coverage", f"{DOCUMENT_ROWS} SELECT document_id, CAST(round_even(share, 1) AS DOUBLE) AS coverage FROM rows_")
def a11_coverage(spark, d):
    rows = corpus.document_rows(corpus.distinct_documents(records(spark, d)), pages(spark, d), chunks(spark, d))
    return rows.select("document_id", "coverage")


@query("a9_metrics", f"""{DOCUMENT_ROWS}, m AS (SELECT count(*) AS documents, count(*) FILTER (status = 'Processed') AS processed, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(native_pages) AS BIGINT) AS native_pages, CAST(sum(ocr_pages) AS BIGINT) AS ocr_pages, count(*) FILTER (warning) AS warnings FROM rows_), v AS (SELECT count(*) AS vectors FROM chunk_vectors)
    SELECT m.*, CAST(round_even(100.0 * native_pages / pages, 1) AS DOUBLE) AS native_percentage, CAST(round_even(100.0 * ocr_pages / pages, 1) AS DOUBLE) AS ocr_percentage, CASE WHEN vectors > 0 THEN 'Online' ELSE 'Offline' END AS index_status, CASE WHEN documents > 0 AND processed = documents AND warnings = 0 THEN 'Good' WHEN processed >= greatest(1, ceil(documents * 0.75)) THEN 'Moderate' ELSE 'Needs Attention' END AS health FROM m, v""")
def a9_metrics(spark, d):
    vectors = table(spark, d, "chunk_vectors").agg(F.count(F.lit(1))).scalar()
    return corpus.metrics(corpus.document_rows(corpus.distinct_documents(records(spark, d)), pages(spark, d), chunks(spark, d)), vectors).drop("events", "entities", "conflicts")


@query("x1_rollup_totals", f"{DOCUMENT_ROWS} SELECT publisher, status, count(*) AS documents, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(grouping(publisher, status) AS BIGINT) AS level FROM rows_ GROUP BY ROLLUP (publisher, status)")
def x1_rollup_totals(spark, d):
    return corpus.rollup_totals(corpus.document_rows(corpus.distinct_documents(records(spark, d)), pages(spark, d), chunks(spark, d)))


@query("j6_source_views", f"""
    WITH {PAGES}, {CHUNKS}, docs AS (SELECT document_id, filename FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY uploaded_at, filename) AS n FROM doc_records WHERE status = 'Processed') WHERE n = 1),
    v AS (SELECT view_id, any_value(document_id) AS document_id, any_value(page_number) AS page_number, any_value(chunk_id) AS chunk_id, any_value(passage) AS passage FROM source_views GROUP BY view_id),
    one AS (SELECT document_id, page_number, min(chunk_id) AS only_id, min(text) AS only_text FROM c GROUP BY ALL HAVING count(*) = 1)
    SELECT v.view_id, v.document_id, docs.filename, v.page_number, length(coalesce(p.page_text, '')) AS page_chars,
      coalesce(CASE WHEN c.text IS NULL AND coalesce(v.passage, '') = '' THEN coalesce(only_id, v.chunk_id) ELSE v.chunk_id END, '') AS chunk_id,
      CASE WHEN coalesce(v.passage, '') <> '' THEN v.passage ELSE coalesce(c.text, only_text, '') END AS passage
    FROM v JOIN docs USING (document_id) JOIN p ON p.document_id = v.document_id AND p.page_number = v.page_number
    LEFT JOIN c ON c.document_id = v.document_id AND c.page_number = v.page_number AND c.chunk_id = v.chunk_id
    LEFT JOIN one ON one.document_id = v.document_id AND one.page_number = v.page_number""")
def j6_source_views(spark, d):
    rows = corpus.source_views(views(spark, d), records(spark, d), pages(spark, d), chunks(spark, d))
    return rows.select("view_id", "document_id", "filename", "page_number", F.length("page_text").alias("page_chars"), "chunk_id", "passage")


@query("w20_chunks")
def w20_chunks(spark, d):
    """Chunks of every page, cut anew."""
    cut = pages(spark, d).where(F.trim(F.coalesce("page_text", F.lit(""))) != "").select("document_id", "page_number", F.posexplode(chunked(F.col("page_text"))).alias("n", "text"))
    return cut.select("document_id", "page_number", F.concat(F.lit("page-"), F.col("page_number").cast("string"), F.lit("-chunk-"), (F.col("n") + 1).cast("string")).alias("chunk_id"), "text")


@query("w3_evidence_ids", f"WITH {CHUNKS} SELECT document_id, chunk_id, 'S' || row_number() OVER (PARTITION BY document_id ORDER BY page_number, chunk_ord, chunk_id) AS evidence_id FROM c")
def w3_evidence_ids(spark, d):
    return evidence.numbered(chunks(spark, d), "S", ["page_number", "chunk_ord", "chunk_id"], ["document_id"]).select("document_id", "chunk_id", "evidence_id")


@query("k6_table_lines", r"""
    WITH r AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY uploaded_at, filename) AS n FROM doc_records) WHERE n = 1),
    x AS (SELECT document_id, replace(trim(regexp_replace(filename, '\s+', ' ', 'g')), '|', '\|') AS a, coalesce(replace(trim(regexp_replace(publisher, '\s+', ' ', 'g')), '|', '\|'), '') AS b FROM r)
    SELECT document_id, '| ' || CASE WHEN length(a) > 96 THEN a[1:95] || '…' ELSE a END || ' | ' || CASE WHEN length(b) > 96 THEN b[1:95] || '…' ELSE b END || ' |' AS line FROM x""")
def k6_table_lines(spark, d):
    return reports.table_lines(corpus.distinct_documents(records(spark, d)), ["filename", "publisher"], ["document_id"])


@query("t28_corpus_key", """
    WITH h AS (SELECT DISTINCT sha256(concat_ws(chr(0), filename, document_id)) AS h FROM doc_records), s AS (SELECT CAST(sum(CAST(CAST('0x' || h[1:15] AS UBIGINT) AS HUGEINT)) AS VARCHAR) AS s, count(*) AS pairs FROM h)
    SELECT sha256('corpus:' || s || ':' || pairs) AS corpus_key, pairs FROM s""")
def t28_corpus_key(spark, d):
    return corpus.corpus_key(records(spark, d))


@query("x2_hourly_events", "SELECT time_bucket(INTERVAL 1 hour, ts) AS hour, event_type, count(*) AS rows, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x2_hourly_events(spark, d):
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")
    return table(spark, d, "events").groupBy(hour, "event_type").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total"))


