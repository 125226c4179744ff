"""Tables as the queries want them: repeated rows once, by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.session import once
from lectern.sources.tables import table

QUERIES = [
    (1, "mandatory licence for the aquifer near the river"),
    (2, "deadline of the tariff review and its budget in crore rupees"),
    (3, "who must register the vaccine clinic; what is prohibited"),
]


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "doc_chunks"), ["document_id", "chunk_id"]).select("document_id", "chunk_id", "source_filename", "page_number", "chunk_ord", "extraction_method", "text")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "doc_pages"), ["document_id", "page_number"]).select("document_id", "page_number", "source_filename", "extraction_method", "ocr_error", "page_text")


def papers(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "papers"), ["paper_id"])


def views(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "source_views"), ["view_id"])


def records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_records")


# The same in SQL; put before a query's own common table expressions.
CHUNKS = "c AS (SELECT document_id, chunk_id, min(source_filename) AS source_filename, min(page_number) AS page_number, min(chunk_ord) AS chunk_ord, min(extraction_method) AS extraction_method, min(text) AS text FROM doc_chunks WHERE document_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY document_id, chunk_id)"
PAGES = "p AS (SELECT document_id, page_number, min(source_filename) AS source_filename, min(extraction_method) AS extraction_method, min(ocr_error) AS ocr_error, min(page_text) AS page_text FROM doc_pages WHERE document_id IS NOT NULL AND page_number IS NOT NULL GROUP BY document_id, page_number)"
PAPERS = "pp AS (SELECT paper_id, any_value(body) AS body FROM papers WHERE paper_id IS NOT NULL GROUP BY paper_id)"
FIRST = "r AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY uploaded_at, filename) AS n FROM doc_records) WHERE n = 1)"
TOKEN = r"'[A-Za-z0-9]+(?:[./-][A-Za-z0-9]+)*'"
STOP = "['a','an','and','are','as','at','be','by','for','from','how','in','is','it','of','on','or','the','these','this','to','was','were','what','when','where','which','who','with']"
ASKED = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, '{text}')" for n, text in QUERIES) + ") AS v(query_id, query))"
