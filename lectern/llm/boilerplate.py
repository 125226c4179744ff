"""Problem 6: lines that come back in many documents of one source, and texts without them.

Documents with the same pages are collapsed to one cluster per source before anything is counted, so an article
published again costs nothing and, with `unit="clusters"`, is not taken for boilerplate: a line must then come
back over distinct clusters and distinct publication dates. With `unit="documents"` a cluster counts as often
as it has documents, which gives exactly the count over documents.

Lines travel as (document, hash); texts are never shuffled to find the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = "[ \\t]+"


def normal_lines(rows: DataFrame, line: str) -> DataFrame:
    """`rows` without empty lines and with `line` normalised: stripped (of any carriage return too), spaces and tabs
    collapsed, lower case, digit runs as `#`.

    One step is one projection: Catalyst keeps them apart, as each step refers to the one before more than once, so
    nothing is computed twice. Patterns run only on lines that need them.
    """
    x = F.col(line)
    rows = rows.withColumn(line, F.btrim(x, F.lit(" \t\n\r\f\u000b"))).where(x != "")
    rows = rows.withColumn(line, F.when(x.contains("  ") | x.contains("\t"), F.regexp_replace(x, BLANKS, " ")).otherwise(x))
    rows = rows.withColumn(line, F.lower(x))
    return rows.withColumn(line, F.when(x.rlike("[0-9]"), F.regexp_replace(x, "[0-9]+", "#")).otherwise(x))


def page_lines(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, page, line_no, line_hash) of every line that is not empty; line_no counts all lines from 1."""
    lines = pages.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    return normal_lines(lines, "line").select("doc", "page", (F.col("line_no") + 1).alias("line_no"), F.xxhash64("line").alias("line_hash"))


def publishers(records: DataFrame, *, doc: str = "document_id", source: str = "publisher") -> DataFrame:
    """(doc, source) of the documents that have a source, each once."""
    return records.where(F.col(doc).isNotNull() & F.col(source).isNotNull()).groupBy(F.col(doc).alias("doc")).agg(F.min(source).alias("source"))


def frequent_lines(pages: DataFrame, records: DataFrame, *, doc: str = "document_id", page: str = "page_number", text: str = "page_text", source: str = "publisher", published: str = "uploaded_at", unit: str = "documents", least: int = 5, percent: int = 30, least_dates: int = 1) -> DataFrame:
    """(source, line_hash, units, of_units, dates): lines in at least `least` and `percent` % of a source's units.

    Units are documents with any row in `pages`, or clusters of documents with the same pages. Documents
    without a source are left out; one sent or uploaded twice counts once.
    """
    if unit not in ("documents", "clusters"):
        raise ValueError("unit is documents or clusters")
    known = records.where(F.col(doc).isNotNull() & F.col(source).isNotNull()).groupBy(F.col(doc).alias("doc")).agg(F.min(source).alias("source"), F.min(F.to_date(published)).alias("day"))
    # The sum over distinct page hashes does not depend on the order of pages and is combined before the shuffle.
    once = pages.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.xxhash64(F.col(page), F.coalesce(F.col(text), F.lit(""))).alias("h")).distinct()
    digest = once.groupBy("doc").agg(F.sum(F.col("h").cast("decimal(20,0)")).alias("digest"), F.count(F.lit(1)).alias("page_count"))
    clusters = digest.join(known, "doc").groupBy("source", "digest", "page_count").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("documents"), F.min("day").alias("day"))
    weight = F.col("documents") if unit == "documents" else F.lit(1)
    members = clusters.select("source", "doc", "day", weight.alias("weight"))
    lines = page_lines(pages, doc, page, text).select("doc", "line_hash").distinct()
    counts = lines.join(members, "doc").groupBy("source", "line_hash").agg(F.sum("weight").alias("units"), F.count_distinct("day").alias("dates"))
    totals = members.groupBy("source").agg(F.sum("weight").alias("of_units"))
    enough = (F.col("units") >= least) & (F.col("units") * 100 >= F.col("of_units") * percent) & (F.col("dates") >= least_dates)
    return counts.where(F.col("units") >= least).join(totals, "source").where(enough)


def boilerplate_lines(pages: DataFrame, records: DataFrame, *, doc: str = "document_id", page: str = "page_number", text: str = "page_text", source: str = "publisher", **options) -> DataFrame:
    """(doc, page, line_no): where the frequent lines of a document's source stand, each place once."""
    frequent = frequent_lines(pages, records, doc=doc, page=page, text=text, source=source, **options).select("source", "line_hash")
    lines = page_lines(pages, doc, page, text)
    near = lines.join(frequent.select("line_hash").distinct(), "line_hash", "left_semi")
    known = publishers(records, doc=doc, source=source)
    found = near.join(known, "doc").join(frequent, ["source", "line_hash"], "left_semi")
    return found.select(F.col("doc").alias(doc), F.col("page").alias(page), "line_no").distinct()


def without_lines(pages: DataFrame, lines: DataFrame, *, doc: str = "document_id", page: str = "page_number", text: str = "page_text") -> DataFrame:
    """Distinct pages with their text without the given lines, as `clean_text`; null texts stay null."""
    gone = lines.groupBy(doc, page).agg(F.collect_set("line_no").alias("_gone"))
    once = pages.select(doc, page, text).dropDuplicates([doc, page])
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<int>")), i + 1))
    return once.join(gone, [doc, page], "left").select(doc, page, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias("clean_text"))
