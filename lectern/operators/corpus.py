"""Documents, pages and chunks as a corpus: identity, scope, quarantine, previews, dashboards."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import document_hash, half_even

POTENTIAL = "POTENTIAL CONFLICT"


def first_uploads(records: DataFrame, order: list[str], key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(first rows, repeated rows) by content id in the given order; rows without an id are never repeats."""
    nameless = F.coalesce(F.col(key), F.lit("")) == ""
    # Rows without an id would all meet in one window; they need none.
    ranked = records.where(~nameless).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    first = ranked.where(F.col("_n") == 1).drop("_n").unionByName(records.where(nameless))
    return first, ranked.where(F.col("_n") > 1).drop("_n")


def distinct_documents(records: DataFrame) -> DataFrame:
    """U1 by time of upload, then file name."""
    return first_uploads(records, ["uploaded_at", "filename"])[0]


def processed(rows: DataFrame, records: DataFrame) -> DataFrame:
    """rows of documents that were processed."""
    return rows.join(records.where("status = 'Processed'").select("document_id").distinct(), "document_id", "left_semi")


def missing_from(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows not done before."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def safeguarded(records: DataFrame, most_bytes: int = 100 * 2**20, most_pages: int = 500, warn_bytes: int = 25 * 2**20, warn_pages: int = 75) -> DataFrame:
    """`verdict` of each upload: rejected, warned or accepted by its size and page count; unknown is accepted."""
    size, pages = F.col("file_size"), F.col("page_count")
    over = F.coalesce((size > most_bytes) | (pages > most_pages), F.lit(False))
    near = F.coalesce((size > warn_bytes) | (pages > warn_pages), F.lit(False))
    return records.withColumn("verdict", F.when(over, "rejected").when(near, "warned").otherwise("accepted"))


def quarantined(records: DataFrame) -> DataFrame:
    """Rows of failed documents with the stage and error, ready for a quarantine table."""
    return records.where("status = 'Failed'").select("document_id", "filename", "file_size", F.coalesce("error", F.lit("unknown")).alias("error"), F.lit("extraction").alias("failure_stage"))


def relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """children carry the file name that `labels` (document_id, filename) now gives their document."""
    return rows.join(labels.select("document_id", F.col("filename").alias("_filename")), "document_id", "left").withColumn("source_filename", F.coalesce("_filename", "source_filename")).drop("_filename")


def page_policy(pages: DataFrame, native: str = "native_text", ocr: str = "ocr_text", least: int = 40) -> DataFrame:
    """Which text a page keeps: native text with at least `least` visible characters, else the recognised
    text, else what native text there is; a page with neither failed."""
    solid = F.length(F.regexp_replace(F.coalesce(native, F.lit("")), r"\s", ""))
    read = F.length(F.trim(F.coalesce(ocr, F.lit(""))))
    method = F.when(solid >= least, "Native text").when(read > 0, "OCR").when(solid > 0, "Native text").otherwise("Failed")
    return pages.withColumn("extraction_method", method).withColumn("text", F.when(method == "OCR", F.trim(ocr)).when(method == "Native text", F.trim(native)).otherwise(""))


def preview(pages: DataFrame, limit: int = 150_000) -> DataFrame:
    """of each document the first `limit` characters, over its pages in order."""
    rows = pages.where(F.col("page_text").isNotNull())
    so_far = F.coalesce(F.sum("_n").over(Window.partitionBy("document_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Only lengths go through the window; texts join the few pages with room left.
    room = rows.select("document_id", "page_number", F.length("page_text").alias("_n")).withColumn("_room", F.greatest(F.lit(0), F.lit(limit) - so_far)).where("_room > 0").select("document_id", "page_number", "_room")
    return rows.join(room, ["document_id", "page_number"]).select("document_id", "page_number", F.substring(F.col("page_text"), F.lit(1), F.col("_room").cast("int")).alias("preview"))


def method_totals(pages: DataFrame, by: list[str]) -> DataFrame:
    """Pages by extraction method, with characters and errors."""
    method = F.col("extraction_method")
    return pages.groupBy(*by).agg(F.count(F.lit(1)).alias("pages"), F.count_if(method == "Native text").alias("native_pages"), F.count_if(method == "OCR").alias("ocr_pages"), F.count_if(method == "Failed").alias("failed_pages"), F.coalesce(F.sum(F.length("page_text")), F.lit(0)).alias("characters"), F.count("ocr_error").alias("ocr_errors"))


def recent(log: DataFrame, keep: Column, order: list[Column], limit: int = 10) -> DataFrame:
    """The latest `limit` rows, and of those the ones to keep: the limit comes before the filter."""
    return log.orderBy(*order).limit(limit).where(keep)


def paged(rows: DataFrame, order: list[Column | str], page: int, size: int = 20, by: list[str] | None = None) -> DataFrame:
    """Rows of one page of a listing, per group `by`."""
    if not by:  # no page lies beyond so many rows, and they are few
        rows = rows.orderBy(*order).limit(page * size)
    n = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order))
    return rows.withColumn("position", n).where((F.col("position") > (page - 1) * size) & (F.col("position") <= page * size))


def fingerprints(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Per document the SHA-256 of its chunk texts in order, every text ended by a NUL, and the number of chunks.

    The digest is one sequence over a document, so a document is read by one task; its chunks stream by, sorted, and
    none is held. Null texts count as empty.
    """

    def digested(batches):
        held, digest, count = None, None, 0

        def row():
            return pa.RecordBatch.from_pydict({"document_id": [held], "fingerprint": [digest.hexdigest()], "chunks": [count]})

        for batch in batches:
            for document, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if document != held or digest is None:
                    if digest is not None:
                        yield row()
                    held, digest, count = document, hashlib.sha256(), 0
                digest.update((text or "").encode("utf-8", "surrogatepass") + b"\0")
                count += 1
        if digest is not None:
            yield row()

    rows = chunks.select("document_id", *order, "text").repartition("document_id").sortWithinPartitions("document_id", *order, "text")
    return rows.select("document_id", "text").mapInArrow(digested, "document_id string, fingerprint string, chunks bigint")


def valid_cache_rows(rows: DataFrame, version: int = 1) -> DataFrame:
    """rows of a document cache whose version, id and state are sound."""
    sound = (F.col("cache_version") == version) & document_hash(F.col("document_id")) & F.col("status").isin("Processed", "Failed") & F.col("filename").isNotNull()
    return rows.where(F.coalesce(sound, F.lit(False)))


def document_rows(records: DataFrame, pages: DataFrame, chunks: DataFrame, entity_refs: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """Per document its pages, chunks, methods, share of all chunks, distinct entities and events.

    Every side is aggregated to one row per document before it is joined. Without entities or events their
    columns are null (not computed), which is not 0.
    """
    p = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("extraction_method") == "Native text").alias("native_pages"), F.count_if(F.col("extraction_method") == "OCR").alias("ocr_pages"), F.bool_or(F.col("ocr_error").isNotNull()).alias("page_error"))
    c = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    rows = records.join(p, "document_id", "left").join(c, "document_id", "left").fillna({"pages": 0, "chunks": 0, "native_pages": 0, "ocr_pages": 0, "page_error": False})
    total = chunks.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = rows.withColumn("coverage", F.when(total > 0, half_even(F.col("chunks") * 100.0 / total, 1)).otherwise(0.0))
    warned = F.col("safeguard_warning").isNotNull() | (F.col("status") != "Processed") | F.col("page_error")
    rows = rows.withColumn("warning", F.coalesce(warned, F.lit(True)))
    for name, side, count in (("entities", entity_refs, F.count_distinct("category", "canonical")), ("events", events, F.count(F.lit(1)))):
        if side is None:
            rows = rows.withColumn(name, F.lit(None).cast("bigint"))
        else:
            rows = rows.join(side.groupBy("document_id").agg(count.alias(name)), "document_id", "left").fillna({name: 0})
    return rows.select("document_id", "filename", "publisher", "status", "pages", "chunks", "native_pages", "ocr_pages", "coverage", "warning", "entities", "events")


def metrics(rows: DataFrame, indexed_vectors: int | Column = 1, findings: DataFrame | None = None) -> DataFrame:
    """One row of totals over `document_rows`, with the state of the corpus.

    Without vectors in an index no corpus is healthy. Conflicts are null where no findings are given: not computed
    is not zero.
    """
    n, good = F.count(F.lit(1)), F.count_if(F.col("status") == "Processed")
    out = rows.agg(n.alias("documents"), good.alias("processed"), F.sum("pages").alias("pages"), F.sum("chunks").alias("chunks"), F.sum("native_pages").alias("native_pages"), F.sum("ocr_pages").alias("ocr_pages"), F.sum("entities").alias("entities"), F.sum("events").alias("events"), F.count_if("warning").alias("warnings"))
    for name in ("native", "ocr"):
        out = out.withColumn(f"{name}_percentage", F.when(F.col("pages") > 0, half_even(F.col(f"{name}_pages") * 100.0 / F.col("pages"), 1)).otherwise(0.0))
    online = (indexed_vectors if isinstance(indexed_vectors, Column) else F.lit(indexed_vectors)) > 0
    found = F.lit(None).cast("bigint") if findings is None else findings.where(F.col("relationship") == POTENTIAL).agg(F.count(F.lit(1))).scalar()
    health = F.when(online & (F.col("documents") > 0) & (F.col("processed") == F.col("documents")) & (F.col("warnings") == 0), "Good").when(online & (F.col("processed") >= F.greatest(F.lit(1), F.ceil(F.col("documents") * 0.75))), "Moderate").otherwise("Needs Attention")
    return out.withColumn("conflicts", found).withColumn("index_status", F.when(online, "Online").otherwise("Offline")).withColumn("health", health)


def rollup_totals(rows: DataFrame) -> DataFrame:
    """Totals by publisher and status with subtotals, in one pass."""
    return rows.rollup("publisher", "status").agg(F.count(F.lit(1)).alias("documents"), F.sum("pages").alias("pages"), F.sum("chunks").alias("chunks"), F.grouping_id().alias("level"))


def conflict_totals(findings: DataFrame) -> DataFrame:
    """(conflicts, documents): the potential conflicts among findings, and the sorted names of all documents compared.

    The names are those of the documents a reader chose to compare, one short list.
    """
    names = F.array_sort(F.collect_set(F.when(F.col("document") != "", F.col("document"))))
    both = findings.withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("document", F.when(F.col("_side") == 0, F.col("document_a")).otherwise(F.col("document_b")))
    return both.agg(F.count_if((F.col("_side") == 0) & (F.col("relationship") == POTENTIAL)).alias("conflicts"), names.alias("documents"))


def conflict_topics(findings: DataFrame) -> DataFrame:
    """(topic, conflicts): potential conflicts by topic."""
    topic = F.coalesce("topic", F.lit("Unspecified topic")).alias("topic")
    return findings.where(F.col("relationship") == POTENTIAL).groupBy(topic).agg(F.count(F.lit(1)).alias("conflicts"))


def source_views(citations: DataFrame, records: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """What a citation shows: its page's text and the passage.

    The document must have been processed and the page exist. A chunk id is looked up on that page; without a
    match, and without a passage, a page's only chunk stands in.
    """
    docs = distinct_documents(records.where("status = 'Processed'")).select("document_id", F.col("filename").alias("_filename"))
    page_rows = pages.select("document_id", "page_number", "page_text", F.col("extraction_method").alias("_method"), F.col("source_filename").alias("_page_file")).dropDuplicates(["document_id", "page_number"])
    named = chunks.select("document_id", "page_number", "chunk_id", F.col("text").alias("_named"))
    single = chunks.groupBy("document_id", "page_number").agg(F.count(F.lit(1)).alias("_n"), F.min("chunk_id").alias("_only_id"), F.min("text").alias("_only")).where("_n = 1").drop("_n")
    rows = citations.join(docs, "document_id").join(page_rows, ["document_id", "page_number"]).join(named, ["document_id", "page_number", "chunk_id"], "left").join(single, ["document_id", "page_number"], "left")
    bare = F.coalesce("passage", F.lit("")) == ""
    fallback = F.col("_named").isNull() & bare
    chunk_id = F.when(fallback, F.coalesce("_only_id", "chunk_id")).otherwise(F.col("chunk_id"))
    passage = F.when(~bare, F.col("passage")).otherwise(F.coalesce("_named", "_only", F.lit("")))
    return rows.select("view_id", "evidence_id", "document_id", F.coalesce("_filename", "_page_file").alias("filename"), "page_number", F.col("_method").alias("extraction_method"), F.coalesce("page_text", F.lit("")).alias("page_text"), F.coalesce(chunk_id, F.lit("")).alias("chunk_id"), passage.alias("passage"))


def corpus_key(records: DataFrame) -> DataFrame:
    """One row with a digest over the sorted (file name, id) pairs: a key for caches, not of content."""
    per = records.select(F.sha2(F.concat_ws("\0", "filename", "document_id"), 256).alias("h")).distinct()
    # An order-free sum of digests needs no gathering of all rows.
    return per.agg(F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("pairs")).select(F.sha2(F.concat_ws(":", F.lit("corpus"), F.col("s").cast("string"), F.col("pairs").cast("string")), 256).alias("corpus_key"), "pairs")
