"""Files as tables: page files through a pluggable extractor, XML full texts, vectors, cached documents."""

from __future__ import annotations

import importlib.util
import shutil
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import document_hash

CACHE_VERSION = 1
PAGE = "document_id string, source_filename string, page_number int, native_text string, ocr_text string, ocr_error string"


def upload_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(filename, document_id, content, file_size): the id is the SHA-256 of the bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("document_id"), "content", F.col("length").alias("file_size"), F.col("modificationTime").alias("uploaded_at"))


def extracted_pages(files: DataFrame, extract: Callable[[bytes, str], Iterable[dict]], most_bytes: int = 100 * 2**20) -> DataFrame:
    """Pages of uploaded files, one file at a time, by `extract(content, filename)`.

    It yields dicts with page_number, native_text, ocr_text, ocr_error. A file it cannot read (or one that is too
    large) becomes one row with page number 0 and the error: bad files never end the job. Which text a page
    keeps is decided afterwards by `operators.corpus.page_policy`.
    """

    def work(batches):
        for batch in batches:
            for name, document, content in zip(batch["filename"], batch["document_id"], batch["content"], strict=True):
                rows = []
                try:
                    if len(content) > most_bytes:
                        raise ValueError("file exceeds the size limit")
                    for page in extract(bytes(content), name):
                        rows.append((document, name, int(page["page_number"]), page.get("native_text"), page.get("ocr_text"), page.get("ocr_error")))
                except Exception as error:  # noqa: BLE001 - anything an extractor raises is that file's failure
                    rows = [(document, name, 0, None, None, f"{type(error).__name__}: {error}"[:300])]
                yield pd.DataFrame(rows, columns=["document_id", "source_filename", "page_number", "native_text", "ocr_text", "ocr_error"])

    return files.select("filename", "document_id", "content").mapInPandas(work, PAGE)


def ocr_available() -> tuple[bool, str]:
    """Whether a recogniser is on this machine, and what is missing."""
    if shutil.which("tesseract") is None:
        return False, "the tesseract program is not installed"
    if importlib.util.find_spec("pytesseract") is None:
        return False, "the pytesseract package is not installed"
    return True, "available"


def plain_text_pages(content: bytes, filename: str) -> Iterable[dict]:
    """An extractor for text files: pages are ended by form feeds."""
    for n, page in enumerate(content.decode("utf-8").split("\f"), 1):
        yield {"page_number": n, "native_text": page}


def full_texts(files: DataFrame, xml: str = "xml") -> DataFrame:
    """Body paragraphs of full texts in XML as `paragraphs`; documents that declare entities are refused."""
    declared = F.col(xml).rlike(r"(?i)<!(?:DOCTYPE|ENTITY)")
    texts = F.transform(F.xpath(F.when(~declared, F.col(xml)), F.lit("//body//p//text()")), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return files.withColumn("status", F.when(declared, "refused: entity declarations").otherwise("retrieved")).withColumn("paragraphs", F.when(declared, F.array().cast("array<string>")).otherwise(F.filter(texts, lambda x: x != "")))


def resolved_references(references: DataFrame, works: DataFrame, consent: bool = False, most: int | None = 25) -> DataFrame:
    """`status` and metadata of references by DOI in a supplied table of works.

    Without consent nothing is looked up; unparsed references never are; beyond the first `most` parsed ones of
    a paper the rest is not checked.
    """
    from pyspark.sql import Window

    place = F.sum(F.col("parsed").cast("int")).over(Window.partitionBy("paper_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    rows = references.withColumn("_place", place)
    known = works.select(F.lower("doi").alias("doi"), F.col("title").alias("work_title"), F.col("year").alias("work_year"), "open_access").dropDuplicates(["doi"])
    joined = rows.join(known, "doi", "left")
    status = F.when(F.lit(not consent), "Not checked: no consent").when(~F.col("parsed"), "Not checked: unparsed").when(F.lit(False) if most is None else F.col("_place") > most, "Not checked: limit").when(F.coalesce("doi", F.lit("")) == "", "Unverified: no DOI").when(F.col("work_title").isNull(), "Not found").otherwise("Verified by DOI")
    return joined.withColumn("status", status).drop("_place")


def save_documents(records: DataFrame, path: str) -> None:
    """K1: write cache rows (document_id, filename, status, ...) with version and digest, by prefix of the id.

    Prefix folders are overwritten as wholes by the committed job, so readers see old or new rows, never half.
    """
    columns = [c for c in ("document_id", "filename", "content_hash", "file_size", "page_count", "status", "error", "safeguard_warning") if c in records.columns]
    rows = records.select(*columns).withColumn("cache_version", F.lit(CACHE_VERSION)).withColumn("record_sha256", F.sha2(F.to_json(F.struct(*columns)), 256))
    rows.withColumn("prefix", F.substring("document_id", 1, 2)).repartition("prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(path)


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """Sound rows of the cache; a row with a wrong version, id or digest is a miss, never an error."""
    rows = spark.read.option("ignoreCorruptFiles", "true").parquet(path)
    columns = [c for c in rows.columns if c not in ("cache_version", "record_sha256", "prefix")]
    sound = (F.col("cache_version") == CACHE_VERSION) & document_hash(F.col("document_id")) & (F.col("record_sha256") == F.sha2(F.to_json(F.struct(*columns)), 256))
    return rows.where(F.coalesce(sound, F.lit(False))).select(*columns)


def save_vectors(vectors: DataFrame, fingerprints: DataFrame, path: str) -> None:
    """K2: vectors with the fingerprint of the chunks they were made from, by prefix of the document id."""
    rows = vectors.join(fingerprints.select("document_id", "fingerprint"), "document_id").withColumn("dimension", F.size("embedding"))
    rows.withColumn("prefix", F.substring("document_id", 1, 2)).repartition("prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(path)


def load_vectors(spark: SparkSession, path: str, fingerprints: DataFrame, model: str, dims: int) -> DataFrame:
    """Cached vectors that still fit: same chunks, model and number of dimensions."""
    rows = spark.read.option("ignoreCorruptFiles", "true").parquet(path).where((F.col("model") == model) & (F.col("dimension") == dims)).drop("prefix")
    return rows.join(fingerprints.select("document_id", "fingerprint"), ["document_id", "fingerprint"], "left_semi")


def cache_statistics(spark: SparkSession, path: str) -> DataFrame:
    """K3: one row of files and bytes below a path (metadata only: contents are not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def clear_cache(spark: SparkSession, path: str, least_depth: int = 3) -> bool:
    """K4: delete a cache folder; paths close to the root are refused."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.depth() < least_depth:
        raise ValueError("refusing to delete a folder this close to the root")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
