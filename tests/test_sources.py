import datetime as dt

from pyspark.sql import functions as F

from lectern.operators import corpus
from lectern.sources import files
from lectern.streaming import arrivals

ID = ["%064x" % n for n in range(4)]


def test_cache_round_trip_and_corruption(spark, tmp_path, rows):
    path = str(tmp_path / "some" / "cache")
    df = spark.createDataFrame([(ID[0], "a.pdf", 10, "Processed"), (ID[1], "b.pdf", None, "Failed")], "document_id string, filename string, file_size bigint, status string")
    files.save_documents(df, path)
    assert rows(files.load_documents(spark, path), "document_id", "filename") == {(ID[0], "a.pdf"), (ID[1], "b.pdf")}
    spark.read.parquet(path).drop("prefix").withColumn("filename", F.lit("changed")).write.mode("append").parquet(path + "/prefix=zz")
    assert rows(files.load_documents(spark, path), "filename") == {("a.pdf",), ("b.pdf",)}
    assert files.cache_statistics(spark, path).first().files > 0
    assert files.clear_cache(spark, path) is True


def test_vectors_of_changed_chunks_are_a_miss(spark, tmp_path, rows):
    path = str(tmp_path / "a" / "vectors")
    chunks = spark.createDataFrame([(ID[0], 1, "x"), (ID[1], 1, "y")], "document_id string, chunk_ord int, text string")
    prints = corpus.fingerprints(chunks, ["chunk_ord"])
    vectors = spark.createDataFrame([(ID[0], [1.0], "m"), (ID[1], [2.0], "m")], "document_id string, embedding array<float>, model string")
    files.save_vectors(vectors, prints, path)
    changed = corpus.fingerprints(chunks.withColumn("text", F.when(F.col("document_id") == ID[1], "z").otherwise(F.col("text"))), ["chunk_ord"])
    assert rows(files.load_vectors(spark, path, changed, "m", 1), "document_id") == {(ID[0],)}
    assert rows(files.load_vectors(spark, path, changed, "other", 1)) == set()


def test_unreadable_files_become_rows(spark, tmp_path, rows):
    (tmp_path / "ok.txt").write_text("one\ftwo")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    got = files.extracted_pages(files.upload_files(spark, str(tmp_path), "*.txt"), files.plain_text_pages)
    pages = rows(got.where("ocr_error is null"), "source_filename", "page_number", "native_text")
    assert pages == {("ok.txt", 1, "one"), ("ok.txt", 2, "two")}
    assert [r.source_filename for r in got.where("ocr_error is not null").collect()] == ["bad.txt"]


def test_full_texts_refuse_entities(spark):
    df = spark.createDataFrame([(1, "<article><body><p>A  b</p><p/></body></article>"), (2, "<!DOCTYPE x [<!ENTITY e 'v'>]><article/>")], "n int, xml string")
    got = {r.n: (r.status, r.paragraphs) for r in files.full_texts(df).collect()}
    assert got[1] == ("retrieved", ["A b"]) and got[2][0].startswith("refused") and got[2][1] == []


def test_references_are_looked_up_only_with_consent(spark):
    refs = spark.createDataFrame([(1, 0, "10.1/A", True), (1, 1, "10.1/b", False), (1, 2, "", True), (1, 3, "10.1/c", True)], "paper_id int, position int, doi string, parsed boolean").withColumn("doi", F.lower("doi"))
    works = spark.createDataFrame([("10.1/a", "T", "2020", True)], "doi string, title string, year string, open_access boolean")
    got = {r.position: r.status for r in files.resolved_references(refs, works, consent=True).collect()}
    assert got == {0: "Verified by DOI", 1: "Not checked: unparsed", 2: "Unverified: no DOI", 3: "Not found"}
    assert {r.status for r in files.resolved_references(refs, works).collect()} == {"Not checked: no consent"}


def test_streams_process_each_arrival_once(spark, tmp_path, rows):
    shape = "document_id string, source_filename string, page_number int, extraction_method string, page_text string, ingested_at timestamp"
    day = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("d", "d.pdf", 1, "OCR", "text " * 300, day), ("d", "d.pdf", 1, "OCR", "text " * 300, day), ("e", "e.pdf", 1, "OCR", None, day)], shape)
    df.write.parquet(str(tmp_path / "in"))
    stream = arrivals.arriving(spark, str(tmp_path / "in"), str(tmp_path / "in"))
    once = arrivals.first_arrivals(stream, ["document_id", "page_number"], "ingested_at")
    arrivals.drained(arrivals.arriving_chunks(once), str(tmp_path / "out"), str(tmp_path / "state"))
    got = rows(spark.read.parquet(str(tmp_path / "out")), "document_id", "chunk_id")
    assert got == {("d", "page-1-chunk-1"), ("d", "page-1-chunk-2")}
    for n in range(2):
        arrivals.upserted(arrivals.arriving(spark, str(tmp_path / "in"), str(tmp_path / "in")), str(tmp_path / "kept"), ["document_id", "page_number"], str(tmp_path / f"c{n}"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 2
