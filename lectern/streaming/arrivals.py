"""Arriving rows as streams: the batch operators over what has arrived. An extension: the batch analyses have no
streams of their own, but every incremental rule of theirs (a document once, chunks of new pages only) is here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.splitting import chunked


def arriving(spark: SparkSession, folder: str, like: str, files_per_batch: int = 50) -> DataFrame:
    """Parquet files that arrive in a folder, with the schema of the table at `like`."""
    return spark.readStream.schema(spark.read.parquet(like).schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_arrivals(rows: DataFrame, keys: list[str], time: str, late: str = "7 days") -> DataFrame:
    """U1 on a stream: each key once. Keys are remembered for `late` of event time, which bounds the state."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def arriving_chunks(pages: DataFrame, limit: int = 1000, overlap: int = 200) -> DataFrame:
    """W20 on a stream: chunks of each arriving page; stateless."""
    cut = pages.where(F.trim(F.coalesce("page_text", F.lit(""))) != "").select("document_id", "source_filename", "page_number", "extraction_method", F.posexplode(chunked(F.col("page_text"), limit, overlap)).alias("n", "text"))
    return cut.select("document_id", "source_filename", "page_number", F.concat(F.lit("page-"), F.col("page_number").cast("string"), F.lit("-chunk-"), (F.col("n") + 1).cast("string")).alias("chunk_id"), "extraction_method", "text")


def hourly_counts(rows: DataFrame, time: str, by: list[str], late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Rows per event-time window; a window is final once the watermark passed it."""
    return rows.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *by).agg(F.count(F.lit(1)).alias("rows")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "rows")


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that has arrived, write it exactly once, and stop."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def upserted(stream: DataFrame, path: str, keys: list[str], checkpoint: str, parts: int = 256) -> None:
    """New keys only: each micro-batch is held against what is stored (J16) before it is appended.

    The store is partitioned by a hash of the keys (`part`), and a batch reads the keys of its own parts only.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        once = batch.dropDuplicates(keys).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        own = [r[0] for r in once.select("part").distinct().collect()]  # at most `parts` numbers
        try:
            once = once.join(spark.read.parquet(path).where(F.col("part").isin(own)).select(*keys), keys, "left_anti")
        except Exception as error:  # noqa: BLE001 - nothing stored yet
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        once.write.mode("append").partitionBy("part").parquet(path)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
