"""Q7: dated events in chronological order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.matching import matches
from lectern.functions.text import event_type

# The day formats that count as a parsed date.
DAY_FORMATS = ["yyyy-M-d", "yyyy/M/d", "d MMMM yyyy", "d MMM yyyy", "MMMM d yyyy", "MMM d yyyy"]
MONTH_NAMES = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def sort_key(date: Column, precision: Column) -> Column:
    """struct(year, month, day, rank, text): exact days first, then months, fiscal years, and last relative
    and unreadable dates, which sort as the end of 9999."""
    plain = F.regexp_replace(F.replace(F.regexp_replace(date, r"(?i)(\d)(st|nd|rd|th)\b", "$1"), F.lit(","), F.lit("")), r"(?i)\bSept\b", "Sep")
    titled = F.initcap(F.regexp_replace(plain, r"\s+", " "))
    day = F.coalesce(*[F.try_to_timestamp(titled, F.lit(f)) for f in DAY_FORMATS])
    low = F.lower(date)
    year = F.regexp_extract(date, r"(?:19|20)\d{2}", 0).cast("int")
    month = (F.array_position(F.array(*map(F.lit, MONTH_NAMES)), F.substring(low, 1, 3))).cast("int")

    def key(y, m, d, rank):
        return F.struct(y.cast("int").alias("year"), m.cast("int").alias("month"), d.cast("int").alias("day"), F.lit(rank).alias("rank"), low.alias("text"))

    last = key(F.lit(9999), F.lit(12), F.lit(31), 3)
    exact = F.when(day.isNotNull(), key(F.year(day), F.month(day), F.dayofmonth(day), 0)).otherwise(last)
    return F.when(precision == "exact", exact).when(precision == "month", key(F.regexp_extract(date, r"((?:19|20)\d{2})$", 1).try_cast("int"), month, F.lit(0), 1)).when(precision == "fiscal", key(year, F.lit(1), F.lit(0), 2)).otherwise(last)


def events(chunks: DataFrame) -> DataFrame:
    """The dated passages of chunks, each (document, page, date, passage) once.

    Of repeats (overlapping chunks hold the same sentence) the first chunk by `chunk_ord` and chunk id is kept.
    Chunks without a digit have no date and skip the recogniser.
    """
    dated = chunks.where(F.col("text").rlike("[0-9]")).withColumn("m", F.explode(matches("dates", F.col("text"))))
    rows = dated.select("source_filename", "document_id", "page_number", "chunk_id", "chunk_ord", "extraction_method", "m.*").withColumn("event_type", event_type(F.col("event")))
    first = Window.partitionBy("document_id", "page_number", F.lower("date"), F.lower("event")).orderBy("chunk_ord", "chunk_id", "date", "date_precision", "event")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "chunk_ord")


def timeline(chunks: DataFrame, numbered_by: list[str] | None = None) -> DataFrame:
    """Events with ids T1, T2, .. in order of date, file, page and chunk.

    The ids run over everything unless `numbered_by` names columns to start anew for (one document's timeline
    is numbered in parallel; one over everything is a global order, which Spark range-sorts before numbering).
    """
    rows = events(chunks).withColumn("key", sort_key(F.col("date"), F.col("date_precision")))
    order = ["key", "source_filename", "page_number", "chunk_id", "event", "document_id"]
    if numbered_by:
        rows = rows.withColumn("position", F.row_number().over(Window.partitionBy(*numbered_by).orderBy(*order)))
    else:
        rows = globally_numbered(rows, order, "position")
    return rows.withColumn("evidence_id", F.concat(F.lit("T"), F.col("position").cast("string"))).drop("key")


def globally_numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Row numbers over one total order without a single task: ranges are sorted and counted in parallel, and
    each range starts after the rows of the ranges before it (one number per range)."""
    from lectern.session import cut

    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    # The checkpoint keeps partitions and their order, and within a partition the id grows by one with every row.
    local = ranged.withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counts = {r[0]: r[1] for r in ranged.groupBy("_part").agg(F.count(F.lit(1))).collect()}  # one number a range
    before, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, before))
        before += counts[part]
    starts = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part int, _before bigint"))
    return local.join(starts, "_part").withColumn(name, F.col("_row") + F.col("_before") + 1).drop("_part", "_row", "_before")


def timeline_summary(rows: DataFrame) -> DataFrame:
    """Per document its number of events and the earliest and latest date that is not relative."""
    keyed = rows.withColumn("key", sort_key(F.col("date"), F.col("date_precision"))).withColumn("fixed", F.col("date_precision") != "relative")
    return keyed.groupBy("document_id").agg(F.count(F.lit(1)).alias("events"), F.min_by("date", F.when(F.col("fixed"), F.struct("key", "date"))).alias("earliest"), F.max_by("date", F.when(F.col("fixed"), F.struct("key", "date"))).alias("latest"))
