"""Summaries made of source sentences, and the grouping of chunks under a budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import readable, sentences, utf8_cost

GROUP_CHUNKS, GROUP_BYTES, CHUNK_RESERVE = 20, 10_000, 100
LONG_WORD = r"[\p{L}\p{N}_]{4,}"


def bounded(chunks: DataFrame, budget: int = GROUP_BYTES) -> DataFrame:
    """Readable chunks, stripped; one beyond the budget is cut into pieces of a fixed width (a
    quarter of the budget, as a character has at most four bytes) named by their offset."""
    width = (budget - CHUNK_RESERVE) // 4
    rows = chunks.where(readable(F.col("text"))).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    fits = utf8_cost(F.col("text")) + CHUNK_RESERVE <= budget
    offsets = F.when(fits, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length("text") - 1, F.lit(width)))
    cut = rows.withColumn("_fits", fits).withColumn("offset", F.explode(offsets))
    return cut.withColumn("chunk_id", F.when(F.col("_fits"), F.col("chunk_id")).otherwise(F.concat("chunk_id", F.lit(":"), F.col("offset").cast("string")))).withColumn("text", F.when(F.col("_fits"), F.col("text")).otherwise(F.substring(F.col("text"), F.col("offset") + 1, F.lit(width)))).drop("_fits")


def grouped(chunks: DataFrame, order: list[str], most: int = GROUP_CHUNKS, budget: int = GROUP_BYTES) -> DataFrame:
    """`group_no` of each chunk: consecutive chunks of one document, at most `most` and within the budget.

    Where a group ends depends on where the one before ended, so documents are walked in order; a task streams
    its sorted partition and holds one running total, never a document.
    """
    rows = chunks.select("document_id", *order, (utf8_cost(F.col("text")) + CHUNK_RESERVE).cast("bigint").alias("cost"))

    def walk(batches):
        document, number, count, total = None, 0, 0, 0
        for batch in batches:
            numbers = []
            for d, cost in zip(batch["document_id"], batch["cost"], strict=True):
                if d != document:
                    document, number, count, total = d, 1, 0, 0
                elif count >= most or total + cost > budget:
                    number, count, total = number + 1, 0, 0
                count, total = count + 1, total + cost
                numbers.append(number)
            yield batch.assign(group_no=pd.Series(numbers, index=batch.index, dtype="int64"))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", group_no bigint"
    return rows.repartition("document_id").sortWithinPartitions("document_id", *order).mapInPandas(walk, shape)


def extractive(chunks: DataFrame, by: list[str], order: list[str], most: int = 8, least: int = 25) -> DataFrame:
    """Up to `most` sentences of each scope `by`, best first, taking pages in turns.

    A sentence scores the scope's frequencies of its words of four or more characters, over its length. Round r
    takes the r-th best sentence of every page; a sentence met before uses up its page's turn.
    """
    cut = chunks.select(*by, "page_number", "chunk_id", *order, F.posexplode(sentences(F.col("text"))).alias("n", "sentence"))
    rows = cut.withColumn("sentence", F.trim("sentence")).where((F.length("sentence") >= least) & readable(F.col("sentence")))
    words = rows.select(*by, "page_number", "chunk_id", *order, "n", "sentence", F.explode_outer(F.transform(F.regexp_extract_all("sentence", F.lit(LONG_WORD), F.lit(0)), F.lower)).alias("word"))
    totals = words.where("word is not null").groupBy(*by, "word").agg(F.count(F.lit(1)).alias("f"))
    key = list(dict.fromkeys([*by, "page_number", "chunk_id", *order, "n", "sentence"]))
    scored = words.join(totals, [*by, "word"], "left").groupBy(*key).agg(F.coalesce(F.sum("f"), F.lit(0)).alias("weight")).withColumn("score", F.col("weight") / F.greatest(F.lit(1), F.length("sentence")))
    tie = ["page_number", *order, "chunk_id", "n"]
    page = Window.partitionBy(*by, "page_number").orderBy(F.desc("score"), *tie)
    turn = scored.withColumn("turn", F.row_number().over(page))
    first = F.max("score").over(Window.partitionBy(*by, "page_number"))
    seen = Window.partitionBy(*by, "sentence").orderBy("turn", F.desc("page_best"), "page_number")
    unique = turn.withColumn("page_best", first).withColumn("_seen", F.row_number().over(seen)).where("_seen = 1")
    place = Window.partitionBy(*by).orderBy("turn", F.desc("page_best"), "page_number")
    return unique.withColumn("position", F.row_number().over(place)).where(F.col("position") <= most).select(*by, "position", "page_number", "chunk_id", "sentence", "score")
