"""Evidence: ids, selection, validation, citations, strength and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.responses import answer_of
from lectern.functions.text import allowed_ids, evidence_terms, negative_modality, positive_modality, POSITIVE_MODALITIES
from lectern.operators.timeline import globally_numbered

KEY = ["document_id", "chunk_id"]
INSUFFICIENT = "I could not find sufficient evidence in the indexed documents to answer this question reliably."  # fixed value


def numbered(rows: DataFrame, prefix: str, order: list[Column | str], by: list[str] | None = None, name: str = "evidence_id") -> DataFrame:
    """Ids of a prefix and a number from 1 in the given order, over everything or per group `by`."""
    if by:
        place = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    else:
        place = globally_numbered(rows, order, "_place")
    return place.withColumn(name, F.concat(F.lit(prefix), F.col("_place").cast("string"))).drop("_place")


def once_per_chunk(rows: DataFrame, order: list[Column | str], by: list[str] | None = None) -> DataFrame:
    """The first row of each chunk in the given order."""
    window = Window.partitionBy(*(by or []), *KEY).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def selected_hybrid(rows: DataFrame, by: str = "query_id", floor: float = 0.28, gap: float = 0.25) -> DataFrame:
    """rows near the best hybrid score, and all that a keyword found."""
    top = F.max("hybrid_score").over(Window.partitionBy(by))
    return rows.withColumn("_top", top).where((F.col("hybrid_score") >= F.greatest(F.lit(floor), F.col("_top") - gap)) | F.col("retrieval_source").isin("Keyword", "Both")).drop("_top")


def selected_semantic(rows: DataFrame, by: str = "query_id", least_top: float = 0.28, floor: float = 0.25, gap: float = 0.15) -> DataFrame:
    """nothing unless the best similarity is high enough, else rows near it."""
    top = F.max("similarity").over(Window.partitionBy(by))
    return rows.withColumn("_top", top).where((F.col("_top") >= least_top) & (F.col("similarity") >= F.greatest(F.lit(floor), F.col("_top") - gap))).drop("_top")


def strength(best: Column, average: Column) -> Column:
    """A5: High, Moderate or Low by the best and average similarity; nothing is Low."""
    return F.when((best >= 0.60) & (average >= 0.50), "High").when((best >= 0.40) & (average >= 0.32), "Moderate").otherwise("Low")


def valid_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, evidence_ids): the proposed ids of each answer that its evidence has.

    The evidence of one answer is a short selected list (F5), so its ids fit one array.
    """
    allowed = evidence.groupBy("query_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("allowed"))
    none = F.array().cast("array<string>")
    return answers.join(allowed, "query_id", "left").select("query_id", allowed_ids(F.coalesce("proposed_ids", none), F.coalesce("allowed", none)).alias("evidence_ids"))


def verified_sources(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Metadata of cited evidence in the order of citation, each chunk once."""
    cited = citations.select("query_id", F.posexplode("evidence_ids").alias("position", "evidence_id"))
    rows = cited.join(evidence, ["query_id", "evidence_id"])
    return once_per_chunk(rows, ["position"], ["query_id"]).select("query_id", "position", "evidence_id", "source_filename", "document_id", "page_number", "chunk_id", "extraction_method")


def grounded(queries: DataFrame, retrieved: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q2: (answers, sources) of queries from what was retrieved for them and the responses of a model.

    Retrieved rows are numbered E1, E2, .. and selected (F5); where confidence says there is too little, no response
    is used and nothing is cited. Responses (query_id, response) are read as JSON; of their ids those count that the
    selected evidence has. `queries` has (query_id, query).
    """
    rows = numbered(retrieved, "E", [F.desc("hybrid_score"), "rank"], ["query_id"])
    chosen = selected_hybrid(rows)
    counts = chosen.groupBy("query_id").agg(F.count(F.lit(1)).alias("selected_count"), F.max("similarity").alias("best"), F.avg("similarity").alias("average"))
    asked = queries.join(counts.drop("best", "average"), "query_id", "left").fillna({"selected_count": 0}).withColumn("sufficient", F.lit(True))
    sure = confidence(asked, rows).select("query_id", "level", "conflict")
    read = queries.select("query_id").join(responses, "query_id", "left").select("query_id", answer_of(F.col("response")).alias("a"))
    usable = read.join(sure, "query_id", "left").withColumn("enough", F.coalesce(F.col("level") != "INSUFFICIENT", F.lit(False)))
    proposed = usable.select("query_id", "enough", "level", "conflict", F.when(F.col("enough"), F.col("a.answer")).otherwise(INSUFFICIENT).alias("answer"), F.when(F.col("enough"), F.col("a.evidence_ids")).alias("proposed_ids"))
    cited = valid_citations(proposed.select("query_id", "proposed_ids"), chosen)
    answers = proposed.drop("proposed_ids").join(cited, "query_id").join(counts, "query_id", "left").withColumn("strength", strength(F.col("best"), F.col("average"))).drop("best", "average", "selected_count")
    return answers, verified_sources(cited, chosen)


def opposed_pairs(rows: DataFrame, by: str = "query_id") -> DataFrame:
    """Pairs of chunks of one query of which one permits or obliges and the other forbids, with a
    common term (one of the query's terms, if `query_terms` has any).

    Pairs meet on a shared term as an equi-join of (query, term) rows, each side only with its own modality, so
    the join never sees pairs of equal modality.
    """
    terms = rows.select(by, "evidence_id", positive_modality(F.col("text")).alias("positive"), negative_modality(F.col("text")).alias("negative"), "query_terms", F.explode(evidence_terms(F.lower("text"))).alias("term"))
    named = (F.size("query_terms") == 0) | F.array_contains("query_terms", F.col("term"))
    terms = terms.where(named & ~F.col("term").isin(POSITIVE_MODALITIES))
    for_it = terms.where("positive").select(by, "term", F.col("evidence_id").alias("positive_id"))
    against = terms.where("negative").select(by, "term", F.col("evidence_id").alias("negative_id"))
    return for_it.join(against, [by, "term"]).groupBy(by, "positive_id", "negative_id").agg(F.count_distinct("term").alias("common_terms"))


def confidence(queries: DataFrame, supporting: DataFrame, by: str = "query_id") -> DataFrame:
    """Level, score and its parts for each query (query_id, query, selected_count, sufficient).

    `supporting` has the cited chunks. Null similarities are left out of the best one. Levels: INSUFFICIENT
    where the caller says so, without support, or where neither vectors nor words connect query and support;
    LOW under an explicit conflict; else by an additive score (7: HIGH, 4: MEDIUM).
    """
    asked = queries.select(by, "query", "selected_count", F.coalesce("sufficient", F.lit(True)).alias("sufficient"), evidence_terms(F.col("query")).alias("query_terms"))
    rows = supporting.join(asked.select(by, "query_terms"), by)
    # Terms of the support matter only where the query has them, so the collected sets are bounded by the query.
    hit = F.array_intersect(evidence_terms(F.coalesce("text", F.lit(""))), F.col("query_terms"))
    facts = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("support"),
        F.count_distinct(F.when(F.col("document_id") != "", F.col("document_id"))).alias("documents"),
        F.array_distinct(F.flatten(F.collect_set(hit))).alias("hits"),
        F.avg(F.when(F.col("retrieval_source") == "Both", 1.0).otherwise(0.0)).alias("agreement"),
        F.max(F.coalesce("semantic_similarity", F.when(F.col("retrieval_source").isNull(), F.col("similarity")))).alias("top"),
        F.bool_or(F.col("retrieval_source").isin("Keyword", "Both") & F.col("keyword_score").isNotNull()).alias("lexical"),
    )
    clash = opposed_pairs(rows, by).groupBy(by).agg(F.lit(True).alias("conflict"))
    all_ = asked.join(facts, by, "left").join(clash, by, "left").fillna({"support": 0, "documents": 0, "agreement": 0.0, "top": 0.0, "lexical": False, "conflict": False})
    terms = F.size("query_terms")
    out = all_.withColumn("citation_coverage", F.col("support") / F.greatest("selected_count", F.lit(1))).withColumn("term_coverage", F.when(terms > 0, F.coalesce(F.size("hits"), F.lit(0)) / terms).otherwise(0.0))
    out = out.withColumn("term_coverage", F.when(F.col("hits").isNull(), 0.0).otherwise(F.col("term_coverage")))
    points = (
        F.when(F.col("top") >= 0.60, 2).when(F.col("top") >= 0.40, 1).otherwise(0)
        + F.when(F.col("support") >= 3, 2).when(F.col("support") >= 2, 1).otherwise(0)
        + F.when(F.col("documents") >= 2, 1).otherwise(0)
        + F.when(F.col("citation_coverage") >= 0.75, 2).when(F.col("citation_coverage") >= 0.50, 1).otherwise(0)
        + F.when(F.col("term_coverage") >= 0.60, 1).otherwise(0)
        + F.when(F.col("agreement") >= 0.50, 1).otherwise(0)
    )
    nothing = ~F.col("sufficient") | (F.col("support") == 0) | ((F.col("top") < 0.20) & ~F.col("lexical") & (F.col("term_coverage") < 0.20))
    level = F.when(nothing, "INSUFFICIENT").when(F.col("conflict"), "LOW").when(F.col("points") >= 7, "HIGH").when(F.col("points") >= 4, "MEDIUM").otherwise("LOW")
    return out.withColumn("points", points).select(by, level.alias("level"), "points", "support", "documents", "citation_coverage", "term_coverage", "agreement", "top", "conflict")
