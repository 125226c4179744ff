"""Topics, claims with cited evidence, and what of them may stand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import allowed_ids, topics

# Retrieval queries of the two comparisons, and the sections of their results.
COMPARISON_QUERIES = [
    "policy purpose scope common provisions themes",
    "eligibility requirements qualifications criteria",
    "important dates deadlines effective dates thresholds",
    "financial budget funding costs appropriations",
    "authorities agencies departments organizations",
    "obligations responsibilities duties reporting procedures",
    "exceptions exemptions waivers limitations restrictions",
]
CONFLICT_QUERIES = [
    "eligibility criteria minimum maximum thresholds qualifications",
    "dates deadlines effective expiration duration",
    "financial amounts funding budgets costs payments",
    "responsible authorities agencies departments administration",
    "definitions terminology means defined as",
    "requirements obligations restrictions prohibited permitted exemptions",
]
RELATIONSHIPS = ["CONSISTENT", "COMPLEMENTARY", "POTENTIAL CONFLICT", "INSUFFICIENT EVIDENCE"]
BILATERAL = ["similarities", "differences", "conclusion"]
NOT_STATED = "Not stated in retrieved evidence."


def by_topic(chunks: DataFrame) -> DataFrame:
    """One row per chunk and topic."""
    return chunks.withColumn("topic", F.explode(topics(F.coalesce("text", F.lit("")))))


def topic_totals(chunks: DataFrame) -> DataFrame:
    """Chunks and documents of every topic."""
    return by_topic(chunks).groupBy("topic").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("document_id").alias("documents"))


def validated_findings(findings: DataFrame) -> DataFrame:
    """conflict findings with ids that exist (arrays `allowed_a`, `allowed_b`).

    A finding that cites neither side is dropped; one that misses a side cannot establish a relationship.
    """
    a = allowed_ids(F.col("document_a_evidence_ids"), F.col("allowed_a"))
    b = allowed_ids(F.col("document_b_evidence_ids"), F.col("allowed_b"))
    rows = findings.withColumn("a_ids", a).withColumn("b_ids", b).where((F.size("a_ids") > 0) | (F.size("b_ids") > 0))
    both = (F.size("a_ids") > 0) & (F.size("b_ids") > 0)
    stated = lambda side, ids: F.when(F.size(ids) == 0, NOT_STATED).otherwise(F.coalesce(F.nullif(F.trim(side), F.lit("")), F.lit(NOT_STATED)))
    relationship = F.when(~both | ~F.col("relationship").isin(RELATIONSHIPS), "INSUFFICIENT EVIDENCE").otherwise(F.col("relationship"))
    return rows.select("finding_id", F.coalesce(F.nullif(F.trim("topic"), F.lit("")), F.lit("Unspecified topic")).alias("topic"), stated("document_a_statement", "a_ids").alias("document_a_statement"), stated("document_b_statement", "b_ids").alias("document_b_statement"), relationship.alias("relationship"), "a_ids", "b_ids")


def validated_points(points: DataFrame) -> DataFrame:
    """Comparison points (section, text, evidence_ids, comparison_status, not_stated_for) that may stand.

    Ids must be in `allowed`. An overview of one document cites only that document; what is said to be missing
    on one side cites only the other; similarities, differences and conclusions cite both.
    """
    rows = points.withColumn("ids", allowed_ids(F.col("evidence_ids"), F.col("allowed"))).withColumn("sides", F.array_sort(F.array_distinct(F.transform("ids", lambda x: F.substring(x, 1, 1)))))
    only = lambda *sides: F.col("sides") == F.array(*map(F.lit, sides))
    section = F.col("section")
    missing = F.when(section == "unique_a", "Document B").when(section == "unique_b", "Document A").when(F.col("comparison_status") == "not_stated_in_retrieved_evidence", F.col("not_stated_for"))
    absent = section.isin("unique_a", "unique_b") | (F.col("comparison_status") == "not_stated_in_retrieved_evidence")
    rows = rows.withColumn("missing", missing).withColumn("absent", F.coalesce(absent, F.lit(False)))
    stands = F.when(section == "document_a", only("A")).when(section == "document_b", only("B")).otherwise(F.lit(True))
    sided = F.when(F.col("missing") == "Document A", only("B")).when(F.col("missing") == "Document B", only("A")).otherwise(F.lit(False))
    fine = stands & F.when(F.col("absent"), sided).when(section.isin(BILATERAL), only("A", "B")).otherwise(F.lit(True))
    text = F.trim("text")
    kept = rows.where((text != "") & (F.size("ids") > 0) & fine)
    return kept.select("point_id", "section", F.when(F.col("absent"), F.concat("missing", F.lit(f": {NOT_STATED} "), text)).otherwise(text).alias("text"), F.col("ids").alias("evidence_ids"))


def summary_points(points: DataFrame) -> DataFrame:
    """summary points with text and at least one id in `allowed`."""
    rows = points.withColumn("ids", allowed_ids(F.col("evidence_ids"), F.col("allowed")))
    return rows.where((F.trim("text") != "") & (F.size("ids") > 0)).select("point_id", "section", F.trim("text").alias("text"), F.col("ids").alias("evidence_ids"))
