"""Q8: entities, facts and where they stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.matching import matches
from lectern.functions.text import canonical, clean_entity, refined_category

# The order of categories in every output.
CATEGORIES = [
    "Ministries", "Government departments", "Defence organizations", "Agencies", "Committees", "Policies", "Acts", "Rules/regulations",
    "Programs/schemes", "Locations", "Dates", "Monetary amounts", "Percentages", "Organizations", "Equipment/platform names", "People/designations",
]


def category_order(column: str = "category"):
    return F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col(column))


def references(chunks: DataFrame) -> DataFrame:
    """Each (category, canonical form, chunk, sentence) once, with the form as it stands there."""
    rows = chunks.withColumn("m", F.explode(matches("entities", F.col("text")))).select("source_filename", "document_id", "page_number", "chunk_id", "chunk_ord", "m.*")
    entity = clean_entity(F.col("raw"))
    last = F.element_at(F.split(entity, r"\s+and\s+(?:the\s+)?"), -1)
    rows = rows.withColumn("entity", F.when(F.col("category") == "Organizations", last).otherwise(entity))
    rows = rows.where((F.col("entity") != "") & (F.length("entity") <= 180)).withColumn("category", refined_category(F.col("category"), F.col("entity"))).withColumn("canonical", canonical(F.col("entity"))).where("canonical != ''")
    same_place = Window.partitionBy("document_id", "chunk_id", "start", "end", "canonical").orderBy("pattern", "entity")
    rows = rows.withColumn("_n", F.row_number().over(same_place)).where("_n = 1").drop("_n")
    same = Window.partitionBy("category", "canonical", "document_id", "page_number", "chunk_id", "context").orderBy("pattern", "start", "entity")
    return rows.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n", "raw")


def merged(refs: DataFrame) -> DataFrame:
    """(category, entity, canonical, references, documents); an entity is named as where it first stands
    (document, page, chunk). Counts only: the references stay rows, so a common entity is no long list."""
    place = F.struct("document_id", "page_number", "chunk_ord", "pattern", "start", "entity")
    return refs.groupBy("category", "canonical").agg(F.min_by("entity", place).alias("entity"), F.count(F.lit(1)).alias("references"), F.count_distinct("document_id").alias("documents"))


def counts(entities: DataFrame) -> DataFrame:
    """Entities by category, in the fixed order."""
    return entities.groupBy("category").agg(F.count(F.lit(1)).alias("entities")).withColumn("position", category_order()).orderBy("position")


def facts(refs: DataFrame) -> DataFrame:
    """References with ids F1, F2, .. running over categories, entities, files, pages and chunks."""
    from lectern.operators.timeline import globally_numbered

    named = refs.join(merged(refs).select("category", "canonical", F.col("entity").alias("name")), ["category", "canonical"])
    rows = named.select(category_order().alias("category_position"), F.lower("name").alias("sort_name"), "category", F.col("name").alias("entity"), "canonical", "source_filename", "page_number", "chunk_id", "context", "document_id", "start")
    order = ["category_position", "sort_name", "canonical", "source_filename", "page_number", "chunk_id", "start", "context", "document_id"]
    return globally_numbered(rows, order, "position").withColumn("evidence_id", F.concat(F.lit("F"), F.col("position").cast("string"))).drop("sort_name", "category_position", "start", "position")
