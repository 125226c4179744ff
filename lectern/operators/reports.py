"""K5-K8: reports as Markdown, one row per section, and one text of a bounded report at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import table_cell


def table_lines(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """K6: (line_order.., line): each row as a Markdown table line."""
    cells = [F.coalesce(table_cell(F.col(c)), F.lit("")) for c in columns]
    return rows.select(*order, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def table_head(columns: list[str]) -> str:
    return "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |"


def cited_points(points: DataFrame, evidence: DataFrame) -> DataFrame:
    """K8: points with the file and page of their evidence: (section, point_id, line)."""
    cited = points.select("section", "point_id", "text", F.posexplode("evidence_ids").alias("n", "evidence_id")).join(evidence.select("evidence_id", "source_filename", "page_number"), "evidence_id")
    mark = F.concat(F.lit("["), "evidence_id", F.lit("] "), "source_filename", F.lit(", p. "), F.col("page_number").cast("string"))
    # a point cites at most a handful of ids
    listed = cited.groupBy("section", "point_id", "text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", mark.alias("m")))), lambda x: x["m"]), "; ").alias("marks"))
    return listed.select("section", "point_id", F.concat(F.lit("- "), "text", F.lit(" ("), "marks", F.lit(")")).alias("line"))


def rendered(title: str, notes: list[str], sections: list[tuple[str, DataFrame, list[str]]], most_lines: int = 2000) -> str:
    """K5, K7: one Markdown text; each section takes its first `most_lines` lines and says so if there are more."""
    out = [f"# {title}", *notes]
    for name, lines, order in sections:
        rows = lines.orderBy(*order).limit(most_lines + 1).select("line").collect()
        out += ["", f"## {name}", *[r[0] for r in rows[:most_lines]]]
        if len(rows) > most_lines:
            out.append(f"(more than {most_lines} lines)")
    return "\n".join(out) + "\n"
