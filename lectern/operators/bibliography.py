"""Q11: papers from pages: running margins dropped, bibliography set apart from the body, entries parsed.

Lines are rows, and what decides about a line are windows over the lines around it in one paper; no text is walked
by a Python function. Input is (paper_id, page_number, text), one row a page; pages without text have no lines. Where
pages may lack a number, `page_index` gives their order; else the number does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import bibliography as b
from lectern.functions.text import dois

EDGE, LEAST_LINES, LEAST_PAGES = 2, 4, 2
LOOK_BACK, LOOK_AHEAD, RUN, RUN_ENTRIES = 12, 15, 64, 5


def pages_of(papers: DataFrame) -> DataFrame:
    """(paper_id, page_index, page_number, text) of papers with `body` and `page_spans`; a paper without spans is one page."""
    spans = F.when(F.size("page_spans") > 0, F.expr("transform(page_spans, s -> struct(s.page_number as page_number, substring(body, s.span_start + 1, s.span_end - s.span_start) as text))"))
    single = F.array(F.struct(F.lit(1).alias("page_number"), F.col("body").alias("text")))
    return papers.where(F.col("body").isNotNull()).select("paper_id", F.posexplode(F.coalesce(spans, single)).alias("page_index", "p")).select("paper_id", "page_index", "p.page_number", "p.text")


def lines_of(pages: DataFrame) -> DataFrame:
    """(paper_id, page_index, page_number, line_no, line) with the flags of `line_flags`; line_no from 0 in its page."""
    placed = pages if "page_index" in pages.columns else pages.withColumn("page_index", F.col("page_number"))
    cut = placed.where(F.coalesce("text", F.lit("")) != "").select("paper_id", "page_index", "page_number", F.posexplode(F.split(F.regexp_replace("text", r"\n\z", ""), r"\r?\n", -1)).alias("line_no", "line"))
    return cut.withColumns(b.line_flags(F.col("line")))


def with_margins(lines: DataFrame) -> DataFrame:
    """`margin` for lines to leave out: the page's number alone, and lines at the edge of a page (first or
    last two of four or more) that stand so, digits apart, on two pages; headings and entries are spared."""
    page = Window.partitionBy("paper_id", "page_index")
    solid = b.stripped(F.col("line")) != ""
    count = F.sum(solid.cast("int"))
    rows = lines.withColumn("_from_top", count.over(page.orderBy("line_no"))).withColumn("_solid", count.over(page))
    at_edge = solid & (F.col("_solid") >= LEAST_LINES) & ((F.col("_from_top") <= EDGE) | (F.col("_from_top") > F.col("_solid") - EDGE))
    key = F.lower(F.regexp_replace(b.stripped(F.col("line")), r"\d+", "#"))
    rows = rows.withColumn("_key", F.when(at_edge & ~(F.col("heading") | F.col("numbered") | F.col("author")) & (key != "#"), key))
    # The pages of one key of one paper, and most lines have no key.
    often = rows.where(F.col("_key").isNotNull()).groupBy("paper_id", "_key").agg(F.count_distinct("page_index").alias("_pages")).where(F.col("_pages") >= LEAST_PAGES).select("paper_id", "_key", F.lit(True).alias("_often"))
    number = b.stripped(F.col("line")) == F.col("page_number").cast("string")
    return rows.join(often, ["paper_id", "_key"], "left").withColumn("margin", F.coalesce(number, F.lit(False)) | F.coalesce("_often", F.lit(False))).drop("_key", "_often", "_from_top", "_solid")


def with_sections(lines: DataFrame) -> DataFrame:
    """Lines that are no margin, numbered through their paper (`n`), with `part`: body, bibliography, or
    heading for headings of the bibliography.

    The last heading with an entry in the 15 lines after it opens the bibliography; one in the first half below a
    table of contents (12 lines) does not. Without one it opens at a well-formed entry of the latter half with five
    such in 64 lines. A body heading or a caption closes it.
    """
    order = Window.partitionBy("paper_id").orderBy("page_index", "line_no")
    rows = lines.where(~F.col("margin")).withColumn("n", F.row_number().over(order) - 1)
    paper, by_n = Window.partitionBy("paper_id"), Window.partitionBy("paper_id").orderBy("n")

    def any_of(flag: Column, first: int, last: int) -> Column:
        return F.coalesce(F.max(flag).over(by_n.rowsBetween(first, last)), F.lit(False))

    half = F.floor(F.count(F.lit(1)).over(paper) / 2)
    listed = (F.col("n") < half) & any_of(F.col("contents"), -LOOK_BACK, -1)
    opens = F.col("heading") & ~listed & any_of(F.col("numbered") | F.col("author"), 1, LOOK_AHEAD)
    run = F.sum(F.col("formed").cast("int")).over(by_n.rowsBetween(0, RUN - 1)) >= RUN_ENTRIES
    rows = rows.withColumn("_opens", opens).withColumn("_run", (F.col("n") >= half) & F.col("bare_author") & run)
    start = F.max(F.when(F.col("_opens"), F.col("n"))).over(paper)
    headless = F.when(start.isNull(), F.min(F.when(F.col("_run"), F.col("n"))).over(paper))
    rows = rows.withColumn("_start", start).withColumn("_headless", headless)
    state = F.when((F.col("n") == F.col("_start")) | (F.col("n") == F.col("_headless")), True).when(F.col("leaves"), False)
    inside = F.coalesce(F.last(state, ignorenulls=True).over(by_n.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    part = F.when(F.col("n") == F.col("_start"), "heading").when(inside & F.col("heading"), "heading").when(inside, "bibliography").otherwise("body")
    return rows.withColumn("part", part).withColumn("found", F.col("_start").isNotNull() | F.col("_headless").isNotNull()).drop("_start", "_headless", "_opens", "_run")


def entries(lines: DataFrame) -> DataFrame:
    """(paper_id, entry_no, label, raw, pages): the bibliography's lines put together as entries.

    A number opens an entry. An author opens one if none is open or a year was read since the last line that could
    have opened one: had that line not, the entry before it would lack a year too, so the rule needs no walk. Body
    headings and long prose close; a short line outside an entry is one of its own, prose there is dropped.
    """
    order = Window.partitionBy("paper_id").orderBy("n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    bare = b.stripped(F.col("line"))
    words = F.size(F.split(bare, r"\s+"))
    rows = lines.where((F.col("part") == "bibliography") & (bare != "")).withColumn("_text", bare)
    closes = b.has(bare, b.BODY, fold=True) | (~F.col("numbered") & (words > b.LONG_LINE) & b.has(bare, b.LONG_PROSE))
    rows = rows.withColumn("_closes", closes).withColumn("_could", ~closes & (F.col("numbered") | F.col("author")))
    text = F.when(F.col("numbered"), F.regexp_extract("_text", "(?U)" + b.NUMBER, 3)).otherwise(F.col("_text"))
    rows = rows.withColumn("text", text).withColumn("_stretch", F.sum((F.col("_could") | F.col("_closes")).cast("int")).over(order))
    rows = rows.withColumn("_year", F.max(b.has(F.col("text"), b.YEAR)).over(Window.partitionBy("paper_id", "_stretch")))
    open_before = F.coalesce(F.last(F.when(F.col("_could"), True).when(F.col("_closes"), False), ignorenulls=True).over(before), F.lit(False))
    rows = rows.withColumn("_open", open_before).withColumn("_dated", F.coalesce(F.lag("_year").over(order), F.lit(False)))
    stray = ~F.col("_could") & ~F.col("_open") & ~F.col("_closes")
    lone = stray & (F.length("_text") > 3) & (words <= b.LONG_LINE) & ~b.has(F.col("_text"), b.PROSE)
    first = (F.col("_could") & (F.col("numbered") | ~F.col("_open") | F.col("_dated"))) | lone
    kept = rows.withColumn("_first", first).where(~F.col("_closes") & (~stray | lone)).withColumn("entry_no", F.sum(F.col("_first").cast("int")).over(order))
    label = F.when(F.col("_first") & F.col("numbered"), F.coalesce(F.nullif(F.regexp_extract("_text", b.NUMBER, 1), F.lit("")), F.regexp_extract("_text", b.NUMBER, 2)).cast("bigint"))
    parts = F.array_sort(F.collect_list(F.struct("n", "text", "page_number")))
    whole = kept.withColumn("_label", label).groupBy("paper_id", "entry_no").agg(F.max("_label").alias("label"), parts.alias("l"))
    return whole.select("paper_id", "entry_no", "label", F.array_join("l.text", " ").alias("raw"), F.array_compact(F.array_distinct("l.page_number")).alias("pages"))


def references(found: DataFrame) -> DataFrame:
    """Entries with ids R1, R2, .., their fields, DOI, excerpt and status."""
    rows = found.withColumn("f", b.entry_fields(F.col("raw"))).withColumn("doi", F.coalesce(F.get(dois(F.col("raw")), F.lit(0)), F.lit("")))
    return rows.select(
        "paper_id", F.concat(F.lit("R"), F.col("entry_no").cast("string")).alias("reference_id"), "label", "raw", "pages", "f.authors", "f.title", "f.year", "f.surname", "f.parsed", "doi",
        F.substring("raw", 1, b.EXCERPT).alias("excerpt"), F.when(F.col("f.parsed"), b.PARSED).otherwise(b.UNPARSED).alias("status"),
    )


def bodies(lines: DataFrame) -> DataFrame:
    """(paper_id, body, page_spans): the text without margins and bibliography, and the stretch of every page in it."""
    own = lines.where("part = 'body'").groupBy("paper_id", "page_index").agg(F.first("page_number").alias("page_number"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    text = own.select("paper_id", "page_index", "page_number", F.concat(F.array_join("l.line", "\n"), F.lit("\n")).alias("text"))
    end = F.sum(F.length("text")).over(Window.partitionBy("paper_id").orderBy("page_index"))
    placed = text.withColumn("span_end", end).withColumn("span_start", F.col("span_end") - F.length("text"))
    joined = placed.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "page_number", "text", "span_start", "span_end"))).alias("p"))
    spans = F.transform("p", lambda x: F.struct(x["span_start"].cast("int").alias("span_start"), x["span_end"].cast("int").alias("span_end"), x["page_number"].alias("page_number")))
    return joined.select("paper_id", F.array_join("p.text", "").alias("body"), spans.alias("page_spans"))


def notes(pages: DataFrame, margined: DataFrame, sectioned: DataFrame) -> DataFrame:
    """(paper_id, found, removed_lines, unreadable_pages, ocr_pages): what a reader of the paper must know."""
    method = F.col("extraction_method") if "extraction_method" in pages.columns else F.lit(None).cast("string")
    per_page = pages.withColumn("_m", method).groupBy("paper_id").agg(F.count_if(F.coalesce(b.stripped(F.col("text")), F.lit("")) == "").alias("unreadable_pages"), F.count_if(F.col("_m") == "OCR").alias("ocr_pages"))
    removed = margined.groupBy("paper_id").agg(F.count_if("margin").alias("removed_lines"))
    found = sectioned.groupBy("paper_id").agg(F.bool_or("found").alias("found"))
    return per_page.join(removed, "paper_id", "left").join(found, "paper_id", "left").select("paper_id", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("removed_lines", F.lit(0)).alias("removed_lines"), "unreadable_pages", "ocr_pages")


def papers_from(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Q11: (bodies, references, notes) of the papers whose pages are given."""
    margined = with_margins(lines_of(pages))
    sectioned = with_sections(margined)
    return bodies(sectioned), references(entries(sectioned)), notes(pages, margined, sectioned)
