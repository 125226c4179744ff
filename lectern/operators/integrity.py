"""Papers: bibliographies, citations, overlap with sources."""

from __future__ import annotations

from difflib import SequenceMatcher
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern.functions.bibliography import HEADING, has
from lectern.functions.grams import array_hashes, word_hashes
from lectern.functions.matching import matches
from lectern.functions.text import half_even

SEED_WORDS, NEAR_RATIO, WINDOW_WORDS, LEAST_WINDOW = 8, 0.88, 60, 8
# Statuses a reader sees.
MATCHED, AMBIGUOUS, MISSING = "Matched bibliography entry", "Ambiguous bibliography match", "Missing bibliography reference"
QUOTED_CITED, CITED_ONLY = "Quoted and source citation observed — review quotation accuracy", "Source citation observed; complete quotation not detected"
QUOTED_ONLY, UNATTRIBUTED = "Quoted; source citation association not established", "Potentially unattributed overlap — review required"
# End of the fixed values.


def union_length(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """(by.., covered): positions in the union of half-open ranges, by gaps and islands."""
    order = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(before, F.col(start))))
    return rows.where(F.col(end) > F.col(start)).withColumn("_fresh", fresh).groupBy(*by).agg(F.sum("_fresh").alias("covered"))


def page_of(rows: DataFrame, papers: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Rows with `pages`, the sorted distinct pages of the paper whose span meets the row's range."""
    spans = papers.select("paper_id", F.explode("page_spans").alias("s")).select("paper_id", F.col("s.span_start").alias("_a"), F.col("s.span_end").alias("_b"), F.col("s.page_number").alias("_page")).distinct()
    keyed = rows.withColumn("_row", F.xxhash64(*rows.columns))
    meets = (F.col(start) < F.col("_b")) & (F.col(end) > F.col("_a"))
    found = keyed.select("paper_id", "_row", start, end).distinct().join(spans, "paper_id").where(meets).groupBy("paper_id", "_row").agg(F.array_sort(F.collect_set("_page")).alias("pages"))
    return keyed.join(found, ["paper_id", "_row"], "left").drop("_row").withColumn("pages", F.coalesce("pages", F.array().cast("array<int>")))


def markers(papers: DataFrame, text: str = "body") -> DataFrame:
    """Q12: citation markers of every paper: (paper_id, style, marker, target, year, start, end)."""
    once = papers.where(F.col(text).isNotNull()).select("paper_id", text).dropDuplicates(["paper_id"])
    return once.select("paper_id", F.explode(matches("citations", F.col(text))).alias("m")).select("paper_id", "m.*")


def matched_citations(found: DataFrame, references: DataFrame) -> DataFrame:
    """Markers with the references they may mean and a status by their number.

    `references` has (paper_id, reference_id, label, surname, year, doi). The three styles are three values of
    one join key, so it is one join.
    """
    targets = references.select("paper_id", "reference_id", F.explode(F.array(F.concat_ws("\1", F.lit("numeric"), F.col("label").cast("string"), F.lit("")), F.concat_ws("\1", F.lit("author-year"), "surname", "year"), F.concat_ws("\1", F.lit("DOI"), "doi", F.lit("")))).alias("key"))
    keyed = found.withColumn("key", F.concat_ws("\1", "style", "target", "year"))
    ids = F.array_sort(F.collect_set("reference_id"))
    rows = keyed.join(targets, ["paper_id", "key"], "left").groupBy("paper_id", "style", "marker", "start", "end", "key").agg(ids.alias("reference_ids"))
    status = F.when(F.size("reference_ids") == 1, MATCHED).when(F.size("reference_ids") > 1, AMBIGUOUS).otherwise(MISSING)
    return rows.drop("key").withColumn("status", status)


def reference_use(matched: DataFrame, references: DataFrame) -> DataFrame:
    """Which references are cited (by a unique match) and which only ambiguously."""
    used = matched.select("paper_id", F.explode("reference_ids").alias("reference_id"), (F.size("reference_ids") == 1).alias("unique"))
    flags = used.groupBy("paper_id", "reference_id").agg(F.bool_or("unique").alias("cited"), F.bool_or(~F.col("unique")).alias("ambiguous_citation"))
    return references.join(flags, ["paper_id", "reference_id"], "left").fillna({"cited": False, "ambiguous_citation": False})


def numbered_words(texts: DataFrame, id_col: str, text_col: str, most: int | None = None) -> DataFrame:
    """(id, position, word, start, end), from 0, of the first `most` words of each text."""
    rows = texts.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col).dropDuplicates([id_col])
    found = matches("words", F.col(text_col))
    cut = found if most is None else F.slice(found, 1, most)
    return rows.select(id_col, F.posexplode(cut).alias("position", "m")).select(id_col, "position", "m.word", "m.start", "m.end")


def word_grams(texts: DataFrame, id_col: str, text_col: str, width: int, most: int | None = None) -> DataFrame:
    """(id, position, gram): a hash of `width` words in a row at every position."""
    rows = texts.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col).dropDuplicates([id_col])
    return rows.select(id_col, F.posexplode(word_hashes(F.col(text_col), width, most)).alias("position", "gram"))


def exact_runs(submitted: DataFrame, sources: DataFrame, *, sid: str = "doc_id", stext: str = "text", rid: str = "item_id", rtext: str = "text", width: int = SEED_WORDS, most_seeds: int | None = 20) -> DataFrame:
    """Greedy leftmost-longest runs of equal words of each (submitted text, source).

    Seeds of `width` words meet by equi-join, at most `most_seeds` places of a seed within a source (the rule of
    the analysis, not a guard; None takes all). Seeds on one diagonal in a row are one maximal run; of the runs from a place the
    longest is taken and the search goes on after it, which is a walk over the few runs of one pair.
    """
    seeds = word_grams(sources, rid, rtext, width)
    if most_seeds is not None:
        seeds = seeds.withColumn("_n", F.row_number().over(Window.partitionBy(rid, "gram").orderBy("position"))).where(F.col("_n") <= most_seeds)
    seeds = seeds.select(rid, "gram", F.col("position").alias("there"))
    met = word_grams(submitted, sid, stext, width).join(seeds, "gram").select(sid, rid, F.col("position").alias("here"), "there")
    diagonal = Window.partitionBy(sid, rid, F.col("here") - F.col("there")).orderBy("here")
    islands = met.withColumn("_i", F.col("here") - F.row_number().over(diagonal)).groupBy(sid, rid, (F.col("here") - F.col("there")).alias("_d"), "_i").agg(F.min("here").alias("a"), (F.max("here") + width).alias("b"))

    def taken(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """`runs` (first word, one past the last, diagonal) in order of their first word, larger diagonals first."""
        out, at, k, open_runs = [], 0, 0, []
        while True:
            ahead = [r for r in open_runs if r[1] - width >= at]
            while k < len(runs) and runs[k][0] <= at:
                if runs[k][1] - width >= at:
                    ahead.append(runs[k])
                k += 1
            open_runs = ahead
            if ahead:
                _, b, d = max(ahead, key=lambda r: (r[1], r[2]))
                out.append((at, b, at - d, b - d))
                at = b
            elif k == len(runs):
                return out
            else:
                at = runs[k][0]

    def greedy(batches):
        """Pairs arrive one after another, sorted; the few runs of one pair are held at a time."""

        def rows():
            pair, runs = None, []
            for batch in batches:
                for sid_, rid_, a, b, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (sid_, rid_) != pair:
                        yield from ((*pair, *run) for run in taken(runs)) if runs else ()
                        pair, runs = (sid_, rid_), []
                    runs.append((a, b, d))
            if runs:
                yield from ((*pair, *run) for run in taken(runs))

        found = rows()
        while part := list(islice(found, 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True)], names)

    types = {f.name: f.dataType for f in islands.schema.fields}
    names = [sid, rid, "word_start", "word_end", "source_start", "source_end"]
    kinds = [to_arrow_type(types[sid]), to_arrow_type(types[rid]), *[pa.int64()] * 4]
    shape = ", ".join(f"`{n}` {types[n].simpleString() if n in types else 'bigint'}" for n in names)
    ordered = islands.select(sid, rid, "a", "b", "_d").repartition(sid, rid).sortWithinPartitions(sid, rid, "a", F.desc("_d"))
    return ordered.mapInArrow(greedy, shape)


def windows(texts: DataFrame, id_col: str, text_col: str, width: int = WINDOW_WORDS, least: int = LEAST_WINDOW, most: int | None = 1000) -> DataFrame:
    """(id, window, words, word_start): tumbling windows of `width` words, the last one if long
    enough; the first `most`, or all."""
    rows = texts.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col).dropDuplicates([id_col])
    listed = rows.select(id_col, matches("plain_words", F.col(text_col)).alias("w")).where(F.size("w") >= least)
    last = F.floor((F.size("w") - 1) / width).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last if most is None else F.least(F.lit(most - 1), last)), lambda i: F.slice("w", i * width + 1, width))
    return listed.select(id_col, F.posexplode(cut).alias("window", "words")).where(F.size("words") >= least).withColumn("word_start", F.col("window") * width)


def near_exact(submitted: DataFrame, sources: DataFrame, *, sid: str = "doc_id", stext: str = "text", rid: str = "item_id", rtext: str = "text", seed: int = 4, candidates: int | None = 10, ratio: float = NEAR_RATIO, most: int | None = 1000) -> DataFrame:
    """Windows that nearly equal a source window: the best candidate with `ratio` <= similarity < 1.

    Two windows this similar share `seed` words in a row (at most an eighth of the words differ, so the equal
    blocks cannot all be shorter), or one less where at most 16 words are equal, so in windows of up to 21 words;
    this keeps the candidate join to such windows; of these the `candidates` with
    most common words are compared, ties to the earlier window; all with None, as `most` None takes all windows.
    """

    def seeded(df, key):
        grams, shorter = (array_hashes(F.col("words"), n) for n in (seed, seed - 1))
        return df.select(key, "window", F.explode(F.when(F.size("words") <= 21, F.concat(grams, shorter)).otherwise(grams)).alias("gram"))

    mine, theirs = windows(submitted, sid, stext, most=most), windows(sources, rid, rtext, most=most)
    met = seeded(mine, sid).join(seeded(theirs, rid).withColumnRenamed("window", "source_window"), "gram").select(sid, "window", rid, "source_window").distinct()
    both = met.join(mine.withColumnRenamed("words", "a"), [sid, "window"]).join(theirs.select(rid, F.col("window").alias("source_window"), F.col("words").alias("b"), F.col("word_start").alias("source_start")), [rid, "source_window"])
    common = F.size(F.array_intersect("a", "b"))
    ranked = both.withColumn("_n", F.row_number().over(Window.partitionBy(sid, "window", rid).orderBy(F.desc(common), "source_window"))).where(F.lit(True) if candidates is None else F.col("_n") <= candidates)

    @F.pandas_udf("struct<similarity: double, equal_words: int, blocks: array<struct<a: int, b: int>>>")
    def compared(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            m = SequenceMatcher(None, list(x), list(y), autojunk=False)
            blocks = [(block.a, block.a + block.size) for block in m.get_matching_blocks() if block.size]
            out.append((m.ratio(), sum(j - i for i, j in blocks), [{"a": i, "b": j} for i, j in blocks]))
        return pd.DataFrame(out, columns=["similarity", "equal_words", "blocks"])

    scored = ranked.withColumn("c", compared("a", "b")).select(sid, "window", "word_start", F.size("a").alias("words"), rid, "source_window", "source_start", F.size("b").alias("source_words"), "_n", "c.*")
    good = scored.where((F.col("similarity") >= ratio) & (F.col("similarity") < 1) & (F.col("equal_words") >= LEAST_WINDOW))
    first = Window.partitionBy(sid, "window", rid).orderBy("_n")
    rows = good.withColumn("_f", F.row_number().over(first)).where("_f = 1")
    return rows.select(sid, "window", "word_start", "words", rid, "source_window", "source_start", "source_words", half_even(F.col("similarity"), 4).alias("similarity"), "equal_words", "blocks")


MATCH = ["word_start", "word_end", "source_start", "source_end", "match_type"]
EXACT, NEAR_EXACT, SEMANTIC = "exact overlap", "near-exact overlap", "semantic similarity"


def compared_sources(submitted: DataFrame, sources: DataFrame, *, sid: str = "doc_id", stext: str = "text", rid: str = "item_id", rtext: str = "text", semantic: DataFrame | None = None) -> DataFrame:
    """All matches of every (submitted text, source): exact runs, nearly equal windows that lie in none of
    them, and `semantic` ones (sid, rid, word_start, word_end, source_start, source_end, similarity) that lie in
    neither; each once, with the ranges of submitted words that overlap (none for semantic ones).

    The pairs of a match lie in one (submitted, source) pair, which is the key of every join here.
    """
    one = exact_runs(submitted, sources, sid=sid, stext=stext, rid=rid, rtext=rtext)
    exact = one.select(sid, rid, *MATCH[:4], F.lit(EXACT).alias("match_type"), F.lit(1.0).alias("similarity"), F.array(F.struct(F.col("word_start").alias("a"), F.col("word_end").alias("b"))).alias("ranges"))

    def outside(rows, others):
        held = others.select(F.col(sid).alias("_s"), F.col(rid).alias("_r"), F.col("word_start").alias("_a"), F.col("word_end").alias("_b"))
        return rows.join(held, (F.col(sid) == F.col("_s")) & (F.col(rid) == F.col("_r")) & (F.col("_a") <= F.col("word_start")) & (F.col("word_end") <= F.col("_b")), "left_anti")

    two = near_exact(submitted, sources, sid=sid, stext=stext, rid=rid, rtext=rtext)
    start = F.col("word_start").cast("bigint")
    ranges = F.transform("blocks", lambda x: F.struct((start + x["a"]).alias("a"), (start + x["b"]).alias("b")))
    near = two.select(sid, rid, start.alias("word_start"), (start + F.col("words")).alias("word_end"), F.col("source_start").cast("bigint").alias("source_start"), (F.col("source_start") + F.col("source_words")).cast("bigint").alias("source_end"), F.lit(NEAR_EXACT).alias("match_type"), "similarity", ranges.alias("ranges"))
    found = exact.unionByName(outside(near, exact))
    if semantic is not None:
        none = F.array().cast("array<struct<a: bigint, b: bigint>>")
        found = found.unionByName(outside(semantic.select(sid, rid, *MATCH[:4], F.lit(SEMANTIC).alias("match_type"), "similarity", none.alias("ranges")), found))
    return found.dropDuplicates([sid, rid, *MATCH])


def comparison_report(found: DataFrame, totals: DataFrame, by: str, attributed: DataFrame | None = None) -> DataFrame:
    """(by, words, overlapping_words, overlap_percentage, unattributed_percentage, quoted_cited_percentage)
    over the union of the overlapping ranges of `compared_sources`.

    `attributed` has `found`'s rows with `cited` and `quoted`; without it nothing is.
    """
    rows = found.withColumns({"cited": F.lit(False), "quoted": F.lit(False)}) if attributed is None else attributed
    parts = rows.select(by, "cited", "quoted", F.explode("ranges").alias("r")).select(by, "cited", "quoted", F.col("r.a").alias("word_start"), F.col("r.b").alias("word_end"))
    counted = totals.join(unattributed_words(parts, by), by, "left").fillna({"covered": 0, "unattributed_words": 0, "quoted_cited_words": 0})

    def share(n):
        return F.when(F.col("words") > 0, 100.0 * F.col(n) / F.col("words")).otherwise(0.0)

    return counted.select(by, "words", F.col("covered").alias("overlapping_words"), share("covered").alias("overlap_percentage"), share("unattributed_words").alias("unattributed_percentage"), share("quoted_cited_words").alias("quoted_cited_percentage"))


def overlap_report(runs: DataFrame, totals: DataFrame, by: str) -> DataFrame:
    """(by, words, overlapping_words, overlap_percentage): the union of runs over a text's words."""
    covered = union_length(runs, [by], "word_start", "word_end")
    rows = totals.join(covered, by, "left").fillna({"covered": 0})
    return rows.select(by, "words", F.col("covered").alias("overlapping_words"), F.when(F.col("words") > 0, 100.0 * F.col("covered") / F.col("words")).otherwise(0.0).alias("overlap_percentage"))


def attribution(found: DataFrame, quotes: DataFrame, citations: DataFrame, texts: DataFrame, by: str = "paper_id", text: str = "body") -> DataFrame:
    """Matches (match_id, start, end, source_ids) with `quoted` (inside a quotation), `cited` (a uniquely
    matched citation of one of the sources from 80 characters before to 180 after, with no blank line between) and
    `attribution`, what both say.

    Quotations, citations and matches of one paper meet on its id; the ranges are a residual of that equi-join.
    Of the texts only the places of blank lines are joined.
    """
    inside = found.join(quotes.select(by, F.col("start").alias("_a"), F.col("end").alias("_b")), by).where((F.col("_a") <= F.col("start")) & (F.col("end") <= F.col("_b"))).select("match_id").distinct().withColumn("quoted", F.lit(True))
    sure = citations.where(F.col("status") == MATCHED).select(by, F.col("start").alias("_a"), F.col("end").alias("_b"), F.col("reference_ids").alias("_ids"))
    near = found.join(sure, by).where((F.col("_a") <= F.col("end") + 180) & (F.col("_b") >= F.col("start") - 80) & F.arrays_overlap("source_ids", "_ids"))
    pieces = F.split(text, "\n\n", -1)
    # where each piece but the last ends
    ends = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), F.array().cast("array<int>"), lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)) + 2, F.lit(0)) + F.length(x))))
    blanks = texts.where(F.contains(F.col(text), F.lit("\n\n"))).select(by, ends.alias("_blanks"))
    first, last = F.least("_b", "end"), F.greatest("_a", "start")
    parted = F.exists(F.coalesce("_blanks", F.array().cast("array<int>")), lambda x: (x >= first) & (x + 2 <= last))
    close = near.join(blanks, by, "left").where(~parted).select("match_id").distinct().withColumn("cited", F.lit(True))
    rows = found.join(inside, "match_id", "left").join(close, "match_id", "left").fillna({"quoted": False, "cited": False})
    says = F.when(F.col("quoted") & F.col("cited"), QUOTED_CITED).when(F.col("cited"), CITED_ONLY).when(F.col("quoted"), QUOTED_ONLY).otherwise(UNATTRIBUTED)
    return rows.withColumn("attribution", says)


def unattributed_words(found: DataFrame, by: str) -> DataFrame:
    """Covered positions minus those in any cited match, and those quoted and cited."""
    everything = union_length(found, [by], "word_start", "word_end")
    cited = union_length(found.where("cited"), [by], "word_start", "word_end").withColumnRenamed("covered", "cited_words")
    both = union_length(found.where("cited and quoted"), [by], "word_start", "word_end").withColumnRenamed("covered", "quoted_cited_words")
    rows = everything.join(cited, by, "left").join(both, by, "left").fillna({"cited_words": 0, "quoted_cited_words": 0})
    return rows.withColumn("unattributed_words", F.col("covered") - F.col("cited_words"))


def writing_observations(texts: DataFrame, by: str, text_col: str) -> DataFrame:
    """Per text its sentences of four or more words: number, average (1 place), least and most words."""
    rows = texts.where(F.col(text_col).isNotNull()).select(by, text_col).dropDuplicates([by])
    cut = rows.select(by, F.explode(F.split(text_col, r"(?<=[.!?])\s+")).alias("s"))
    counted = cut.select(by, F.size(F.regexp_extract_all("s", F.lit(r"[\p{L}\p{N}_]+(?:['’\-][\p{L}\p{N}_]+)*"), F.lit(0))).alias("n")).where("n >= 4")
    return counted.groupBy(by).agg(F.count(F.lit(1)).alias("sentences"), half_even(F.avg("n"), 1).alias("average_words"), F.min("n").alias("least_words"), F.max("n").alias("most_words"))


def repeated_openings(texts: DataFrame, by: str, text_col: str) -> DataFrame:
    """Three-word openings that more than one sentence of a text has."""
    rows = texts.where(F.col(text_col).isNotNull()).select(by, text_col).dropDuplicates([by])
    listed = rows.select(by, F.explode(F.split(text_col, r"(?<=[.!?])\s+")).alias("s")).select(by, F.regexp_extract_all("s", F.lit(r"[\p{L}\p{N}_]+(?:['’\-][\p{L}\p{N}_]+)*"), F.lit(0)).alias("w")).where("size(w) >= 4")
    opening = F.array_join(F.transform(F.slice("w", 1, 3), F.lower), " ")
    return listed.groupBy(by, opening.alias("opening")).agg(F.count(F.lit(1)).alias("sentences")).where("sentences > 1")


def edge_lines(pages: DataFrame, by: str = "document_id") -> DataFrame:
    """Lines among the first or last two of a page's four or more non-blank lines, digits as `#`, that
    stand so on two or more pages of one document."""
    lines = F.filter(F.split("page_text", "\n", -1), lambda x: F.trim(x) != "")
    rows = pages.where(F.col("page_text").isNotNull()).select(by, "page_number", lines.alias("l")).where(F.size("l") >= 4)
    edge = F.array_distinct(F.transform(F.concat(F.slice("l", 1, 2), F.slice("l", -2, 2)), lambda x: F.lower(F.regexp_replace(F.trim(F.replace(x, F.lit("\r"), F.lit(""))), r"\d+", "#"))))
    return rows.select(by, "page_number", F.explode(edge).alias("line")).distinct().groupBy(by, "line").agg(F.count(F.lit(1)).alias("pages")).where((F.col("pages") >= 2) & (F.col("line") != "#"))


def deduplicated_sources(sources: DataFrame, submitted_digest: str | None, order: list[str], most: int | None = 10) -> DataFrame:
    """`status` of each source: the first `most` by position are checked, of equal digests the first, and
    never the submitted text itself. Sources that are not available use up their position."""
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy(*order))
    rows = sources.withColumn("position", place)
    again = F.row_number().over(Window.partitionBy("paper_id", "digest").orderBy("position"))
    itself = F.lit(False) if submitted_digest is None else F.col("digest") == F.col(submitted_digest)
    return rows.withColumn("_again", again).withColumn("status", F.when(F.col("digest").isNull(), "Unavailable").when(F.lit(False) if most is None else F.col("position") > most, "Not checked: limit").when((F.col("_again") > 1) | itself, "Not checked: duplicate").otherwise("Checked")).drop("_again")


def heading_lines(texts: DataFrame, by: str, text_col: str) -> DataFrame:
    """(by, line_no) of lines that are a bibliography heading."""
    rows = texts.where(F.col(text_col).isNotNull()).select(by, F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))
    return rows.where(has(F.col("line"), HEADING, fold=True)).select(by, (F.col("line_no") + 1).alias("line_no"), "line").distinct()


def semantic_windows(mine: DataFrame, theirs: DataFrame, least: float = 0.82) -> DataFrame:
    """Of each window vector (window_id, unit) the most similar source window (source_id, source_unit) from
    `least` on, ties to the larger source_id. Ids are integers; both sides meet in blocks of matrices."""
    from lectern.operators.retrieval import best_of, semantic_blocks

    scored = semantic_blocks(theirs.select(F.col("source_id").alias("vec_id"), F.col("source_unit").alias("unit")), mine.select(F.col("window_id").alias("query_id"), F.col("unit").alias("query_vector")), best_of(1))
    best = scored.groupBy("query_id").agg(F.max_by(F.struct(F.col("vec_id").alias("source_id"), "similarity"), F.struct("similarity", "vec_id")).alias("b"))
    return best.select(F.col("query_id").alias("window_id"), "b.*").where(F.col("similarity") >= least)
