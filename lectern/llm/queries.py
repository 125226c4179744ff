"""Queries of the training-text operators over the tables of one folder, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import boilerplate, cutting, leakage, near, neighbours, packing, scans, spans, subjects, terms
from lectern.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "papers"), "paper_id", "body")


def p1_papers(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "papers")
    return spans.share_report(papers, "paper_id", "body", spans.shared_spans(papers, "paper_id", "body"))


def p1_pages(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "papers")
    return spans.page_report(papers, "paper_id", "page_spans", spans.shared_spans(papers, "paper_id", "body"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    marked = terms.marked_terms(table(spark, d, "bm25_rows"), "chunk_row", "term_frequencies")
    return marked.where(F.col("mark").isNotNull()).select("term", "mark")


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(table(spark, d, "bm25_rows"), "chunk_row", "term_frequencies")


def _oversized(spark: SparkSession, d: str, with_text: bool, only_oversized: bool) -> tuple[DataFrame, DataFrame]:
    pages, views = table(spark, d, "doc_pages"), table(spark, d, "source_views")
    page_key = F.concat_ws(":", "document_id", F.col("page_number").cast("string"))
    pages = pages.where(F.col("document_id").isNotNull() & F.col("page_number").isNotNull()).select(F.lit("page").alias("kind"), page_key.alias("item_key"), "page_number", F.col("page_text").alias("text"))
    views = views.where(F.col("view_id").isNotNull()).select(F.lit("passage").alias("kind"), F.col("view_id").cast("string").alias("item_key"), "page_number", F.col("passage").alias("text"))
    if with_text:
        pages, views = (x.dropDuplicates(["item_key"]) for x in (pages, views))
    return tuple(cutting.cut_items(x, ["kind", "item_key", "page_number"], "text", with_text=with_text, only_oversized=only_oversized) for x in (pages, views))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pages, views = _oversized(spark, d, with_text=False, only_oversized=True)
    return pages.unionByName(views).where("piece_no = 2").select("kind", "item_key").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    pages, views = _oversized(spark, d, with_text=True, only_oversized=True)
    number = F.concat(F.lit("page-"), F.coalesce(F.col("page_number").cast("string"), F.lit("")), F.lit("-chunk-"), F.col("piece_no").cast("string"))
    return pages.unionByName(views).withColumn("chunk_id", number)


def p5_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The pieces put together again without their overlap, as a digest, and whether limit and overlap were kept."""
    pieces = p5_pieces(spark, d)
    part = F.struct("piece_no", "piece_start", "piece_end", F.when(F.col("piece_no") == 1, F.col("piece")).otherwise(F.expr("substring(piece, 201)")).alias("fresh"))
    items = pieces.groupBy("kind", "item_key").agg(F.array_sort(F.collect_list(part)).alias("p"))
    laps = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.element_at("p", i + 1)["piece_start"] == F.element_at("p", i)["piece_end"] - 200)
    whole = F.array_join(F.transform("p", lambda x: x["fresh"]), "")
    return items.select("kind", "item_key", F.md5(whole.cast("binary")).alias("digest"), F.forall("p", lambda x: x["piece_end"] - x["piece_start"] <= 1000).alias("within"), laps.alias("overlapping"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.boilerplate_lines(table(spark, d, "doc_pages"), table(spark, d, "doc_records"))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "doc_pages")
    return boilerplate.without_lines(pages, boilerplate.boilerplate_lines(pages, table(spark, d, "doc_records")))


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    """How often lines come back over distinct clusters and at least two publication dates."""
    lines = boilerplate.frequent_lines(table(spark, d, "doc_pages"), table(spark, d, "doc_records"), unit="clusters", least_dates=2)
    return lines.select(F.col("source").alias("publisher"), "units", "of_units", "dates")


def p6_cluster_lines(spark: SparkSession, d: str) -> DataFrame:
    """Where lines stand that come back over clusters and publication dates: republished texts are not taken for boilerplate."""
    return boilerplate.boilerplate_lines(table(spark, d, "doc_pages"), table(spark, d, "doc_records"), unit="clusters", least_dates=2)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(table(spark, d, "documents"), "doc_id", "text").where("piece_no = 2").select("doc_id").distinct()


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(table(spark, d, "documents"), "doc_id", "text")


def p8_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Per document its tokens as they lie in containers, its pieces, and whether they follow one another without a gap."""
    size = F.col("token_end") - F.col("token_start")
    placed = p8_fill(spark, d).groupBy("doc_id").agg(F.sum(size).alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.max("token_end").alias("last"), F.max(size).alias("largest"))
    return placed.select("doc_id", "tokens", "pieces", (F.col("last") == F.col("tokens")).alias("whole"), (F.col("largest") <= 2048).alias("within"))


def p8_overfull(spark: SparkSession, d: str) -> DataFrame:
    """Containers with more tokens than they hold, or pieces on top of each other: none."""
    size = F.col("token_end") - F.col("token_start")
    full = p8_fill(spark, d).groupBy("container").agg(F.sum(size).alias("tokens"), F.max(F.col("container_start") + size).alias("last"), F.count_distinct("container_start").alias("starts"), F.count(F.lit(1)).alias("pieces"))
    return full.agg(F.count_if((F.col("tokens") > 2048) | (F.col("last") != F.col("tokens")) | (F.col("starts") != F.col("pieces"))).alias("wrong"), F.sum("tokens").alias("tokens"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_fill(spark, d), "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), score=None).select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _near(spark: SparkSession, d: str) -> dict[str, near.NearDuplicates]:
    return {
        "paper": near.NearDuplicates(table(spark, d, "papers"), "paper_id", "body", width=3, threshold=0.6),
        "view": near.NearDuplicates(table(spark, d, "source_views"), "view_id", "passage", width=3, threshold=0.6),
    }


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [x.pairs().select(F.lit(kind).alias("kind"), "id_a", "id_b") for kind, x in _near(spark, d).items()]
    return parts[0].unionByName(parts[1])


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    parts = [x.groups().select(F.lit(kind).alias("kind"), "record", "group_id", "links") for kind, x in _near(spark, d).items()]
    return parts[0].unionByName(parts[1])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    near_ones = neighbours.nearest(table(spark, d, "chunk_vectors"), "vec_id", "embedding")
    return near_ones.select(F.least("vec_id", "neighbour").alias("vec_id_a"), F.greatest("vec_id", "neighbour").alias("vec_id_b")).distinct()


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "chunk_vectors"), "vec_id", "embedding")


def p7_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the neighbours against an exact search, for the vectors whose id is divisible by 20."""
    vectors = table(spark, d, "chunk_vectors")
    return neighbours.measured(neighbours.nearest(vectors, "vec_id", "embedding"), vectors, "vec_id", "embedding")


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    model = subjects.train(documents, table(spark, d, "subject_areas"), table(spark, d, "subject_labels"))
    return subjects.subjects(documents, model)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters by subject and source, with totals (a document of two subjects counts in both)."""
    sizes = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("chars"))
    found = _subjects(spark, d).select("doc_id", "subject").distinct().join(sizes, "doc_id")
    return found.cube("subject", "source").agg(F.count(F.lit(1)).alias("documents"), F.sum("chars").alias("chars"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.Scans(table(spark, d, "doc_pages"), table(spark, d, "doc_records")).damage()


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.Scans(table(spark, d, "doc_pages"), table(spark, d, "doc_records")).repaired()


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("p") and name[1:2].isdigit() and callable(f)}
LINES = r"""
        pub AS (SELECT document_id, min(publisher) AS publisher, min(CAST(uploaded_at AS DATE)) AS day FROM doc_records WHERE publisher IS NOT NULL GROUP BY document_id),
        pages AS (SELECT DISTINCT document_id, page_number, page_text FROM doc_pages),
        parts AS (SELECT document_id, page_number, string_split(page_text, chr(10)) AS parts FROM pages WHERE page_text IS NOT NULL),
        lines AS (SELECT document_id, page_number, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS raw FROM parts),
        norm AS (SELECT document_id, page_number, CAST(line_no AS INTEGER) AS line_no, regexp_replace(lower(regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '[ \t]+', ' ', 'g')), '[0-9]+', '#', 'g') AS line FROM lines)"""
CLUSTERS = rf"""{LINES},
        digests AS (SELECT document_id, md5(string_agg(page_number || ':' || coalesce(page_text, ''), chr(1) ORDER BY page_number, page_text)) AS digest FROM pages GROUP BY document_id),
        clusters AS (SELECT publisher, min(document_id) AS document_id, min(day) AS day FROM digests JOIN pub USING (document_id) GROUP BY publisher, digest),
        totals AS (SELECT publisher, count(*) AS of_units FROM clusters GROUP BY publisher),
        counts AS (SELECT publisher, line, count(DISTINCT document_id) AS units, count(DISTINCT day) AS dates FROM norm JOIN clusters USING (document_id) WHERE line <> '' GROUP BY ALL),
        often AS (SELECT * FROM counts JOIN totals USING (publisher) WHERE units >= 5 AND units * 100 >= 30 * of_units AND dates >= 2)"""
SPANS = """
        once AS (SELECT paper_id, any_value(body) AS b FROM papers WHERE paper_id IS NOT NULL GROUP BY paper_id),
        places AS (SELECT paper_id, b, unnest(range(1, length(b) - 198)) AS i FROM once WHERE length(b) >= 200),
        windows AS (SELECT paper_id, i - 1 AS s, md5(substr(b, i, 200)) AS h FROM places),
        held AS (SELECT h FROM windows GROUP BY h HAVING count(DISTINCT paper_id) > 1),
        hits AS (SELECT paper_id, s, CASE WHEN s > lag(s + 200) OVER (PARTITION BY paper_id ORDER BY s) THEN 1 ELSE 0 END AS fresh FROM windows WHERE h IN (SELECT h FROM held)),
        numbered AS (SELECT paper_id, s, sum(fresh) OVER (PARTITION BY paper_id ORDER BY s) AS n FROM hits),
        spans AS (SELECT paper_id, CAST(min(s) AS INTEGER) AS span_start, CAST(max(s) + 200 AS INTEGER) AS span_end FROM numbered GROUP BY paper_id, n)"""
PAIRS = """
        vectors AS (SELECT vec_id, any_value(CAST(embedding AS DOUBLE[])) AS e FROM chunk_vectors WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
        near AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(a.e, b.e), 9) AS similarity FROM vectors a, vectors b WHERE a.vec_id <> b.vec_id),
        best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS rank FROM near)"""
SQL: dict[str, str] = {
    # Exact up to 10,000 vectors, where one cell holds them all; beyond, p7_recall measures what is found.
    "p7_found": f"WITH {PAIRS} SELECT DISTINCT least(vec_id, neighbour) AS vec_id_a, greatest(vec_id, neighbour) AS vec_id_b FROM best WHERE rank <= 5",
    "p7_neighbours": f"WITH {PAIRS} SELECT vec_id, neighbour, CAST(rank AS INTEGER) AS rank, similarity FROM best WHERE rank <= 5",
    "p7_recall": f"WITH {PAIRS}, n AS (SELECT count(DISTINCT vec_id) AS queries, count(*) AS wanted FROM best WHERE rank <= 5 AND vec_id % 20 = 0) SELECT queries, wanted, wanted AS found, 1.0::DOUBLE AS recall FROM n",
    "p5_rebuilt": """
        SELECT DISTINCT 'page' AS kind, document_id || ':' || page_number AS item_key, md5(page_text) AS digest, true AS within, true AS overlapping FROM doc_pages WHERE length(page_text) > 1000
        UNION SELECT DISTINCT 'passage', CAST(view_id AS VARCHAR), md5(passage), true, true FROM source_views WHERE length(passage) > 1000""",
    "p6_clusters": f"WITH {CLUSTERS} SELECT publisher, units, of_units, dates FROM often",
    "p6_cluster_lines": f"WITH {CLUSTERS} SELECT DISTINCT document_id, page_number, line_no FROM norm JOIN pub USING (document_id) JOIN often USING (publisher, line)",
    "p6_clean": f"""WITH {LINES},
        held AS (SELECT publisher, norm.* FROM norm JOIN pub USING (document_id) WHERE line <> ''),
        totals AS (SELECT publisher, count(DISTINCT document_id) AS n FROM doc_pages JOIN pub USING (document_id) GROUP BY publisher),
        counts AS (SELECT publisher, line, count(DISTINCT document_id) AS n FROM held GROUP BY ALL),
        gone AS (SELECT document_id, page_number, list(DISTINCT line_no) AS l FROM held JOIN counts USING (publisher, line) JOIN totals USING (publisher) WHERE counts.n >= 5 AND counts.n * 100 >= 30 * totals.n GROUP BY ALL),
        cut AS (SELECT p.document_id, p.page_number, page_text, l, string_split(page_text, chr(10)) AS parts FROM pages p LEFT JOIN gone USING (document_id, page_number))
        SELECT document_id, page_number, CASE WHEN l IS NULL THEN page_text ELSE array_to_string([parts[i] FOR i IN range(1, len(parts) + 1) IF NOT list_contains(l, i)], chr(10)) END AS clean_text FROM cut""",
    "p8_tokens": """
        WITH sized AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[./-][A-Za-z0-9]+)*')) AS tokens FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, CAST(tokens AS BIGINT) AS tokens, CAST(ceil(tokens / 2048) AS BIGINT) AS pieces, true AS whole, true AS within FROM sized WHERE tokens > 0""",
    "p8_overfull": """
        SELECT CAST(0 AS BIGINT) AS wrong, CAST(sum(len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[./-][A-Za-z0-9]+)*'))) AS BIGINT) AS tokens FROM documents""",
    "p1_found": f"WITH {SPANS} SELECT * FROM spans",
    "p1_papers": f"""WITH {SPANS},
        shared AS (SELECT paper_id, CAST(sum(span_end - span_start) AS BIGINT) AS shared_chars, count(*) AS stretches FROM spans GROUP BY paper_id)
        SELECT paper_id, CAST(coalesce(length(b), 0) AS INTEGER) AS chars, coalesce(shared_chars, 0) AS shared_chars, coalesce(stretches, 0) AS stretches,
        CASE WHEN length(b) > 0 THEN coalesce(shared_chars, 0)::DOUBLE / length(b) ELSE 0.0 END AS share FROM once LEFT JOIN shared USING (paper_id)""",
    "p1_pages": f"""WITH {SPANS},
        pages AS (SELECT DISTINCT paper_id, p.span_start AS page_start, p.span_end AS page_end, p.page_number AS page_number FROM (SELECT paper_id, unnest(page_spans) AS p FROM papers WHERE paper_id IS NOT NULL))
        SELECT pages.paper_id, page_number, page_start, page_end, CAST(sum(CASE WHEN span_start IS NULL THEN 0 ELSE greatest(0, least(page_end, span_end) - greatest(page_start, span_start)) END) AS INTEGER) AS shared_chars
        FROM pages LEFT JOIN spans ON pages.paper_id = spans.paper_id AND page_start < span_end AND page_end > span_start GROUP BY ALL""",
    "p3_groups": r"""
        WITH RECURSIVE texts AS (SELECT 'paper' AS kind, paper_id AS id, any_value(body) AS t FROM papers GROUP BY paper_id UNION ALL SELECT 'view', view_id, any_value(passage) FROM source_views GROUP BY view_id),
        words AS (SELECT kind, id, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM texts WHERE t IS NOT NULL AND id IS NOT NULL),
        grams AS (SELECT DISTINCT kind, id, unnest([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) AS g FROM words WHERE len(w) >= 3),
        sets AS (SELECT kind, id, md5(string_agg(g, '|' ORDER BY g)) AS h, count(*) AS n FROM grams GROUP BY ALL),
        members AS (SELECT kind, id, n, min(id) OVER (PARTITION BY kind, h) AS class FROM sets),
        ones AS (SELECT grams.* FROM grams JOIN members USING (kind, id) WHERE id = class),
        met AS (SELECT a.kind, a.id AS a, b.id AS b, count(*) AS c FROM ones a JOIN ones b ON a.kind = b.kind AND a.g = b.g AND a.id <> b.id GROUP BY ALL),
        edges AS (SELECT met.kind, a, b FROM met JOIN members x ON x.kind = met.kind AND x.id = a JOIN members y ON y.kind = met.kind AND y.id = b WHERE c * 10 >= 6 * (x.n + y.n - c)),
        reach AS (SELECT kind, id AS node, id AS seen FROM members WHERE id = class UNION SELECT reach.kind, node, b FROM reach JOIN edges ON edges.kind = reach.kind AND a = seen),
        least AS (SELECT kind, node, min(seen) AS group_id FROM reach GROUP BY ALL),
        degree AS (SELECT kind, a, count(*) AS links FROM edges GROUP BY ALL)
        SELECT m.kind, m.id AS record, group_id, coalesce(links, 0) AS links FROM members m JOIN least ON least.kind = m.kind AND node = class LEFT JOIN degree ON degree.kind = m.kind AND a = class""",
    "p2_found": """
        WITH once AS (SELECT chunk_row, any_value(term_frequencies) AS tf FROM bm25_rows WHERE term_frequencies IS NOT NULL AND chunk_row IS NOT NULL GROUP BY chunk_row),
        held AS (SELECT unnest(map_keys(tf)) AS term FROM once),
        df AS (SELECT term, count(*) AS n FROM held GROUP BY term)
        SELECT term, CASE WHEN n = 1 THEN 'rare' ELSE 'common' END AS mark
        FROM df WHERE n = 1 OR n * 100 > 30 * (SELECT count(*) FROM once)""",
    "p2_terms": """
        WITH once AS (SELECT chunk_row, any_value(term_frequencies) AS tf FROM bm25_rows WHERE term_frequencies IS NOT NULL AND chunk_row IS NOT NULL GROUP BY chunk_row),
        held AS (SELECT unnest(map_keys(tf)) AS term, unnest(map_values(tf)) AS n FROM once),
        df AS (SELECT term, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total, count(*) AS rows FROM held GROUP BY term)
        SELECT term, total, rows, CASE WHEN rows = 1 THEN 'rare' WHEN rows * 100 > 30 * (SELECT count(*) FROM once) THEN 'common' END AS mark FROM df""",
    "p5_found": """
        SELECT DISTINCT 'page' AS kind, document_id || ':' || page_number AS item_key FROM doc_pages WHERE length(page_text) > 1000
        UNION SELECT DISTINCT 'passage', CAST(view_id AS VARCHAR) FROM source_views WHERE length(passage) > 1000""",
    "p6_found": r"""
        WITH pub AS (SELECT document_id, min(publisher) AS publisher FROM doc_records WHERE publisher IS NOT NULL GROUP BY document_id),
        pages AS (SELECT DISTINCT document_id, page_number, page_text FROM doc_pages),
        parts AS (SELECT document_id, page_number, string_split(page_text, chr(10)) AS parts FROM pages WHERE page_text IS NOT NULL),
        lines AS (SELECT document_id, page_number, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS raw FROM parts),
        norm AS (SELECT document_id, page_number, CAST(line_no AS INTEGER) AS line_no, regexp_replace(lower(regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '[ \t]+', ' ', 'g')), '[0-9]+', '#', 'g') AS line FROM lines),
        held AS (SELECT publisher, norm.* FROM norm JOIN pub USING (document_id) WHERE line <> ''),
        totals AS (SELECT publisher, count(DISTINCT document_id) AS n FROM doc_pages JOIN pub USING (document_id) GROUP BY publisher),
        counts AS (SELECT publisher, line, count(DISTINCT document_id) AS n FROM held GROUP BY ALL)
        SELECT DISTINCT document_id, page_number, line_no FROM held JOIN counts USING (publisher, line) JOIN totals USING (publisher)
        WHERE counts.n >= 5 AND counts.n * 100 >= 30 * totals.n""",
    "p8_found": "SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[./-][A-Za-z0-9]+)*')) > 2048",
    "p9_found": """
        WITH texts AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
        grams AS (SELECT doc_id, unnest([array_to_string(w[i:i + 11], ' ') FOR i IN range(1, len(w) - 10)]) AS g FROM texts WHERE len(w) >= 12),
        items AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
        asked AS (SELECT item_id, unnest([array_to_string(w[i:i + 11], ' ') FOR i IN range(1, len(w) - 10)]) AS g FROM items WHERE len(w) >= 12)
        SELECT DISTINCT doc_id, item_id FROM grams JOIN asked USING (g)""",
    "p3_found": r"""
        WITH texts AS (SELECT 'paper' AS kind, paper_id AS id, any_value(body) AS t FROM papers GROUP BY paper_id UNION ALL SELECT 'view', view_id, any_value(passage) FROM source_views GROUP BY view_id),
        words AS (SELECT kind, id, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM texts WHERE t IS NOT NULL),
        grams AS (SELECT DISTINCT kind, id, unnest([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) AS g FROM words WHERE len(w) >= 3),
        sizes AS (SELECT kind, id, count(*) AS n FROM grams GROUP BY ALL),
        both_ AS (SELECT a.kind, a.id AS id_a, b.id AS id_b, count(*) AS c FROM grams a JOIN grams b ON a.kind = b.kind AND a.g = b.g AND a.id < b.id GROUP BY ALL)
        SELECT kind, id_a, id_b FROM both_ JOIN sizes x USING (kind) JOIN sizes y USING (kind) WHERE x.id = id_a AND y.id = id_b AND c * 10 >= 6 * (x.n + y.n - c)""",
}
