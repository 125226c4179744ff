"""Lexical and vector retrieval over chunks, and their fusion.

The index is tables, not objects: postings (term, chunk, tf), document frequencies and chunk lengths. Queries are
a table too, so many are answered by one plan; scalars of the corpus come in as scalar subqueries.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import lexical_tokens
from lectern.session import once

K1, B, RRF_K = 1.5, 0.75, 60
KEY = ["document_id", "chunk_id"]


def chunk_terms(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Chunk keys and tokens (T1) of every chunk; null texts have none."""
    return chunks.select(*KEY, F.coalesce(lexical_tokens(F.col(text)), F.array().cast("array<string>")).alias("terms"))


def postings(terms: DataFrame) -> DataFrame:
    """A1: (document_id, chunk_id, length, term, tf)."""
    return terms.select(*KEY, F.size("terms").alias("length"), F.explode("terms").alias("term")).groupBy(*KEY, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(post: DataFrame) -> DataFrame:
    """A1: (term, df), a chunk counted once for each of its terms.

    Every posting has tf > 0; asking for it keeps `tf` in this branch of a plan too, so that its exchange is the
    same as that of the postings themselves and is computed once.
    """
    return post.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))


def index_totals(terms: DataFrame) -> DataFrame:
    """A1: one row (chunks, average_length); the average is at least 1."""
    return terms.agg(F.count(F.lit(1)).alias("chunks"), F.greatest(F.lit(1.0), F.coalesce(F.avg(F.size("terms")), F.lit(0.0))).alias("average_length"))


def term_weight(chunks: Column, df: Column) -> Column:
    """Inverse document frequency of BM25, never negative."""
    return F.log(F.lit(1.0) + (chunks - df + F.lit(0.5)) / (df + F.lit(0.5)))


def keyword_scores(terms: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, scope: Column | None = None) -> DataFrame:
    """(query_id, document_id, chunk_id, keyword_score) of every chunk with a query term.

    `queries` has (query_id, query). A term asked twice counts twice. Frequencies and lengths are those of the
    whole corpus, whatever the scope. Only postings of asked terms are grouped: the query side is a semi-join
    before the shuffle.
    """
    asked = queries.select("query_id", F.explode(lexical_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    hits = terms.select(*KEY, F.size("terms").alias("length"), F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    post = hits.groupBy(*KEY, "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    # One row per asked term; both branches read the same exchange. A window would put a term's postings in one task.
    df = document_frequencies(post)
    totals = index_totals(terms).select(F.struct("chunks", "average_length")).scalar()
    n, average = totals["chunks"], totals["average_length"]
    if scope is not None:
        post = post.where(scope)
    weight = term_weight(n, F.col("df"))
    part = F.col("times") * weight * (F.col("tf") * F.lit(k1 + 1.0)) / (F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("length") / average))
    return post.join(df, "term").join(asked, "term").groupBy("query_id", *KEY).agg(F.sum(part).alias("keyword_score"))


def indexed_scores(index: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """The same score from an index kept as one map of term frequencies per chunk (`chunk_row`, `term_frequencies`,
    `document_length`): (query_id, chunk_row, keyword_score). Rows without a map do not count."""
    rows = index.where(F.col("term_frequencies").isNotNull()).select("chunk_row", "term_frequencies", "document_length").dropDuplicates(["chunk_row"])
    asked = queries.select("query_id", F.explode(lexical_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(1.0), F.coalesce(F.avg("document_length"), F.lit(0.0))).alias("average")).select(F.struct("n", "average")).scalar()
    post = rows.select("chunk_row", "document_length", F.explode("term_frequencies").alias("term", "tf")).join(asked.select("term").distinct(), "term", "left_semi")
    weight = term_weight(totals["n"], F.col("df"))
    part = F.col("times") * weight * (F.col("tf") * F.lit(k1 + 1.0)) / (F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("document_length") / totals["average"]))
    return post.join(post.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term").join(asked, "term").groupBy("query_id", "chunk_row").agg(F.sum(part).alias("keyword_score"))


def usable_vectors(vectors: DataFrame, dims: int = 64) -> DataFrame:
    """(vec_id, document_id, chunk_id, unit): vectors with `dims` finite values, not all zero, at unit length."""
    wide = F.col("embedding").cast("array<double>")
    fine = (F.size("embedding") == dims) & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(wide, lambda x: x != 0)
    norm = F.sqrt(F.aggregate("wide", F.lit(0.0), lambda s, x: s + x * x))
    rows = once(vectors.where(fine), ["vec_id"]).select("vec_id", *KEY, wide.alias("wide")).withColumn("norm", norm)
    # The norm is repeated as an array, so that it is computed once per row and not once per element.
    return rows.select("vec_id", *KEY, F.zip_with("wide", F.array_repeat("norm", dims), lambda x, n: x / n).alias("unit"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def semantic_scores(units: DataFrame, queries: DataFrame, scope: Column | None = None) -> DataFrame:
    """(query_id, vec_id, document_id, chunk_id, similarity) of each query vector with each vector.

    `queries` (query_id, query_vector) is the stated query set, held against all vectors in one scan.
    """
    rows = units if scope is None else units.where(scope)
    return rows.crossJoin(queries.select("query_id", "query_vector")).select("query_id", "vec_id", *KEY, dot(F.col("unit"), F.col("query_vector")).alias("similarity"))


def best_of(k: int) -> Callable[[np.ndarray], np.ndarray]:
    """For `semantic_blocks`: of each row of similarities the k best, and what equals the last of them."""

    def keep(near: np.ndarray) -> np.ndarray:
        near = np.round(near, 9)
        return near >= np.partition(near, -k, axis=1)[:, [-k]] if near.shape[1] > k else np.ones(near.shape, bool)

    return keep


def near_best(floor: float = 0.25, gap: float = 0.15) -> Callable[[np.ndarray], np.ndarray]:
    """For `semantic_blocks`: of each row of similarities those near its best."""
    return lambda near: near >= np.maximum(floor, near.max(axis=1, keepdims=True) - gap)


def semantic_blocks(units: DataFrame, queries: DataFrame, keep: Callable[[np.ndarray], np.ndarray], block: int = 8192) -> DataFrame:
    """J4 for a query set that grows with the collection: (query_id, vec_id, similarity), of each query and block of
    vectors what `keep` keeps. Every query meets every vector, as matrices of at most about `block` rows each."""
    shape = "query_id bigint, vec_id bigint, similarity double"
    wide, long = (max(1, math.ceil(x.count() / block)) for x in (queries, units))
    one = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(wide)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(long - 1).cast("bigint"))).alias("ub"), "query_id", "query_vector")
    all_ = units.select(F.pmod(F.xxhash64("vec_id"), F.lit(long)).alias("ub"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(wide - 1).cast("bigint"))).alias("qb"), "vec_id", "unit")

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [], [], []
        if left.num_rows and right.num_rows:
            asked, names = left["query_id"].to_numpy(), right["vec_id"].to_numpy()
            q, x = (c.combine_chunks().flatten().to_numpy().reshape(len(c), -1) for c in (left["query_vector"], right["unit"]))
            for a in range(0, len(q), 256):
                near = q[a : a + 256] @ x.T
                at, row = np.nonzero(keep(near))
                for column, values in zip(found, (asked[a + at], names[row], near[at, row]), strict=True):
                    column.append(values)
        columns = [np.concatenate(c) if c else np.empty(0, kind) for c, kind in zip(found, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table(dict(zip(("query_id", "vec_id", "similarity"), columns, strict=True)))

    return one.groupBy("qb", "ub").cogroup(all_.groupBy("qb", "ub")).applyInArrow(met, shape)


def top_ranked(scores: DataFrame, k: int, score: str, ties: list[str], by: str = "query_id", name: str = "rank") -> DataFrame:
    """The best k rows of each query, ranked from 1; ties in the order of `ties`.

    A rank filter over a window keeps k rows per task before the shuffle.
    """
    order = Window.partitionBy(by).orderBy(F.desc(score), *ties)
    return scores.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def fused(semantic: DataFrame, keyword: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """Both lists joined on the chunk key and fused by reciprocal rank.

    `semantic` has (query_id, key, similarity, semantic_rank), `keyword` (query_id, key, keyword_score,
    keyword_rank). A score a list does not give stays null; `similarity` is 0.0 there.
    """
    both = semantic.join(keyword, ["query_id", *KEY], "full_outer")
    share = F.coalesce(1.0 / (rrf_k + F.col("semantic_rank")), F.lit(0.0)) + F.coalesce(1.0 / (rrf_k + F.col("keyword_rank")), F.lit(0.0))
    source = F.when(F.col("semantic_rank").isNotNull() & F.col("keyword_rank").isNotNull(), "Both").when(F.col("semantic_rank").isNotNull(), "Semantic").otherwise("Keyword")
    return both.select("query_id", *KEY, F.col("similarity").alias("semantic_similarity"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "keyword_score", source.alias("retrieval_source"), share.alias("rrf_score"), (share / (2.0 / (rrf_k + 1))).alias("hybrid_score"))


def semantic_only(semantic: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """A4: the semantic list alone, scaled so that its first row has 1."""
    share = 1.0 / (rrf_k + F.col("semantic_rank"))
    return semantic.select("query_id", *KEY, F.col("similarity").alias("semantic_similarity"), "similarity", F.lit(None).cast("double").alias("keyword_score"), F.lit("Semantic").alias("retrieval_source"), share.alias("rrf_score"), (share / (1.0 / (rrf_k + 1))).alias("hybrid_score"))


def hybrid(chunks: DataFrame, terms: DataFrame, units: DataFrame, queries: DataFrame, k: int = 4, scope: Column | None = None) -> DataFrame:
    """Q1: keyword and vector candidates (max(12, 4k) each), fused; the best k with their chunk.

    `queries` has (query_id, query, query_vector). Order: fused score, file name, page, chunk id (O3).
    """
    depth = max(12, 4 * k)
    keyword = top_ranked(keyword_scores(terms, queries, scope=scope), depth, "keyword_score", KEY, name="keyword_rank")
    scored = semantic_scores(units, queries, scope).groupBy("query_id", *KEY).agg(F.max("similarity").alias("similarity"))
    semantic = top_ranked(scored, depth, "similarity", KEY, name="semantic_rank")
    found = fused(semantic, keyword).join(chunks, KEY)
    return top_ranked(found, k, "rrf_score", ["source_filename", "page_number", "chunk_id", "document_id"])


def document_pools(chunks: DataFrame, terms: DataFrame, queries: DataFrame, k: int = 4, limit: int = 18, units: DataFrame | None = None) -> DataFrame:
    """For every document the pool of what the queries find in it alone, ranked from 1 (`position`).

    `queries` has (query_id, query) and, with `units`, query_vector; frequencies and lengths stay those of the
    corpus. Rank windows are per (query, document), so no document's chunks meet another's.
    """
    group = ["query_id", "document_id"]
    depth = max(12, 4 * k)

    def ranked(rows, score, name):
        order = Window.partitionBy(*group).orderBy(F.desc(F.round(score, 9)), "chunk_id")
        return rows.withColumn(name, F.row_number().over(order)).where(F.col(name) <= depth)

    keyword = ranked(keyword_scores(terms, queries), "keyword_score", "keyword_rank")
    if units is None:
        semantic = keyword.select("query_id", *KEY, F.lit(0.0).alias("similarity"), F.lit(1).alias("semantic_rank")).limit(0)
    else:
        semantic = ranked(semantic_scores(units, queries).groupBy("query_id", *KEY).agg(F.max("similarity").alias("similarity")), "similarity", "semantic_rank")
    found = fused(semantic, keyword).join(chunks, KEY)
    best = Window.partitionBy(*group).orderBy(F.desc("rrf_score"), "source_filename", "page_number", "chunk_id")
    kept = found.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= k) & ~((F.col("retrieval_source") == "Semantic") & (F.col("similarity") < 0.25)))
    once_ = kept.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy("query_id", "rank"))).where("_n = 1").drop("_n")
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("hybrid_score"), "query_id", "rank", "chunk_id"))
    return once_.withColumn("position", place).where(F.col("position") <= limit)


def pooled(results: DataFrame, limit: int = 18, floor: float = 0.25) -> DataFrame:
    """Results of many queries as one list: semantic-only noise dropped (F4), each chunk once with its best
    score, at most `limit` by score, then query and rank."""
    kept = results.where(~((F.col("retrieval_source") == "Semantic") & (F.col("similarity") < floor)))
    best = Window.partitionBy(*KEY).orderBy("query_id", "rank")
    once = kept.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return once.orderBy(F.desc("hybrid_score"), "query_id", "rank", *KEY).limit(limit)
