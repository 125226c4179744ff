"""Problem 7: the most similar vectors of every vector.

The collection is cut into cells by the signed largest coordinates of random rotations, `tables` times, every
vector going to its `PROBES` best cells of a table, and is held there against all vectors of the cell. The number
of cells follows the number of vectors, so cells keep their size as the collection grows. In a cell the products
in single precision only choose; what they choose, and all that is too near to tell, is compared in double.

A cell that is still too large (a dense region may hold a third of all rows) has one direction in common, which
says nothing about who is near whom. It is hashed again around its own mean, by rotations of its table's own, and
so on until it is small. What `LEVELS` rounds leave too large (vectors of one direction) is verified whole, in
pairs of salted blocks. Vectors that met fewer than k others are held against the whole collection.

Equal vectors are one class, searched once. A class carries its smallest ids, enough for any answer.

Collision counting (`collide`: windows around a query in sorted projections, grown until enough vectors collide
often enough) chooses no candidates here: it costs more than the comparison it saves. See the README for figures.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import cut, stored

CELL = 4000  # vectors per cell aimed at
LINES, SHARE, GROWTH = 40, 0.55, 1.5
WHOLE = 2.5  # times that many are verified whole
PROBES, LEVELS, SLACK = 2, 3, 1.25  # cells of a table a vector goes to, rounds of hashing large cells again, room for uneven cells
AGAIN = 5  # codes a vector of a large cell goes to: a dense region has no better and worse ones
NEAR = 1e-5  # more than products in single precision err
ASKED = 4096  # vectors at a time that are held against the whole collection


def usable(df: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(vec, v) of the distinct ids whose vector has `dims` finite values, not all zero."""
    v = F.col(vector_col).cast("array<float>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # The element-wise test is the dear part: it is made once, before the rows move.
    return df.where((F.size(v) == dims) & fine).select(F.col(id_col).cast("bigint").alias("vec"), v.alias("v")).where("vec is not null").dropDuplicates(["vec"])


def _rotations(tables: int, depth: int, dims: int, seed: int) -> np.ndarray:
    rng = np.random.RandomState(seed)
    return np.stack([[np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(depth)] for _ in range(tables)])


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashed(tables: int, depth: int, codes: int, dims: int, seed: int):
    """Cells of every vector: per table the best code of each rotation, and the second best where it loses least."""

    def work(batches):
        turns = _rotations(tables, depth, dims, seed)[..., : -(-codes // 2)]
        for batch in batches:
            x = _unit(batch.column(2), dims)
            cells = np.zeros((len(x), tables, PROBES), np.int64)
            row = np.arange(len(x))
            for t in range(tables):
                first, second, loss = [], [], []
                for r in range(depth):
                    y = x @ turns[t, r]
                    both = np.concatenate((y, -y), axis=1)[:, :codes]
                    best = np.argsort(-both, axis=1, kind="stable")[:, :2]
                    first.append(best[:, 0])
                    second.append(best[:, -1])
                    loss.append(both[row, best[:, 0]] - both[row, best[:, -1]])
                least = np.argmin(loss, axis=0)
                for r in range(depth):
                    cells[:, t, 0] = cells[:, t, 0] * codes + first[r]
                    cells[:, t, 1] = cells[:, t, 1] * codes + np.where(least == r, second[r], first[r])
            wide = tables * PROBES
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * wide), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], flat], ["class", "ids", "v", "cells"])

    return work


def _rehashed(level: int, whole: int, dims: int, seed: int):
    """Codes of the rows of large cells: the signed largest coordinates of what is left of a vector without its cell's mean."""

    def work(batches):
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            tables, rows = batch.column(0).to_numpy(), batch.column(5).to_numpy()
            x = _unit(batch.column(4), dims)
            x -= batch.column(6).flatten().to_numpy().reshape(-1, dims)
            y = np.zeros_like(x)
            for t in np.unique(tables).tolist():
                if t not in turns:
                    turns[t] = np.linalg.qr(np.random.RandomState([seed, level, t]).standard_normal((dims, dims)))[0]
                y[tables == t] = x[tables == t] @ turns[t]
            y = np.round(y, 6)  # what is nearer has the same similarity
            used = np.clip(np.ceil(SLACK * AGAIN * rows / whole / 2), 2, dims)  # as many coordinates as the cell needs
            y[np.arange(dims) >= used[:, None]] = 0.0
            both = np.concatenate((y, -y), axis=1)
            best = np.argsort(-both, axis=1, kind="stable")[:, :AGAIN]
            far = np.take_along_axis(both, best, axis=1) > 0
            far[:, 0] = True
            codes = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(far.sum(axis=1)))).astype(np.int32)), pa.array(best[far].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], codes], ["tbl", "cell", "class", "ids", "v", "codes"])

    return work


def collide(values: np.ndarray, queries: np.ndarray, wanted: int) -> np.ndarray:
    """For each query row (an index) a mask over rows: those that passed the collision threshold.

    `values` holds one projection per column. Windows start at a width in which few vectors collide and grow by
    GROWTH until each query has `wanted` vectors beyond SHARE of the lines, or the windows hold everything.
    """
    n, lines = values.shape
    order = np.argsort(values, axis=0, kind="stable")
    arrays = np.take_along_axis(values, order, axis=0)
    out = np.zeros((len(queries), n), bool)
    open_rows = np.arange(len(queries))
    radius = max(float(np.median(arrays[-1] - arrays[0])) / max(n, 2) * 4, 1e-12)
    widest = float((arrays[-1] - arrays[0]).max())
    while len(open_rows):
        counts = np.zeros((len(open_rows), n), np.int16)
        for i in range(lines):
            at = values[queries[open_rows], i]
            low = np.searchsorted(arrays[:, i], at - radius, "left")
            high = np.searchsorted(arrays[:, i], at + radius, "right")
            step = np.zeros((len(open_rows), n + 1), np.int16)
            rows = np.arange(len(open_rows))
            np.add.at(step, (rows, low), 1)
            np.add.at(step, (rows, high), -1)
            counts[:, order[:, i]] += np.cumsum(step[:, :n], axis=1, dtype=np.int16)
        passed = counts > SHARE * lines
        done = (passed.sum(axis=1) > wanted) | (radius >= widest)
        out[open_rows[done]] = passed[done]
        open_rows = open_rows[~done]
        radius *= GROWTH
    return out


def chosen(product: np.ndarray, k: int) -> np.ndarray:
    """Flat positions of all values at least as large as the k-th of their row, less NEAR, and few others.

    The k-th of the maxima of strided groups is a bound from below for the k-th value.
    """
    rows, n = product.shape
    groups = max(8 * k, int(n**0.5))
    if n <= 2 * groups:
        if n <= k:
            return np.arange(rows * n)
        bound = np.partition(product, n - k, axis=1)[:, n - k : n - k + 1]
    else:
        even = n // groups * groups
        tops = np.maximum.reduce(product[:, :even].reshape(rows, n // groups, groups), axis=1)
        bound = np.partition(tops, groups - k, axis=1)[:, groups - k : groups - k + 1]
    return np.flatnonzero(product >= bound - np.float32(NEAR))


def nearest_in_cell(x: np.ndarray, ids: list[list[int]], k: int, asked: np.ndarray | None = None) -> list[list[tuple[float, int]]]:
    """For each row (or each of the rows `asked`) the k best (-similarity, id) of the rows `x`, ties to the smaller id; itself included."""
    flat = np.array([i for group in ids for i in group], np.int64)
    sizes = np.array([len(group) for group in ids])
    starts = np.cumsum(sizes) - sizes
    single, answers = x.astype(np.float32), []
    queries = x if asked is None else asked
    for a in range(0, len(queries), 512):
        part = queries[a : a + 512]
        query, row = np.divmod(chosen(part.astype(np.float32) @ single.T, k), len(x))  # k rows have k ids at least
        scores, many = -np.round(np.einsum("ij,ij->i", part[query], x[row]), 9), sizes[row]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[row], many)
        query, scores, names = np.repeat(query, many), np.repeat(scores, many), flat[at]
        order = np.lexsort((names, scores, query))
        edges = np.searchsorted(query[order], np.arange(len(part) + 1))
        scores, names = scores[order].tolist(), names[order].tolist()
        answers += [list(zip(scores[i : min(j, i + k)], names[i : min(j, i + k)], strict=True)) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return answers


ANSWERS = "class bigint, found array<struct<far: double, id: bigint>>"


def _searched(dims: int, k: int):
    found_type = pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64())]))

    def work(batches):
        held: list[pa.RecordBatch] = []
        key = None

        def cells(batch):
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            edges = [0, *edges.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if b > a:
                    yield tuple(keys[:, a].tolist()), batch.slice(a, b - a)

        def answer(parts, classes, found):
            rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            classes += rows.column(3).to_pylist()
            found += nearest_in_cell(_unit(rows.column(5), dims), rows.column(4).to_pylist(), k)

        def packed(classes, found):
            return pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array([[{"far": s, "id": i} for s, i in f] for f in found], found_type)], ["class", "found"])

        classes, found = [], []
        for batch in batches:
            for cell, rows in cells(batch):
                if cell != key and held:
                    answer(held, classes, found)
                    held = []
                key = cell
                held.append(rows)
            if len(classes) > 5000:
                yield packed(classes, found)
                classes, found = [], []
        if held:
            answer(held, classes, found)
        if classes:
            yield packed(classes, found)

    return work


def _asked(held, dims: int, k: int):
    """The k best of each batch for the vectors held."""
    found_type = pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64())]))

    def work(batches):
        classes, x = held.value
        for batch in batches:
            if batch.num_rows:
                found = nearest_in_cell(_unit(batch.column(1), dims), batch.column(0).to_pylist(), k, x)
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array([[{"far": s, "id": i} for s, i in f] for f in found], found_type)], ["class", "found"])

    return work


def _best(answers: DataFrame, k: int) -> DataFrame:
    return answers.groupBy("class").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, k).alias("found"))


def nearest(df: DataFrame, id_col: str, vector_col: str, k: int = 5, dims: int = 64, tables: int | None = None, cell: int = CELL, seed: int = 7) -> DataFrame:
    """(vec_id, neighbour, rank, similarity): the k most similar other vectors found for every usable vector.

    Similarity is the cosine in double precision rounded to 9 decimals; ties go to the smaller id. Vectors with
    null, infinite or missing values, of another size or all zero take no part; an id sent twice counts once.
    A collection of up to 2.5 x `cell` vectors is one cell, and the result exact. Every vector has k neighbours if
    there are so many.
    """
    spark = df.sparkSession
    vectors = stored(usable(df, id_col, vector_col, dims).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), F.col("v"))}))
    # Equal vectors are found by 128 bits of hash; of a class only its smallest ids and one vector go on.
    names = vectors.select("vec", "h1", "h2")
    few = names.withColumn("_rank", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec"))).where(F.col("_rank") <= k + 1)
    classed = cut(few.groupBy("h1", "h2").agg(F.min("vec").alias("class"), F.array_sort(F.collect_list("vec")).alias("ids")))
    classes = stored(vectors.select(F.col("vec").alias("class"), "v").join(classed.select("class", "ids").hint("merge"), "class").select("class", "ids", "v"))
    count, whole = classes.count(), WHOLE * cell
    depth, codes = 1, math.ceil(count * PROBES / cell)
    while codes > 2 * dims:
        depth += 1
        codes = math.ceil((count * PROBES / cell) ** (1 / depth))
    tables = tables or 2**depth
    if count <= whole:
        placed = classes.select(F.lit(0).alias("tbl"), F.lit(0).cast("bigint").alias("cell"), "class", "ids", "v")
    else:
        hashed = classes.mapInArrow(_hashed(tables, depth, codes, dims, seed), "class bigint, ids array<bigint>, v array<float>, cells array<bigint>")
        placed = hashed.select(F.posexplode("cells").alias("at", "cell"), "class", "ids", "v").select(F.expr(f"cast(at div {PROBES} as int)").alias("tbl"), "cell", "class", "ids", "v")
    small = None
    for level in range(LEVELS + 1):
        big = cut(placed.groupBy("tbl", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole))
        if big.isEmpty():
            kept, large = placed, None
        else:
            sizes = F.broadcast(big) if big.count() <= 100_000 else big.hint("merge")
            kept, large = placed.join(sizes, ["tbl", "cell"], "left_anti"), placed.join(sizes, ["tbl", "cell"]).select("tbl", "cell", "class", "ids", "v", "n")
        kept = kept.withColumn("part", F.lit(0).cast("bigint"))
        small = kept if small is None else small.unionByName(kept)
        if large is None:
            break
        if level < LEVELS:
            norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
            mean = F.array(*(F.avg(F.col("v")[i] / F.col("norm")) for i in range(dims)))
            centre = cut(large.withColumn("norm", norm).groupBy("tbl", "cell").agg(mean.alias("centre")))
            rows = large.join(centre.hint("merge"), ["tbl", "cell"]).select("tbl", "cell", "class", "ids", "v", "n", "centre")
            coded = rows.mapInArrow(_rehashed(level, whole, dims, seed), "tbl int, cell bigint, class bigint, ids array<bigint>, v array<float>, codes array<bigint>")
            placed = coded.withColumn("code", F.explode("codes")).select("tbl", F.xxhash64("cell", "code").alias("cell"), "class", "ids", "v")
        else:
            blocks = F.ceil(2 * F.col("n") / whole)
            pairs = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
            beside = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda j: F.least("block", j) * F.col("blocks") + F.greatest("block", j))
            small = small.unionByName(pairs.withColumn("part", F.explode(beside)).select("tbl", "cell", "class", "ids", "v", "part"))
    cells = small.select("tbl", "cell", "part", "class", "ids", "v")
    searched = cells.repartition("tbl", "cell", "part").sortWithinPartitions("tbl", "cell", "part").mapInArrow(_searched(dims, k + 1), ANSWERS)
    # Some lists of k + 1 for a class: one a placement, more only from large cells.
    merged = _best(searched, k + 1)
    if count > whole:
        merged = stored(merged)
        short = cut(merged.where(F.size("found") < k + 1).select("class"))
        many = short.count()
        for block in range(-(-many // ASKED)):
            rows = classes.join(short.where(F.pmod(F.xxhash64("class"), F.lit(-(-many // ASKED))) == block).hint("merge"), "class", "left_semi").select("class", "v").toArrow()
            if rows.num_rows:
                held = spark.sparkContext.broadcast((rows.column("class").to_pylist(), _unit(rows.column("v").combine_chunks(), dims)))
                merged = _best(merged.unionByName(classes.select("ids", "v").mapInArrow(_asked(held, dims, k + 1), ANSWERS)), k + 1)
    members = names.join(classed.select("h1", "h2", "class").hint("merge"), ["h1", "h2"]).select("vec", "class")
    own = F.slice(F.filter("found", lambda x: x["id"] != F.col("vec")), 1, k)
    return members.join(merged.hint("merge"), "class").select(F.col("vec").alias(id_col), F.posexplode(own).alias("rank", "n")).select(id_col, F.col("n.id").alias("neighbour"), (F.col("rank") + 1).alias("rank"), (-F.col("n.far")).alias("similarity"))


def measured(found: DataFrame, df: DataFrame, id_col: str, vector_col: str, every: int = 20, k: int = 5, dims: int = 64) -> DataFrame:
    """(queries, wanted, found, recall): `found` (of `nearest`) against an exact search for the ids divisible by `every`.

    The queries are held in blocks against all rows, so the work grows with the square of the table.
    """
    vectors = stored(usable(df, id_col, vector_col, dims))
    asked = vectors.where(F.pmod("vec", F.lit(every)) == 0)
    blocks, exact = -(-asked.count() // ASKED), None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec"), F.lit(blocks)) == block).toArrow()
        held = df.sparkSession.sparkContext.broadcast((rows.column("vec").to_pylist(), _unit(rows.column("v").combine_chunks(), dims))) if rows.num_rows else None
        if held:
            part = vectors.select(F.array("vec").alias("ids"), "v").mapInArrow(_asked(held, dims, k + 1), ANSWERS)
            exact = part if exact is None else exact.unionByName(part)
    if exact is None:
        return df.sparkSession.createDataFrame([(0, 0, 0, None)], "queries bigint, wanted bigint, found bigint, recall double")
    own = F.slice(F.filter("found", lambda x: x["id"] != F.col("class")), 1, k)
    wanted = _best(exact, k + 1).select(F.col("class").alias(id_col), F.explode(own).alias("n")).select(id_col, F.col("n.id").alias("neighbour"))
    both = wanted.join(found.select(id_col, "neighbour").distinct().withColumn("hit", F.lit(1)).hint("merge"), [id_col, "neighbour"], "left")
    return both.agg(F.count_distinct(id_col).alias("queries"), F.count(F.lit(1)).alias("wanted"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found")).withColumn("recall", F.col("found") / F.col("wanted"))
