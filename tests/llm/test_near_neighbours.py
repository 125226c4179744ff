import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import near, neighbours


def sets(text, width):
    import re

    w = re.findall("[a-z0-9]+", text.lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def test_sketches_estimate_similarity():
    rng = np.random.RandomState(0)
    for share in (0.2, 0.6, 0.9):
        common = rng.randint(1, 2**62, int(1000 * share)).astype(np.uint64)
        a = np.unique(np.concatenate((common, rng.randint(1, 2**62, 1000 - len(common)).astype(np.uint64))))
        b = np.unique(np.concatenate((common, rng.randint(1, 2**62, 1000 - len(common)).astype(np.uint64))))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(near.joint_similarity(near.sketch(a), near.sketch(b), len(a), len(b)) - true) < 0.12
    union = near.sketch(np.union1d(a, b))
    assert (union == np.maximum(near.sketch(a), near.sketch(b))).all()
    assert near.sketch(np.empty(0, np.uint64)).max() == 0


@pytest.mark.parametrize("hot", [near.HOT, 2])
def test_pairs_equal_brute_force(spark, rows, hot):
    rng = random.Random(2)
    base = [[f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(20, 60))] for _ in range(25)]
    texts = []
    for words in base:
        for edits in (0, 0, 1, 3, 8):
            w = list(words)
            for _ in range(edits):
                w[rng.randrange(len(w))] = "new"
            texts.append(" ".join(w))
    data = [*enumerate(texts, 1), (900, None), (901, ""), (902, "two words"), (1, texts[0]), (None, texts[0])]
    df = spark.createDataFrame(data, "id bigint, text string").withColumn("class", F.lit("clash")).withColumn("record", F.lit(1))
    found = near.NearDuplicates(df, "id", "text", width=3, threshold=0.6, hot=hot)
    want = set()
    for i, a in enumerate(texts, 1):
        for j, b in enumerate(texts[i:], i + 1):
            x, y = sets(a, 3), sets(b, 3)
            if x and y and len(x & y) >= 0.6 * len(x | y):
                want.add((i, j))
    assert rows(found.pairs().distinct()) == want
    groups = {r.record: (r.group_id, r.links) for r in found.groups().collect()}
    assert set(groups) == set(range(1, len(texts) + 1))
    for a, b in want:
        assert groups[a][0] == groups[b][0]
    assert all(group <= record for record, (group, _) in groups.items())
    empty = near.NearDuplicates(df.limit(0), "id", "text")
    assert rows(empty.pairs()) == set() and empty.groups().count() == 0


def test_components_of_long_chains(spark):
    links = [(n, n + 1) for n in range(1, 40)] + [(100, 101), (102, 101)]
    got = {r["class"]: r.group_id for r in near.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{n: 1 for n in range(1, 41)}, 100: 100, 101: 100, 102: 100}


def exact(vectors, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    out = {}
    for n, i in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != n), key=lambda j: (-s[n, j], ids[j]))[:k]
        out[i] = [ids[j] for j in order]
    return out


def test_neighbours_recall_and_ties(spark):
    rng = np.random.RandomState(4)
    centres = rng.randn(60, 64)
    vectors = {n: (centres[n % 60] + 0.15 * rng.randn(64)).astype(np.float32).tolist() for n in range(1, 1201)}
    for n in range(2001, 2010):
        vectors[n] = vectors[1]
    vectors[2010] = [3 * v for v in vectors[2]]
    data = [(n, v) for n, v in vectors.items()] + [(1, vectors[1]), (5001, None), (5002, [0.0] * 64), (5003, [1.0] * 63), (5004, [float("nan")] * 64), (5005, [None] * 64), (5006, [float("inf")] + [0.0] * 63)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>").withColumn("class", F.lit("clash"))
    got = {}
    for r in neighbours.nearest(df, "vec_id", "embedding").orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append(r.neighbour)
    want = exact(vectors, 5)
    assert set(got) == set(want)
    assert got == want  # one cell
    assert got[1] == [2001, 2002, 2003, 2004, 2005] and got[2009] == [1, 2001, 2002, 2003, 2004]
    assert neighbours.nearest(df.limit(0), "vec_id", "embedding").count() == 0


def test_more_vectors_than_a_cell_holds(spark):
    rng = np.random.RandomState(6)
    centre = rng.randn(64)
    vectors = {n: (centre + 0.05 * rng.randn(64)).astype(np.float32).tolist() for n in range(600)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, "vec_id", "embedding", cell=40, tables=6).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour)
    want = exact(vectors, 5)
    assert set(got) == set(want)
    assert sum(len(got[n] & set(want[n])) for n in want) / (5 * len(want)) > 0.9


def test_a_dense_region_of_a_third_of_the_rows_keeps_its_neighbours(spark):
    rng = np.random.RandomState(11)
    centre = rng.randn(64)
    x = np.concatenate([rng.randn(4000, 64), centre + 0.01 * rng.randn(2000, 64)]).astype(np.float32)
    df = spark.createDataFrame([(n, v) for n, v in enumerate(x.tolist())], "vec_id bigint, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, "vec_id", "embedding", cell=200).where("vec_id >= 4000").collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour)
    want = exact({n: x[n] for n in range(4000, 6000)}, 5)
    assert set(got) == set(want)
    assert sum(len(got[n] & set(want[n])) for n in want) / (5 * len(want)) > 0.99


def test_every_vector_has_its_neighbours(spark):
    rng = np.random.RandomState(12)
    vectors = {n: v for n, v in enumerate(rng.randn(300, 64).astype(np.float32).tolist())}
    df = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<float>")
    found = neighbours.nearest(df, "vec_id", "embedding", cell=6, tables=1)  # cells too small for five neighbours
    assert {r.vec_id: r["count"] for r in found.groupBy("vec_id").count().collect()} == dict.fromkeys(vectors, 5)
    want = exact(vectors, 5)
    report = neighbours.measured(found, df, "vec_id", "embedding").first()
    got = {}
    for r in found.collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour)
    hits = sum(len(got[n] & set(want[n])) for n in want if n % 20 == 0)
    assert (report.queries, report.wanted, report.found) == (15, 75, hits) and report.recall == hits / 75
    assert neighbours.measured(found, df.limit(0), "vec_id", "embedding").first().queries == 0


def test_few_of_a_row_are_chosen_and_none_of_the_best_is_lost():
    product = np.random.RandomState(2).standard_normal((50, 3000)).astype(np.float32)
    taken = np.zeros(product.shape, bool)
    taken.ravel()[neighbours.chosen(product, 6)] = True
    for row, mask in zip(product, taken, strict=True):
        assert set(np.argsort(-row)[:6]) <= set(np.flatnonzero(mask)) and mask.sum() < 60


def test_cells_of_one_direction_are_verified_whole(spark):
    vectors = [(n, [float(n + 1)] * 64) for n in range(400)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, "vec_id", "embedding", cell=100).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append(r.neighbour)
    assert got == {n: [i for i in range(6) if i != n][:5] for n in range(400)}


def test_collisions_find_the_near_ones():
    rng = np.random.RandomState(8)
    x = rng.randn(400, 64)
    x[1] = x[0] + 0.05 * rng.randn(64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    seen = neighbours.collide(x @ rng.randn(64, neighbours.LINES), np.array([0]), 5)
    assert seen[0, 1] and seen[0].sum() < 400
