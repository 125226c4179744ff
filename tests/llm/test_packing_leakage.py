import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import leakage, packing
from lectern.llm.hashing import WORD


def test_hilbert_neighbours_touch():
    side = np.array([[x, y] for x in range(8) for y in range(8)])
    keys = packing.hilbert_keys(side, 3)
    assert sorted(keys.tolist()) == list(range(64))
    walk = side[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_every_token_is_packed_once(spark):
    rng = random.Random(1)
    data = [(n, " ".join(f"w{rng.randint(0, 50)}" for _ in range(rng.choice([0, 1, 5, 30, 64, 65, 200])))) for n in range(300)] + [(900, None), (901, "..."), (902, "same"), (902, "same")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("container", F.lit("clash"))
    pieces = packing.fill_containers(df, "doc_id", "text", capacity=64).collect()
    fill, tokens = defaultdict(list), defaultdict(list)
    for p in pieces:
        fill[p.container].append((p.container_start, p.container_start + p.token_end - p.token_start))
        tokens[p.doc_id].append((p.token_start, p.token_end, p.piece_no))
    for ranges in fill.values():
        ranges.sort()
        assert all(b <= c for (_, b), (c, _) in zip(ranges, ranges[1:], strict=False)) and ranges[-1][1] <= 64
    sizes = {n: len((t or "").split()) for n, t in data if n < 900}
    for n, size in sizes.items():
        assert sum(b - a for a, b, _ in tokens[n]) == size
        assert (len(tokens[n]) > 1) == (size > 64)
    assert len(tokens[902]) == 2 and 900 not in tokens and 901 not in tokens
    total = sum(b - a for x in tokens.values() for a, b, _ in x)
    assert total / (64 * len(fill)) > 0.85
    assert packing.fill_containers(df.limit(0), "doc_id", "text").count() == 0


def test_tokenizer_files_count(spark):
    public = __import__("importlib").util.find_spec("public_tokenizers")
    if public is None:
        return
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.token_counter(path)(["hello world", ""]) == [2, 0]


def test_alignment_scores_and_runs():
    item = np.arange(10)
    assert leakage.align(item, item) == (20, 10)
    edited = np.array([0, 1, 2, 99, 4, 5, 6, 7, 8, 9]) * 1
    edited[3] = -1
    assert leakage.align(item, edited) == (17, 6)
    assert leakage.align(item, np.array([-1, -1])) == (0, 0)
    assert leakage.align(item, np.concatenate((item[:5], [-1], item[5:]))) == (19, 5)


def test_many_alignments_equal_single_ones():
    rng = np.random.RandomState(3)
    items = [rng.randint(0, 6, rng.randint(1, 30)) for _ in range(40)]
    passages = [rng.randint(0, 6, rng.randint(1, 60)) for _ in range(40)]

    def slow(a, b):
        h, best, longest = np.zeros((len(a) + 1, len(b) + 1), int), 0, 0
        r = np.zeros_like(h)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
                r[i, j] = r[i - 1, j - 1] + 1 if x == y else 0
        return h.max(), r.max()

    scores, runs = leakage.align_many(items, passages)
    assert list(zip(scores, runs, strict=True)) == [slow(a, b) for a, b in zip(items, passages, strict=True)]


def test_the_bitmap_holds_every_gram(spark):
    grams = np.random.RandomState(4).randint(-(2**63), 2**63 - 1, 3000)
    bits = leakage.bitmap(spark.createDataFrame([(int(g),) for g in grams], "gram bigint"))
    assert leakage.may_hold(bits, grams.view(np.uint64)).all()
    others = np.random.RandomState(5).randint(-(2**63), 2**63 - 1, 20000).view(np.uint64)
    assert leakage.may_hold(bits, others).mean() < 0.002


def test_leaks_equal_brute_force(spark, rows):
    rng = random.Random(7)
    vocabulary = [f"w{n}" for n in range(40)]
    items = [(n, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([4, 15, 30])))) for n in range(30)]
    docs = []
    for n in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 10, 60]))]
        source = rng.choice(items)[1].split()
        cut = rng.randint(0, len(source))
        docs.append((n, " ".join(words[:20] + source[: cut + 5] + words[20:]).upper()))
    docs += [(500, None), (501, ""), (0, docs[0][1]), (None, items[0][1])]

    def grams(text):
        w = WORD.findall((text or "").lower())
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    want = {(d, i) for d, t in docs if d is not None for i, u in items if grams(t) & grams(u)}
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("passage", F.lit("clash"))
    it = spark.createDataFrame([*items, (None, "x"), (77, None)], "item_id bigint, text string")
    got = leakage.leaks(df, it)
    assert rows(got.where("run >= 12"), "doc_id", "item_id") == want
    assert rows(leakage.leaks(df, it, score=None), "doc_id", "item_id") == want
    assert leakage.leaks(df.limit(0), it).count() == 0 and leakage.leaks(df, it.limit(0)).count() == 0


def test_edited_copies_are_reported(spark):
    words = [f"u{n}" for n in range(40)]
    edited = [w if n % 9 else "other" for n, w in enumerate(words)]
    docs = spark.createDataFrame([(1, "before " + " ".join(edited) + " after"), (2, "nothing alike")], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, " ".join(words))], "item_id bigint, text string")
    got = leakage.leaks(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.run) for r in got] == [(1, 5, 8)] and got[0].score > 0.7


def test_an_edited_copy_beside_a_full_one_is_reported(spark):
    words = [f"u{n}" for n in range(80)]
    edited = [w if n % 10 != 5 else "other" for n, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(edited)), (2, "before " + " ".join(words)), (3, "nothing alike")], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, " ".join(words))], "item_id bigint, text string")
    got = {r.doc_id: (r.item_id, r.run, round(r.score, 3)) for r in leakage.leaks(docs, items).collect()}
    assert got == {1: (5, 9, 0.85), 2: (5, 80, 1.0)}
    assert [r.doc_id for r in leakage.leaks(docs, items, score=None).collect()] == [2]
