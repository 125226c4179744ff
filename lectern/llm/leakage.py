"""Problem 9: evaluation texts, or parts of them, inside a corpus.

N-gram seeds, then alignment. The items' n-grams are rows. A bitmap of them, of bounded size however many items
there are, goes to every task, which looks for them in one pass over the corpus and keeps only the passages around
hits; hits of the bitmap become exact by a join with the items' n-grams. Every passage with an n-gram of an item is
aligned with it (Smith-Waterman over words, many pairs at a time), which scores edited copies, and the longest run
of equal words is taken in the same pass.

Where only runs are asked for, every window of `run` words of an item keeps as seed the one of its n-grams that
fewest passages hold: a shared run of `run` words always meets a seed, and phrases common in the corpus do not
start alignments. An edited copy beside a full one may hold none of the rarest, so scores need all.

Words travel as 64-bit hashes. Every join names its strategy, as the planner knows of what Python returns no size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.hashing import WORD, WordIds, rolling
from lectern.session import cut, spread, stored

MATCH, MISMATCH, GAP = 2, -1, -1
BITS_A_GRAM, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 28
PROBES = (0, 18, 36)  # bits of a hash by which it is shifted for each look-up
LONGEST_PASSAGE = 4096  # words between the first and last hit of a passage
CELLS = 150_000  # of one alignment table


def align_many(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(Smith-Waterman scores, longest runs of equal words) of the pairs, worked on in tables of like lengths."""
    scores, runs = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    order = sorted(range(len(items)), key=lambda k: (len(passages[k]), len(items[k])))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * (len(passages[order[end]]) + 1) <= CELLS:
            end += 1
        rows = order[at:end]
        m, n = max(len(passages[k]) for k in rows), max(len(items[k]) for k in rows)
        # each pair has word numbers of its own, so what only fills a table equals nothing
        left, right = np.full((len(rows), n), -1, np.int32), np.full((len(rows), m), -2, np.int32)
        for r, k in enumerate(rows):
            words, numbers = np.unique(np.concatenate((items[k], passages[k])), return_inverse=True)
            left[r, : len(items[k])], right[r, : len(passages[k])] = numbers[: len(items[k])], numbers[len(items[k]) :]
        slope = (np.arange(m + 1) * -GAP).astype(np.int32)
        above, length = np.zeros((len(rows), m + 1), np.int32), np.zeros((len(rows), m + 1), np.int32)
        best, longest = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int32)
        for i in range(n):
            same = right == left[:, i : i + 1]
            row = np.zeros_like(above)
            np.maximum(above[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH)), above[:, 1:] + np.int32(GAP), out=row[:, 1:])
            np.maximum(row, 0, out=row)
            row += slope
            np.maximum.accumulate(row, axis=1, out=row)  # gaps along the passage
            row -= slope
            run = np.zeros_like(length)
            np.multiply(length[:, :-1] + np.int32(1), same, out=run[:, 1:])
            np.maximum(best, row.max(axis=1), out=best)
            np.maximum(longest, run.max(axis=1), out=longest)
            above, length = row, run
        scores[rows], runs[rows] = best, longest
        at = end
    return scores, runs


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(Smith-Waterman score, longest run of equal words) of one pair."""
    scores, runs = align_many([np.asarray(item)], [np.asarray(passage)])
    return int(scores[0]), int(runs[0])


def _item_words(seed: int):
    def work(batches):
        ids = WordIds()
        for batch in batches:
            words = [ids(WORD.findall(text.lower())) for text in batch.column(1).to_pylist()]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w.view(np.int64) for w in words], kind), pa.array([rolling(w, seed).view(np.int64) for w in words], kind)], ["item", "words", "grams"])

    return work


def bitmap(grams: DataFrame) -> np.ndarray:
    """64-bit words of a bitmap in which the bits of every `gram` are set: at most `MOST_BITS` bits, whatever their number."""
    many = grams.count()
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_A_GRAM * many):
        bits *= 2
    probes = F.array(*[F.shiftrightunsigned("gram", k).bitwiseAND(F.lit(bits - 1)) for k in PROBES])
    places = grams.select(F.explode(probes).alias("p")).select(F.shiftrightunsigned("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    rows = places.groupBy("w").agg(F.bit_or("bit").alias("bits")).collect()  # at most MOST_BITS / 64
    out = np.zeros(bits // 64, np.int64)
    if rows:
        where, values = zip(*rows, strict=True)
        out[np.array(where)] = np.array(values, np.int64)
    return out.view(np.uint64)


def may_hold(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Which of the hashes have all their bits set."""
    mask, out = np.uint64(len(bits) * 64 - 1), np.ones(len(grams), bool)
    for k in PROBES:
        p = (grams >> np.uint64(k)) & mask
        out &= ((bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)
    return out


def _hits(bits, seed: int, reach: int):
    def work(batches):
        ids = WordIds()
        for batch in batches:
            docs, passages, found = [], [], []
            texts = [WORD.findall(text.lower()) for text in batch.column(1).to_pylist()]
            flat = ids([w for words in texts for w in words])
            ends = np.cumsum([len(words) for words in texts])
            hashes = rolling(flat, seed)
            at = np.flatnonzero(may_hold(bits.value, hashes))
            owner = np.searchsorted(ends, at, "right")
            inside = at + seed <= ends[owner] if len(at) else np.zeros(0, bool)  # not across two texts
            at, owner = at[inside], owner[inside]
            if len(at):
                fresh = np.flatnonzero((owner[1:] != owner[:-1]) | (at[1:] - at[:-1] > 2 * reach) | (at[1:] // LONGEST_PASSAGE != at[:-1] // LONGEST_PASSAGE)) + 1
                for where in np.split(at, fresh):
                    doc = int(np.searchsorted(ends, where[0], "right"))
                    first = int(ends[doc]) - len(texts[doc])
                    docs.append(batch.column(0)[doc].as_py())
                    passages.append(flat[max(first, where[0] - reach) : min(int(ends[doc]), where[-1] + seed + reach)].view(np.int64))
                    found.append(np.unique(hashes[where]).view(np.int64))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(passages, kind), pa.array(found, kind)], ["doc", "passage", "grams"])

    return work


SHAPE = "doc bigint, item bigint, score int, of_score int, run int"


def _aligned(batches):
    def rows(column):
        edges, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        return [values[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    for batch in batches:
        items, passages = rows(batch.column(2)), rows(batch.column(3))
        scores, runs = align_many(items, passages)
        numbers = (scores, np.array([MATCH * len(x) for x in items], np.int64), runs)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x.astype(np.int32)) for x in numbers)], ["doc", "item", "score", "of_score", "run"])


def _seeds(grams: DataFrame, met: DataFrame, wide: int) -> DataFrame:
    """(item, gram): for every window of `wide` n-grams of an item, of those found at all the one in fewest passages."""
    held = met.select("gram", "passage_id").distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rows = grams.join(held.hint("merge"), "gram", "left")
    ahead = Window.partitionBy("item").orderBy("position").rowsBetween(0, wide - 1)
    rarest = F.min(F.when(F.col("n").isNotNull(), F.struct("n", "gram"))).over(ahead)  # an item's own n-grams: as many as it has words
    chosen = rows.withColumn("s", rarest).where((F.col("position") <= F.greatest(F.lit(0), F.col("of") - wide)) & F.col("s").isNotNull())
    return chosen.select("item", F.col("s.gram").alias("gram")).distinct()


def leaks(corpus: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", seed: int = 6, run: int = 12, score: float | None = 0.5) -> DataFrame:
    """(doc, item, score, run): documents that hold an item, wholly or partly.

    `score` is the alignment score over that of the whole item, `run` the longest run of equal words. A pair is
    kept with a run of at least `run` words, or a score of at least `score`, among pairs that share a seed of
    `seed` words; with `score` None, only with such a run. Words are runs of [a-z0-9] in the lower-cased text. Null
    ids and texts give nothing; items of fewer than `seed` words are not looked for; a row sent twice is reported
    once. Empty tables give an empty result.
    """
    if not 0 < seed <= run:
        raise ValueError("seed must be at most run")
    texts = spread(corpus).select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    asked = items.select(F.col(item).cast("bigint").alias("item"), F.col(item_text).alias("text")).where(F.col("item").isNotNull() & F.col("text").isNotNull()).distinct()
    worded = cut(asked.mapInArrow(_item_words(seed), "item bigint, words array<bigint>, grams array<bigint>").where(F.size("grams") > 0))
    grams = worded.select("item", F.size("grams").alias("of"), F.posexplode("grams").alias("position", "gram"))
    reach = worded.agg(F.coalesce(F.max(F.size("words")), F.lit(0))).first()[0]
    bits = corpus.sparkSession.sparkContext.broadcast(bitmap(grams.select("gram")))
    hits = stored(texts.mapInArrow(_hits(bits, seed, reach), "doc bigint, passage array<bigint>, grams array<bigint>").withColumn("passage_id", F.monotonically_increasing_id()))
    met = hits.select("passage_id", F.explode("grams").alias("gram")).join(grams.select("gram", "item").distinct().hint("merge"), "gram")
    if score is None:
        met = met.join(_seeds(grams, met, run - seed + 1).hint("merge"), ["item", "gram"])
    pairs = met.select("passage_id", "item").distinct()
    both = pairs.join(worded.select("item", "words").hint("merge"), "item").join(hits.select("passage_id", "doc", "passage").hint("merge"), "passage_id")
    best = both.select("doc", "item", "words", "passage").mapInArrow(_aligned, SHAPE).groupBy("doc", "item").agg(F.max(F.col("score") / F.col("of_score")).alias("score"), F.max("run").alias("run"))
    enough = F.col("run") >= run
    if score is not None:
        enough = enough | (F.col("score") >= score)
    return best.where(enough).select(F.col("doc").alias(doc), F.col("item").alias(item), "score", "run")
