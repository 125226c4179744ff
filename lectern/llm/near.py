"""Problem 3: texts that are the same apart from small changes.

SetSketch. A text is the set of its distinct word sequences; its sketch has `REGISTERS` registers, each the
smallest of one exponential variate per element, on an exponentially spaced, truncated scale. Registers of a
union are the maxima of the registers, and two registers agree about as often as the sets overlap. Four
registers make one band; texts meeting in a band are candidates, joined as rows, never within a driver or task.
For each candidate pair the similarity is estimated jointly by maximum likelihood from the registers above,
below and equal; what is clearly below the threshold is dropped. Only then are the sets made, of the texts that
are left, and every pair is verified on them.

Texts with equal sets are one class, named by its smallest record, and are joined and verified once. A band
value of more than `HOT` classes (text all have in common) is not joined as rows: its classes are held against
each other in pairs of blocks, on their registers, and only pairs that pass the estimate become rows. Every join
names its strategy, as the planner knows of what Python returns no true size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.hashing import WORD, WordIds, mix, shingles
from lectern.session import cut, spread, stored

REGISTERS, BAND = 256, 4
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2
SLACK = 4.0  # standard deviations an estimate may lie below the threshold before the pair is dropped
HOT, BLOCK = 256, 256  # classes of a band value joined as rows at most; classes of a block beyond
FEW = 1_000_000  # ids that may be broadcast

_rng = np.random.RandomState(20240229)
_FACTORS = (mix(_rng.randint(0, 2**31, REGISTERS).astype(np.uint64) + (np.arange(REGISTERS, dtype=np.uint64) << np.uint64(32))) | np.uint64(1)).astype(np.uint32)
_SHIFTS = mix(_FACTORS).astype(np.uint32)


def sketch(elements: np.ndarray) -> np.ndarray:
    """Registers (uint16) of a set of 64-bit hashes; sets without elements have all registers 0."""
    if not len(elements):
        return np.zeros(REGISTERS, np.uint16)
    # 32 bits are hashed eight at a time; a register of millions of elements becomes coarser, never unequal for equal sets.
    lows = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
    low = (elements ^ (elements >> np.uint64(32))).astype(np.uint32)
    x, y = np.empty((2, 128, REGISTERS), np.uint32)  # small enough for a core's own cache
    for a in range(0, len(low), 128):
        n = min(128, len(low) - a)
        np.multiply(low[a : a + n, None], _FACTORS, out=x[:n])
        x[:n] += _SHIFTS
        np.right_shift(x[:n], np.uint32(16), out=y[:n])
        x[:n] ^= y[:n]
        x[:n] *= np.uint32(0x7FEB352D)
        np.minimum(lows, x[:n].min(axis=0), out=lows)
    least = -np.log1p(-(lows.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def joint_similarity(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int, steps: int = 200) -> float:
    """Jaccard similarity of greatest likelihood, given the registers and the sizes of both sets."""
    above, below = int((a > b).sum()), int((a < b).sum())
    same = len(a) - above - below
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    j = np.linspace(0, min(u / v, v / u), steps)

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    p, q = chance(u - v * j), chance(v - u * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(n > 0, n * np.log(np.maximum(x, 1e-300)), 0.0) for n, x in ((above, p), (below, q), (same, 1 - p - q))]
    return float(j[int(np.argmax(sum(parts)))])


SKETCHED = "record bigint, h1 bigint, h2 bigint, size int, bands array<bigint>"


def _sketched(width: int):
    def work(batches):
        ids = WordIds()
        for batch in batches:
            out = ([], [], [], [], [])
            for record, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = shingles(ids(WORD.findall(text.lower())), width)
                if len(parts):
                    # a set is named by two hashes
                    order = np.arange(1, len(parts) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    sums = np.array([mix(parts + order).sum(), mix(parts ^ order).sum()], np.uint64)
                    for column, value in zip(out, (record, *mix(sums).view(np.int64).tolist(), len(parts), sketch(parts).view(np.int64)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["record", "h1", "h2", "size", "bands"])

    return work


def _elements(width: int):
    def work(batches):
        ids = WordIds()
        for batch in batches:
            sets = [shingles(ids(WORD.findall(text.lower())), width).view(np.int64) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["class", "elements"])

    return work


def _rows(column):
    edges = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _registers(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, REGISTERS)


def passes(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (rows of registers and sizes) may reach the threshold, by the estimate of their similarity.

    Equal registers are nearly as frequent as the sets are similar, which settles most pairs; the likelihood
    decides about the others.
    """
    slack = SLACK * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    fine = np.minimum(size_a, size_b) >= threshold * np.maximum(size_a, size_b)
    fine[fine] = (a[fine] == b[fine]).mean(axis=1) >= threshold - slack - 0.02
    for k in np.flatnonzero(fine).tolist():
        fine[k] = joint_similarity(a[k], b[k], int(size_a[k]), int(size_b[k])) >= threshold - slack
    return fine


PAIRS = "a bigint, b bigint"


def _estimated(threshold: float):
    def work(batches):
        for batch in batches:
            if batch.num_rows:
                keep = passes(_registers(batch.column(4)), _registers(batch.column(5)), batch.column(2).to_numpy(), batch.column(3).to_numpy(), threshold)
                rows = pa.array(np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], ["a", "b"])

    return work


def _blocks(threshold: float):
    """Pairs within one pair of blocks at a time; rows are (band, value, x, y, block, class, size, bands) sorted by the first four."""

    def met(rows, x, y):
        names, sizes, registers = rows.column("class").to_numpy(), rows.column("size").to_numpy(), _registers(rows.column("bands").combine_chunks())
        block = rows.column("block").to_numpy()
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        for i in left.tolist():
            others = right[names[right] > names[i]] if x == y else right
            keep = others[passes(np.broadcast_to(registers[i], (len(others), REGISTERS)), registers[others], np.full(len(others), sizes[i]), sizes[others], threshold)]
            yield np.minimum(names[i], names[keep]), np.maximum(names[i], names[keep])

    def work(batches):
        held, key = [], None

        def answer():
            parts = list(met(pa.Table.from_batches(held), key[2], key[3]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64), pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a < b:
                    if key is not None and tuple(keys[:, a].tolist()) != key:
                        yield answer()
                        held = []
                    key = tuple(keys[:, a].tolist())
                    held.append(batch.slice(a, b - a))
        if held:
            yield answer()

    return work


def _verified(threshold: float):
    def work(batches):
        for batch in batches:
            keep, similar = [], []
            for k, (x, y) in enumerate(zip(_rows(batch.column(2)), _rows(batch.column(3)), strict=True)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common >= threshold * (len(x) + len(y) - common) - 1e-9:
                    keep.append(k)
                    similar.append(common / (len(x) + len(y) - common))
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(similar, pa.float64())], ["a", "b", "similarity"])

    return work


class NearDuplicates:
    """Classes of equal sets, their members, and the pairs of classes at or above the threshold.

    A class is named by its smallest record. Null ids and texts without any sequence of `width` words belong to no
    class. A record sent twice is one member. Words are runs of [a-z0-9] in the lower-cased text.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, width: int = 5, threshold: float = 0.8, hot: int = HOT):
        texts = spread(df).select(F.col(id_col).cast("bigint").alias("record"), F.col(text_col).alias("text")).where(F.col("record").isNotNull() & F.col("text").isNotNull())
        sketched = stored(texts.mapInArrow(_sketched(width), SKETCHED).withColumn("row", F.monotonically_increasing_id()))
        first = sketched.groupBy("h1", "h2").agg(F.min(F.struct("record", "row")).alias("first"))
        named = cut(first.select("h1", "h2", F.col("first.record").alias("class"), F.col("first.row").alias("row")))
        self.members = sketched.select("h1", "h2", "record").join(named.hint("merge"), ["h1", "h2"]).select("class", "record").distinct()
        classes = stored(sketched.select("row", "size", "bands").join(named.select("row", "class").hint("merge"), "row").select("class", "size", "bands"))
        met = classes.select("class", F.posexplode("bands").alias("band", "value"))
        # Most band values have one class and most others two, which need no join.
        shared = cut(met.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("a"), F.max("class").alias("b")).where("n > 1"))
        kinds = shared.where(F.col("n") > 2).select("band", "value", "n")
        many, wide = shared.agg(F.count_if(F.col("n") > hot), F.count_if(F.col("n") > 2)).first()
        asked = F.broadcast(kinds) if wide <= FEW else kinds.hint("merge")
        several = met.join(asked, ["band", "value"])
        usual = several.where(F.col("n") <= hot).select("class", "band", "value")
        other = usual.select(F.col("class").alias("b"), "band", "value")
        joined = usual.join(other.hint("merge"), ["band", "value"]).where("class < b").select(F.col("class").alias("a"), "b")
        pairs = shared.where("n = 2").select("a", "b").unionByName(joined).distinct()
        one = classes.select(F.col("class").alias("a"), F.col("size").alias("na"), F.col("bands").alias("ba"))
        two = classes.select(F.col("class").alias("b"), F.col("size").alias("nb"), F.col("bands").alias("bb"))
        near = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "na", "nb", "ba", "bb").mapInArrow(_estimated(threshold), PAIRS)
        if many:
            sized = several.where(F.col("n") > hot).join(classes.hint("merge"), "class").withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
            beside = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("x"), F.greatest("block", j).alias("y")))
            placed = sized.withColumn("p", F.explode(beside)).select(F.col("band").cast("bigint").alias("band"), "value", "p.x", "p.y", "block", "class", "size", "bands")
            keys = ("band", "value", "x", "y")
            near = near.unionByName(placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_blocks(threshold), PAIRS).distinct()).distinct()
        near = cut(near)
        ids = near.select(F.explode(F.array("a", "b")).alias("record")).distinct()
        asked = F.broadcast(ids) if near.count() * 2 <= FEW else ids.hint("merge")
        sets = stored(texts.join(asked, "record", "left_semi").mapInArrow(_elements(width), "class bigint, elements array<bigint>").dropDuplicates(["class"]))
        one, two = sets.withColumnsRenamed({"class": "a", "elements": "ea"}), sets.withColumnsRenamed({"class": "b", "elements": "eb"})
        both = near.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "ea", "eb")
        self.links = both.mapInArrow(_verified(threshold), "a bigint, b bigint, similarity double")

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: every pair of records, copies included."""
        one = self.members.select(F.col("class").alias("a"), F.col("record").alias("x"))
        two = self.members.select(F.col("class").alias("b"), F.col("record").alias("y"))
        across = self.links.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        within = one.join(two.hint("merge"), F.col("a") == F.col("b")).where("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
        return across.unionByName(within)

    def groups(self) -> DataFrame:
        """(record, class, group_id, links): one row per record; `group_id` is the smallest record reachable,
        `links` the number of other classes the record's own is linked with."""
        links = cut(self.links.select("a", "b"))
        both = links.union(links.select("b", "a"))
        degree = both.groupBy(F.col("a").alias("class")).agg(F.count(F.lit(1)).alias("links"))
        return self.members.join(components(links).hint("merge"), "class", "left").join(degree.hint("merge"), "class", "left").select("record", "class", F.coalesce("group_id", "class").alias("group_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(class, group_id) for the ends of `links` (a, b): the smallest node each can reach.

    Alternates linking a node's neighbours to its smallest neighbour, over larger ones and over all, until no
    link changes; every round is two aggregates, written to the checkpoint folder.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    mark = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("v", "u"))
        # Aggregates and joins, not windows: the neighbours of one node may be a third of all nodes.
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = cut(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least.hint("merge"), "u")
        edges = cut(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    ends = edges.select(F.col("u").alias("class"), F.col("v").alias("group_id"))
    return ends.union(edges.select(F.col("v").alias("class"), F.col("v").alias("group_id"))).groupBy("class").agg(F.min("group_id").alias("group_id"))
