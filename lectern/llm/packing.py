"""Problem 8: fill containers of fixed capacity with whole items, neighbours in content together.

Each text becomes a hashed vector of its words, projected to four dimensions; the Hilbert key of the quantised
point puts texts of like content next to each other on one line. The line is range-partitioned by (key, id), so
equal keys (a text copied over and over) are spread as well, and every task packs its stretch of the line:
best fit into a bounded set of open containers. Only sizes and keys are shuffled, never texts.

An item larger than a container is split: full containers of its own, and a rest that is packed like an item.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.hashing import WordIds
from lectern.session import spread, stored

TOKEN = r"[A-Za-z0-9]+(?:[./-][A-Za-z0-9]+)*"
DIMENSIONS, DEPTH = 4, 12


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of unsigned integer points (rows), each coordinate of `bits` bits."""
    x = [c.astype(np.int64) for c in points.T]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of each level
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key


def token_counter(tokenizer: str | None) -> Callable[[list[str]], list[int]]:
    """Counts tokens: of the built-in pattern, or of a tokenizer file (.json, of the `tokenizers` library)."""
    if tokenizer is None:
        find = re.compile(TOKEN).findall
        return lambda texts: [len(find(x)) for x in texts]
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(tokenizer)
    loaded.encode_special_tokens = True
    return lambda texts: [len(x) for x in loaded.encode_batch(texts, add_special_tokens=False)]


def _sized(tokenizer: str | None):
    def work(batches):
        from lectern.llm.hashing import mix

        find, count, ids = re.compile(TOKEN).findall, None if tokenizer is None else token_counter(tokenizer), WordIds()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            words = [find(x) for x in texts]
            sizes = [len(w) for w in words] if count is None else count(texts)
            points = np.zeros((len(texts), DIMENSIONS))
            for row, w in enumerate(words):
                if w:
                    bits = mix(ids(list(set(w))))
                    lanes = np.stack([(bits >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in range(DIMENSIONS)], axis=1).astype(np.float64)
                    points[row] = (lanes / 32767.5 - 1).sum(axis=0) * np.sqrt(3 / len(bits))  # about a standard normal
            grid = np.clip((points + 3) / 6 * (1 << DEPTH), 0, (1 << DEPTH) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(hilbert_keys(grid, DEPTH))], ["item", "tokens", "curve"])

    return work


class Packer:
    """Best fit into at most `open_most` open containers; the fullest is closed when there are more."""

    def __init__(self, capacity: int, open_most: int):
        self.capacity, self.open_most = capacity, open_most
        self.room: list[tuple[int, int]] = []  # (free, container), ascending
        self.next = 0

    def fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, size: int) -> tuple[int, int]:
        """(container, where in it) of an item of at most the capacity."""
        k = bisect_left(self.room, (size, -1))
        free, container = self.room.pop(k) if k < len(self.room) else (self.capacity, self.fresh())
        if free > size:
            insort(self.room, (free - size, container))
            if len(self.room) > self.open_most:
                self.room.pop(0)
        return container, self.capacity - free


def _packed(capacity: int, open_most: int):
    def work(batches):
        packer, part = Packer(capacity, open_most), TaskContext.get().partitionId() << 40
        for batch in batches:
            out = ([], [], [], [], [], [])
            rows, sizes = batch.column(0), batch.column(1).to_pylist()
            for row, size in enumerate(sizes):
                start = number = 0
                while start < size:
                    number += 1
                    take = min(capacity, size - start)
                    container, at = (packer.fresh(), 0) if take == capacity else packer.place(take)
                    for column, value in zip(out, (row, part + container, at, number, start, start + take), strict=True):
                        column.append(value)
                    start += take
            columns = [rows.take(pa.array(out[0], pa.int64())), *(pa.array(x, pa.int64()) for x in out[1:])]
            yield pa.RecordBatch.from_arrays(columns, ["item", "container", "container_start", "piece_no", "token_start", "token_end"])

    return work


def fill_containers(df: DataFrame, id_col: str, text_col: str, capacity: int = 2048, tokenizer: str | None = None, open_most: int = 256) -> DataFrame:
    """(id, container, container_start, piece_no, token_start, token_end): every token of every text once.

    A container holds at most `capacity` tokens; only a text with more tokens has more than one piece. Null
    texts and texts without tokens are in no container. Repeated rows and null ids are items of their own; an
    empty table gives no containers. Container numbers are unique, not dense. Ids must be integers.
    """
    texts = spread(df).select(F.col(id_col).cast("bigint").alias("item"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # Stored, as the range partitioning samples its input before it sorts it: texts are read once.
    sized = stored(texts.mapInArrow(_sized(tokenizer), "item bigint, tokens bigint, curve bigint").where("tokens > 0"))
    line = sized.repartitionByRange("curve", "item").sortWithinPartitions("curve", "item", "tokens").select("item", "tokens")
    shape = "item bigint, container bigint, container_start bigint, piece_no bigint, token_start bigint, token_end bigint"
    return line.mapInArrow(_packed(capacity, open_most), shape).withColumnRenamed("item", id_col)


def fill_report(pieces: DataFrame, id_col: str, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, the share of capacity filled, and the items split."""
    size = F.col("token_end") - F.col("token_start")
    return pieces.agg(F.count_distinct("container").alias("containers"), F.coalesce(F.sum(size), F.lit(0)).alias("tokens"), (F.sum(size) / (F.count_distinct("container") * capacity)).alias("filled"), F.count_if(F.col("piece_no") == 2).alias("split_items"))
