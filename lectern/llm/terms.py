"""Problem 2: how often every term occurs, in how many records, and which terms are of no use.

Recursive radix spilling. Each task cuts its (term, count) rows by hash bits of the term into files of its own
spill folder, pre-aggregating every block before it is written; a part that is still too large is cut again by
the next bits, and every part that fits is aggregated by DuckDB under a memory limit with its own spill file.
The same code runs twice: before the shuffle, so that a term held by every record crosses it once per task,
and after it, over the task's share of the terms.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import once, scratch_dir

COUNTS = pa.schema([("term", pa.string()), ("total", pa.int64()), ("rows", pa.int64())])
BITS, DEEPEST = 4, 14


class RadixCounter:
    """Sums (total, rows) per term over more rows than fit in memory."""

    def __init__(self, folder: str, part_rows: int, block_rows: int, memory: str = "256MB"):
        import duckdb

        self.folder, self.part_rows, self.block_rows = folder, part_rows, block_rows
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": os.path.join(folder, "duckdb")})

    def _summed(self, rows: pa.Table, depth: int) -> pa.Table:
        """One row per term, with the hash bits of this depth."""
        self.db.register("block", rows)
        shift = 64 - BITS * (depth + 1)
        out = self.db.sql(f"SELECT term, sum(total)::BIGINT AS total, sum(rows)::BIGINT AS rows, ((hash(term) >> {shift}) & {(1 << BITS) - 1})::INTEGER AS part FROM block GROUP BY term ORDER BY part").to_arrow_table()
        self.db.unregister("block")
        return out

    def _blocks(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= self.block_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def counts(self, batches: Iterable[pa.RecordBatch], depth: int = 0, path: str = "p") -> Iterator[pa.RecordBatch]:
        """Partition by the hash bits of this depth, then finish every part or cut it further."""
        files: dict[int, tuple] = {}
        sizes: dict[int, int] = {}
        blocks = 0
        for block in self._blocks(batches):
            blocks += 1
            summed = self._summed(block, depth)
            parts = summed.column("part").to_numpy()
            edges = [0, *((parts[1:] != parts[:-1]).nonzero()[0] + 1).tolist(), len(parts)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                part = int(parts[a])
                if part not in files:
                    sink = pa.OSFile(os.path.join(self.folder, f"{path}{part:x}"), "wb")
                    files[part] = (sink, pa.ipc.new_stream(sink, COUNTS))
                files[part][1].write_table(summed.slice(a, b - a).drop_columns("part").cast(COUNTS))
                sizes[part] = sizes.get(part, 0) + b - a
        for sink, writer in files.values():
            writer.close()
            sink.close()
        for part in sorted(files):
            name = os.path.join(self.folder, f"{path}{part:x}")
            with pa.memory_map(name) as source:
                stream = pa.ipc.open_stream(source)
                if sizes[part] > self.part_rows and depth < DEEPEST and blocks > 1:
                    yield from self.counts(stream, depth + 1, f"{path}{part:x}")
                elif blocks == 1:  # every term is there once
                    yield from stream
                else:
                    self.db.register("part", stream)
                    yield from self.db.sql("SELECT term, sum(total)::BIGINT AS total, sum(rows)::BIGINT AS rows FROM part GROUP BY term").to_arrow_reader(50_000)
                    self.db.unregister("part")
            os.remove(name)


def _count(part_rows: int, block_rows: int):
    def work(batches):
        folder = scratch_dir("terms-")
        try:
            for out in RadixCounter(folder, part_rows, block_rows).counts(x.cast(COUNTS) if x.schema != COUNTS else x for x in batches):
                yield out.cast(COUNTS)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return work


def term_counts(df: DataFrame, id_col: str, map_col: str, part_rows: int = 500_000, block_rows: int = 500_000) -> DataFrame:
    """(term, total, rows): occurrences of every term and the number of distinct records holding it.

    A record is one value of `id_col`; repeated rows count once. Null ids, null maps and empty maps add
    nothing; a null count adds a record but no occurrence. Empty input gives an empty result.
    """
    rows = once(df.where(F.col(map_col).isNotNull()), [id_col])
    pairs = rows.select(F.explode(map_col).alias("term", "total")).select("term", F.coalesce(F.col("total").cast("bigint"), F.lit(0).cast("bigint")).alias("total"), F.lit(1).cast("bigint").alias("rows"))
    shape, work = "term string, total bigint, rows bigint", _count(part_rows, block_rows)
    return pairs.mapInArrow(work, shape).repartition("term").mapInArrow(work, shape)


def marked_terms(df: DataFrame, id_col: str, map_col: str, rare_rows: int = 1, common_percent: int = 30, **sizes: int) -> DataFrame:
    """`term_counts` with `mark`: `rare` (held by at most `rare_rows` records), `common` (by more than
    `common_percent` % of the records with a map), else null. A term that is both is `rare`."""
    counts = term_counts(df, id_col, map_col, **sizes)
    held = df.where(F.col(id_col).isNotNull() & F.col(map_col).isNotNull()).agg(F.count_distinct(id_col)).scalar()
    mark = F.when(F.col("rows") <= rare_rows, "rare").when(F.col("rows") * 100 > held * common_percent, "common")
    return counts.withColumn("mark", mark)
