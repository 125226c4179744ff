"""Session helpers: a local session for tests, and cutting lineage on shared storage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []


def local_session(cores: str = "8", app: str = "lectern", **conf: str) -> SparkSession:
    """A session for tests and benches. On a cluster the caller's session is used as it is."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.host": "127.0.0.1",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only where that is unset (a local session) one is made, since then driver and executors are the same
    machine; it is removed when the process ends.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="lectern-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder as a checkpoint and continue from there.

    Checkpoint files of frames nobody refers to any more go where the session sets
    spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like `cut`, as a Parquet table: compressed, and later plans read only the columns they use.

    The planner knows the table's compressed size only, so joins of what was stored name their strategy. The
    table is kept until `clear_stored`.
    """
    path = f"{shared_folder(df.sparkSession)}/lectern-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> None:
    """Remove the tables `stored` has written; for long sessions, between jobs whose results are saved."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def few_splits(df: DataFrame) -> bool:
    """Whether a file-backed table has fewer splits than there are cores: one small file."""
    if "_metadata" not in df._jdf.queryExecution().analyzed().metadataOutput().toString():
        return False
    return df.select(df.columns[:1])._jdf.queryExecution().toRdd().getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than cores spread over them in turns; any larger one stays as it lies.

    Not by a key: a partitioning the planner may build on must come from its own exchanges.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if few_splits(df) else df


def once(df: DataFrame, keys: list[str], most: int = 1_000_000) -> DataFrame:
    """The rows of `df` without null keys, one of each key; repeated rows must be alike.

    Of a file-backed table only keys (as 128-bit hashes) and row positions are shuffled to find the surplus rows,
    and if there are at most `most` of them their positions are broadcast: the rows themselves, whole texts, stay
    where they are. Beyond that, and for other frames, rows are dropped by an ordinary aggregate.
    """
    fine = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    if "_metadata" not in fine._jdf.queryExecution().analyzed().metadataOutput().toString():
        return fine.dropDuplicates(keys)
    place = [F.xxhash64(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_row")]
    located = fine.select(F.xxhash64(*keys).alias("h"), F.xxhash64(F.lit(1), *keys).alias("g"), F.struct(*place).alias("at"))
    repeated = located.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).where("n > 1").drop("n")
    surplus = cut(located.join(repeated, ["h", "g"]).where(F.col("at") != F.col("first")).select("at._file", "at._row"))
    many = surplus.count()
    if not many:
        return spread(fine)
    if many > most:
        return fine.dropDuplicates(keys)
    gone = F.broadcast(surplus.withColumnsRenamed({"_file": "_gone_file", "_row": "_gone_row"}))
    cores = df.sparkSession.sparkContext.defaultParallelism
    rest = fine.join(gone, (F.xxhash64(F.col("_metadata.file_path")) == F.col("_gone_file")) & (F.col("_metadata.row_index") == F.col("_gone_row")), "left_anti")
    return rest.repartition(cores) if few_splits(df) else rest


def scratch_dir(prefix: str) -> str:
    """A folder for one task's own spill files, among the local directories Spark gives its executors.

    Nothing in it outlives the task, so a lost executor costs a retried task and no data.
    """
    named = next((os.environ[k] for k in ("SPARK_EXECUTOR_DIRS", "SPARK_LOCAL_DIRS", "LOCAL_DIRS") if os.environ.get(k)), "")
    roots = [x for x in named.replace(os.pathsep, ",").split(",") if os.path.isdir(x)]
    return tempfile.mkdtemp(prefix=prefix, dir=roots[os.getpid() % len(roots)] if roots else None)
