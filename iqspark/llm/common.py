"""Shared-folder tables and other helpers of the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path, shared_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch that a Python task gets, besides its last row.
BATCH_BYTES = 2_000_000


def small_batches(spark: SparkSession) -> None:
    """Python tasks of this session get batches of BATCH_BYTES from now on, where Spark's own bound (64 MB, 10,000 rows)
    holds; a bound that the user has set stays. Executor and Python worker each hold whole batches, both ways."""
    if spark.conf.get(_BATCH, None) in (None, "64MB", "67108864", "67108864b"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def few_files(df: DataFrame) -> DataFrame:
    """df in an eighth of the shuffle partitions, but no fewer than there are cores: for small tables that are written,
    as each file costs the executor a process or two on a local file system (for chmod)."""
    spark = df.sparkSession
    return df.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that a lost executor never replays what came before; shuffle
    files of the write go with its end."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Remove what materialize has written, once nothing reads it any more."""
    for df in written:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if shared_dir(spark).split(":")[-1].lstrip("/") in path:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_key(text: Column) -> Column:
    """64 bits of a text: with its doc_id, the name of a row wherever ids are null or repeated."""
    return F.xxhash64(text.cast("string"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, name: str, most: int = 500_000) -> DataFrame:
    """df written to the shared folder, and marked for broadcast if it has at most so many rows; else joins shuffle."""
    written = materialize(df, name)
    return F.broadcast(written) if written.count() <= most else written
