"""Small helpers for jobs that run on many executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of keys (two longs each, some 40 bytes with overhead) that may be broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local master gets a new temporary folder (tests);
    on a cluster that would be another disk on each machine, so it is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        have = sc.getCheckpointDir()
        if have is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = have.rsplit("/", 1)[0] if have else "file://" + tempfile.mkdtemp(prefix="helixframe-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
        _until_the_end(spark, sc.getCheckpointDir())
    return folder


def _until_the_end(spark: SparkSession, folder: str) -> None:
    """The folder is deleted when the driver ends in good order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_table(spark: SparkSession, name: str) -> str:
    """Path of a new table in the shared folder; it is deleted when the driver ends."""
    parent = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(parent)
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{parent}/table"


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder, or a part of one, that no later step reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets the session send executors' Python at most so many rows of text at a time (less where it is set lower): a batch is held on both sides.

    For queries and pipelines, which own their session; operators leave it alone.
    """
    now = int(spark.conf.get(ARROW_ROWS))
    if not 0 < now <= rows:
        spark.conf.set(ARROW_ROWS, str(rows))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """While it lasts, the session has these settings; then its own hold again."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def freed_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """While it lasts, each write removes its shuffle files when it has ended."""
    return settings(spark, {CLEANUP: "true"})


#: For tables of large binary values: bytes of a batch to or from Python, rows read at once; and folders written without sorting the rows by folder first.
LARGE_VALUES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.parquet.columnarReaderBatchSize": "64", "spark.sql.maxConcurrentOutputFileWriters": "8"}


def hashable(docs: DataFrame) -> list[Column]:
    """All columns, those that can't be hashed (maps and variants, at any depth) as strings."""
    odd = lambda f: any(x in f.dataType.simpleString() for x in ("map<", "variant"))
    return [F.col(f"`{f.name}`").cast("string") if odd(f) else F.col(f"`{f.name}`") for f in docs.schema.fields]


def few(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """keys, broadcast if they are counted to be few enough; else a join with them shuffles."""
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys
