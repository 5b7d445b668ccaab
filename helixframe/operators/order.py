"""Row numbers over a whole table without passing it through one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a new folder on a local master, and an error on a cluster, whose machines have a disk each."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="helixframe-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


#: A table that Spark reads as one task, as Parquet's row groups are up to that size.
ROW_GROUP = 128 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys over the session's cores, if by its plan's statistics it is smaller than a row group; else, and if it's a stream, df itself.

    For rows that are cheap to send and costly to work on: a small table is
    one row group, so one task would do all that follows up to the first
    shuffle.  Groups of the same keys are then where they belong already.
    Larger tables have splits enough, and are not shuffled for that.
    """
    if df.isStreaming:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys) if size < ROW_GROUP else df


def _dealt(df: DataFrame, *order: str) -> DataFrame:
    """df dealt out by range and sorted; rows that tie are parted by chance, so that many of them are no single task."""
    return df.withColumn("__by_chance", F.rand(7)).repartitionByRange(*order, "__by_chance").sortWithinPartitions(*order, "__by_chance").drop("__by_chance")


def running_totals(df: DataFrame, order: str, *values: str) -> DataFrame:
    """df with the totals of values over all rows up to each in the order of a column, as total_<value>; rows that tie have different totals.

    As numbered: sorted by range, and the driver only sees the partitions' totals.
    """
    ranged = _dealt(df, order)
    ranged = checkpointed(ranged.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sums = ranged.groupBy(part.alias("__part")).agg(*[F.sum(v).alias(v) for v in values]).orderBy("__part").collect()
    before, starts = [0.0] * len(values), []
    for r in sums:
        starts.append((r["__part"], *before))
        before = [a + float(r[v]) for a, v in zip(before, values, strict=True)]
    offsets = df.sparkSession.createDataFrame(starts, "__part long" + "".join(f", __before_{v} double" for v in values))
    w = Window.partitionBy("__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return out.select(*df.columns, *[(F.sum(v).over(w) + F.col(f"__before_{v}")).alias(f"total_{v}") for v in values])


def numbered(df: DataFrame, *order: str, name: str = "row_idx") -> DataFrame:
    """Adds the row's place (from 0, gapless) in the order of some columns; ties are broken by all columns.

    Rows are dealt out by range and sorted in each partition; the driver only
    sees the partitions' counts.
    """
    ranged = _dealt(df, *order, *[c for c in df.columns if c not in order])
    ranged = checkpointed(ranged.withColumn("__id", F.monotonically_increasing_id()))
    counts = ranged.groupBy(F.shiftright("__id", 33).alias("__part")).agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()
    total, starts = 0, []
    for r in counts:
        starts.append((r["__part"], total))
        total += r["n"]
    offsets = df.sparkSession.createDataFrame(starts, "__part long, __start long")
    out = ranged.withColumn("__part", F.shiftright("__id", 33)).join(F.broadcast(offsets), "__part")
    return out.withColumn(name, F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__start", "__id")
