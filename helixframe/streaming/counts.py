"""Counts over streams of timed annotations; edits and encodings work on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, key: str, *, time: str = "ts", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_start, key, n, total) of value by tumbling windows; rows later than that behind the latest time are dropped."""
    some = stream.withWatermark(time, late)
    return some.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def run_once(result: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what there is and adds the rows that each batch changed to a Parquet table, with the batch's number.

    The watermark bounds the state: windows it has passed are dropped.  A batch
    that is run again writes the same rows under the same number.
    """
    write = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/of={batch}")
    result.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows that run_once wrote the last of each key."""
    values = [c for c in rows.columns if c not in (*keys, "batch", "of")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("x")).select(*keys, "x.*")


def stream_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A Parquet table of a folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    files = f"{folder}/{table}.parquet"
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(files)
