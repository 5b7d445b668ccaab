"""Data behind plots: letters, annotations in view, tracks for labels."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def logo_letters(attr: DataFrame, start: int, end: int, least: float = 0.0) -> DataFrame:
    """(example_idx, pos, char_idx, value) in view, of at least some absolute height."""
    return attr.where((F.col("pos") >= start) & (F.col("pos") < end) & (F.abs("value") > least))


def annotations_in_view(spans: DataFrame, start: int, end: int) -> DataFrame:
    """Spans inside the view, with their place by start in each example."""
    some = spans.where((F.col("start") > start) & (F.col("end") < end))
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("example_idx").orderBy("start", "end", "annotation_idx")))


def strongest_letter(attr: DataFrame) -> DataFrame:
    """(example_idx, pos, char_idx, total): the letter of greatest absolute value at each position, and the sum over letters."""
    return attr.groupBy("example_idx", "pos").agg(F.max_by("char_idx", F.struct(F.abs("value"), -F.col("char_idx"))).alias("char_idx"), F.sum("value").alias("total"))


def _stacker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, busy, free, used = None, [], [], 0
    for batch in batches:
        tracks = []
        for example, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if (example,) != now:
                now, busy, free, used = (example,), [], [], 0
            while busy and busy[0][0] <= start:
                heapq.heappush(free, heapq.heappop(busy)[1])
            if free:
                track = heapq.heappop(free)
            else:
                track, used = used, used + 1
            heapq.heappush(busy, (end, track))
            tracks.append(track)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tracks, pa.int32())], names=[*batch.schema.names, "track"])


def label_tracks(spans: DataFrame) -> DataFrame:
    """(example_idx, annotation_idx, start, end, track): the first track free at a span's start, spans taken by start, end and annotation.

    A task goes through its spans in order and holds those that overlap where
    it stands.  Spans without start or end are left out; null examples are one.
    """
    rows = spans.select("example_idx", "annotation_idx", "start", "end").where(F.col("start").isNotNull() & F.col("end").isNotNull())
    rows = rows.repartition("example_idx").sortWithinPartitions("example_idx", "start", "end", "annotation_idx")
    return rows.mapInArrow(_stacker, T.StructType([*rows.schema.fields, T.StructField("track", T.IntegerType())]))


def motif_heights(motifs: DataFrame, eps: float = 1e-7) -> DataFrame:
    """(motif_idx, pos, char_idx, height): each letter's share of its column's information, for a logo of (motif_idx, pos, probs)."""
    bits = F.aggregate("probs", F.lit(0.0), lambda a, p: a + p * F.log2(p + eps) + 0.5)
    return motifs.select("motif_idx", "pos", F.posexplode(F.transform("probs", lambda p: p * bits)).alias("char_idx", "height"))


def model_tracks(tracks: dict[str, DataFrame]) -> DataFrame:
    """Attribution rows of several models in one table, with the model's name."""
    out = None
    for name, df in tracks.items():
        rows = df.withColumn("model", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out
