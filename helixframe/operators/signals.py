"""Signals of piecewise-constant intervals along a genome: sums and profiles of windows.

A signal is (track, chrom, start, end, value), 0-based and half-open, as
bedGraph files have it; points are intervals of one position.  Where intervals
overlap, their values add up; null and NaN values count nothing.

Sums come from an index of prefix sums.  In a tile of fixed width the sum up to
position x is x * A - B, where A and B add up, over all ends of intervals that
lie before x, the change of the value there, and the change times its place.  So
a window's sum is the difference of two look-ups, however many intervals it
covers, and no task sees more than a tile of a track.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions of a tile of the index.
TILE = 65_536
#: Numbers of profiles that a task fills at once.
CELLS = 1 << 21


def as_intervals(signal: DataFrame) -> DataFrame:
    """(track, chrom, start, end, value) of a signal of intervals or of points (pos)."""
    if "pos" in signal.columns:
        signal = signal.select("track", "chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "value")
    return signal.select("track", "chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("value").cast("double").alias("value"))


def _pieces(signal: DataFrame, tile: int) -> DataFrame:
    """(track, chrom, tile, from, to, value): intervals cut at tiles, places counted from the tile's start."""
    some = as_intervals(signal).where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("start", F.greatest("start", F.lit(0).cast("long"))).where(F.col("start") < F.col("end"))
    cut = some.withColumn("tile", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("end") - 1) / tile))))
    low = F.col("tile") * tile
    return cut.select("track", "chrom", "tile", F.greatest(F.col("start") - low, F.lit(0)).alias("from"), F.least(F.col("end") - low, F.lit(tile)).alias("to"), "value")


def interval_sums(windows: DataFrame, signal: DataFrame, tracks: list[str], *, key: str = "locus_idx", absent: float = 0.0, tile: int = TILE) -> DataFrame:
    """(key, track, total): the sum over [win_start, win_end) of each window, for each of the tracks.

    windows: (key, chrom, win_start, win_end).  Positions without a value count
    0, also those beyond a chromosome.  absent: the total where a track has no
    interval at all on the window's chromosome.  Windows that are empty or run
    backwards have 0.  A null bound gives a null total.
    """
    some = windows.select(key, "chrom", F.greatest("win_start", F.lit(0)).cast("long").alias("__a"), F.greatest("win_start", "win_end", F.lit(0)).cast("long").alias("__b"), (F.col("win_start") + F.col("win_end")).isNull().alias("__open"))
    pieces = _pieces(signal.where(F.col("track").isin(*tracks)), tile)
    ends = pieces.select("track", "chrom", "tile", F.explode(F.array(F.struct(F.col("from").alias("at"), F.col("value").alias("by")), F.struct(F.col("to").alias("at"), (-F.col("value")).alias("by")))).alias("x"))
    changes = ends.groupBy("track", "chrom", "tile", F.col("x.at").alias("at")).agg(F.sum("x.by").alias("by"))
    # Places that are looked up, each once, however many windows begin or end there.
    places = some.select("chrom", F.explode(F.array("__a", "__b")).alias("pos")).where("pos is not null").distinct()
    asked = places.select(F.explode(F.array(*map(F.lit, tracks))).alias("track"), "chrom", "pos", F.floor(F.col("pos") / tile).alias("tile"), (F.col("pos") % tile).alias("at"))
    within = Window.partitionBy("track", "chrom", "tile").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    none = F.lit(0.0)
    both = changes.select("track", "chrom", "tile", "at", "by", (F.col("by") * F.col("at")).alias("moment"), F.lit(None).cast("long").alias("pos"))
    both = both.union(asked.select("track", "chrom", "tile", "at", none, none, "pos"))
    found = both.select("track", "chrom", "tile", "pos", (F.col("at") * F.sum("by").over(within) - F.sum("moment").over(within)).alias("inside")).where("pos is not null")
    # Sums of whole tiles before each one: a row a tile, of which a chromosome has few.
    sums = pieces.groupBy("track", "chrom", "tile").agg(F.sum(F.col("value") * (F.col("to") - F.col("from"))).alias("sum"))
    before = Window.partitionBy("track", "chrom").orderBy("tile").rangeBetween(Window.unboundedPreceding, -1)
    tiles = sums.union(asked.select("track", "chrom", "tile", none).distinct()).groupBy("track", "chrom", "tile").agg(F.sum("sum").alias("sum"))
    starts = tiles.select("track", "chrom", "tile", F.coalesce(F.sum("sum").over(before), none).alias("before"))
    looked = found.join(starts, ["track", "chrom", "tile"]).select("track", "chrom", "pos", (F.col("before") + F.col("inside")).alias("upto"))
    each = some.withColumn("track", F.explode(F.array(*map(F.lit, tracks))))
    low, high = (looked.select("track", "chrom", F.col("pos").alias(c), F.col("upto").alias(f"{c}_upto")) for c in ("__a", "__b"))
    total = each.join(low, ["track", "chrom", "__a"], "left").join(high, ["track", "chrom", "__b"], "left")
    value = F.when(~F.col("__open"), F.coalesce(F.col("__b_upto") - F.col("__a_upto"), none))
    if absent != 0.0:
        there = as_intervals(signal).select("track", "chrom").distinct().withColumn("__there", F.lit(True))
        total = total.join(there, ["track", "chrom"], "left")
        value = F.when(F.col("__there"), value).otherwise(F.lit(absent))
    return total.select(key, "track", value.alias("total"))


def _filler(tracks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            step = max(1, CELLS // max(1, tracks * int(widths.max(initial=1))))
            for at in range(0, batch.num_rows, step):
                rows, size = batch.slice(at, step), widths[at : at + step]
                pieces = rows.column(2)
                row = np.repeat(np.arange(len(rows)), pieces.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                flat = pieces.flatten()
                track, low, high, value = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("track", "from", "to", "value"))
                begin = np.r_[0, np.cumsum(np.repeat(size, tracks))]
                length = (high - low).astype(np.int64)
                first = begin[row * tracks + track] + low
                cell = np.repeat(first - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum()) if len(length) else np.zeros(0, np.int64)
                filled = np.bincount(cell, np.repeat(value, length), minlength=int(begin[-1]))
                inner = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(filled))
                outer = pa.ListArray.from_arrays(pa.array((np.arange(len(rows) + 1) * tracks).astype(np.int32)), inner)
                yield pa.RecordBatch.from_arrays([rows.column(0), outer], names=["key", "values"])

    return run


def profiles(windows: DataFrame, signal: DataFrame, tracks: list[str], *, key: str = "locus_idx", name: str = "signals", grain: int = 1024) -> DataFrame:
    """(key, name): for each window an array of the values at its positions for each of the tracks, 0 where there is none.

    windows: (key, chrom, win_start, win_end), each key once.  Windows meet
    intervals by an equi-join on stretches of grain positions; a window's
    intervals, as many as it has positions at most where they don't overlap, are
    filled into arrays in batches.  Empty windows have empty arrays.
    """
    some = windows.select(F.col(key).alias("key"), "chrom", F.col("win_start").alias("a"), F.greatest("win_start", "win_end").alias("b"))
    number = F.create_map(*[x for i, t in enumerate(tracks) for x in (F.lit(t), F.lit(i))])
    own = as_intervals(signal.where(F.col("track").isin(*tracks))).where(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("start") < F.col("end")))
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / grain), F.floor((F.col(b) - 1) / grain)))
    left = some.where("a < b").select("key", F.col("chrom").alias("on"), "a", "b", bins("a", "b").alias("bin"))
    right = own.select(F.element_at(number, F.col("track")).alias("track"), "chrom", "start", "end", "value", bins("start", "end").alias("stretch"))
    once = F.col("bin") == F.floor(F.greatest("a", "start") / grain)
    met = left.join(right, (F.col("on") == F.col("chrom")) & (F.col("bin") == F.col("stretch")) & (F.col("start") < F.col("b")) & (F.col("a") < F.col("end")) & once)
    piece = F.struct("track", (F.greatest("start", "a") - F.col("a")).cast("int").alias("from"), (F.least("end", "b") - F.col("a")).cast("int").alias("to"), "value")
    found = met.groupBy("key").agg(F.collect_list(piece).alias("pieces"))
    rows = some.join(found, "key", "left").select("key", (F.col("b") - F.col("a")).cast("int").alias("width"), F.coalesce("pieces", F.expr("cast(array() as array<struct<track:int,from:int,to:int,value:double>>)")).alias("pieces"))
    kind = some.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_filler(len(tracks)), f"key {kind}, values array<array<double>>").select(F.col("key").alias(key), F.col("values").alias(name))
