"""Genomic intervals: interleaving, filters, interval joins, extraction of sequences and signals.

Coordinates are 0-based and half-open.  Interval joins cut both sides into
bins of a fixed width and join on (chromosome, bin); a pair is emitted only in
the bin of the later start, so that it comes once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators import signals as signal
from helixframe.operators.order import checkpointed, numbered


def interleave(sources: list[DataFrame], chroms: list[str] | None = None, *, order: str = "row") -> DataFrame:
    """(locus_idx, source, chrom, start, end): the sources dealt out in turn; order is each source's own row order.

    Chromosomes are filtered before the turns are dealt.
    """
    out = []
    for i, df in enumerate(sources):
        some = df if chroms is None else df.where(F.col("chrom").isin(chroms))
        turns = numbered(some, order)
        out.append(turns.select((F.col("row_idx") * len(sources) + i).alias("locus_idx"), F.lit(i).alias("source"), "chrom", "start", "end"))
    return reduce(DataFrame.unionByName, out)


def recenter(df: DataFrame, summit: str | None = None) -> DataFrame:
    """start and end moved so that the summit (an offset from start) is the middle; the width stays, halved downwards on both sides.

    Raises for a negative summit or one beyond the end.
    """
    if summit is None:
        return df
    at = F.col("start") + F.col(summit)
    half = F.floor((F.col("end") - F.col("start")) / 2).cast("long")
    df = df.withColumn("__half", half)
    ok = (F.col(summit) >= 0) & (at <= F.col("end"))
    mid = F.when(ok, at).otherwise(F.raise_error(F.lit("summit outside the locus")).cast("long"))
    return df.withColumn("__mid", mid).withColumn("start", F.col("__mid") - F.col("__half")).withColumn("end", F.col("__mid") + F.col("__half")).drop("__mid", "__half")


def window(df: DataFrame, width: int) -> DataFrame:
    """Adds win_start and win_end: width positions around the middle of each locus, one more on the right if odd."""
    mid = F.col("start") + F.floor((F.col("end") - F.col("start")) / 2).cast("long")
    return df.withColumn("win_start", mid - width // 2).withColumn("win_end", mid + width // 2 + width % 2)


def inside(df: DataFrame, sizes: DataFrame, width: int, jitter: int = 0) -> DataFrame:
    """Loci whose window of that width, widened by jitter on both sides, lies in its chromosome; sizes: (chrom, size).

    A window that ends exactly at the end stays.  The extra position of an odd window isn't checked.
    """
    mid = F.col("start") + F.floor((F.col("end") - F.col("start")) / 2).cast("long")
    half = width // 2 + jitter
    return df.join(sizes, "chrom").where((mid - half >= 0) & (mid + half <= F.col("size"))).drop("size")


def exclude(df: DataFrame, zones: DataFrame, grain: int = 100) -> DataFrame:
    """Loci that share no stretch of grain positions with any zone; both ends' stretches count as covered."""
    bins = lambda d: F.explode(F.sequence(F.floor(d["start"] / grain), F.floor(d["end"] / grain)))
    covered = zones.select(F.col("chrom"), bins(zones).alias("bin")).distinct()
    keyed = df.select("chrom", "start", "end", bins(df).alias("bin"))
    bad = keyed.join(covered, ["chrom", "bin"], "left_semi").select("chrom", "start", "end").distinct()
    return df.join(bad, ["chrom", "start", "end"], "left_anti").select(*df.columns)


def interval_join(left: DataFrame, right: DataFrame, grain: int, how: str = "inner") -> DataFrame:
    """Pairs of overlapping intervals.  left: (chrom, start, end, ...); right: the same with chrom_r, start_r, end_r."""
    lb = left.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start") / grain), F.floor((F.col("end") - 1) / grain))))
    rb = right.withColumn("__bin_r", F.explode(F.sequence(F.floor(F.col("start_r") / grain), F.floor((F.col("end_r") - 1) / grain))))
    on = (F.col("chrom") == F.col("chrom_r")) & (F.col("__bin") == F.col("__bin_r"))
    meet = (F.col("start") < F.col("end_r")) & (F.col("start_r") < F.col("end"))
    once = F.col("__bin") == F.floor(F.greatest("start", "start_r") / grain)
    return lb.join(rb, on & meet & once, how).drop("__bin", "__bin_r")


def extract_sequences(df: DataFrame, tiles: DataFrame, tile: int, *, key: str = "locus_idx") -> DataFrame:
    """(key, chrom, win_start, win_end, seq) from genome tiles (chrom, tile_start, seq) of a fixed width: an equi-join on the tiles a window touches."""
    touched = F.explode(F.sequence(F.floor(F.col("win_start") / tile), F.floor((F.col("win_end") - 1) / tile)))
    some = df.select(key, "chrom", "win_start", "win_end", touched.alias("tile_idx"))
    some = some.select(key, "chrom", "win_start", "win_end", (F.col("tile_idx") * tile).cast("long").alias("tile_start"))
    parts = some.join(tiles, ["chrom", "tile_start"]).groupBy(key, "chrom", "win_start", "win_end")
    whole = parts.agg(F.array_sort(F.collect_list(F.struct("tile_start", "seq"))).alias("parts"))
    joined = F.array_join("parts.seq", "")
    at = (F.col("win_start") - F.get("parts", F.lit(0))["tile_start"] + 1).cast("int")
    return whole.select(key, "chrom", "win_start", "win_end", F.substring(joined, at, (F.col("win_end") - F.col("win_start")).cast("int")).alias("seq"))


def signal_sums(df: DataFrame, points: DataFrame, grain: int, *, key: str = "locus_idx") -> DataFrame:
    """(key, track, total): sum of the points over each window that has some; points: (track, chrom, pos, value), NaN and null count 0."""
    sig = points.select("track", F.col("chrom").alias("chrom_r"), F.col("pos").alias("start_r"), (F.col("pos") + 1).alias("end_r"), F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)).alias("value"))
    spans = df.select(key, "chrom", F.col("win_start").alias("start"), F.col("win_end").alias("end"))
    return interval_join(spans, sig, grain).groupBy(key, "track").agg(F.sum("value").alias("total"))


def count_filter(df: DataFrame, totals: DataFrame, track: str, low: float | None = None, high: float | None = None, *, key: str = "locus_idx") -> DataFrame:
    """Loci whose total of a track is between low and high; a locus without signal has 0."""
    one = totals.where(F.col("track") == track).select(key, "total")
    total = F.coalesce("total", F.lit(0.0))
    keep = F.lit(True)
    if low is not None:
        keep = keep & (total >= low)
    if high is not None:
        keep = keep & (total <= high)
    return df.join(one, key, "left").where(keep).select(*df.columns)


class Extracted(NamedTuple):
    """loci: key, chrom, win_start, win_end, seq and the signals asked for; mask: (key, kept) of all loci looked at."""

    loci: DataFrame
    mask: DataFrame


def passing(df: DataFrame, keep: Callable[[DataFrame], DataFrame], n: int, *, key: str = "locus_idx") -> tuple[DataFrame, object]:
    """The first n rows by key that keep (a filter of rows) lets through, and the key of the last one looked at.

    keep only sees ranges of the key, each as large as all before it together
    with n more, until n rows have passed.  Keys are whole numbers, each once.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    found, have, size = None, 0, max(1, n)
    while low is not None and low <= high and have < n:
        some = checkpointed(keep(df.where((F.col(key) >= low) & (F.col(key) < low + size))))
        found = some if found is None else found.union(some)
        have += some.count()
        low, size = low + size, 2 * size + n
    if found is None:
        return keep(df).limit(0), high
    first = found.orderBy(key).limit(n)
    return first, first.agg(F.max(key)).first()[0] if have >= n > 0 else high


def extract(
    df: DataFrame, tiles: DataFrame, sizes: DataFrame, *, tile: int, in_window: int = 2114, out_window: int = 1000, jitter: int = 0, zones: DataFrame | None = None,
    signals: DataFrame | None = None, tracks: list[str] | None = None, in_signals: DataFrame | None = None, in_tracks: list[str] | None = None,
    target: int = 0, min_counts: float | None = None, max_counts: float | None = None, n_loci: int | None = None, key: str = "locus_idx",
) -> Extracted:
    """Sequences and signals of loci (key, chrom, start, end) around their middles, and which of them passed.

    A locus passes if its window (the wider one of in_window and, with signals,
    out_window, plus jitter on both sides) lies in its chromosome and touches no
    stretch that a zone touches, and if the sum of the target track over
    out_window lies between min_counts and max_counts.  seq has in_window
    letters, signals an array of out_window values for each of tracks,
    in_signals one of in_window values for each of in_tracks, 0 where there is
    no value; all are wider by twice the jitter.  Signals are intervals or
    points, see signals.

    n_loci: only the first so many by key that pass; no more loci are looked at
    than that takes, but for the last range of keys, and the mask ends with the
    last one.  Loci without a chromosome, start or end don't pass.

    With zones or bounds on counts, the loci that passed are worked out at once
    and kept in the shared folder, as all that follows starts from them.
    """
    half = max(in_window // 2, out_window // 2 if signals is not None or in_signals is not None else 0)
    if (min_counts is not None or max_counts is not None) and not (signals is not None and tracks):
        raise ValueError("bounds on counts need signals and tracks")

    def keep(part: DataFrame) -> DataFrame:
        some = inside(part.select(key, "chrom", "start", "end"), sizes, 2 * half, jitter)
        if zones is not None:
            mid = F.col("start") + F.floor((F.col("end") - F.col("start")) / 2).cast("long")
            spans = some.select(key, "chrom", (mid - half - jitter).alias("start"), (mid + half + jitter).alias("end"))
            some = some.join(exclude(spans, zones).select(key), key, "left_semi")
        if min_counts is not None or max_counts is not None:
            some = checkpointed(some)  # sums look at the windows several times
            totals = signal.interval_sums(window(some, out_window + 2 * jitter), signals, [tracks[target]], key=key)
            some = count_filter(some, totals, tracks[target], min_counts, max_counts, key=key)
        return some

    if n_loci is None:
        kept, seen = keep(df), df
        if zones is not None or min_counts is not None or max_counts is not None:
            kept = checkpointed(kept)  # sequences, each kind of signal and the mask start from it
    else:
        kept, last = passing(df, keep, n_loci, key=key)
        seen = df.where(F.col(key) <= last) if last is not None else df
    wide = window(kept, in_window + 2 * jitter)
    out = extract_sequences(wide, tiles, tile, key=key)
    if signals is not None:
        out = out.join(signal.profiles(window(kept, out_window + 2 * jitter), signals, tracks, key=key), key)
    if in_signals is not None:
        out = out.join(signal.profiles(wide, in_signals, in_tracks, key=key, name="in_signals"), key)
    return Extracted(out, kept_mask(seen, kept, key=key))


def extract_loci(df: DataFrame, tiles: DataFrame, sizes: DataFrame, **options) -> DataFrame:
    """The loci of extract()."""
    return extract(df, tiles, sizes, **options).loci


def kept_mask(df: DataFrame, kept: DataFrame, *, key: str = "locus_idx") -> DataFrame:
    """(key, kept): whether each locus is among those that filters kept."""
    return df.select(key).join(kept.select(key).distinct().withColumn("kept", F.lit(True)), key, "left").select(key, F.coalesce("kept", F.lit(False)).alias("kept"))


def to_genome(spans: DataFrame, df: DataFrame, width: int, one_indexed: bool = False, *, key: str = "example_idx", locus: str = "locus_idx") -> DataFrame:
    """Spans of examples (key, start, end, ...) in coordinates of the genome: chrom, start and end replace the first three columns."""
    mids = window(df, width).select(F.col(locus).alias(key), "chrom", "win_start")
    rest = [c for c in spans.columns if c not in (key, "start", "end")]
    shift: Column = F.col("win_start") - (1 if one_indexed else 0)
    return spans.join(mids, key).select("chrom", (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"), *rest)


def extract_signal(spans: DataFrame, tracks: DataFrame, *, key: str = "example_idx") -> DataFrame:
    """(key, start, end, total): sum of an array column `values` of each example over [start, end)."""
    at = F.slice("values", F.col("start") + 1, F.col("end") - F.col("start"))
    return spans.join(tracks, key).select(key, "start", "end", F.aggregate(at, F.lit(0.0), lambda a, x: a + x).alias("total"))
