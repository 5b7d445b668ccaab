"""Background regions matched to loci by GC content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.functions import scalar
from helixframe.operators import signals, windows
from helixframe.operators.order import checkpointed, running_totals

#: Digits of the hash by which the border of a bin's share is found.
CELL = 3


def gc_bin(gc: Column, width: float) -> Column:
    """The bin whose middle is nearest to a share: floor division of share and half a bin, as floating-point numbers do it."""
    x = gc + F.lit(width / 2)
    return F.round((x - x % F.lit(width)) / F.lit(width)).cast("int")


def chromosome_tiles(sizes: DataFrame, width: int) -> DataFrame:
    """(chrom, start, end): adjacent tiles; what is left at the end is dropped."""
    some = sizes.where(F.col("size") >= width)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("size") - width).cast("long"), F.lit(width).cast("long")))
    return some.select("chrom", starts.alias("start")).withColumn("end", F.col("start") + width)


def gc_profile(df: DataFrame, max_n: float = 0.1, width: float = 0.02, *, strict: bool = False) -> DataFrame:
    """Rows with seq whose share of N is at most (or, strictly, less than) max_n, with gc and gc_bin; GC counts against all letters."""
    n = scalar.char_share(F.col("seq"), "N")
    some = df.where(n < max_n if strict else n <= max_n)
    return some.withColumn("gc", scalar.char_share(F.col("seq"), "GC")).withColumn("gc_bin", gc_bin(F.col("gc"), width))


def quotas(wanted: dict[int, int], have: dict[int, int], bins: int) -> dict[int, int]:
    """How many background rows to take from each bin: as many as wanted or there are; what is missing comes from the nearest bins, higher first, bins from the highest down."""
    take = {b: min(wanted.get(b, 0), have.get(b, 0)) for b in range(bins)}
    left = {b: have.get(b, 0) - take[b] for b in range(bins)}
    for b in range(bins - 1, -1, -1):
        need = wanted.get(b, 0) - take[b]
        for offset in range(1, bins):
            for other in (b + offset, b - offset):
                if need > 0 and 0 <= other < bins and left[other] > 0:
                    n = min(need, left[other])
                    take[other] += n
                    left[other] -= n
                    need -= n
    return take


def matching_loci(
    targets: DataFrame, tiles: DataFrame, *, width: float = 0.02, max_n: float = 0.1, seed: int = 0, signal: DataFrame | None = None, signal_share: float = 0.01, signal_beta: float = 0.5,
    out_window: int | None = None, chroms: list[str] | None = None,
) -> DataFrame:
    """(chrom, start, end, gc_bin): tiles with the targets' GC histogram, none of which a target touches.

    targets and tiles: (chrom, start, end, seq), the tiles all of one width and
    laid out from 0.  A target touches the tiles from that of its start to that
    of its end, the latter position included.  chroms: the chromosomes to use,
    of targets and tiles; else those of the targets.

    With a signal (intervals or points, all tracks count), tiles are left out
    whose middle out_window positions (else all) hold more than signal_limit of
    the targets; so are tiles of chromosomes without any signal.

    The driver sees a count for each bin; rows of a bin are taken by a hash of
    seed and place.  Without targets or tiles there are no rows.
    """
    bins = int(1 / width) + 1
    if chroms is not None:
        targets, tiles = (d.where(F.col("chrom").isin(*chroms)) for d in (targets, tiles))
    else:
        tiles = tiles.join(targets.select("chrom").distinct(), "chrom", "left_semi")
    some = tiles.select((F.col("end") - F.col("start")).cast("long").alias("w")).first()
    tile = some["w"] if some is not None else 1
    wanted = gc_profile(targets, max_n, width, strict=True).groupBy("gc_bin").count()
    touched = targets.select("chrom", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor(F.col("end") / tile))).alias("i")).distinct()
    touched = touched.select("chrom", (F.col("i") * tile).cast("long").alias("start"))
    free = gc_profile(tiles, max_n, width).join(touched, ["chrom", "start"], "left_anti")
    if signal is not None:
        limit = signal_limit(targets, signal, share=signal_share, beta=signal_beta, out_window=out_window)
        quiet = region_signal(free.select("chrom", "start", "end"), signal, out_window=out_window).where(~F.isnan("total") & (F.col("total") <= limit)).select("chrom", "start", "end")
        free = free.join(quiet, ["chrom", "start", "end"], "left_semi")
    free = checkpointed(free.select("chrom", "start", "end", "gc_bin"))
    have = free.groupBy("gc_bin").count()
    count = lambda d: {r["gc_bin"]: r["count"] for r in d.collect()}  # noqa: E731  at most a row for each bin
    take = quotas(count(wanted), count(have), bins)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "chrom", F.col("start").cast("string")))
    keyed = free.select("chrom", "start", "end", "gc_bin", key.alias("key")).withColumn("cell", F.substring("key", 1, CELL))
    # Counts by the key's first digits tell up to where a bin's rows are all taken: only those at the border are ranked.
    cells: dict[int, list[tuple[str, int]]] = {}
    for r in keyed.groupBy("gc_bin", "cell").count().orderBy("cell").collect():  # at most 16 ** CELL for each bin
        cells.setdefault(r["gc_bin"], []).append((r["cell"], r["count"]))
    border = []
    for b, counts in cells.items():
        left = take.get(b, 0)
        for cell, n in counts:
            if left <= n:
                border.append((b, cell, left))
                break
            left -= n
    edges = F.broadcast(df_of(free, border, "gc_bin int, edge string, quota int"))
    near = keyed.join(edges, "gc_bin").where(F.col("cell") <= F.col("edge"))
    whole = near.where(F.col("cell") < F.col("edge"))
    ranked = near.where(F.col("cell") == F.col("edge")).withColumn("rn", F.row_number().over(Window.partitionBy("gc_bin").orderBy("key", "chrom", "start")))
    columns = ["chrom", "start", "end", "gc_bin"]
    return whole.select(*columns).union(ranked.where(F.col("rn") <= F.col("quota")).select(*columns))


def df_of(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def signal_limit(targets: DataFrame, signal: DataFrame, *, share: float = 0.01, beta: float = 0.5, out_window: int | None = None) -> float:
    """beta times the quantile (share) of the targets' summed signal: what a background region may have at most.

    targets: (chrom, start, end), each counted as often as it is there; those
    of chromosomes without any signal don't count.  Without others the limit is 0.
    """
    sums = region_signal(targets, signal, out_window=out_window)
    totals = targets.select("chrom", "start", "end").join(sums, ["chrom", "start", "end"])
    at = windows.quantiles(totals, "total", [share]).first()[0]
    return beta * float(at or 0.0)


def region_signal(regions: DataFrame, signal: DataFrame, *, out_window: int | None = None) -> DataFrame:
    """(chrom, start, end, total): the signal in each different region, or in its middle out_window positions; NaN where the chromosome has none at all.

    signal: intervals or points, of which all tracks count.
    """
    keyed = regions.select("chrom", "start", "end").distinct().withColumn("locus_idx", F.struct("chrom", "start", "end"))
    if out_window is None:
        windows_ = keyed.select("locus_idx", "chrom", F.col("start").alias("win_start"), F.col("end").alias("win_end"))
    else:
        left = F.floor((F.col("end") - F.col("start") - out_window) / 2)
        windows_ = keyed.select("locus_idx", "chrom", (F.col("start") + left).alias("win_start"), (F.col("start") + left + out_window).alias("win_end"))
    sums = signals.interval_sums(windows_, signals.as_intervals(signal).withColumn("track", F.lit("all")), ["all"], absent=float("nan"))
    return sums.select("locus_idx.*", "total")


def ks_statistic(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row: the largest gap between the empirical distributions of a value in two tables; null values are left out, of an empty table the gap is null."""
    rows = a.select(F.col(value).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(value, F.lit(0), F.lit(1))).where("v is not null")
    sums = checkpointed(rows.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    n = sums.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    gap = F.abs(F.col("total_a") / F.lit(float(n["a"] or 0)) - F.col("total_b") / F.lit(float(n["b"] or 0)))
    if not n["a"] or not n["b"]:
        gap = F.lit(None).cast("double")
    return running_totals(sums, "v", "a", "b").agg(F.max(gap).alias("ks"))
