"""Signals, extraction, matching and order statistics against plain Python."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import loci, match, order, signals, windows

SIGNAL = "track string, chrom string, start long, end long, value double, key int, name string"
CHROMS = {"chr1": 230, "chr2": 97, "chr3": 40}


def intervals(seed=1, n=60):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        chrom = r.choice(["chr1", "chr2"])
        a = r.randrange(-3, CHROMS[chrom] - 1)
        rows.append((r.choice("xy"), chrom, a, a + r.choice([0, 1, 3, 50, 120]), r.choice([1.0, -2.5, 7.0, math.nan, None]), 1, "n"))
    return [*rows, ("x", "chr1", 0, 230, 0.5, 1, "n"), ("x", "chr1", 9, 4, 100.0, 1, "n"), ("z", "chr1", 0, 230, 1000.0, 1, "n")]


def value_at(rows, track, chrom, p):
    return sum(v for t, c, a, b, v, *_ in rows if t == track and c == chrom and max(a, 0) <= p < b and v is not None and not math.isnan(v))


def genome(r):
    return {c: "".join(r.choice("ACGTN") for _ in range(n)) for c, n in CHROMS.items()}


@pytest.mark.parametrize("tile", [7, 64, 65_536])
def test_sums_and_profiles(spark, tile):
    rows, r = intervals(), random.Random(2)
    some = [(i, r.choice(["chr1", "chr2", "chr3"]), (a := r.randrange(-20, 220)), a + r.choice([-4, 0, 1, 5, 90])) for i in range(80)]
    some += [(100, "chr1", None, 5), (101, None, 3, 9), (102, "chr1", 0, 230), (103, "chr1", 0, 230)]
    df = spark.createDataFrame(some, "locus_idx int, chrom string, win_start long, win_end long")
    signal = spark.createDataFrame(rows, SIGNAL).repartition(3)
    want = {(i, t): None if a is None else sum(value_at(rows, t, c, p) for p in range(a, b)) for i, c, a, b in some for t in "xy"}
    got = {(x["locus_idx"], x["track"]): x["total"] for x in signals.interval_sums(df, signal, ["x", "y"], tile=tile).collect()}
    assert got.keys() == want.keys() and all(got[k] is None if want[k] is None else abs(got[k] - want[k]) < 1e-9 for k in want)
    far = {x["locus_idx"]: x["total"] for x in signals.interval_sums(df, signal, ["x"], tile=tile, absent=float("nan")).collect()}
    assert all(math.isnan(far[i]) == (c not in ("chr1", "chr2")) for i, c, a, b in some if a is not None)
    lists = {x["locus_idx"]: x["signals"] for x in signals.profiles(df.where("win_start is not null"), signal, ["y", "x"], grain=tile).collect()}
    for i, c, a, b in some:
        if a is not None:
            assert len(lists[i]) == 2 and np.allclose(lists[i], [[value_at(rows, t, c, p) for p in range(a, b)] for t in "yx"])
    none = spark.createDataFrame([], SIGNAL)
    assert {x["total"] for x in signals.interval_sums(df.where("win_start is not null"), none, ["x"]).collect()} == {0.0}
    assert signals.interval_sums(df.limit(0), signal, ["x"]).isEmpty() and signals.profiles(df.limit(0), signal, ["x"]).isEmpty()


@pytest.mark.parametrize("jitter", [0, 3])
@pytest.mark.parametrize("sizes", [(10, 14), (21, 9)])
def test_extract(spark, jitter, sizes):
    r = random.Random(5)
    g, rows = genome(r), intervals(3)
    own = [(i, r.choice(list(CHROMS)), (a := r.randrange(0, 220)), a + r.randrange(1, 30)) for i in range(150)]
    zones = [("chr1", 120, 130), ("chr2", 0, 3)]
    in_window, out_window = sizes
    half = max(in_window // 2, out_window // 2)
    kept = {}
    for i, c, a, b in own:
        mid = a + (b - a) // 2
        lo, hi = mid - half - jitter, mid + half + jitter
        if lo < 0 or hi > CHROMS[c] or any(z == c and zb // 100 >= lo // 100 and za // 100 <= hi // 100 for z, za, zb in zones):
            continue
        out = [(mid - out_window // 2 - jitter, mid + out_window // 2 + jitter + out_window % 2) for _ in "xy"]
        signal = [[value_at(rows, t, c, p) for p in range(*o)] for t, o in zip("xy", out, strict=True)]
        if not 1 <= sum(signal[1]) <= 60:
            continue
        s, e = mid - in_window // 2 - jitter, mid + in_window // 2 + jitter + in_window % 2
        kept[i] = (g[c][s:e], signal, [[value_at(rows, "x", c, p) for p in range(s, e)]])
    tiles = spark.createDataFrame([(c, s, g[c][s : s + 32]) for c in g for s in range(0, len(g[c]), 32)], "chrom string, tile_start long, seq string")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    signal = frame(rows, SIGNAL)
    df = frame([*own, (500, None, 1, 2), (501, "chr1", None, 2)], "locus_idx int, chrom string, start long, end long")
    lengths = frame(list(CHROMS.items()), "chrom string, size long")
    call = lambda **more: loci.extract(
        df, tiles, lengths, tile=32, in_window=in_window, out_window=out_window, jitter=jitter, zones=frame(zones, "chrom string, start long, end long"),
        signals=signal, tracks=["x", "y"], in_signals=signal, in_tracks=["x"], target=1, min_counts=1, max_counts=60, **more,
    )
    got = call()
    assert len(kept) > 5
    found = {x["locus_idx"]: (x["seq"], x["signals"], x["in_signals"]) for x in got.loci.collect()}
    assert found.keys() == kept.keys()
    assert all(found[i][0] == kept[i][0] and np.allclose(found[i][1], kept[i][1]) and np.allclose(found[i][2], kept[i][2]) for i in kept)
    assert {x["locus_idx"]: x["kept"] for x in got.mask.collect()} == {x[0]: x[0] in kept for x in [*own, (500,), (501,)]}
    first = sorted(kept)[:4]
    some = call(n_loci=4)
    assert sorted(x["locus_idx"] for x in some.loci.collect()) == first
    assert {x["locus_idx"]: x["kept"] for x in some.mask.collect()} == {i: i in kept for i in range(first[-1] + 1)}
    assert call(n_loci=10_000).mask.count() == 152 and call(n_loci=0).loci.isEmpty()


def test_first_loci_look_at_few(spark):
    """Filters see the ranges of loci that are needed, and no others."""
    seen = []

    def keep(part):
        seen.append(part.count())
        return part.where("locus_idx % 10 = 3")

    df = spark.range(100_000).withColumnRenamed("id", "locus_idx")
    first, last = loci.passing(df, keep, 20)
    assert [x[0] for x in first.orderBy("locus_idx").collect()] == list(range(3, 200, 10)) and last == 193
    assert sum(seen) < 500
    first, last = loci.passing(df, lambda d: d.where("locus_idx = 70000"), 3)
    assert first.count() == 1 and last == 99_999


def test_bounds_need_signals(spark):
    df = spark.createDataFrame([], "locus_idx int, chrom string, start long, end long")
    with pytest.raises(ValueError, match="need signals"):
        loci.extract(df, df, df, tile=32, min_counts=1)


def test_matching_by_middle_and_chromosome(spark):
    r = random.Random(8)
    rows = [(c, 20 * i, 20 * i + 20, "".join(r.choice("ACGT") for _ in range(20))) for c in ("chr1", "chr2", "chr3") for i in range(200)]
    tiles = spark.createDataFrame(rows, "chrom string, start long, end long, seq string")
    targets = tiles.where("chrom <> 'chr3' and start % 400 = 20")
    got = match.matching_loci(targets, tiles, width=0.1)
    assert {x["chrom"] for x in got.collect()} <= {"chr1", "chr2"} and got.count() == 20
    assert not {(x["chrom"], x["start"]) for x in got.collect()} & {(c, 400 * i + s) for c in ("chr1", "chr2") for i in range(10) for s in (20, 40)}
    assert {x["chrom"] for x in match.matching_loci(targets, tiles, width=0.1, chroms=["chr2"]).collect()} == {"chr2"}
    # chr2 has no signal at all; on chr1 only the flanks of odd tiles, and the middles of every fifth one, have some.
    loud = [("t", "chr1", 20 * i + 1, 20 * i + 3, 50.0) for i in range(1, 200, 2)] + [("u", "chr1", 20 * i + 8, 20 * i + 12, 5.0) for i in range(0, 200, 5)] + [("t", "chr1", 400 * i + 29, 400 * i + 31, 1.0) for i in range(10)]
    signal = spark.createDataFrame(loud, "track string, chrom string, start long, end long, value double")
    quiet = match.matching_loci(targets, tiles, width=0.1, signal=signal, out_window=10).collect()
    assert quiet and all(x["chrom"] == "chr1" and x["start"] // 20 % 5 for x in quiet) and any(x["start"] // 20 % 2 for x in quiet)
    assert all(x["start"] // 20 % 2 == 0 for x in match.matching_loci(targets, tiles, width=0.1, signal=signal, signal_beta=0.1).collect())
    assert match.matching_loci(targets.limit(0), tiles).isEmpty() and match.matching_loci(targets, tiles.limit(0)).isEmpty()


def test_gc_bins_round_to_the_middle(spark):
    seqs = spark.createDataFrame([("GC" * i + "AT" * (50 - i),) for i in range(51)], "seq string")
    got = sorted(x["gc_bin"] for x in match.gc_profile(seqs).collect())
    assert got == sorted(int((np.float64(i / 50) + 0.01) // 0.02) for i in range(51))


@pytest.mark.parametrize("cells", [3, 4096])
def test_quantiles_by_key(spark, monkeypatch, cells):
    monkeypatch.setattr(windows, "CELLS", cells)
    r = np.random.RandomState(4)
    groups = {"a": r.randn(301), "b": np.r_[np.zeros(500), r.randn(3)], "c": [5.0], None: np.r_[r.randn(20) * 1e300, r.randn(20) * 1e-300, [1e-320, 2e-320]], "d": np.r_[[-np.inf] * 3, r.randn(5), [np.inf] * 4], "e": r.randint(0, 9, 100).astype(float)}
    rows = [(k, float(v), 1) for k, vs in groups.items() for v in vs] + [("f", None, 1), ("f", math.nan, 1), ("a", math.nan, 1)]
    df = spark.createDataFrame(rows, "k string, v double, spot int").repartition(5)
    at = [0.0, 0.013, 0.5, 0.9, 1.0]
    got = {x["k"]: list(x)[1:] for x in windows.quantiles(df, "v", at, ["k"]).collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        v = np.sort(v)
        for q, x in zip(at, got[k], strict=True):
            spot = q * (len(v) - 1)
            lo, hi = v[int(spot)], v[min(int(spot) + 1, len(v) - 1)]
            want = lo if spot == int(spot) or lo == hi else lo + (hi - lo) * (spot - int(spot))
            assert x == want or abs(x - want) <= 1e-12 * abs(want)
    whole = windows.quantiles(df.where("k <> 'd'"), "v", [0.25]).first()[0]
    assert abs(whole - np.quantile(np.concatenate([groups[k] for k in "abce"]), 0.25)) < 1e-12


def test_ties_are_parted(spark):
    """Of 99 % equal values no partition is over twice the mean."""
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    try:
        ties_are_parted(spark)
    finally:
        spark.conf.unset(merge)


def ties_are_parted(spark):
    df = spark.range(100_000).select(F.when(F.col("id") % 100 == 0, F.col("id").cast("double")).otherwise(0.0).alias("v")).repartition(6)
    for out in (order.numbered(df, "v"), order.running_totals(df.withColumn("w", F.lit(1.0)), "v", "w")):
        sizes = [x["count"] for x in out.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) <= 2 * 100_000 / 4
    rows = order.numbered(df, "v").collect()
    assert sorted(x["row_idx"] for x in rows) == list(range(100_000))
    assert [x["v"] for x in sorted(rows, key=lambda x: x["row_idx"])] == sorted(x["v"] for x in rows)
    assert collections.Counter(x["v"] for x in rows)[0.0] == 99_001
