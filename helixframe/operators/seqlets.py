"""Calling spans of high attribution.

Tracks are (example_idx, values), values an array of doubles.  Null models
come from histograms over the whole table, which Spark counts and the driver
turns into tables of a fixed size; calling itself goes example by example in
numpy batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators import windows
from helixframe.operators.order import checkpointed

SEQLETS = "example_idx long, start int, end int, attribution double, p_value double"


def plain(tracks: DataFrame) -> DataFrame:
    """(example_idx, values) without null and empty tracks, null and NaN values as 0."""
    fine = F.transform("values", lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)))
    return tracks.where(F.size("values") > 0).select("example_idx", fine.alias("values"))


def value_histogram(tracks: DataFrame, bins: int) -> tuple[float, float, np.ndarray]:
    """Least value, bin width and the share of values in each bin, over the whole table."""
    values = tracks.select(F.explode("values").alias("v"))
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n:
        return 0.0, 1.0, np.zeros(bins)
    width = (high - low) / (bins - 1) or 1.0
    counts = values.groupBy(F.floor((F.col("v") - low) / width).cast("int").alias("bin")).count().collect()  # at most bins rows
    share = np.zeros(bins)
    for r in counts:
        share[min(r["bin"], bins - 1)] += r["count"] / n
    return low, width, share


def survival(share: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each length the probability that the sum of so many bins is greater than each value."""
    out, density = [np.ones(1)], np.ones(1)
    for _ in range(longest):
        density = np.convolve(density, share)
        tail = np.maximum(1 - np.cumsum(density), 0)
        tail[0] = 1.0
        out.append(tail)
    return out


def call_spans(values: np.ndarray, low: float, width: float, tails: list[np.ndarray], threshold: float, shortest: int, longest: int) -> list[tuple[int, int, float]]:
    """(start, length, p): longest spans first, that are significant together with every span nested in them, none overlapping a called one."""
    n = len(values)
    total = np.r_[0, np.cumsum(values)]
    p = {}
    fine = {shortest - 1: np.ones(n + 1, bool)}
    before = np.zeros(n + 1)
    for size in range(shortest, longest + 1):
        m = n - size + 1
        own = np.ones(n + 1)
        if m > 0:
            at = np.floor((total[size:] - total[:-size] - low * size) / width).astype(int)
            own[:m] = np.maximum(tails[size][np.clip(at, 0, len(tails[size]) - 1)], before[:m])
        if n >= shortest:
            own[n - shortest] = 1.0
        p[size] = before = own
        nested = np.zeros(n + 1, bool)
        nested[:-1] = fine[size - 1][1:]
        fine[size] = (own < threshold) & nested
    taken = np.zeros(n + longest + 1, bool)
    out = []
    for size in range(longest, shortest - 1, -1):
        good = np.flatnonzero(fine[size])
        for s in good[np.argsort(p[size][good], kind="stable")]:
            if not taken[s : s + size].any():
                out.append((int(s), size, float(p[size][s])))
                taken[s : min(s + size, n - 1)] = True
    return out


def recursive_seqlets(tracks: DataFrame, *, threshold: float = 0.01, shortest: int = 4, longest: int = 25, flanks: int = 0, bins: int = 1000) -> DataFrame:
    """(example_idx, start, end, attribution, p_value) of positive spans.  Two passes: the histogram of all values, then the calls.

    Null and empty tracks have no spans; a null value counts 0.
    """
    tracks = plain(tracks)
    low, width, share = value_histogram(tracks, bins)
    shared = tracks.sparkSession.sparkContext.broadcast(survival(share, longest))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tails = shared.value
        for batch in batches:
            rows = []
            for k, v in zip(batch["example_idx"], batch["values"], strict=True):
                v = np.asarray(v, float)
                total = np.r_[0, np.cumsum(v)]
                for s, size, p in call_spans(v, low, width, tails, threshold, shortest, longest):
                    end, start = min(s + size + flanks, len(v) - 1), max(s - flanks, 0)
                    rows.append((k, start, end, total[end] - total[start], p))
            yield pd.DataFrame(rows, columns=["example_idx", "start", "end", "attribution", "p_value"])

    return tracks.select("example_idx", "values").mapInPandas(run, SEQLETS)


def laplace_null(values: DataFrame, bins: int = 1000) -> tuple[float, float, float, float]:
    """Mode, rates above and below it, and the share of values from it on, of a two-sided exponential law over (v).

    The mode is the middle of the fullest bin of the values strictly inside the
    fullest bin; the rates are the steepest over 19 exact quantiles.
    """
    inside = values
    for _ in range(2):
        low, high = inside.agg(F.min("v"), F.max("v")).first()
        if low is None:
            break
        width = (high - low) / bins
        if not width:
            mode = low
            break
        at = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("int")
        top = inside.groupBy(at.alias("bin")).count().orderBy(F.desc("count"), "bin").first()  # at most bins rows
        edge = low + top["bin"] * width
        mode, inside = edge + width / 2, inside.where((F.col("v") > edge) & (F.col("v") < edge + width))
    q = [i * 0.05 for i in range(19)]
    up, down = values.where(F.col("v") >= mode), values.where(F.col("v") <= mode)
    above, below = windows.quantiles(up, "v", q).first(), windows.quantiles(down, "v", [1 - x for x in q]).first()
    rate = lambda qs: max((-np.log(1 - x) / abs(v - mode) for x, v in zip(q[1:], list(qs)[1:], strict=True) if v is not None and abs(v - mode) > 1e-12), default=1.0)
    return mode, rate(above), rate(below), up.count() / max(1, values.count())


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted least-squares fit that never falls, by pooling neighbours."""
    blocks: list[list[float]] = []
    for v, w in zip(y, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def null_groups(values: DataFrame, null: np.ndarray, sign: int) -> DataFrame:
    """(code, n, least, most): how many of sign * sums lie on each null value (odd codes) and in each gap between two (even ones).

    values: (sums), arrays; only numbers of that sign count, 0 with the
    positive ones.  null: sorted, without repeats.
    """
    shared = values.sparkSession.sparkContext.broadcast(null)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = sign * batch.column(0).flatten().to_numpy(zero_copy_only=False)
            v = np.sort(v[v >= 0] if sign > 0 else v[v > 0])
            left, right = (np.searchsorted(shared.value, v, side) for side in ("left", "right"))
            code, at, n = np.unique(2 * left + (right > left), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(v[at]), pa.array(v[at + n - 1])], names=["code", "n", "least", "most"])

    rows = values.select("sums").mapInArrow(run, "code long, n long, least double, most double")
    return rows.groupBy("code").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def fdr_threshold(values: DataFrame, drawn: np.ndarray, fdr: float, sign: int = 1, least_null: float = 0.95) -> float | None:
    """The least of sign * sums at which the share of real values reaches 1 - fdr by an isotonic fit of all values; None without values.

    values: (sums), arrays; drawn: numbers from the null law, few enough for
    the driver.  Between two of them all values are real, and pool into one
    block of the fit, so that the counts of null_groups give the same fit as
    the values themselves.
    """
    null, times = np.unique(sign * drawn, return_counts=True)
    groups = sorted(map(tuple, null_groups(values, null, sign).collect()))  # at most two rows a drawn number
    if not groups:
        return None
    total = sum(g[1] for g in groups)
    ratio = total / max(1, times.sum())
    real, weight = np.zeros(2 * len(null) + 1), np.zeros(2 * len(null) + 1)
    weight[1::2] = times * ratio
    for code, n, _, _ in groups:
        real[code] = n
        weight[code] += n
    some = weight > 0
    fit = np.zeros(len(weight))
    fit[some] = isotonic(real[some] / weight[some], weight[some])
    first = max(fit[some][0], 1e-7)
    share = -1 / (1 - 1 / min(first, 1 - 1e-12))
    share = min(max(share, least_null), 1.0)
    for code, _, least, _ in groups:
        if 1 + share * (1 - 1 / max(fit[code], 1e-7)) >= 1 - fdr:
            return float(least)
    return float(groups[-1][3])


def suppressed(candidates: DataFrame, radius: int, *, tile: int = 65_536) -> DataFrame:
    """Of candidates (example_idx, pos, strength, ...) those that a walk from the strongest on takes, each leaving out all others within radius of it.

    Equal ones go by position.  Tracks may be of any length: each tile of
    positions decides what doesn't hang on undecided candidates beyond its
    border, and the others wait for the next round.  Tracks within a tile take
    one round; the strongest undecided one is decided in any round.
    """
    rest = [c for c in candidates.columns if c not in ("example_idx", "pos", "strength")]
    state = candidates.withColumn("__taken", F.lit(False))
    kind = state.schema

    def run(table: pa.Table) -> pa.Table:
        own, pos, strength, taken = (table.column(c).to_numpy(zero_copy_only=False) for c in ("__own", "pos", "strength", "__taken"))
        order = np.argsort(pos, kind="stable")
        place = pos[order]
        gone, done = np.zeros(len(pos), bool), taken[order].copy()
        waits = np.zeros(len(pos), bool)

        def around(p: int) -> slice:
            return slice(np.searchsorted(place, p - radius, "left"), np.searchsorted(place, p + radius, "right"))

        for i in np.flatnonzero(done):
            near = around(place[i])
            gone[near] |= ~done[near]
        mine = own[order]
        for i in np.lexsort((place, -strength[order])):
            if gone[i] or done[i]:
                continue
            near = around(place[i])
            if not mine[i] or waits[near].any():
                waits[i] = True
                continue
            done[i] = True
            gone[near] |= ~done[near]
        keep = mine & ~gone
        out = table.take(pa.array(order[keep]))
        out = out.set_column(out.schema.get_field_index("__taken"), "__taken", pa.array(done[keep]))
        return out.select(kind.names)

    while True:
        home = F.floor(F.col("pos") / tile)
        # A candidate is also seen from the tiles that its surroundings reach into.
        seen = F.array_distinct(F.sequence(F.floor((F.col("pos") - radius) / tile), F.floor((F.col("pos") + radius) / tile)))
        dealt = state.withColumn("__tile", F.explode(seen)).withColumn("__own", F.col("__tile") == home)
        state = checkpointed(dealt.groupBy("example_idx", "__tile").applyInArrow(run, kind))
        if state.where("not __taken").isEmpty():
            return state.select("example_idx", "pos", "strength", *rest)


def window_sums(tracks: DataFrame, window: int) -> DataFrame:
    """(example_idx, sums): sums of window values from each position on, of tracks at least as long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [np.lib.stride_tricks.sliding_window_view(np.asarray(v), window).sum(1) for v in batch.column(1).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.list_(pa.float64()))], names=["example_idx", "sums"])

    rows = plain(tracks).where(F.size("values") >= window)
    return rows.mapInArrow(run, f"example_idx {rows.schema['example_idx'].dataType.simpleString()}, sums array<double>")


def tfmodisco_seqlets(tracks: DataFrame, *, window: int = 21, flank: int = 10, fdr: float = 0.2, least: float = 0.03, most: float = 0.2, samples: int = 10_000, seed: int = 1234) -> DataFrame:
    """(example_idx, start, end, attribution): windows whose sums stand out from a Laplace null, taken greedily from the strongest on.

    Thresholds are exact, for positive and negative sums apart; if fewer than
    least or more than most of all sums pass, that quantile of their sizes
    takes their place.  Null tracks, and those shorter than a window, have no
    seqlets; a null value counts 0.
    """
    kind = tracks.schema["example_idx"].dataType.simpleString()
    sums = checkpointed(window_sums(tracks, window))
    values = sums.select(F.explode("sums").alias("v"))
    n = values.count()
    if not n:
        return tracks.sparkSession.createDataFrame([], f"example_idx {kind}, start int, end int, attribution double")
    mode, up, down, share = laplace_null(values)
    u = np.random.RandomState(seed).uniform(size=(samples, 2))
    drawn = np.where(u[:, 0] < share, mode - np.log(1 - u[:, 1]) / up, mode + np.log(1 - u[:, 1]) / down)
    high, low = fdr_threshold(sums, drawn[drawn >= 0], fdr), fdr_threshold(sums, drawn[drawn < 0], fdr, -1)
    passes = lambda: ((F.col("v") >= high) if high is not None else F.lit(False)) | ((F.col("v") <= -low) if low is not None else F.lit(False))
    passing = values.where(passes()).count() / n
    if not least <= passing <= most:
        high = low = windows.quantiles(values.select(F.abs("v").alias("v")), "v", [1 - (least if passing < least else most)]).first()[0]
    one = sums.select("example_idx", F.size("sums").alias("d"), F.posexplode("sums").alias("pos", "v"))
    inside = (F.col("pos") >= flank) & (F.col("pos") < F.col("d") - flank)
    found = one.where(passes() & inside).select("example_idx", F.col("pos").cast("long").alias("pos"), F.abs("v").alias("strength"), F.col("v").alias("attribution"))
    taken = suppressed(found, window // 2 + flank)
    return taken.select("example_idx", (F.col("pos") - flank).cast("int").alias("start"), (F.col("pos") + window + flank).cast("int").alias("end"), "attribution")


def pwm_scan(df: DataFrame, probs: list[list[float]], *, background: float = 0.25, eps: float = 1e-4) -> DataFrame:
    """(example_idx, start, score): log-odds of a motif (a list of four probabilities for each position) at every place; unknown letters count 0."""
    places = df.where(F.length("seq") >= len(probs)).withColumn("start", F.explode(F.sequence(F.lit(0), F.length("seq") - len(probs))))
    score = F.lit(0.0)
    for i, column in enumerate(probs):
        at = F.instr(F.lit("ACGT"), F.substring("seq", F.col("start") + i + 1, F.lit(1)))
        score = score + F.when(at > 0, F.get(F.array(*[F.lit(float(np.log2((p + eps) / background))) for p in column]), at - 1)).otherwise(F.lit(0.0))
    return places.select("example_idx", "start", score.alias("score"))
