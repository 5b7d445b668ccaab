"""Exact thresholds, suppression over tiles, shuffles in step, and degenerate sequences in every operator that takes some."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import annotate, attribution, design, edits, encode, models, perturb, seqlets
from helixframe.functions import scalar

TRACKS = "example_idx long, values array<double>"


def plain_fit(real, null):
    """Value -> fit of the isotonic regression over all values, ties averaged."""
    ratio = len(real) / max(1, len(null))
    x = np.unique(np.r_[real, null])
    ones, zeros = (np.array([(v == y).sum() for y in x], float) for v in (real, null))
    weight = ones + zeros * ratio
    return dict(zip(x, seqlets.isotonic(ones / weight, weight), strict=True))


@pytest.mark.parametrize("sign", [1, -1])
@pytest.mark.parametrize("fdr", [0.01, 0.2, 0.5, 0.99])
def test_thresholds_are_exact(spark, sign, fdr):
    for seed in range(3):
        r = np.random.RandomState(seed)
        sums = np.round(r.laplace(scale=2, size=(30, 20)) + (r.rand(30, 20) < 0.1) * 6 * sign, 1)
        drawn = np.round(r.laplace(size=300), 1)
        drawn = sign * drawn[sign * drawn >= 0]
        real = sign * sums.ravel()
        real = real[real >= 0] if sign > 0 else real[real > 0]
        fit = plain_fit(real, sign * drawn * 1.0)
        first = max(fit[min(fit)], 1e-7)
        share = min(max(-1 / (1 - 1 / min(first, 1 - 1e-12)), 0.95), 1.0)
        good = [v for v in sorted(real) if 1 + share * (1 - 1 / max(fit[v], 1e-7)) >= 1 - fdr]
        df = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sums)], "example_idx long, sums array<double>").repartition(3)
        got = seqlets.fdr_threshold(df, sign * drawn * sign, fdr, sign)
        assert got == (good[0] if good else max(real))
    assert seqlets.fdr_threshold(df.limit(0), drawn, fdr) is None


@pytest.mark.parametrize("tile", [10, 37, 65_536])
def test_suppression_is_the_walk(spark, tile):
    r = random.Random(tile)
    rows = [(e, p, float(r.randrange(6)) if e % 2 else p * 1.0, "x") for e in range(4) for p in r.sample(range(400), 150)]
    want = set()
    for e in range(4):
        own, taken = sorted((-s, p) for f, p, s, _ in rows if f == e), []
        for _, p in own:
            if all(abs(p - q) > 7 for q in taken):
                taken.append(p)
        want |= {(e, p) for p in taken}
    df = spark.createDataFrame(rows, "example_idx long, pos long, strength double, name string").repartition(3)
    got = seqlets.suppressed(df, 7, tile=tile)
    assert got.columns == df.columns and {(x["example_idx"], x["pos"]) for x in got.collect()} == want
    assert seqlets.suppressed(df.limit(0), 7).isEmpty()


def test_seqlets_by_walk(spark):
    """All seqlets of a table by a plain walk with the same thresholds."""
    r = np.random.RandomState(5)
    tracks = r.laplace(size=(12, 150)) * (1 + 4 * (r.rand(12, 150) < 0.03))
    df = spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(tracks)], TRACKS)
    got = sorted((x["example_idx"], x["start"], x["end"]) for x in seqlets.tfmodisco_seqlets(df, window=9, flank=2).collect())
    sums = np.array([[t[i : i + 9].sum() for i in range(142)] for t in tracks])
    starts = {(e, s + 2) for e, s, _ in got}
    low = min(abs(sums[e, s]) for e, s in starts)
    assert all(e - s == 13 for _, s, e in got) and {2 <= s < 140 for _, s in starts} == {True}
    for e in range(12):
        own = sorted(s for f, s in starts if f == e)
        assert all(b - a > 6 for a, b in zip(own, own[1:]))
    again = seqlets.tfmodisco_seqlets(df.repartition(5), window=9, flank=2)
    assert sorted((x["example_idx"], x["start"], x["end"]) for x in again.collect()) == got and low > 0


@pytest.mark.parametrize("n", [1, 4])
def test_shuffles_in_step(n):
    r = np.random.RandomState(2)
    parts = [r.randint(0, 5, size).astype(np.int8) for size in (0, 1, 2, 3, 40, 40, 7, 200, 1)] + [np.zeros(30, np.int8)]
    got = edits.eulerian_batch(parts, n, list(range(len(parts))))
    for i, (part, walks) in enumerate(zip(parts, got, strict=True)):
        assert [w.tolist() for w in walks] == [w.tolist() for w in edits.eulerian(part, n, i)]


ODD = [(0, None), (1, ""), (2, "A"), (3, "N"), (4, "ACGTACGTAA"), (4, "GGGTTTACGA"), (None, "ACGTTGCAAC")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "example_idx long, seq string")


def count(df):
    return len(df.collect())


def test_shuffles_of_little(odd):
    got = edits.dinucleotide_shuffle(odd, n=3)
    assert got.columns == ["example_idx", "shuffle_idx", "seq"] and count(got) == 21
    by = {}
    for x in got.collect():
        by.setdefault((x["example_idx"], len(x["seq"] or "")), []).append(x["seq"])
    assert by[0, 0] == [None] * 3 and by[1, 0] == [""] * 3 and by[2, 1] == ["A"] * 3 and by[3, 1] == ["N"] * 3
    assert count(edits.dinucleotide_shuffle(odd.limit(0))) == 0


def test_maps_of_little(spark, odd):
    rows = attribution.saturation_mutagenesis(odd, models.COUNTER)
    assert count(rows) == 4 * (1 + 1 + 30)
    assert count(attribution.saturation_mutagenesis(odd, models.COUNTER, start=4, end=4)) == 0
    assert count(attribution.saturation_mutagenesis(odd, models.COUNTER, start=6, end=4)) == 0
    assert count(attribution.saturation_mutagenesis(odd, models.COUNTER, start=9, end=99)) == 3 * 4
    assert count(attribution.mutagenesis_attribution(rows)) > 0
    refs = odd.select("example_idx", F.lit(0).alias("shuffle_idx"), "seq")
    assert {x["example_idx"] for x in attribution.linear_deep_lift(odd, refs, models.toy_weight).collect()} == {2, 3, 4, None}
    assert all(x["pos"] >= 0 for x in attribution.linear_deep_lift(odd, refs, models.toy_weight).collect())


def test_rows_that_share_keys_have_their_own_maps(spark):
    """Also with key columns called as what the operator needs."""
    graph = attribution.Graph([attribution.flatten(), attribution.dense(np.arange(40).reshape(1, -1).astype(float))])
    rows = [(1, "ACGTACGTAA", 1, 1, 1), (1, "GGGTTTACGA", 1, 1, 1), (2, "", 1, 1, 1), (3, None, 1, 1, 1)]
    df = spark.createDataFrame(rows, "example_idx long, seq string, row_key int, own int, ref int")
    got = attribution.deep_lift_shap(df, graph, n_shuffles=2)
    assert got.columns[:4] == ["example_idx", "row_key", "own", "ref"]
    maps = [x["attribution"] for x in got.collect()]
    assert len(maps) == 2 and maps[0] != maps[1]
    alone = [attribution.deep_lift_shap(df.where(F.col("seq") == s), graph, n_shuffles=2).first()["attribution"] for s in ("ACGTACGTAA", "GGGTTTACGA")]
    assert sorted(map(tuple, maps)) == sorted(map(tuple, alone))


def test_tracks_of_little(spark):
    df = spark.createDataFrame([(0, None), (1, []), (2, [1.0]), (3, [0.0] * 30), (4, [float("nan"), None] + [5.0] * 6 + [0.1] * 60)], TRACKS)
    assert {x["example_idx"] for x in seqlets.recursive_seqlets(df, threshold=0.2).collect()} <= {3, 4}
    assert {x["example_idx"] for x in seqlets.tfmodisco_seqlets(df, window=4, flank=1).collect()} <= {3, 4}
    for none in (df.limit(0), df.where("example_idx < 2"), df.where("example_idx = 2")):
        assert count(seqlets.tfmodisco_seqlets(none)) == 0
        assert count(seqlets.recursive_seqlets(none)) == 0


def test_designs_of_little(spark, odd):
    keys = odd.select("example_idx")
    assert {x["seq"] for x in design.random_sequences(keys, 0).collect()} == {""} == {x["seq"] for x in design.random_sequences(keys, -3).collect()}
    assert {len(x["seq"]) for x in design.random_sequences(keys, 1).collect()} == {1}
    assert {x["example_idx"] for x in design.candidates(odd, ["ACG", "NAN"]).collect()} == {4, None}
    assert count(design.candidates(odd, None)) == 4 * 32
    best = {(x["example_idx"], x["seq"]) for x in design.greedy_round(odd.where("example_idx < 4"), models.COUNTER, design.highest(), ["ACG"]).collect()}
    assert {(1, ""), (2, "A"), (3, "N")} <= best


def test_motifs_with_and_without_gaps(spark):
    one = spark.createDataFrame([(0, "TTTTTT")], "example_idx int, seq string")
    got = {(x["motif_idx"], x["pos"]): x["new_seq"] for x in design.candidates(one, ["ANC", "GG"], reverse_complement=False).collect()}
    assert got[0, 1] == "TATCTT" and got[1, 4] == "TTTTGG" and len(got) == 4 + 5


@pytest.mark.parametrize(
    "f",
    [
        lambda d: d.select(scalar.reverse_complement(F.col("seq"))), lambda d: d.select(scalar.gc_content(F.col("seq"))),
        lambda d: encode.kmers(d, 3), lambda d: perturb.marginalize(d.where(F.length("seq") > 2), "AC", perturb.predicting(models.TOY)),
        lambda d: edits.randomize(d, start=0, end=2), lambda d: edits.shuffle(d, start=0, end=2),
    ],
)
def test_others_bear_odd_sequences(odd, f):
    f(odd).collect()
    assert f(odd.limit(0)).count() == 0


def test_motif_beyond_the_sequence(odd):
    with pytest.raises(Exception, match="motif outside"):
        perturb.marginalize(odd, "AC", perturb.predicting(models.TOY)).collect()


def test_null_annotations(spark):
    df = spark.createDataFrame([(0, 1), (0, None), (1, None)], "example_idx int, annotation_idx int")
    assert sorted(map(tuple, annotate.count_matrix(df, 2).collect())) == [(0, 0, 1), (1, 0, 0)]
