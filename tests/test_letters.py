"""Letters of weights, tracks of labels and constructs tried as rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import design, encode, models, plotdata

WEIGHTS = "example_idx int, pos int, probs array<double>"


def test_characters(spark):
    rows = [[0.25, 0.2, 0.3, 0.25], [0.0, 1.0, 0.0, 0.0], [0.1, 1.0, 0.3, 3.0], [0.95, 0.05, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]]
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate(rows)], WEIGHTS).orderBy(F.desc("pos"))
    text = lambda d, **o: encode.characters(d, **o).first()["seq"]
    assert text(df) == "GCTAC" == text(df, force=True) == text(df, allow_n=True)
    five = df.withColumn("probs", F.concat("probs", F.array(F.lit(0.0))))
    assert text(five, alphabet="ACGTN") == "GCTAC"
    for wrong in ("ACG", "ACGTN"):
        with pytest.raises(Exception, match="differ in size"):
            text(df, alphabet=wrong)
    tied = df.union(spark.createDataFrame([(1, 5, [0.0, 2.0, 2.0, 0.0]), (1, 6, [0.0] * 4)], WEIGHTS))
    with pytest.raises(Exception, match="same weight"):
        text(tied)
    assert text(tied, force=True) == "GCTACCA" and text(tied, allow_n=True) == "GCTACCN"
    for odd in (None, [1.0, None, 0.0, 0.0], []):
        with pytest.raises(Exception, match="differ in size"):
            text(spark.createDataFrame([(1, 0, odd)], WEIGHTS))
    assert encode.characters(df.limit(0)).isEmpty()


def test_label_tracks(spark):
    r = random.Random(3)
    rows = [(r.choice([1, 2, None]), i % 5, (a := r.randrange(60)), a + r.randrange(9)) for i in range(200)] + [(1, 0, None, 4), (1, 0, 4, None)]
    got = plotdata.label_tracks(spark.createDataFrame(rows, "example_idx int, annotation_idx int, start int, end int").repartition(3)).collect()
    want = []
    for e in (1, 2, None):
        ends = []
        for s, t, a in sorted((s, t, a) for f, a, s, t in rows if f == e and s is not None and t is not None):
            track = next((i for i, x in enumerate(ends) if x <= s), len(ends))
            ends[track : track + 1] = [t]
            want.append((e, a, s, t, track))
    assert sorted(map(str, (tuple(x) for x in got))) == sorted(map(str, want))


def test_constructs_by_trying_all(spark):
    """The construct after each motif is the best of all places, by hand."""
    r = random.Random(8)
    backs = ["".join(r.choice("ACGT") for _ in range(24)) for _ in range(5)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(backs)], "example_idx int, seq string")
    score = lambda s: sum(s[i : i + 3] == "ACG" for i in range(len(s))) * 3 - sum(s[i : i + 2] == "TA" for i in range(len(s)))

    def put(s, c, at):
        return "".join(c[i - at] if at <= i < at + len(c) and c[i - at] != "N" else x for i, x in enumerate(s))

    loss = lambda c, at: sum((7.0 - (score(put(s, c, at)) - score(s))) ** 2 for s in backs) / 5
    motifs, reach = ["ACG", "CGTA"], 4
    construct, start, last = "", 11, 49.0
    while True:
        tried = []
        for m in motifs:
            for p in [start] if not construct else range(max(0, start - reach - len(m)), min(24 - len(m), start + len(construct) + reach) + 1):
                low, high = (min(start, p), max(start + len(construct), p + len(m))) if construct else (p, p + len(m))
                c = list("N" * (high - low))
                c[start - low : start - low + len(construct)] = construct
                c[p - low : p - low + len(m)] = m
                tried.append((loss("".join(c), low), len(tried), "".join(c), low))
        best = min(tried)
        if last - best[0] <= 1e-3:
            break
        last, _, construct, start = best
    assert construct and design.greedy_marginalize(df, models.MOTIFS, 7.0, motifs, max_spacing=reach) == (construct, start)
