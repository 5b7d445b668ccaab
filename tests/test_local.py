"""Local models against whole runs; screens in rounds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import attribution, design, models


@pytest.fixture(scope="module")
def seqs(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("ACGTNA") for _ in range(n))) for i, n in enumerate((0, 1, 2, 3, 5, 30, 31))] + [(7, "ACGACGTATA"), (8, None)]
    return spark.createDataFrame(rows, "example_idx long, seq string")


@pytest.mark.parametrize("model", [models.TOY, models.MOTIFS])
def test_local_scores_are_whole_scores(seqs, model):
    whole = models.SqlModel(model.heads)
    assert model.local and not whole.local
    as_set = lambda df: sorted(map(str, df.collect()))
    for bounds in ({}, {"start": 2, "end": 9}):
        assert as_set(attribution.saturation_mutagenesis(seqs, model, **bounds)) == as_set(attribution.saturation_mutagenesis(seqs, whole, **bounds))
    for motifs in (["ACG", "TANA"], None):
        a, b = (design.greedy_round(seqs, m, design.distance_to(9), motifs) for m in (model, whole))
        assert as_set(a) == as_set(b)
        a, b = (design.beam_round(seqs.where("length(seq) > 4"), m, design.highest(), 5, motifs) for m in (model, whole))
        assert as_set(a) == as_set(b)


def test_screen_in_rounds(spark):
    keys = spark.range(40).select(F.col("id").alias("example_idx"), F.lit(1).alias("round"))
    made = []

    def generate(k, seed):
        made.append(seed)
        return design.random_sequences(k, 12, seed=seed)

    score = lambda s: abs(sum((("ACGT".index(c) * 7 + p * 3) % 11 - 5) for p, c in enumerate(s)) - 20) ** 2
    pool = lambda rounds: sorted((score(x["seq"]) * 1.0, r, x["example_idx"], x["seq"]) for r in range(rounds) for x in design.random_sequences(keys, 12, seed=5 + r).collect())
    for n_best, tol in ((1, 1e-3), (4, 30.0), (50, 1e9)):
        made.clear()
        got = [(x["loss"], x["round"], x["example_idx"], x["seq"]) for x in design.screen_rounds(keys, models.TOY, design.distance_to(20), generate, n_best=n_best, tol=tol, max_iter=8, seed=5).collect()]
        assert got == pool(len(made))[:n_best] and made == list(range(5, 5 + len(made)))
        last = [len(p) == n_best and p[-1][0] < tol for p in (pool(r)[:n_best] for r in range(1, len(made) + 1))]
        assert not any(last[:-1]) and (last[-1] or len(made) == 8)
    assert design.screen_rounds(keys.limit(0), models.TOY, design.highest(), generate).isEmpty()
    assert design.screen_rounds(keys, models.TOY, design.highest(), generate, n_best=0).isEmpty()
