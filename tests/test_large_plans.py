"""Steps that must not broadcast or shuffle what grows with the data, though by its files' size it looks small."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import attribution, design, encode, models
from helixframe.plans import catalog

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_gapped_kmers_broadcast_nothing(spark):
    plan = plan_of(catalog.QUERIES["f11_gapped_kmers"](spark, SMALL))
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") <= 2


def test_gapped_kmers_by_enumeration(spark):
    """All chains of positions, some with gaps, two rows at a position, and rows without an example or a position."""
    r = random.Random(4)
    rows = [(k, p, r.randrange(4), float(r.randint(-9, 9))) for k in ("a", "b") for p in range(14) if r.random() < 0.8]
    rows += [("a", 3, 2, 5.0), ("a", None, 1, 3.0), (None, 1, 1, 4.0), (None, 2, 1, 4.0), ("c", 0, 0, 1.0)]
    df = spark.createDataFrame(rows, "example_idx string, pos int, char_idx int, value double")
    for min_k, max_k, max_gap, max_len in ((2, 4, 2, 6), (1, 3, 3, 4), (1, 2, 1, 1)):
        want = defaultdict(list)
        for key in ("a", "b", "c", None):
            own = [x for x in rows if x[0] == key]
            for k in range(min_k, max_k + 1):
                for chain in itertools.permutations(own, k):
                    if k > 1 and (key is None or any(x[1] is None for x in chain) or any(not 0 < b[1] - a[1] <= max_gap for a, b in itertools.pairwise(chain)) or chain[-1][1] - chain[0][1] >= max_len):
                        continue
                    want[key, sum((x[2] + 1) * 5 ** (x[1] - chain[0][1] if k > 1 else 0) for x in chain)].append(sum(x[3] for x in chain) / k)
        got = encode.gapped_kmers(df, min_k=min_k, max_k=max_k, max_gap=max_gap, max_len=max_len, max_gkmers=10**6).collect()
        assert {(x["example_idx"], x["gkmer"]): (round(x["value"], 6), x["n"]) for x in got} == {k: (round(sum(v), 6), len(v)) for k, v in want.items()}
        assert len(got) == len(want)


def test_maps_are_not_shuffled(spark):
    """Only letters are: means are made up where a row's references pass."""
    plan = plan_of(catalog.QUERIES["m08_pisa"](spark, SMALL))
    assert "Aggregate" not in plan and "Broadcast" not in plan
    assert plan.rindex("Exchange") > plan.rindex("MapInArrow")


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_maps_are_means_over_references(spark, batch):
    """Of sequences of several lengths, with references on both sides of the ends of batches."""
    r = random.Random(5)
    draw = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    seqs = [(i, i % 2 == 0, draw(n)) for i, n in enumerate([12, 12, 14, 12, 30, 14])]
    refs = [(i, k, draw(len(s))) for i, _, s in seqs for k in range([1, 70, 2, 5, 3, 0][i])]
    pooled = attribution.Graph([attribution.conv(np.arange(60).reshape(3, 4, 5) % 7 - 3.0), attribution.relu(), attribution.Layer(lambda x: x.sum(2), lambda g, x, *_: np.repeat(g[:, :, None], x.shape[2], 2))])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    try:
        df = spark.createDataFrame(seqs, "example_idx long, even boolean, seq string").repartition(2, "example_idx")
        got = attribution.pisa(df, pooled, 3, references=spark.createDataFrame(refs, "example_idx long, shuffle_idx int, seq string").repartition(5), warning=1e-6).orderBy("example_idx", "output_idx").collect()
        drawn = attribution.deep_lift_shap(df, pooled, n_shuffles=4).orderBy("example_idx").collect()
    finally:
        spark.conf.set(key, before)
    assert [(x["example_idx"], x["even"], x["output_idx"]) for x in got] == [(i, i % 2 == 0, o) for i in range(5) for o in range(3)]
    assert [x["example_idx"] for x in drawn] == list(range(6))
    for x in got:
        i, o = x["example_idx"], x["output_idx"]
        ref = models.one_hot_batch([t for j, _, t in refs if j == i]).astype(float)
        own = models.one_hot_batch([seqs[i][2]] * len(ref)).astype(float)
        m = pooled.multipliers(own, ref, o)
        want = ((m - (ref * m).sum(1, keepdims=True)) * own).mean(0).reshape(-1)
        delta = np.abs(pooled(own)[:, o] - pooled(ref)[:, o] - ((own - ref) * m).sum((1, 2))).max()
        assert np.allclose(x["attribution"], want) and abs(x["delta"] - delta) < 1e-9 and x["converged"] == (delta <= 1e-6)


def test_greedy_rounds_send_nothing(spark):
    """A round is a pass over the rows: no join, no sorting of edits, and rows that share a key or have none are rows of their own."""
    seqs = spark.createDataFrame([(1, "AAAAAAAA"), (1, "ACTTACTT"), (None, "TTTTTTTT"), (2, "AC"), (3, None)], "example_idx long, seq string")
    for options in ({}, {"mask": [0, 2, 7]}, {"output_mask": [1, 2, 3, 4]}, {"reverse_complement": False}):
        done = design.greedy_round(seqs, models.COUNTER, design.highest(), ["ACG", "TNTA"], **options)
        plan = plan_of(done)
        assert "Exchange" not in plan and "Join" not in plan and "Aggregate" not in plan
        tried = design.candidates(seqs, ["ACG", "TNTA"], **options).collect()
        score = lambda s: s and -(s.count("ACG") * 3.0 - s.count("TT"))
        want = set()
        for key, seq in seqs.collect():
            best = min(((score(x["new_seq"]), x["motif_idx"], x["pos"], x["new_seq"]) for x in tried if x["seq"] == seq), default=None)
            want.add((key, best[3], best[0]) if best and best[0] < score(seq) else (key, seq, score(seq)))
        got = {tuple(x) for x in done.collect()}
        assert got == want and {x[0] for x in got} == {1, 2, 3, None}


def test_beams_send_few_rows(spark):
    """A member sends on no more rows than the beam holds; the best are those of all edits, however the members share them."""
    r = random.Random(6)
    seqs = spark.createDataFrame([(i, "".join(r.choice("ACT") for _ in range(12))) for i in range(30)] + [(30, "ACTTACTT"), (31, "ACTTACTT"), (32, "A")], "example_idx long, seq string")
    for model, loss in ((models.COUNTER, design.highest()), (models.TOY, design.distance_to(7))):
        for beam in (1, 4, 32, 33, 500):
            done = design.beam_round(seqs, model, loss, beam, ["ACG", "TTNA"])
            got = [(x["loss"], tuple(x["counter"]), x["seq"]) for x in done.collect()]
            f = model.heads["y"]
            tried = design.candidates(seqs, ["ACG", "TTNA"]).select(F.col("new_seq").alias("seq"), "motif_idx", "pos")
            each = seqs.select("seq", F.lit(-1).alias("motif_idx"), F.lit(-1).alias("pos")).union(tried).select("seq", "motif_idx", "pos", loss(f(F.col("seq"))).alias("l"))
            best = {}
            for x in each.collect():
                best[x["seq"]] = min(best.get(x["seq"], (x["l"], (99, 99), x["seq"])), (x["l"], (x["motif_idx"], x["pos"]), x["seq"]))
            assert got == sorted(best.values())[:beam]
            if beam == 4:
                rows = design.beam_round(seqs, model, loss, beam, ["ACG", "TTNA"])
                assert rows._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
