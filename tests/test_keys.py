"""Attributions keep what tells sequences apart; exact order statistics without one task; signal limits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import attribution, design, edits, match, models, order, perturb, windows


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame([(0, "ACGTACGTACGTACGT"), (1, "GGGTTTACGACGAAAC")], "example_idx long, seq string")


def test_attributions_before_and_after(spark, seqs):
    graph = attribution.Graph([attribution.flatten(), attribution.dense(np.arange(64).reshape(1, -1).astype(float))])
    out = perturb.marginalize(seqs, "TT", lambda df: attribution.deep_lift_shap(df, graph, n_shuffles=3))
    rows = {(r["example_idx"], r["variant"]): r["attribution"] for r in out.collect()}
    assert len(rows) == 4 and rows[0, "before"] != rows[0, "after"]
    alone = {r["example_idx"]: r["attribution"] for r in attribution.deep_lift_shap(seqs, graph, n_shuffles=3).collect()}
    assert all(np.allclose(alone[i], rows[i, "before"]) for i in alone)
    refs = seqs.select("example_idx", F.lit(0).alias("shuffle_idx"), F.reverse("seq").alias("seq"))
    out = perturb.marginalize(seqs, "TT", lambda df: attribution.linear_deep_lift(df, refs, models.toy_weight))
    assert out.groupBy("example_idx", "variant").count().where("count = 16").count() == 4


def test_insertions_at_one_position(spark):
    one = spark.createDataFrame([(0, "GGGGGG")], "example_idx long, seq string")
    put = spark.createDataFrame([(0, 2, 1), (0, 2, 0), (0, 2, 1)], "example_idx long, pos long, char_idx int")
    assert edits.apply_insertions(one, put).first()["seq"] == "GGACCG"


def test_output_mask(spark, seqs):
    got = design.candidates(seqs, ["NTN"], reverse_complement=False, output_mask=[3, 4, 5, 6]).collect()
    assert {r["pos"] for r in got} == {3, 4}
    for r in got:
        own = r["seq"]
        assert r["new_seq"] == own[: r["pos"] + 1] + "T" + own[r["pos"] + 2 :]


def test_order_statistics(spark):
    r = np.random.RandomState(3)
    a, b = r.randn(300).round(1), (r.randn(200) + 0.4).round(1)
    x, y = (spark.createDataFrame([(float(v),) for v in z], "v double").repartition(3) for z in (a, b))
    grid = np.unique(np.r_[a, b])
    want = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert abs(match.ks_statistic(x, y, "v").first()[0] - want) < 1e-12
    assert match.ks_statistic(x, y.limit(0), "v").first()[0] is None
    got = windows.quantiles(x, "v", [0.0, 0.013, 0.5, 1.0]).first()
    assert np.allclose(list(got), np.quantile(a, [0.0, 0.013, 0.5, 1.0]))
    assert list(windows.quantiles(x.limit(0), "v", [0.5]).first()) == [None]


@pytest.mark.parametrize("cell", [1, 3])
def test_matching_takes_whole_quota(spark, monkeypatch, cell):
    monkeypatch.setattr(match, "CELL", cell)
    r = np.random.RandomState(1)
    seq = lambda: "".join(r.choice(list("ACGT"), 20))
    tiles = spark.createDataFrame([("chr1", 20 * i, 20 * i + 20, seq()) for i in range(600)], "chrom string, start long, end long, seq string")
    targets = tiles.where("start % 200 = 0")
    got = match.matching_loci(targets, tiles, width=0.05)
    taken = {x["gc_bin"]: x["count"] for x in got.groupBy("gc_bin").count().collect()}
    want = {x["gc_bin"]: x["count"] for x in match.gc_profile(targets, 0.1, 0.05).groupBy("gc_bin").count().collect()}
    assert sum(taken.values()) == sum(want.values()) == 60 and got.distinct().count() == 60
    loud = spark.createDataFrame([("t", "chr1", 20 * i + 3, 9.0 if i % 3 else 1.0) for i in range(600)], "track string, chrom string, pos long, value double")
    assert abs(match.signal_limit(targets, loud, share=0.0, beta=2.0) - 2.0) < 1e-12
    quiet = match.matching_loci(targets, tiles, width=0.05, signal=loud, signal_share=0.0, signal_beta=2.0).collect()
    assert quiet and all(x["start"] // 20 % 3 == 0 for x in quiet)


def test_small_tables_are_dealt_by_key_and_large_ones_stay(spark, monkeypatch):
    rows = spark.range(0, 1000, 1, 1).selectExpr("id % 50 AS k", "id AS v")
    dealt = order.spread(rows, "k")
    where = dealt.select("k", F.spark_partition_id().alias("p")).distinct()
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, rows.collect()))
    assert where.count() == 50 and where.select("p").distinct().count() > 1
    # Groups of the key need no other shuffle.
    assert dealt.groupBy("k").count()._jdf.queryExecution().toString().count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(order, "ROW_GROUP", 100)
    assert order.spread(rows, "k") is rows
    stream = spark.readStream.format("rate").load()
    assert order.spread(stream, "value") is stream
