"""Operators on small inputs: known values, invariants and errors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helixframe.functions import scalar
from helixframe.operators import annotate, attribution, design, edits, encode, loci, match, motifmatch, models, order, perturb, plotdata, seqlets, windows
from helixframe.sources import readers


def seqs(spark, *items):
    return spark.createDataFrame(list(enumerate(items)), "example_idx long, seq string")


def rows(df, *keys):
    return [tuple(r) for r in df.orderBy(*keys).collect()] if keys else [tuple(r) for r in df.collect()]


def test_kmer_indices(spark):
    got = encode.kmers(seqs(spark, "ACGTA"), 2)
    assert rows(got.drop("example_idx"), "kmer_idx") == [(3, 1), (4, 1), (9, 1), (14, 1)]


def test_unknown_letter_counts_as_first(spark):
    assert rows(encode.kmers(seqs(spark, "NA"), 2)) == [(0, 0, 1)]


def test_one_hot_round_trip(spark):
    df = seqs(spark, "ACNGT", "NNNNN", "A").where("example_idx <> 1")
    back = encode.decode(encode.one_hot(df))
    assert rows(back, "example_idx") == [(0, "ACNGT"), (2, "A")]


def test_one_hot_rejects_other_letters(spark):
    with pytest.raises(PySparkException):
        encode.one_hot(seqs(spark, "ACXT")).collect()


@pytest.mark.parametrize("text,want", [("ACGT", "ACGT"), ("AACN", "NGTT"), ("", "")])
def test_reverse_complement(spark, text, want):
    df = seqs(spark, text).select(scalar.reverse_complement(F.col("seq")).alias("a"))
    assert rows(df) == [(want,)]
    assert rows(df.select(scalar.reverse_complement(F.col("a")))) == [(text,)]


def test_gc_content(spark):
    df = seqs(spark, "GGCC", "NNNN", "", "ACNN").select("example_idx", scalar.gc_content(F.col("seq")))
    assert rows(df, "example_idx") == [(0, 1.0), (1, 0.0), (2, 0.0), (3, 0.5)]


def test_entropy_and_information_add_up(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.3, 0.4],), ([0.0] * 4,)], "p array<double>")
    got = rows(df.select(scalar.entropy(F.col("p")) + scalar.information_content(F.col("p"))))
    assert abs(got[0][0] - 2) < 1e-9 and got[1][0] == 0


@pytest.mark.parametrize("edit", [lambda s: scalar.insert(s, "AA", 3), lambda s: scalar.insert(s, "AA", -1), lambda s: scalar.substitute(s, "ACGTA"), lambda s: scalar.substitute(s, "AA", 3), lambda s: scalar.delete(s, 2, 9)])
def test_edits_outside_raise(spark, edit):
    with pytest.raises(PySparkException):
        seqs(spark, "ACGT").select(edit(F.col("seq"))).collect()


def test_multisubstitute_checks_gaps(spark):
    with pytest.raises(ValueError):
        scalar.multisubstitute(F.col("seq"), ["A", "C"], [1, 2])
    with pytest.raises(ValueError):
        scalar.multisubstitute(F.col("seq"), ["A", "C"], -1)


def test_chunks_join_again(spark):
    df = seqs(spark, "ACGTACGTACGTAC", "AAAACCCCGG")
    assert rows(encode.unchunk(encode.chunk(df, 6, 2), 2), "example_idx") == [(0, "ACGTACGTACGTAC"), (1, "AAAACCCCGG")]


def test_shuffles_keep_composition(spark):
    df = seqs(spark, "ACGTACGTTTTACGGG", "CCCCAAAATTTTGGGG")
    for r in edits.shuffle(df, start=2, end=12, n=3, seed=1).join(df.withColumnRenamed("seq", "old"), "example_idx").collect():
        assert sorted(r["seq"]) == sorted(r["old"]) and r["seq"][:2] == r["old"][:2] and r["seq"][12:] == r["old"][12:]


@pytest.mark.parametrize("text", ["CATCACGCATACG", "AAAAAA", "ACACACGT", "A", "NNACGN"])
def test_dinucleotides_stay(text):
    code = np.array(["ACGTN".index(c) for c in text], np.int8)
    for walk in edits.eulerian(code, 5, 3):
        assert walk[0] == code[0] and walk[-1] == code[-1]
        assert sorted(zip(walk[:-1], walk[1:], strict=True)) == sorted(zip(code[:-1], code[1:], strict=True))


def test_known_dinucleotide_shuffle(spark):
    # The published first two shuffles of this sequence with seed 0.
    got = edits.dinucleotide_shuffle(seqs(spark, "CATCACGCATACG"), n=2, seed=0)
    assert rows(got, "shuffle_idx") == [(0, 0, "CGCATCACATACG"), (0, 1, "CATCGCATACACG")]


def test_deletions_trim_alike(spark):
    df = seqs(spark, "ACGTA", "TTGCA")
    variants = spark.createDataFrame([(0, 4), (1, 0), (1, 1)], "example_idx long, pos long")
    assert rows(edits.apply_deletions(df, variants), "example_idx") == [(0, "ACG", "ACG"), (1, "TTG", "GCA")]
    assert rows(edits.apply_deletions(df, variants, left=True), "example_idx") == [(0, "GTA", "CGT"), (1, "GCA", "GCA")]


def test_insertions_keep_length(spark):
    df = seqs(spark, "ACGT")
    variants = spark.createDataFrame([(0, 0, 3), (0, 2, 0)], "example_idx long, pos long, char_idx int")
    assert rows(edits.apply_insertions(df, variants)) == [(0, "TACA")]


def test_interval_join_meets_each_pair_once(spark):
    left = spark.createDataFrame([("c", 0, 500), ("c", 90, 210), ("d", 0, 10)], "chrom string, start long, end long")
    right = spark.createDataFrame([("c", 100, 400), ("c", 499, 501), ("c", 500, 600)], "chrom_r string, start_r long, end_r long")
    got = rows(loci.interval_join(left, right, 100).select("start", "start_r"), "start", "start_r")
    assert got == [(0, 100), (0, 499), (90, 100)]


def test_summit_outside_raises(spark):
    df = spark.createDataFrame([("c", 5, 10, 9)], "chrom string, start long, end long, summit long")
    with pytest.raises(PySparkException):
        loci.recenter(df, "summit").collect()


def test_numbered_has_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    assert [r["row_idx"] for r in order.numbered(df, "x").orderBy("x").collect()] == list(range(1000))


def test_pairs_and_spacing(spark):
    df = spark.createDataFrame([(0, 1, 0, 5), (0, 2, 7, 9), (0, 1, 9, 12), (0, 1, 4, 8)], "example_idx long, annotation_idx long, start long, end long")
    assert rows(annotate.spacing_counts(df, 10, symmetric=False), "a", "b", "distance") == [(1, 1, 1, 1), (1, 1, 4, 1), (1, 2, 2, 1), (2, 1, 0, 1)]
    assert rows(annotate.pair_counts(df, unique=False), "a", "b") == [(1, 1, 3), (1, 2, 3), (2, 1, 3)]


def test_annotation_outside_shape_raises(spark):
    df = spark.createDataFrame([(0, 9)], "example_idx long, annotation_idx long")
    with pytest.raises(PySparkException):
        annotate.count_matrix(df, 3).collect()


def test_mutagenesis_of_a_linear_model(spark):
    out = attribution.saturation_mutagenesis(seqs(spark, "ACGT"), models.TOY)
    got = {(r["pos"], r["char_idx"]): r["y"] - r["y0"] for r in out.collect()}
    w = lambda c, p: (c * 7 + p * 3) % 11 - 5
    assert all(got[p, c] == w(c, p) - w(p, p) for p in range(4) for c in range(4))


def test_deep_lift_converges(spark):
    df = seqs(spark, "ACGTACGTACGTACGTACGTACGT", "TTGACCATGACCATGACCATTACG")
    for graph in (attribution.toy_graph(24), attribution.Graph([attribution.flatten(), attribution.dense(np.random.RandomState(0).randn(3, 96)), attribution.sigmoid(), attribution.dense(np.ones((1, 3)))])):
        out = attribution.deep_lift_shap(df, graph, n_shuffles=5).collect()
        assert all(r["converged"] for r in out) and len(out) == 2


def test_pooling_multipliers_explain_the_change():
    random = np.random.RandomState(1)
    x, r = random.randn(3, 2, 8), random.randn(3, 2, 8)
    graph = attribution.Graph([attribution.max_pool(2), attribution.flatten(), attribution.dense(random.randn(1, 8))])
    m = graph.multipliers(x, r, 0)
    assert np.allclose(((x - r) * m).sum((1, 2)), (graph(x) - graph(r))[:, 0])


def test_greedy_does_nothing_by_default(spark):
    df = seqs(spark, "AAAA")
    assert rows(design.greedy_substitution(df, models.COUNTER, design.highest())) == [(0, "AAAA")]


def test_greedy_and_beam_improve(spark):
    df = seqs(spark, "AAAAAAAAAA")
    got = design.greedy_substitution(df, models.COUNTER, design.highest(), ["ACG"], reverse_complement=False, max_iter=2).collect()[0]
    assert got["loss"] == -6
    best = design.beam_substitution(df.select("seq"), models.COUNTER, design.highest(), ["ACG"], reverse_complement=False, beam=3, max_iter=3).collect()[0]
    assert best["loss"] <= -6


def test_quotas_spill_to_near_bins():
    assert match.quotas({1: 3, 2: 1}, {1: 1, 2: 2, 0: 5}, 4) == {0: 1, 1: 1, 2: 2, 3: 0}


@pytest.mark.parametrize("n", [0, 3, 50])
def test_floor_division_bins(n):
    import pyarrow  # noqa: F401

    assert int((n / 100) // 0.02) == round((n / 100 - (n / 100) % 0.02) / 0.02)


def test_recursive_seqlets_find_a_bump(spark):
    random = np.random.RandomState(0)
    tracks = random.randn(20, 200) * 0.05
    tracks[3, 50:60] += 1.0
    df = spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(tracks)], "example_idx long, values array<double>")
    best = seqlets.recursive_seqlets(df).orderBy(F.desc("attribution")).first()
    assert best["example_idx"] == 3 and 45 <= best["start"] <= 55 and best["end"] <= 70


def test_tfmodisco_seqlets_do_not_overlap(spark):
    random = np.random.RandomState(0)
    tracks = random.laplace(size=(10, 120))
    df = spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(tracks)], "example_idx long, values array<double>")
    by = {}
    for r in seqlets.tfmodisco_seqlets(df, window=9, flank=2).orderBy("example_idx", "start").collect():
        assert r["start"] >= by.get(r["example_idx"], 0) and r["end"] - r["start"] == 13
        by[r["example_idx"]] = r["end"] - 4


def test_isotonic():
    assert seqlets.isotonic(np.array([1.0, 3.0, 2.0]), np.ones(3)).tolist() == [1.0, 2.5, 2.5]


def test_annotate_seqlets_finds_the_motif(spark):
    eye = np.eye(4)
    motifs = [(m, i, eye["ACGT".index(c)].tolist()) for m, word in enumerate(["ACGTA", "GGGCC"]) for i, c in enumerate(word)]
    spans = spark.createDataFrame([(7, "TTACGTATT"), (8, "TACGT")], "seqlet_idx long, seq string")
    got = rows(motifmatch.annotate_seqlets(spans, spark.createDataFrame(motifs, "motif_idx int, pos int, probs array<double>")).select("seqlet_idx", "motif_idx"), "seqlet_idx")
    assert got == [(7, 0), (8, 0)]


def test_pwm_scan(spark):
    got = seqlets.pwm_scan(seqs(spark, "TACG"), [[1, 0, 0, 0], [0, 1, 0, 0]]).orderBy(F.desc("score")).first()
    assert got["start"] == 1 and got["score"] > 3.9


def test_label_tracks_do_not_overlap(spark):
    spans = spark.createDataFrame([(0, i, i * 2, i * 2 + 5) for i in range(10)], "example_idx long, annotation_idx long, start long, end long")
    ends = {}
    for r in plotdata.label_tracks(spans).orderBy("start").collect():
        assert ends.get(r["track"], 0) <= r["start"]
        ends[r["track"]] = r["end"]


def test_sliding_sum_drops_the_tail(spark):
    df = spark.createDataFrame([(0, i, float(i)) for i in range(5)], "example_idx long, pos int, value double")
    assert [r["total"] for r in windows.sliding_sum(df, 3).orderBy("pos").collect()] == [3.0, 6.0, 9.0]


def test_perturbations_are_keyed(spark):
    df = seqs(spark, "ACGTACGT")
    out = perturb.ablate(df, 2, 6, perturb.predicting(models.TOY), n=3)
    assert sorted((r["variant"], r["shuffle_idx"]) for r in out.collect()) == [("after", 0), ("after", 1), ("after", 2), ("before", None)] or out.count() == 4
    with pytest.raises(ValueError):
        perturb.space(df, ["A", "C"], [[1, 2]], perturb.predicting(models.TOY))


def test_files(spark, tmp_path):
    (tmp_path / "a.bed").write_text("chr1\t1\t5\nchr2\t0\t9\n")
    (tmp_path / "a.vcf").write_text("##fileformat=VCFv4.3\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\n1\t12\tx\tA\tC\t.\tPASS\t.\tGT\t0/1\n")
    (tmp_path / "a.fa").write_text("> chr1 some\nACGTAC\nGTNN\n> chr2\nacgt\n")
    (tmp_path / "a.meme").write_text("MEME version 4\n\nMOTIF M1 one\nletter-probability matrix: alength= 4 w= 2\n 0.1 0.2 0.3 0.4\n 1 0 0 0\n\nMOTIF M2\nletter-probability matrix: alength= 4 w= 1\n0.25 0.25 0.25 0.25\n")
    (tmp_path / "a.bedgraph").write_text("track type=bedGraph\nchr1\t0\t5\t1.5\n")
    at = lambda name: str(tmp_path / name)
    assert rows(readers.read_bed(spark, at("a.bed")), "chrom") == [("chr1", 1, 5), ("chr2", 0, 9)]
    assert rows(readers.read_vcf(spark, at("a.vcf")).select("CHROM", "POS", "ALT")) == [("1", 12, "C")]
    genome = readers.read_fasta(spark, at("a.fa"))
    assert rows(genome, "chrom") == [("chr1", "ACGTACGTNN"), ("chr2", "ACGT")]
    assert rows(readers.genome_tiles(genome, 4), "chrom", "tile_start") == [("chr1", 0, "ACGT"), ("chr1", 4, "ACGT"), ("chr1", 8, "NN"), ("chr2", 0, "ACGT")]
    assert rows(readers.read_meme(spark, at("a.meme")), "motif_idx", "pos") == [(0, "M1 one", 0, [0.1, 0.2, 0.3, 0.4]), (0, "M1 one", 1, [1.0, 0.0, 0.0, 0.0]), (1, "M2", 0, [0.25] * 4)]
    assert rows(readers.read_meme(spark, at("a.meme"), 1).select("name").distinct()) == [("M1 one",)]
    assert rows(readers.read_bedgraph(spark, at("a.bedgraph"))) == [("chr1", 0, 5, 1.5)]
    readers.write_fasta(spark.createDataFrame([("x", "A" * 100)], "header string, seq string"), at("out.fa"))
    assert rows(readers.read_fasta(spark, at("out.fa"))) == [("x", "A" * 100)]
