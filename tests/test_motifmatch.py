"""Names of spans against enumeration of all columns."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from helixframe.operators import motifmatch

MOTIFS = "motif_idx int, pos int, probs array<double>, seq string, rank int"


def database(seed):
    r = random.Random(seed)
    motifs = {3: 3, 8: 1, 5: 2}
    return [(m, p, [r.choice([0.0, 0.1, 1.0, 3.0]) for _ in range(4)], "x", 1) for m, n in motifs.items() for p in range(n)]


def steps_of(probs, bins):
    total = sum(probs)
    p = [x / total if total else 0.25 for x in probs]
    out = []
    for a in range(4):
        d = math.sqrt(max(0.0, sum(x * x for x in p) - 2 * p[a] + 1) / 2)
        out.append(min(max(math.floor((1 - d) * (bins - 1) + 0.5), 0), bins - 1))
    return out


def brute(seq, columns, motifs, both, bins):
    """{motif: p} by all tuples of columns that an alignment's letters could meet."""
    table = [steps_of(c, bins) for c in columns]
    median = [sorted(t[a] for t in table)[(len(table) - 1) // 2] for a in range(4)]
    fit = lambda t, a: t[a] - median[a] if a is not None else 0
    letters = ["ACGT".index(c) if c in "ACGT" else None for c in seq.upper()]
    strands = [letters] + ([[None if a is None else 3 - a for a in reversed(letters)]] if both else [])
    out = {}
    for m, own in motifs.items():
        own = [steps_of(c, bins) for c in own]
        least, tries = 1.0, 0
        for s in strands:
            for shift in range(-(len(s) - 1), len(own)):
                met = [(own[i + shift], a) for i, a in enumerate(s) if 0 <= i + shift < len(own)]
                score = sum(fit(t, a) for t, a in met)
                known = [a for _, a in met if a is not None]
                sums = [sum(fit(t, a) for t, a in zip(ts, known, strict=True)) for ts in itertools.product(table, repeat=len(known))]
                least = min(least, sum(x >= score for x in sums) / len(sums))
                tries += 1
        out[m] = 1 - (1 - least) ** tries
    return out


@pytest.mark.parametrize("both", [True, False])
@pytest.mark.parametrize("columns", [100_000, 2])
def test_p_values_are_exact(spark, both, columns):
    rows = database(1)
    motifs = {m: [x[2] for x in rows if x[0] == m] for m in {x[0] for x in rows}}
    seqs = ["ACG", "acg", "T", "GATTACA", "NAN", "", None, "NN", "CCNGT", "ACG"]
    found = motifmatch.annotate_seqlets(spark.createDataFrame(list(enumerate(seqs)), "seqlet_idx int, seq string"), spark.createDataFrame(rows, MOTIFS), n_nearest=3, reverse_complement=both, bins=10, columns=columns)
    got = {}
    for x in found.collect():
        got.setdefault(x["seqlet_idx"], []).append(x)
    assert set(got) == {0, 1, 2, 3, 4, 8, 9}
    for i, hits in got.items():
        want = brute(seqs[i], [x[2] for x in rows], motifs, both, 10)
        hits = sorted(hits, key=lambda x: x["rank"])
        assert [x["rank"] for x in hits] == [1, 2, 3]
        assert all(abs(x["p_value"] - want[x["motif_idx"]]) < 1e-9 for x in hits)
        assert all(a["p_value"] <= b["p_value"] for a, b in zip(hits, hits[1:]))


def test_no_motifs(spark):
    seqs = spark.createDataFrame([(1, "ACGT")], "seqlet_idx int, seq string")
    assert motifmatch.annotate_seqlets(seqs, spark.createDataFrame([], MOTIFS)).isEmpty()
    one = spark.createDataFrame([(1, 0, [0.0] * 4, "", 0)], MOTIFS)
    assert motifmatch.annotate_seqlets(seqs, one).first()["p_value"] == 1.0


def test_strand_and_offset(spark):
    """A motif that spells GATTACA is found where it lies, on either strand."""
    spelt = [(7, p, [float(c == a) for a in "ACGT"], "", 0) for p, c in enumerate("GATTACA")]
    others = [(m, p, [1.0, 1.0, 1.0, 1.0 + (p == m)], "", 0) for m in range(5) for p in range(9)]
    seqs = spark.createDataFrame([(0, "CCGATTACAC"), (1, "GTGTAATCGG"), (2, "TTAC")], "seqlet_idx int, seq string")
    got = {x["seqlet_idx"]: x for x in motifmatch.annotate_seqlets(seqs, spark.createDataFrame(spelt + others, MOTIFS)).collect()}
    assert [(got[i]["motif_idx"], got[i]["strand"], got[i]["offset"]) for i in range(3)] == [(7, 0, -2), (7, 1, -2), (7, 0, 2)]


def test_few_groups_of_motifs_are_scored(monkeypatch):
    """Motifs of several lengths, in several blocks and rounds of sequences, as by scoring all alignments; the bounds leave out most of them."""
    r, bins = np.random.RandomState(3), 60
    sizes = r.choice([1, 7, 12], 3000, p=[0.02, 0.2, 0.78])
    steps = r.randint(0, bins, (sizes.sum(), 4)).astype(np.int16)
    histogram = np.stack([np.bincount(s, minlength=bins) for s in steps.T]) / len(steps)
    low = np.array([int(np.searchsorted(np.cumsum(h), 0.5)) for h in histogram])
    steps -= low.astype(np.int16)
    ids = r.permutation(9000)[: len(sizes)].astype(np.int64)
    seqs = ["".join(r.choice(list("ACGTN"), n, p=[0.24] * 4 + [0.04])) for n in (1, 2, 5, 9, 9, 16, 20, 20, 140)]
    scored = []
    plain = motifmatch.Block.scores
    monkeypatch.setattr(motifmatch.Block, "scores", lambda self, x, rows, groups: (scored.append(len(rows) * motifmatch.GROUP), plain(self, x, rows, groups))[1])
    monkeypatch.setattr(motifmatch, "TABLE", 2 << 20)
    null = motifmatch.Null(histogram, low)
    got = {x.seq: x.best for x in motifmatch.nearest(seqs, ids, sizes, steps, null, 3, True)}
    begins, total = np.r_[0, np.cumsum(sizes)], 0
    for seq in set(seqs):
        letters = ["ACGTN".index(c) for c in seq]
        best = []
        for m, (i, size) in enumerate(zip(begins, sizes, strict=False)):
            found = []
            for strand, own in enumerate((letters, [3 - a if a < 4 else a for a in reversed(letters)])):
                for shift in range(1 - len(own), size):
                    met = [(a, int(steps[i + c, a])) for c in range(max(0, shift), min(size, len(own) + shift)) if (a := own[c - shift]) < 4]
                    code = sum(1 << motifmatch.COUNT * a for a, _ in met)
                    score = sum(x for _, x in met)
                    _, minus, least = null.of(code)
                    found.append((-minus[score - least], strand, shift, score))
            total += len(found)
            tail, strand, shift, score = min(found)
            best.append((float(-np.expm1(len(found) * np.log1p(-np.minimum(np.array([tail]), 1 - 1e-16)))[0]), int(ids[m]), strand, shift, score))
        if seq in got:
            assert got[seq] == sorted(best)[:3]
        else:
            assert set(seq) == {"N"}
    assert sum(scored) < total / 5
