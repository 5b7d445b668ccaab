"""Queries of encodings, scalar functions and edits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from helixframe.functions import scalar
from helixframe.operators import design, edits, encode, seqlets
from helixframe.plans import views
from helixframe.plans.catalog import query
from helixframe.sources import readers

MOTIFS = "motifs AS (SELECT CAST(example_idx AS BIGINT) AS motif_idx, CAST(i // 4 AS INT) AS pos, CAST(i % 4 AS INT) AS char_idx, CAST(abs(value) AS DOUBLE) AS w FROM (SELECT example_idx, pos AS i, value FROM attr))"


def motif_columns(spark, sf_dir):
    """motif_idx, pos, probs: each embedding read as 16 columns of four weights."""
    rows = views.attr(spark, sf_dir).groupBy(F.col("example_idx").alias("motif_idx"), F.floor(F.col("pos") / 4).cast("int").alias("pos"))
    weights = rows.agg(F.array_sort(F.collect_list(F.struct((F.col("pos") % 4).alias("c"), F.abs("value").alias("w")))).alias("x"))
    return weights.select("motif_idx", "pos", F.col("x.w").alias("probs"))


@query(
    """SELECT lang, count(*) AS n, round(avg(gc), 6) AS mean_gc FROM (SELECT lang,
    coalesce(len(regexp_extract_all(seq, '[GC]')) / CAST(nullif(length(seq), 0) AS DOUBLE), 0) AS gc FROM doc_seqs) GROUP BY lang""",
    views.DOC_SEQS,
)
def f05_gc_content_by_lang(spark, sf_dir):
    """mean GC content by language."""
    gc = views.doc_seqs(spark, sf_dir).select("lang", scalar.gc_content(F.col("seq")).alias("gc"))
    return gc.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gc"), 6).alias("mean_gc"))


@query("SELECT example_idx, round(coalesce(len(regexp_extract_all(seq, '[GC]')) / CAST(nullif(length(seq) - len(regexp_extract_all(seq, 'N')), 0) AS DOUBLE), 0), 9) AS gc FROM nseqs", views.NSEQS)
def f05_gc_content(spark, sf_dir):
    """GC content of each sequence, unknown letters left out."""
    return views.nseqs(spark, sf_dir).select("example_idx", F.round(scalar.gc_content(F.col("seq")), 9).alias("gc"))


@query("SELECT example_idx, CAST(p - 1 AS INT) AS pos, CAST(instr('ACGT', seq[p]) - 1 AS INT) AS char_idx FROM nseqs, generate_series(1, 64) AS t(p) WHERE seq[p] <> 'N'", views.NSEQS)
def f01_one_hot_long(spark, sf_dir):
    """one-hot entries of each sequence."""
    return encode.one_hot(views.nseqs(spark, sf_dir))


@query("SELECT example_idx, seq FROM nseqs", views.NSEQS)
def f02_characters(spark, sf_dir):
    """sequences back from their one-hot entries."""
    hot = encode.one_hot(views.nseqs(spark, sf_dir)).withColumn("length", F.lit(64))
    return encode.decode(hot, length="length")


@query("SELECT example_idx, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM nseqs", views.NSEQS)
def f03_reverse_complement(spark, sf_dir):
    """the other strand."""
    return views.nseqs(spark, sf_dir).select("example_idx", scalar.reverse_complement(F.col("seq")).alias("rc"))


@query(
    """SELECT motif_idx, string_agg(c, '' ORDER BY pos) AS consensus FROM (SELECT motif_idx, pos,
    CASE WHEN max(w) = 0 THEN 'N' ELSE substring('ACGT', CAST(arg_max(char_idx, (w, -char_idx)) AS INT) + 1, 1) END AS c FROM motifs GROUP BY motif_idx, pos) GROUP BY motif_idx""",
    views.ATTR,
    MOTIFS,
)
def f04_pwm_consensus(spark, sf_dir):
    """consensus of each motif, the first letter of greatest weight."""
    letters = motif_columns(spark, sf_dir).select("motif_idx", "pos", scalar.consensus_letter(F.col("probs")).alias("c"))
    rows = letters.groupBy("motif_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("x"))
    return rows.select("motif_idx", F.array_join("x.c", "").alias("consensus"))


ENTROPY = "SELECT motif_idx, pos, {} AS {} FROM (SELECT *, sum(w) OVER (PARTITION BY motif_idx, pos) AS s FROM motifs) GROUP BY motif_idx, pos"


@query("SELECT motif_idx, string_agg(CASE WHEN total = 0 THEN 'N' ELSE substring('ACGT', CAST(c + 1 AS INT), 1) END, '' ORDER BY pos) AS seq FROM (SELECT motif_idx, pos, arg_max(char_idx, (w, -char_idx)) AS c, sum(w) AS total FROM motifs GROUP BY 1, 2) GROUP BY motif_idx", views.ATTR, MOTIFS)
def f02_characters_of_weights(spark, sf_dir):
    """the letters of greatest weight of all motifs, N where there is no weight."""
    return encode.characters(motif_columns(spark, sf_dir), key="motif_idx", allow_n=True)


@query(ENTROPY.format("round(CASE WHEN sum(w) = 0 THEN 0 ELSE -sum(CASE WHEN s = 0 THEN 0 ELSE w / s * log2(w / s + 1e-9) END) END, 6)", "entropy"), views.ATTR, MOTIFS)
def f06_entropy(spark, sf_dir):
    """entropy of each motif column."""
    return motif_columns(spark, sf_dir).select("motif_idx", "pos", F.round(scalar.entropy(F.col("probs")), 6).alias("entropy"))


@query(ENTROPY.format("round(CASE WHEN sum(w) = 0 THEN 0 ELSE 2 + sum(CASE WHEN s = 0 THEN 0 ELSE w / s * log2(w / s + 1e-9) END) END, 6)", "ic"), views.ATTR, MOTIFS)
def f07_information_content(spark, sf_dir):
    """information content of each motif column."""
    return motif_columns(spark, sf_dir).select("motif_idx", "pos", F.round(scalar.information_content(F.col("probs")), 6).alias("ic"))


@query("SELECT example_idx, CAST(c AS INT) AS chunk_idx, substring(seq, CAST(c * 12 + 1 AS INT), 16) AS seq FROM doc_seqs, generate_series(0, (length(seq) - 16) // 12) AS t(c) WHERE length(seq) >= 16", views.DOC_SEQS)
def f08_chunk(spark, sf_dir):
    """F8: windows of 16 letters that overlap by 4."""
    return encode.chunk(views.doc_seqs(spark, sf_dir), 16, 4)


@query("SELECT example_idx, CASE WHEN length(seq) < 28 THEN substring(seq, 3, 12) ELSE substring(seq, 1, (length(seq) - 16) // 12 * 12 + 16) END AS seq FROM doc_seqs WHERE length(seq) >= 16", views.DOC_SEQS)
def f09_unchunk(spark, sf_dir):
    """windows joined again, but for what they had dropped; a single window is trimmed."""
    return encode.unchunk(encode.chunk(views.doc_seqs(spark, sf_dir), 16, 4), 4)


KMER = "greatest(instr('ACGT', k[1]) - 1, 0) + 4 * greatest(instr('ACGT', k[2]) - 1, 0) + 16 * greatest(instr('ACGT', k[3]) - 1, 0) + 64 * greatest(instr('ACGT', k[4]) - 1, 0)"


@query(f"SELECT example_idx, CAST({KMER} AS BIGINT) AS kmer_idx, count(*) AS value FROM (SELECT example_idx, substring(seq, CAST(p AS INT), 4) AS k FROM nseqs, generate_series(1, 61) AS t(p)) GROUP BY 1, 2", views.NSEQS)
def f10_kmers(spark, sf_dir):
    """numbers of 4-mers."""
    return encode.kmers(views.nseqs(spark, sf_dir), 4)


@query(
    f"""SELECT example_idx, CAST({KMER} AS BIGINT) AS kmer_idx, sum(s) AS value FROM (SELECT n.example_idx, substring(seq, CAST(a.pos + 1 AS INT), 4) AS k,
    sum(a.value) OVER (PARTITION BY n.example_idx ORDER BY a.pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s, a.pos FROM nseqs n JOIN attr a ON n.example_idx = a.example_idx) WHERE pos <= 60 GROUP BY 1, 2""",
    views.NSEQS,
    views.ATTR,
)
def f10_kmers_scored(spark, sf_dir):
    """sums of attribution under 4-mers."""
    both = views.nseqs(spark, sf_dir).join(views.tracks(spark, sf_dir), "example_idx")
    return encode.kmers(both, 4, scores="values")


@query(
    """SELECT example_idx, CAST(gkmer AS BIGINT) AS gkmer, round(value, 6) AS value, n FROM (SELECT *, row_number() OVER (PARTITION BY example_idx ORDER BY abs(round(value, 9)) DESC, gkmer) AS rn FROM (
    SELECT example_idx, gkmer, sum(v) AS value, count(*) AS n FROM (
      WITH RECURSIVE base AS (SELECT n.example_idx, a.pos, instr('ACGT', seq[CAST(a.pos + 1 AS INT)]) - 1 AS c, a.value AS v FROM kseqs n JOIN attr a ON n.example_idx = a.example_idx),
      chain AS (SELECT example_idx, pos AS first, pos AS last, 1 AS k, (c + 1)::BIGINT AS code, v AS total FROM base
        UNION ALL SELECT x.example_idx, first, b.pos, k + 1, code + (b.c + 1) * pow(5, b.pos - first)::BIGINT, total + b.v FROM chain x JOIN base b ON x.example_idx = b.example_idx AND b.pos > last AND b.pos <= last + 2 AND b.pos - first < 8 WHERE k < 5)
      SELECT example_idx, code AS gkmer, total / k AS v FROM chain WHERE k >= 4) GROUP BY 1, 2)) WHERE rn <= 10""",
    views.KSEQS,
    views.ATTR,
)
def f11_gapped_kmers(spark, sf_dir):
    """the ten strongest gapped k-mers of four or five letters of each example."""
    # Rows meet before their positions do, by a merge: by their files' sizes all tables look small enough to broadcast.
    both = views.kseqs(spark, sf_dir).join(views.tracks(spark, sf_dir).hint("merge"), "example_idx")
    each = both.select("example_idx", "seq", F.posexplode("values").alias("pos", "value")).where(F.col("pos") < F.length("seq"))
    at = scalar.char_index(F.substring(F.col("seq"), F.col("pos") + 1, F.lit(1)), scalar.ALPHABET)
    hot = each.select("example_idx", "pos", at.alias("char_idx"), "value").where("char_idx is not null")
    out = encode.gapped_kmers(hot, min_k=4, max_k=5, max_gap=2, max_len=8)
    return out.select("example_idx", "gkmer", F.round("value", 6).alias("value"), "n")


@query("SELECT example_idx, CAST(c AS INT) AS chunk_idx, round(len(regexp_extract_all(substring(seq, CAST(c * 16 + 1 AS INT), 16), '[GC]')) / 16.0, 9) AS share FROM nseqs, generate_series(0, 3) AS t(c)", views.NSEQS)
def f12_char_share(spark, sf_dir):
    """share of G and C in adjacent windows."""
    return encode.chunk(views.nseqs(spark, sf_dir), 16).select("example_idx", "chunk_idx", F.round(scalar.char_share(F.col("seq"), "GC"), 9).alias("share"))


@query("SELECT regexp_full_match(seq, '[ACGT]*') AS known_only, count(*) AS n FROM nseqs GROUP BY 1", views.NSEQS)
def f13_validate(spark, sf_dir):
    """sequences are validated in the same pass that counts those without unknown letters."""
    valid = views.nseqs(spark, sf_dir).select(scalar.validate(F.col("seq")).alias("seq"))
    return valid.groupBy(F.col("seq").rlike("^[ACGT]*$").alias("known_only")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT example_idx, substring(seq, 1, 32) || 'GATTACAGCA' || substring(seq, 33) AS seq FROM kseqs", views.KSEQS)
def e01_insert(spark, sf_dir):
    """A motif spliced into the middle."""
    return views.kseqs(spark, sf_dir).select("example_idx", scalar.insert(F.col("seq"), "GATTACAGCA").alias("seq"))


@query("SELECT example_idx, substring(seq, 1, 27) || 'GATTACAGCA' || substring(seq, 38) AS seq FROM kseqs", views.KSEQS)
def e02_substitute(spark, sf_dir):
    """A motif written over the middle."""
    return views.kseqs(spark, sf_dir).select("example_idx", scalar.substitute(F.col("seq"), "GATTACAGCA").alias("seq"))


@query("SELECT example_idx, substring(seq, 1, 10) || 'GA' || substring(seq, 13, 2) || 'TA' || substring(seq, 17) AS seq FROM kseqs", views.KSEQS)
def e02_substitute_keep(spark, sf_dir):
    """N in the motif keeps what is there."""
    return views.kseqs(spark, sf_dir).select("example_idx", scalar.substitute(F.col("seq"), "GANNTA", 10).alias("seq"))


@query("SELECT example_idx, substring(seq, 1, 25) || 'ACGT' || substring(seq, 30, 3) || 'GGG' || substring(seq, 36, 2) || 'TTT' || substring(seq, 41) AS seq FROM kseqs", views.KSEQS)
def e03_multisubstitute(spark, sf_dir):
    """Three motifs with gaps of 3 and 2, centred."""
    return views.kseqs(spark, sf_dir).select("example_idx", scalar.multisubstitute(F.col("seq"), ["ACGT", "GGG", "TTT"], [3, 2]).alias("seq"))


@query("SELECT example_idx, substring(seq, 1, 10) || substring(seq, 21) AS seq FROM kseqs", views.KSEQS)
def e04_delete(spark, sf_dir):
    """Positions 10 to 19 removed."""
    return views.kseqs(spark, sf_dir).select("example_idx", scalar.delete(F.col("seq"), 10, 20).alias("seq"))


@query(
    """SELECT example_idx, CAST(i AS INT) AS shuffle_idx, substring(seq, 1, 8) || (SELECT string_agg(substring('ACGT', CAST(floor(CAST(CAST('0x' || substring(md5('5:' || example_idx || ':' || i || ':' || p), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 * 4) AS INT) + 1, 1), '' ORDER BY p)
    FROM generate_series(8, 15) AS q(p)) || substring(seq, 17) AS seq FROM kseqs, generate_series(0, 2) AS t(i)""",
    views.KSEQS,
)
def e05_randomize_hash(spark, sf_dir):
    """E5: a region drawn anew three times."""
    return edits.randomize(views.kseqs(spark, sf_dir), start=8, end=16, n=3, seed=5)


def shuffle_sql() -> str:
    random = np.random.RandomState(3)
    orders = ", ".join(f"({i}, [{', '.join(str(x) for x in random.permutation(20))}])" for i in range(3))
    return f"""SELECT example_idx, CAST(i AS INT) AS shuffle_idx, substring(seq, 1, 10) || array_to_string(list_transform(o, lambda x: seq[CAST(11 + x AS INT)]), '') || substring(seq, 31) AS seq
    FROM kseqs, (VALUES {orders}) AS t(i, o)"""


@query(shuffle_sql(), views.KSEQS)
def e06_shuffle(spark, sf_dir):
    """Positions 10 to 29 in three random orders, the same for all sequences."""
    return edits.shuffle(views.kseqs(spark, sf_dir), start=10, end=30, n=3, seed=3).select("example_idx", "shuffle_idx", "seq")


@query("SELECT example_idx, CAST(i AS INT) AS shuffle_idx, d AS pair, count(*) AS n FROM (SELECT example_idx, substring(seq, CAST(p AS INT), 2) AS d FROM kseqs, generate_series(1, 63) AS s(p)), generate_series(0, 1) AS t(i) GROUP BY ALL", views.KSEQS)
def e07_dinucleotide_pairs(spark, sf_dir):
    """Pairs of neighbours after a dinucleotide shuffle are those before it."""
    shuffled = edits.dinucleotide_shuffle(views.kseqs(spark, sf_dir), n=2, seed=0)
    pairs = encode.chunk(shuffled.withColumn("example_idx", F.struct("example_idx", "shuffle_idx")), 2, 1)
    return pairs.groupBy("example_idx.example_idx", "example_idx.shuffle_idx", F.col("seq").alias("pair")).agg(F.count(F.lit(1)).alias("n"))


LETTERS_OF = "letters AS (SELECT example_idx, seq, CAST(p AS INT) AS p, p - 1 AS pos FROM kseqs, generate_series(1, 64) AS t(p))"
MOST = "most AS (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM variants GROUP BY example_idx))"


@query("SELECT example_idx, string_agg(coalesce(substring('ACGT', v.char_idx + 1, 1), seq[p]), '' ORDER BY p) AS seq FROM letters k LEFT JOIN variants v USING (example_idx, pos) GROUP BY example_idx", views.KSEQS, views.VARIANTS, LETTERS_OF)
def v01_substitution(spark, sf_dir):
    """V1: all point edits of each sequence at once."""
    return edits.apply_substitutions(views.kseqs(spark, sf_dir), views.variants(spark, sf_dir))


@query(
    """SELECT k.example_idx, substring(any_value(seq), 1, 64 - any_value(m)) AS before, substring(coalesce(string_agg(seq[p], '' ORDER BY p) FILTER (WHERE v.char_idx IS NULL), ''), 1, 64 - any_value(m)) AS after
    FROM letters k LEFT JOIN variants v USING (example_idx, pos), most GROUP BY k.example_idx""",
    views.KSEQS,
    views.VARIANTS,
    LETTERS_OF,
    MOST,
)
def v02_deletion(spark, sf_dir):
    """V2: deletions, all examples trimmed alike."""
    return edits.apply_deletions(views.kseqs(spark, sf_dir), views.variants(spark, sf_dir))


@query("SELECT example_idx, right(string_agg(coalesce(substring('ACGT', v.char_idx + 1, 1), '') || seq[p], '' ORDER BY p), 64) AS seq FROM letters k LEFT JOIN variants v USING (example_idx, pos) GROUP BY example_idx", views.KSEQS, views.VARIANTS, LETTERS_OF)
def v03_insertion(spark, sf_dir):
    """V3: insertions, trimmed on the left."""
    return edits.apply_insertions(views.kseqs(spark, sf_dir), views.variants(spark, sf_dir), left=True)


@query(
    "SELECT example_idx, substring(string_agg(coalesce(letters_in, '') || seq[p], '' ORDER BY p), 1, 64) AS seq FROM letters k LEFT JOIN put USING (example_idx, pos) GROUP BY example_idx",
    views.KSEQS,
    views.INSERTS,
    "put AS (SELECT example_idx, pos, string_agg(substring('ACGT', char_idx + 1, 1), '' ORDER BY char_idx) AS letters_in FROM inserts GROUP BY 1, 2)",
    LETTERS_OF,
)
def v03_insertion_ties(spark, sf_dir):
    """V3: several insertions at one position all go in."""
    return edits.apply_insertions(views.kseqs(spark, sf_dir), views.inserts(spark, sf_dir))


@query("SELECT '> ' || example_idx || chr(10) || substring(seq, 1, 24) || chr(10) || substring(seq, 25, 24) || chr(10) || substring(seq, 49) || chr(10) AS record FROM kseqs", views.KSEQS)
def s08_fasta_records(spark, sf_dir):
    """Records as the FASTA writer forms them, with lines of 24 letters."""
    return views.kseqs(spark, sf_dir).select(readers.fasta_record(F.col("example_idx").cast("string"), F.col("seq"), 24).alias("record"))


@query(
    """SELECT p_partkey AS example_idx, (SELECT string_agg(CASE WHEN u < 0.1::DOUBLE THEN 'A' WHEN u < 0.1::DOUBLE + 0.2::DOUBLE THEN 'C' WHEN u < 0.1::DOUBLE + 0.2::DOUBLE + 0.3::DOUBLE THEN 'G' ELSE 'T' END, '' ORDER BY p) FROM (
    SELECT p, CAST(CAST('0x' || substring(md5('9:' || p_partkey || ':' || p), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM generate_series(0, 39) AS t(p))) AS seq FROM part"""
)
def s09_random_sequences(spark, sf_dir):
    """Random sequences from given letter probabilities, a hash for each letter."""
    keys = views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("example_idx"))
    return design.random_sequences(keys, 40, seed=9, probs=[0.1, 0.2, 0.3, 0.4])


MATRIX = [[0.8, 0.1, 0.05, 0.05], [0.1, 0.7, 0.1, 0.1], [0.05, 0.05, 0.8, 0.1]]
SCORES = " + ".join(f"CASE instr('ACGT', seq[CAST(p + {i + 1} AS INT)]) " + " ".join(f"WHEN {j + 1} THEN {float(np.log2((x + 1e-4) / 0.25))!r}::DOUBLE" for j, x in enumerate(column)) + " ELSE 0 END" for i, column in enumerate(MATRIX))


@query(f"SELECT example_idx, round(max(s), 6) AS best, count(*) AS n FROM (SELECT example_idx, 0.0::DOUBLE + {SCORES} AS s FROM nseqs, generate_series(0, 61) AS t(p)) GROUP BY example_idx", views.NSEQS)
def f17_pwm_scan(spark, sf_dir):
    """Extension: the best log-odds of a motif along each sequence."""
    scores = seqlets.pwm_scan(views.nseqs(spark, sf_dir), MATRIX)
    return scores.groupBy("example_idx").agg(F.round(F.max("score"), 6).alias("best"), F.count(F.lit(1)).alias("n"))
