"""Queries of models, perturbations, attributions, design and streams."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from helixframe.operators import attribution, design, edits, models, perturb
from helixframe.operators.order import checkpointed, scratch
from helixframe.plans import views
from helixframe.plans.catalog import query
from helixframe.streaming import counts

FUNC = perturb.predicting(models.TOY)


def y(seq: str) -> str:
    """The toy model in SQL."""
    return f"CAST(coalesce(list_sum(list_transform(generate_series(1, length({seq})), lambda p: CASE WHEN instr('ACGT', ({seq})[CAST(p AS INT)]) > 0 THEN ((instr('ACGT', ({seq})[CAST(p AS INT)]) - 1) * 7 + (p - 1) * 3) % 11 - 5 ELSE 0 END)), 0) AS BIGINT)"


def z(seq: str) -> str:
    """The counting model in SQL."""
    return f"(len(regexp_extract_all({seq}, 'ACG')) * 3 - len(regexp_extract_all({seq}, 'TT')))"


def both(after: str, keys: str = "", source: str = "kseqs", before: str = "seq") -> str:
    """Before and after an edit."""
    names = "".join(f", CAST(NULL AS INT) AS {k}" for k in keys.split())
    own = "".join(f", {k}" for k in keys.split())
    return f"SELECT example_idx{names}, 'before' AS variant, {y(before)} AS y FROM kseqs UNION ALL SELECT example_idx{own}, 'after', {y('e')} FROM (SELECT example_idx{own}, {after} AS e FROM {source})"


@query(f"SELECT example_idx, {y('seq')} AS y FROM nseqs", views.NSEQS)
def p01_predict(spark, sf_dir):
    """A linear model, in generated code."""
    return FUNC(views.nseqs(spark, sf_dir)).select("example_idx", "y")


def numpy_weights() -> np.ndarray:
    c, p = np.meshgrid(np.arange(4), np.arange(64), indexing="ij")
    return ((c * 7 + p * 3) % 11 - 5).astype(np.float32)


@query(f"SELECT example_idx, CAST({y('seq')} AS DOUBLE) AS y FROM nseqs", views.NSEQS)
def p01_predict_numpy(spark, sf_dir):
    """The same model as a numpy function on batches."""
    weights = numpy_weights()
    out = models.predict_numpy(views.nseqs(spark, sf_dir), lambda x: (x * weights).sum((1, 2)))
    return out.select("example_idx", F.get("y", F.lit(0)).alias("y"))


@query(both("substring(seq, 1, 27) || 'GATTACAGCA' || substring(seq, 38)"), views.KSEQS)
def p02_marginalize(spark, sf_dir):
    """Outputs before and after a motif is written in."""
    return perturb.marginalize(views.kseqs(spark, sf_dir), "GATTACAGCA", FUNC).select("example_idx", "variant", "y")


@query(
    f"""SELECT -1 AS example_idx, -1 AS annotation_idx, -1 AS "start", background_idx, 'before' AS variant, {y('seq')} AS y FROM backs
    UNION ALL SELECT example_idx, annotation_idx, "start", background_idx, 'after', {y('e')} FROM (SELECT *, substring(seq, 1, 32 - length(m) // 2) || m || substring(seq, 33 - length(m) // 2 + length(m)) AS e
    FROM (SELECT a.example_idx, annotation_idx, "start", substring(k.seq, CAST("start" + 1 AS INT), CAST("end" - "start" AS INT)) AS m FROM annotations a JOIN kseqs k USING (example_idx)), backs)""",
    views.KSEQS,
    views.ANNOTATIONS,
    views.BACKGROUNDS,
)
def p03_marginalize_annotations(spark, sf_dir):
    """Each annotated span written into all backgrounds, one for each region."""
    seqs = views.kseqs(spark, sf_dir)
    backs = views.backgrounds(spark, sf_dir)
    spans = views.annotations(spark, sf_dir).select("example_idx", "annotation_idx", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    out = perturb.marginalize_annotations(seqs, backs, spans, FUNC)
    return out.select(*[F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c) for c in ("example_idx", "annotation_idx", "start")], "background_idx", "variant", "y")


def ablate_sql() -> str:
    random = np.random.RandomState(1)
    orders = ", ".join(f"({i}, [{', '.join(str(x) for x in random.permutation(12))}])" for i in range(4))
    after = "substring(seq, 1, 20) || array_to_string(list_transform(o, lambda x: seq[CAST(21 + x AS INT)]), '') || substring(seq, 33)"
    return f"SELECT example_idx, -1 AS shuffle_idx, 'before' AS variant, {y('seq')} AS y FROM kseqs UNION ALL SELECT example_idx, i, 'after', {y('e')} FROM (SELECT example_idx, i, {after} AS e FROM kseqs, (VALUES {orders}) AS t(i, o))"


@query(ablate_sql(), views.KSEQS)
def p04_ablate(spark, sf_dir):
    """Outputs before and after a region is shuffled four times."""
    out = perturb.ablate(views.kseqs(spark, sf_dir), 20, 32, FUNC, n=4, seed=1)
    return out.select("example_idx", F.coalesce("shuffle_idx", F.lit(-1)).alias("shuffle_idx"), "variant", "y")


ORDERED = """list_sort(list_transform(generate_series(0, CAST("end" - "start" - 1 AS INT)), lambda i: {'u': CAST('0x' || substring(md5('0:' || s || ':' || i), 1, 8) AS BIGINT), 'i': i}))"""


@query(
    f"""SELECT example_idx, -1 AS annotation_idx, -1 AS "start", -1 AS "end", -1 AS shuffle_idx, 'before' AS variant, {y('seq')} AS y FROM kseqs
    UNION ALL SELECT example_idx, annotation_idx, "start", "end", CAST(s AS INT), 'after', {y('e')} FROM (SELECT *, substring(seq, 1, CAST("start" AS INT)) || array_to_string(list_transform({ORDERED}, lambda x: seq[CAST("start" + 1 + x.i AS INT)]), '') || substring(seq, CAST("end" + 1 AS INT)) AS e
    FROM annotations JOIN kseqs USING (example_idx), generate_series(0, 1) AS t(s))""",
    views.KSEQS,
    views.ANNOTATIONS,
)
def p05_ablate_annotations(spark, sf_dir):
    """P5: each annotated span shuffled twice."""
    out = perturb.ablate_annotations(views.kseqs(spark, sf_dir), views.annotations(spark, sf_dir), FUNC, n=2)
    return out.select("example_idx", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("annotation_idx", "start", "end", "shuffle_idx")], "variant", "y")


@query(
    f"""SELECT example_idx, -1 AS spacing_idx, 'before' AS variant, {y('seq')} AS y FROM kseqs UNION ALL SELECT example_idx, i, 'after', {y('e')} FROM (SELECT example_idx, i,
    substring(seq, 1, 10) || 'ACGT' || substring(seq, 15, g) || 'GGA' || substring(seq, 18 + g) AS e FROM kseqs, (VALUES (0, 0), (1, 3), (2, 7)) AS t(i, g))""",
    views.KSEQS,
)
def p06_space(spark, sf_dir):
    """Two motifs at three spacings."""
    out = perturb.space(views.kseqs(spark, sf_dir), ["ACGT", "GGA"], [[0], [3], [7]], FUNC, start=10)
    return out.select("example_idx", F.coalesce("spacing_idx", F.lit(-1)).alias("spacing_idx"), "variant", "y")


EDITED = "substring(seq, 1, CAST(p AS INT)) || substring('ACGT', CAST(c + 1 AS INT), 1) || substring(seq, CAST(p + 2 AS INT))"


@query(f"SELECT example_idx, CAST(p AS INT) AS pos, CAST(c AS INT) AS char_idx, substring('ACGT', CAST(c + 1 AS INT), 1) = seq[CAST(p + 1 AS INT)] AS is_ref, {z('seq')} AS y0, {z(EDITED)} AS y FROM kseqs, generate_series(20, 43) AS s(p), generate_series(0, 3) AS t(c)", views.KSEQS)
def m01_saturation_mutagenesis(spark, sf_dir):
    """M1: every single edit of a window."""
    return attribution.saturation_mutagenesis(views.kseqs(spark, sf_dir), models.COUNTER, start=20, end=44)


@query(
    f"""SELECT example_idx, pos, char_idx, round(v, 6) AS value FROM (SELECT example_idx, CAST(p AS INT) AS pos, CAST(c AS INT) AS char_idx, seq, ({z(EDITED)} - {z('seq')}) - avg({z(EDITED)} - {z('seq')}) OVER (PARTITION BY example_idx, p) AS v
    FROM kseqs, generate_series(20, 43) AS s(p), generate_series(0, 3) AS t(c)) WHERE substring('ACGT', char_idx + 1, 1) = seq[pos + 1]""",
    views.KSEQS,
)
def m02_mutagenesis_attribution(spark, sf_dir):
    """M2: attributions of the letters that are there."""
    rows = attribution.saturation_mutagenesis(views.kseqs(spark, sf_dir), models.COUNTER, start=20, end=44)
    return attribution.mutagenesis_attribution(rows).select("example_idx", "pos", "char_idx", F.round("value", 6).alias("value"))


def rotated(spark, sf_dir):
    """Two references of each sequence: read backwards, and its other strand."""
    seqs = views.kseqs(spark, sf_dir)
    return seqs.select("example_idx", F.posexplode(F.array(F.reverse("seq"), F.translate("seq", "ACGT", "TGCA"))).alias("shuffle_idx", "seq"))


W = "CASE WHEN instr('ACGT', {0}) > 0 THEN ((instr('ACGT', {0}) - 1) * 7 + (p - 1) * 3) % 11 - 5 ELSE 0 END"
OWN, BACK, OTHER = (W.format(x) for x in ("seq[CAST(p AS INT)]", "reverse(seq)[CAST(p AS INT)]", "translate(seq, 'ACGT', 'TGCA')[CAST(p AS INT)]"))


@query(f"SELECT example_idx, CAST(p - 1 AS INT) AS pos, {OWN} - (({BACK}) + ({OTHER})) / 2.0::DOUBLE AS value FROM kseqs, generate_series(1, 64) AS t(p)", views.KSEQS)
def m03_deep_lift_linear(spark, sf_dir):
    """M3: attributions of the linear model in closed form."""
    return attribution.linear_deep_lift(views.kseqs(spark, sf_dir), rotated(spark, sf_dir), models.toy_weight)


@query(
    f"SELECT example_idx, CAST(p - 1 AS INT) AS pos, round({OWN} - (({BACK}) + ({OTHER})) / 2.0::DOUBLE, 6) AS value FROM kseqs, generate_series(1, 64) AS t(p)",
    views.KSEQS,
)
def m03_deep_lift_graph(spark, sf_dir):
    """M3: the same attributions by multipliers of a layer graph."""
    graph = attribution.Graph([attribution.flatten(), attribution.dense(numpy_weights().reshape(1, -1).astype(float))])
    out = attribution.deep_lift_shap(views.kseqs(spark, sf_dir), graph, references=rotated(spark, sf_dir))
    rows = out.select("example_idx", F.posexplode("attribution").alias("i", "v"))
    return rows.groupBy("example_idx", (F.col("i") % 64).alias("pos")).agg(F.round(F.sum("v"), 6).alias("value"))


MARGINS = "margins AS (SELECT example_idx, 'before' AS variant, seq FROM kseqs UNION ALL SELECT example_idx, 'after', substring(seq, 1, 27) || 'GATTACAGCA' || substring(seq, 38) FROM kseqs)"


@query(
    f"SELECT example_idx, variant, CAST(p AS INT) AS pos, CAST(c AS INT) AS char_idx, substring('ACGT', CAST(c + 1 AS INT), 1) = seq[CAST(p + 1 AS INT)] AS is_ref, {z('seq')} AS y0, {z(EDITED)} AS y FROM margins, generate_series(24, 39) AS s(p), generate_series(0, 3) AS t(c)",
    views.KSEQS,
    MARGINS,
)
def p07_marginalize_mutagenesis(spark, sf_dir):
    """Every single edit of a window, before and after a motif is written in."""
    return perturb.marginalize(views.kseqs(spark, sf_dir), "GATTACAGCA", lambda df: attribution.saturation_mutagenesis(df, models.COUNTER, start=24, end=40))


@query(
    f"""SELECT example_idx, variant, pos, char_idx, round(v, 6) AS value FROM (SELECT example_idx, variant, CAST(p AS INT) AS pos, CAST(c AS INT) AS char_idx, seq, ({z(EDITED)} - {z('seq')}) - avg({z(EDITED)} - {z('seq')}) OVER (PARTITION BY example_idx, variant, p) AS v
    FROM margins, generate_series(24, 39) AS s(p), generate_series(0, 3) AS t(c)) WHERE substring('ACGT', char_idx + 1, 1) = seq[pos + 1]""",
    views.KSEQS,
    MARGINS,
)
def p07_marginalize_mutagenesis_attribution(spark, sf_dir):
    """Attributions by mutagenesis, before and after a motif is written in."""
    func = lambda df: attribution.mutagenesis_attribution(attribution.saturation_mutagenesis(df, models.COUNTER, start=24, end=40))
    return perturb.marginalize(views.kseqs(spark, sf_dir), "GATTACAGCA", func).withColumn("value", F.round("value", 6))


@query(
    f"""SELECT m.example_idx, variant, CAST(p - 1 AS INT) AS pos, {W.format('m.seq[CAST(p AS INT)]')} - (({W.format('reverse(k.seq)[CAST(p AS INT)]')}) + ({W.format("translate(k.seq, 'ACGT', 'TGCA')[CAST(p AS INT)]")})) / 2.0::DOUBLE AS value
    FROM margins m JOIN kseqs k USING (example_idx), generate_series(1, 64) AS t(p)""",
    views.KSEQS,
    MARGINS,
)
def p07_marginalize_linear_deep_lift(spark, sf_dir):
    """Attributions of the linear model against the example's own references, before and after a motif is written in."""
    refs = rotated(spark, sf_dir)
    return perturb.marginalize(views.kseqs(spark, sf_dir), "GATTACAGCA", lambda df: attribution.linear_deep_lift(df, refs, models.toy_weight))


@query()
def m04_deep_lift_convolution(spark, sf_dir):
    """M4 to M7: rescale rules through convolution, ReLU and pooling, against dinucleotide shuffles."""
    out = attribution.deep_lift_shap(views.kseqs(spark, sf_dir), attribution.toy_graph(64), n_shuffles=4)
    return out.select("example_idx", "output_idx", "converged", F.size("attribution").alias("n"))


@query()
def m08_pisa(spark, sf_dir):
    """M8: attributions of every output of a graph."""
    out = attribution.pisa(views.kseqs(spark, sf_dir), attribution.toy_graph(64, outputs=3), 3, references=rotated(spark, sf_dir))
    return out.select("example_idx", "output_idx", "converged", F.size("attribution").alias("n"))


HOT = "hot AS (SELECT example_idx, CAST(pos // 4 AS INT) AS pos, CAST(pos % 4 AS INT) AS char_idx, value AS m, CASE WHEN pos % 4 = (example_idx + pos // 4) % 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS r FROM attr)"


@query("SELECT example_idx, pos, char_idx, m - sum(m * r) OVER (PARTITION BY example_idx, pos) + 0.0 AS value FROM hot", views.ATTR, HOT)
def f16_hypothetical(spark, sf_dir):
    """F16: hypothetical attributions from multipliers and one-hot references."""
    rows = views.attr(spark, sf_dir).select("example_idx", F.floor(F.col("pos") / 4).cast("int").alias("pos"), (F.col("pos") % 4).cast("int").alias("char_idx"), F.col("value").alias("m"))
    refs = rows.where(F.col("char_idx") == (F.col("example_idx") + F.col("pos")) % 4).select("example_idx", "pos", "char_idx", F.lit(1.0).alias("r"))
    out = attribution.hypothetical_attributions(rows, refs)
    return out.select("example_idx", "pos", "char_idx", (F.col("value") + F.lit(0.0)).alias("value"))


@query(f"SELECT example_idx, arg_idx, {y('seq')} * k AS y FROM kseqs, (VALUES (0, 2), (1, -1), (2, 5)) AS t(arg_idx, k)", views.KSEQS)
def l14_pairwise(spark, sf_dir):
    """Every sequence with every row of zipped arguments."""
    args = spark.createDataFrame([(0, 2), (1, -1), (2, 5)], "arg_idx int, k int")
    return perturb.apply_pairwise(views.kseqs(spark, sf_dir), args, FUNC).select("example_idx", "arg_idx", (F.col("y") * F.col("k")).alias("y"))


@query(f"SELECT example_idx, a, b, {y('seq')} * a + b AS y FROM kseqs, (VALUES (2), (-1)) AS t(a), (VALUES (7), (0), (3)) AS u(b)", views.KSEQS)
def l15_product(spark, sf_dir):
    """Every sequence with every combination of arguments."""
    a, b = spark.createDataFrame([(2,), (-1,)], "a int"), spark.createDataFrame([(7,), (0,), (3,)], "b int")
    return perturb.apply_product(views.kseqs(spark, sf_dir), [a, b], FUNC).select("example_idx", "a", "b", (F.col("y") * F.col("a") + F.col("b")).alias("y"))


VARIANT_LETTERS = "letters AS (SELECT example_idx, seq, CAST(p AS INT) AS p, p - 1 AS pos FROM kseqs, generate_series(1, 64) AS t(p))"


@query(
    f"SELECT example_idx, 'before' AS variant, {y('seq')} AS y FROM kseqs UNION ALL SELECT example_idx, 'after', {y('e')} FROM (SELECT example_idx, string_agg(coalesce(substring('ACGT', v.char_idx + 1, 1), seq[p]), '' ORDER BY p) AS e FROM letters k LEFT JOIN variants v USING (example_idx, pos) GROUP BY example_idx)",
    views.KSEQS,
    views.VARIANTS,
    VARIANT_LETTERS,
)
def v01_substitution_effect(spark, sf_dir):
    """V1: outputs before and after all substitutions."""
    return perturb.substitution_effect(views.kseqs(spark, sf_dir), views.variants(spark, sf_dir), FUNC).select("example_idx", "variant", "y")


@query(
    f"SELECT example_idx, loss FROM (SELECT example_idx, pow({y('seq')} - 40, 2)::DOUBLE AS loss FROM kseqs) ORDER BY loss, example_idx LIMIT 20",
    views.KSEQS,
)
def d01_screen(spark, sf_dir):
    """The twenty sequences nearest to a target output, as the report asks for."""
    return design.screen(views.kseqs(spark, sf_dir), models.TOY, design.distance_to(40), n_best=20).select("example_idx", "loss")


@query(
    f"""SELECT round, example_idx, seq, loss FROM (SELECT *, row_number() OVER (ORDER BY loss, round, example_idx) AS n FROM (
    SELECT *, min(round) FILTER (good >= 5) OVER () AS last FROM (SELECT *, count(*) FILTER (loss < 2.5) OVER (ORDER BY round RANGE UNBOUNDED PRECEDING) AS good FROM (
    SELECT round, example_idx, seq, pow({y('seq')} - 70, 2)::DOUBLE AS loss FROM (SELECT r::INT AS round, p_partkey AS example_idx, (SELECT string_agg(substring('ACGT', CAST(floor(u * 4) AS INT) + 1, 1), '' ORDER BY p) FROM (
    SELECT p, CAST(CAST('0x' || substring(md5((3 + r) || ':' || p_partkey || ':' || p), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM generate_series(0, 63) AS t(p))) AS seq FROM part, generate_series(0, 5) AS s(r))))) WHERE last IS NULL OR round <= last) WHERE n <= 5"""
)
def d01_screen_rounds(spark, sf_dir):
    """Rounds of random sequences until the five best are near enough to a target output, six at most."""
    keys = views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("example_idx"))
    return design.screen_rounds(keys, models.TOY, design.distance_to(70), lambda k, s: design.random_sequences(k, 64, seed=s), n_best=5, tol=2.5, max_iter=6, seed=3)


@query(
    f"""SELECT example_idx, CAST(pos AS INT) AS pos, CAST(c AS INT) AS char_idx, c = r AS is_ref, y0, CAST(y0 + (c * 7 + pos * 3) % 11 - (r * 7 + pos * 3) % 11 AS BIGINT) AS y
    FROM (SELECT example_idx, y0, pos, instr('ACGT', seq[CAST(pos + 1 AS INT)]) - 1 AS r FROM (SELECT example_idx, seq, {y('seq')} AS y0 FROM kseqs), generate_series(0, 63) AS s(pos)), generate_series(0, 3) AS t(c)""",
    views.KSEQS,
)
def m01_local_mutagenesis(spark, sf_dir):
    """M1: every single edit of whole sequences for a local model, a letter scored for each."""
    return attribution.saturation_mutagenesis(views.kseqs(spark, sf_dir), models.TOY)


TRIES = "tries AS (SELECT * FROM (VALUES (0, 'ACG'), (1, 'TTTA'), (2, 'CGT'), (3, 'TAAA')) AS t(i, m))"
POOL = "pool AS (SELECT * FROM kseqs)"


@query(
    f"""SELECT example_idx, CASE WHEN b.l < a.l THEN b.e ELSE seq END AS seq, least(a.l, b.l) AS loss FROM (SELECT example_idx, seq, 0.0::DOUBLE - CAST({z('seq')} AS DOUBLE) AS l FROM pool) a JOIN
    (SELECT example_idx, x.l AS l, x.e AS e FROM (SELECT example_idx, min({{'l': l, 'i': i, 'p': p, 'e': e}}) AS x FROM (SELECT example_idx, i, p, e, 0.0::DOUBLE - CAST({z('e')} AS DOUBLE) AS l FROM
    (SELECT example_idx, i, p, substring(seq, 1, CAST(p AS INT)) || m || substring(seq, CAST(p + length(m) + 1 AS INT)) AS e FROM pool, tries, generate_series(0, 61) AS t(p) WHERE p + length(m) <= 64)) GROUP BY example_idx)) b USING (example_idx)""",
    views.KSEQS,
    TRIES,
    POOL,
)
def d02_greedy_round(spark, sf_dir):
    """The best single substitution of each sequence."""
    return design.greedy_round(views.kseqs(spark, sf_dir), models.COUNTER, design.highest(), ["ACG", "TTTA"])


def rounds_sql(n: int) -> list[str]:
    """Tables r0 to rn of (example_idx, seq, loss): each sequence after so many greedy rounds."""
    out = [f"r0 AS MATERIALIZED (SELECT example_idx, seq, 0.0::DOUBLE - CAST({z('seq')} AS DOUBLE) AS loss FROM kseqs)"]
    for i in range(n):
        edit = "substring(seq, 1, CAST(p AS INT)) || m || substring(seq, CAST(p + length(m) + 1 AS INT))"
        out.append(f"""r{i + 1} AS MATERIALIZED (SELECT a.example_idx, CASE WHEN b.l < a.loss THEN b.e ELSE seq END AS seq, least(a.loss, b.l) AS loss FROM r{i} a JOIN
    (SELECT example_idx, x.l AS l, x.e AS e FROM (SELECT example_idx, min({{'l': l, 'i': i, 'p': p, 'e': e}}) AS x FROM (SELECT example_idx, i, p, e, 0.0::DOUBLE - CAST({z('e')} AS DOUBLE) AS l FROM
    (SELECT example_idx, i, p, {edit} AS e FROM r{i}, tries, generate_series(0, 61) AS t(p) WHERE p + length(m) <= 64)) GROUP BY example_idx)) b USING (example_idx))""")
    return out


def beams_sql(n: int) -> list[str]:
    """Tables b0 to bn of (seq, loss): the four best after so many rounds of a beam."""
    out = [f"b0 AS MATERIALIZED (SELECT seq, 0.0::DOUBLE - CAST({z('seq')} AS DOUBLE) AS loss FROM kseqs ORDER BY loss, example_idx LIMIT 4)"]
    for i in range(n):
        out.append(f"""b{i + 1} AS MATERIALIZED (SELECT seq, loss FROM (SELECT seq, min(l) AS loss, min({{'i': i, 'p': p}}) AS c FROM (SELECT seq, loss AS l, -1 AS i, -1 AS p FROM b{i} UNION ALL
    SELECT e, 0.0::DOUBLE - CAST({z('e')} AS DOUBLE), i, p FROM (SELECT i, p, substring(seq, 1, CAST(p AS INT)) || m || substring(seq, CAST(p + length(m) + 1 AS INT)) AS e FROM b{i}, tries, generate_series(0, 61) AS t(p) WHERE p + length(m) <= 64)) GROUP BY seq) ORDER BY loss, c, seq LIMIT 4)""")
    return out


@query("SELECT example_idx, seq, loss FROM r3", views.KSEQS, TRIES, *rounds_sql(3))
def d02_greedy_substitution(spark, sf_dir):
    """Three rounds."""
    return design.greedy_substitution(views.kseqs(spark, sf_dir), models.COUNTER, design.highest(), ["ACG", "TTTA"], max_iter=3)


@query(
    f"""SELECT seq, loss FROM (SELECT seq, min(l) AS loss, min({{'i': i, 'p': p}}) AS c FROM (SELECT seq, 0.0::DOUBLE - CAST({z('seq')} AS DOUBLE) AS l, -1 AS i, -1 AS p FROM pool UNION ALL
    SELECT e, 0.0::DOUBLE - CAST({z('e')} AS DOUBLE), i, p FROM (SELECT i, p, substring(seq, 1, CAST(p AS INT)) || m || substring(seq, CAST(p + length(m) + 1 AS INT)) AS e FROM pool, tries, generate_series(0, 61) AS t(p) WHERE p + length(m) <= 64)) GROUP BY seq) ORDER BY loss, c, seq LIMIT 4""",
    views.KSEQS,
    TRIES,
    POOL,
)
def d03_beam_round(spark, sf_dir):
    """D3: the four best sequences after a round that starts from all."""
    return design.beam_round(views.kseqs(spark, sf_dir), models.COUNTER, design.highest(), 4, ["ACG", "TTTA"]).select("seq", "loss")


@query("SELECT seq, loss FROM b3 ORDER BY loss, seq LIMIT 1", views.KSEQS, TRIES, *beams_sql(3))
def d03_beam_substitution(spark, sf_dir):
    """D3: a beam of four from the best screened sequences on."""
    best = design.screen(views.kseqs(spark, sf_dir), models.COUNTER, design.highest(), n_best=4)
    return design.beam_substitution(checkpointed(best.select("seq")), models.COUNTER, design.highest(), ["ACG", "TTTA"], max_iter=3)


@query()
def d04_greedy_marginalize(spark, sf_dir):
    """A construct whose mean effect on all backgrounds is near 9."""
    seqs = views.kseqs(spark, sf_dir)
    construct, start = design.greedy_marginalize(seqs, models.COUNTER, 9.0, ["ACGACG", "ACG"], max_spacing=3, max_iter=3)
    shown = perturb.marginalize(seqs, construct, perturb.predicting(models.COUNTER), start)
    return shown.groupBy("variant").agg(F.avg("y").alias("mean_y")).withColumn("construct", F.lit(construct)).withColumn("start", F.lit(start))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def s01_stream_counts(spark, sf_dir):
    """Streaming: counts of events by day, the table read as a stream."""
    edits_dir = scratch(spark)
    counts.run_once(counts.windowed_counts(counts.stream_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "event_type"), f"{edits_dir}/out", f"{edits_dir}/state")
    return counts.latest(spark.read.parquet(f"{edits_dir}/out"), ["window_start", "event_type"]).select("window_start", "event_type", "n", F.round("total", 4).alias("total"))



@query("SELECT example_idx, CAST(i AS INT) AS shuffle_idx, length(seq) AS n, seq[1] AS first, seq[64] AS last FROM kseqs, generate_series(0, 1) AS t(i)", views.KSEQS)
def e07_dinucleotide_ends(spark, sf_dir):
    """A dinucleotide shuffle keeps length, first and last letter."""
    out = edits.dinucleotide_shuffle(views.kseqs(spark, sf_dir), n=2, seed=0)
    return out.select("example_idx", "shuffle_idx", F.length("seq").cast("long").alias("n"), F.substring("seq", 1, 1).alias("first"), F.substring("seq", 64, 1).alias("last"))
