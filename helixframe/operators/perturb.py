"""Model outputs before and after an edit.  A func maps a DataFrame with seq to one with more columns: a model's outputs, or attributions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import scalar
from helixframe.operators import edits, models

Func = Callable[[DataFrame], DataFrame]


def predicting(model: models.SqlModel) -> Func:
    return lambda df: models.predict(df, model)


def compare(before: DataFrame, after: DataFrame, func: Func) -> DataFrame:
    """func of both, in one plan, with variant: before or after; keys that only after has are null before."""
    extra = [c for c in after.columns if c not in before.columns]
    kinds = dict(after.dtypes)
    first = before.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in extra], F.lit("before").alias("variant"))
    return func(first.unionByName(after.withColumn("variant", F.lit("after"))))


def marginalize(df: DataFrame, motif: str, func: Func, start: int | None = None) -> DataFrame:
    """Each sequence as it is and with the motif written into it."""
    return compare(df, df.withColumn("seq", scalar.substitute(F.col("seq"), motif, start)), func)


def marginalize_annotations(df: DataFrame, backgrounds: DataFrame, spans: DataFrame, func: Func) -> DataFrame:
    """Each annotated span (example_idx, annotation_idx, start, end) of df written into the middle of every background (background_idx, seq).

    Backgrounds are the given second side of the experiment: every span meets every one of them.
    """
    motifs = spans.join(df, "example_idx").select("example_idx", "annotation_idx", "start", F.substring("seq", F.col("start") + 1, F.col("end") - F.col("start")).alias("motif"))
    both = motifs.crossJoin(backgrounds)
    at = (F.floor(F.length("seq") / 2) - F.floor(F.length("motif") / 2)).cast("int")
    after = both.withColumn("seq", scalar.substitute_column(F.col("seq"), F.col("motif"), at)).select("background_idx", "example_idx", "annotation_idx", "start", "seq")
    return compare(backgrounds.select("background_idx", "seq"), after, func)


def ablate(df: DataFrame, start: int, end: int, func: Func, *, n: int = 20, seed: int = 0) -> DataFrame:
    """Each sequence as it is and with [start, end) shuffled n times."""
    return compare(df, edits.shuffle(df, start=start, end=end, n=n, seed=seed), func)


def ablate_annotations(df: DataFrame, spans: DataFrame, func: Func, *, n: int = 20, seed: int = 0) -> DataFrame:
    """Each span (example_idx, annotation_idx, start, end) shuffled n times by a hash of seed, iteration and offset: spans of one length get one order."""
    rows = spans.join(df, "example_idx").withColumn("shuffle_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    offsets = F.sequence(F.lit(0), (F.col("end") - F.col("start") - 1).cast("int"))
    keyed = F.array_sort(F.transform(offsets, lambda i: F.struct(scalar.hash_unit(seed, F.col("shuffle_idx"), i).alias("u"), i.alias("i"))))
    after = rows.withColumn("seq", scalar.permute(F.col("seq"), F.transform(keyed, lambda x: x["i"]), F.col("start").cast("int")))
    return compare(df.select("example_idx", "seq"), after.select("example_idx", "annotation_idx", "start", "end", "shuffle_idx", "seq"), func)


def space(df: DataFrame, motifs: list[str], spacings: list[list[int]], func: Func, start: int | None = None) -> DataFrame:
    """Each sequence as it is and with all motifs at each of the spacings (spacing_idx)."""
    if any(len(s) != len(motifs) - 1 for s in spacings):
        raise ValueError("each spacing needs one gap fewer than there are motifs")
    rows = df.withColumn("g", F.explode(F.array(*[F.struct(F.lit(i).alias("spacing_idx"), F.array(*map(F.lit, s)).alias("gaps")) for i, s in enumerate(spacings)])))
    gaps = [F.col("g.gaps")[i] for i in range(len(motifs) - 1)]
    after = rows.withColumn("seq", scalar.multisubstitute(F.col("seq"), motifs, gaps, start)).withColumn("spacing_idx", F.col("g.spacing_idx")).drop("g")
    return compare(df, after, func)


def substitution_effect(df: DataFrame, variants: DataFrame, func: Func) -> DataFrame:
    return compare(df.select("example_idx", "seq"), edits.apply_substitutions(df, variants), func)


def deletion_effect(df: DataFrame, variants: DataFrame, func: Func, *, left: bool = False) -> DataFrame:
    both = edits.apply_deletions(df, variants, left=left)
    return compare(both.select("example_idx", F.col("before").alias("seq")), both.select("example_idx", F.col("after").alias("seq")), func)


def insertion_effect(df: DataFrame, variants: DataFrame, func: Func, *, left: bool = False) -> DataFrame:
    return compare(df.select("example_idx", "seq"), edits.apply_insertions(df, variants, left=left), func)


def apply_pairwise(df: DataFrame, args: DataFrame, func: Func) -> DataFrame:
    """func on every sequence with every row of args (zipped arguments); args are a stated set, smaller than the data."""
    return func(df.crossJoin(F.broadcast(args)) if args.count() <= 10_000 else df.crossJoin(args))


def apply_product(df: DataFrame, args: list[DataFrame], func: Func) -> DataFrame:
    """func on every sequence with every combination of one row of each args."""
    for a in args:
        df = df.crossJoin(F.broadcast(a) if a.count() <= 10_000 else a)
    return func(df)
