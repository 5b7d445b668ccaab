"""Counts of annotations: alone, in pairs and by spacing.  Annotations: (example_idx, annotation_idx[, start, end])."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def count_annotations(df: DataFrame) -> DataFrame:
    """(example_idx, annotation_idx, n) for pairs, for annotations alone and for examples alone (null for what is summed over), in one pass."""
    sets = df.groupingSets([["example_idx", "annotation_idx"], ["annotation_idx"], ["example_idx"]], "example_idx", "annotation_idx")
    return sets.agg(F.count(F.lit(1)).alias("n"))


def count_matrix(df: DataFrame, n_annotations: int) -> DataFrame:
    """One row an example, a column a0, a1, ... for each annotation; annotations beyond raise, null ones count nowhere."""
    at = F.when(F.col("annotation_idx").isNull() | F.col("annotation_idx").between(0, n_annotations - 1), F.col("annotation_idx")).otherwise(F.raise_error(F.lit("annotation outside the shape")).cast("long"))
    some = df.select("example_idx", at.alias("annotation_idx"))
    counts = [F.count_if(F.col("annotation_idx") == i).alias(f"a{i}") for i in range(n_annotations)]
    return some.groupBy("example_idx").agg(*counts)


def pair_counts(df: DataFrame, *, unique: bool = True, symmetric: bool = True, order: str | None = None) -> DataFrame:
    """(a, b, n): pairs of annotations in the same example.

    unique counts a pair of annotations once an example.  symmetric counts
    (a, b) and (b, a) alike.  Otherwise, and not unique, a is the one that
    comes first by the order column.  Counting needs no join of rows: numbers
    of each annotation in an example are multiplied.
    """
    if unique:
        some = df.select("example_idx", "annotation_idx").distinct()
        a, b = (some.select("example_idx", F.col("annotation_idx").alias(x)) for x in "ab")
        pairs = a.join(b, "example_idx").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    elif symmetric:
        some = df.groupBy("example_idx", "annotation_idx").agg(F.count(F.lit(1)).alias("k"))
        a, b = (some.select("example_idx", F.col("annotation_idx").alias(x), F.col("k").alias(f"k{x}")) for x in "ab")
        times = F.when(F.col("a") == F.col("b"), F.col("ka") * (F.col("ka") - 1) / 2).otherwise(F.col("ka") * F.col("kb")).cast("long")
        pairs = a.join(b, "example_idx").where("a <= b").groupBy("a", "b").agg(F.sum(times).alias("n")).where("n > 0")
    else:
        # Earlier annotations of each kind, summed up to each row: linear in the rows of an example but for the kinds.
        w = Window.partitionBy("example_idx", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = df.select("example_idx", F.col("annotation_idx").alias("b"), F.col(order).alias("at"))
        kinds = rows.select("example_idx", F.col("b").alias("kind")).distinct()
        grid = rows.join(kinds, "example_idx").withColumn("seen", F.sum((F.col("b") == F.col("kind")).cast("long")).over(w) - (F.col("b") == F.col("kind")).cast("long"))
        return grid.groupBy(F.col("kind").alias("a"), "b").agg(F.sum("seen").alias("n")).where("n > 0")
    if not symmetric:
        return pairs
    return pairs.union(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))


def spacing_counts(df: DataFrame, max_distance: int = 100, *, symmetric: bool = True) -> DataFrame:
    """(a, b, distance, n): pairs in an example by the gap from the end of the left one to the start of the right one.

    The left one starts first; of equal starts the later row (by end, then
    annotation) is left.  Overlapping pairs and gaps of max_distance or more
    don't count.  The band join meets only annotations in the same or the next
    stretch of positions: no example is joined with itself as a whole.
    """
    rows = df.select("example_idx", "annotation_idx", "start", "end")
    left = rows.select("example_idx", F.col("annotation_idx").alias("a"), F.col("end").alias("left_end"), F.explode(F.array(F.floor(F.col("end") / max_distance), F.floor(F.col("end") / max_distance) + 1)).alias("bin"))
    right = rows.select("example_idx", F.col("annotation_idx").alias("b"), F.col("start").alias("right_start"), F.floor(F.col("start") / max_distance).alias("bin"))
    gap = F.col("right_start") - F.col("left_end")
    pairs = left.join(right, ["example_idx", "bin"]).where((gap >= 0) & (gap < max_distance)).groupBy("a", "b", gap.alias("distance")).agg(F.count(F.lit(1)).alias("n"))
    if not symmetric:
        return pairs
    both = pairs.union(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "distance", "n"))
    return both.groupBy("a", "b", "distance").agg(F.sum("n").alias("n"))
