"""Frames over positions of attribution tracks (example_idx, pos, value)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.operators.order import checkpointed


def sliding_sum(df: DataFrame, width: int) -> DataFrame:
    """(example_idx, pos, total): sums of width values from each position on; positions with fewer left are dropped."""
    w = Window.partitionBy("example_idx").orderBy("pos")
    ahead = w.rowsBetween(0, width - 1)
    sums = df.select("example_idx", "pos", F.sum("value").over(ahead).alias("total"), F.count(F.lit(1)).over(ahead).alias("n"))
    return sums.where(F.col("n") == width).drop("n")


def prefix_sum(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("example_idx").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return df.select("example_idx", "pos", F.sum("value").over(w).alias("total"))


def running_max(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.max(value).over(w))


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key, with their rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


#: Cells that the values around a wanted rank are counted in.
CELLS = 4096


def _cell(v: Column, low: Column, high: Column) -> Column:
    """The cell of a value between low and high, from 0 on; infinite ones have their own, before and after the others."""
    width = high / CELLS - low / CELLS
    inner = F.when(width > 0, F.floor(F.least((v - low) / width, F.lit(float(CELLS - 1))))).otherwise((v > low).cast("long"))
    return F.when(v == float("-inf"), -1).when(v == float("inf"), CELLS).otherwise(inner)


def quantiles(df: DataFrame, value: str, at: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, q0, q1, ...): exact quantiles by linear interpolation; NaN and null are left out, keys without values too.

    Without keys there is one row, of nulls if there are no values.  For every
    key the values of the ranks around each quantile are selected at once: a
    round counts the values of the cell that holds a rank in CELLS cells of its
    own, until a cell holds one value only.  No task sorts or holds the values
    of a key; a round counts CELLS numbers a key and rank at most, and one more
    round takes thousands of times more different values.  Null keys are keys.
    """
    names = [f"__k{i}" for i in range(len(keys or ()))]
    some = df.select(*[F.col(k).alias(n) for k, n in zip(keys or (), names, strict=True)], F.col(value).cast("double").alias("__v"))
    some = some.where(~F.isnan("__v") & F.col("__v").isNotNull())
    if not names:
        some, names = some.select(F.lit(0).alias("__k0"), "__v"), ["__k0"]
    same = lambda a, b: reduce(and_, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])
    finite = F.when(F.abs("__v") < float("inf"), F.col("__v"))
    sizes = some.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("least"), F.max("__v").alias("most"), F.min(finite).alias("low"), F.max(finite).alias("high"))
    spot = lambda q: F.lit(float(q)) * (F.col("__n") - 1)
    ranks = [x for q in at for x in (F.floor(spot(q)), F.least(F.floor(spot(q)) + 1, F.col("__n") - 1))]
    wanted = sizes.select(*names, F.posexplode(F.array(*ranks)).alias("spot", "rank"), "least", "most", "low", "high")
    wanted = checkpointed(wanted.withColumn("found", F.when(F.col("least") == F.col("most"), F.col("least"))))
    while not wanted.where("found is null").isEmpty():
        # In the first round the cell is everything; later ones hold finite values only.
        inside = F.col("w.whole") | F.col("v.__v").between(F.col("w.low"), F.col("w.high"))
        cells = wanted.where("found is null").select(*names, "low", "high", F.col("least").isNotNull().alias("whole")).distinct()
        met = some.alias("v").join(cells.alias("w"), same("v", "w") & inside).select(*[f"v.{n}" for n in names], "w.low", "w.high", "v.__v")
        counts = met.groupBy(*names, "low", "high", _cell(F.col("__v"), F.col("low"), F.col("high")).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("a"), F.max("__v").alias("b"))
        before = F.sum("n").over(Window.partitionBy(*names, "low", "high").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumn("before", F.coalesce(before, F.lit(0)))
        own = same("w", "c") & F.col("w.low").eqNullSafe(F.col("c.low")) & F.col("w.high").eqNullSafe(F.col("c.high"))
        hit = (F.col("w.rank") >= F.col("c.before")) & (F.col("w.rank") < F.col("c.before") + F.col("c.n"))
        none = F.lit(None).cast("double")
        nearer = wanted.where("found is null").alias("w").join(counts.alias("c"), own & hit).select(
            *[f"w.{n}" for n in names], "w.spot", (F.col("w.rank") - F.col("c.before")).alias("rank"), none.alias("least"), none.alias("most"),
            F.col("c.a").alias("low"), F.col("c.b").alias("high"), F.when(F.col("c.a") == F.col("c.b"), F.col("c.a")).alias("found"),
        )
        wanted = checkpointed(wanted.where("found is not null").union(nearer))
    of = lambda i: F.max(F.when(F.col("spot") == i, F.col("found")))
    picked = wanted.groupBy(*names).agg(*[of(i).alias(f"__s{i}") for i in range(2 * len(at))])
    joined = sizes.alias("z").join(picked.alias("p"), same("z", "p"))
    part = lambda q: spot(q) - F.floor(spot(q))
    # Between equal values, infinite ones among them, there is nothing to interpolate.
    value_of = lambda i, q: F.when((part(q) == 0) | (F.col(f"__s{2 * i}") == F.col(f"__s{2 * i + 1}")), F.col(f"__s{2 * i}")).otherwise(F.col(f"__s{2 * i}") + (F.col(f"__s{2 * i + 1}") - F.col(f"__s{2 * i}")) * part(q))
    out = joined.select(*[F.col(f"z.{n}").alias(k) for n, k in zip(names, keys or (), strict=False)], *[value_of(i, q).alias(f"q{i}") for i, q in enumerate(at)])
    return out if keys else out.agg(*[F.max(f"q{i}").alias(f"q{i}") for i in range(len(at))])


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) for values in [low, high]; the last bin holds high too."""
    at = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1))
    return df.where(F.col(value).between(low, high)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def empirical_rank(df: DataFrame, value: str, threshold: float, keys: list[str] | None = None) -> DataFrame:
    """Share of values whose absolute value is below a threshold."""
    return df.groupBy(*(keys or [])).agg(F.avg((F.abs(value) < threshold).cast("double")).alias("share"))
