"""Mixing sources to target weights by Poisson replication.

Every document gets a repetition count drawn from a Poisson distribution whose
mean is the target repetition rate of its source.  The draw inverts the
distribution at a number hashed from seed and document, so that it does not
depend on partitions, order or retries.  A document is a row: the hash covers
all its columns, so that neither a null nor a repeated id ties draws together.
Rows equal in every column can't be told apart; as sums of Poisson numbers are
Poisson, a lot of n of them gets one draw of n times the rate.  Documents are
exploded by their count and dealt out by a hash of document and copy: one
global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.cluster import cut, few, hashable

#: Largest mean that is inverted at once; a larger one is a sum of equal independent parts.
PART_RATE = 64.0
#: Sources whose table may be broadcast; beyond, the join shuffles and adaptive execution splits hot sources.
BROADCAST_SOURCES = 10_000
#: Equal rows that share a draw; more of them are several lots.
LOT = 1024


def unit(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) with 52 hashed bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *cols)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= j) for j = 0, 1, ... to where the rest is below the hash's resolution."""
    last = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(30.0)).cast("int")
    step = lambda s, j: F.struct(
        (s["p"] * rate / j).alias("p"),
        (s["total"] + s["p"] * rate / j).alias("total"),
        F.concat(s["all"], F.array(s["total"] + s["p"] * rate / j)).alias("all"),
    )
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("total"), F.array(first).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["all"])


def source_rates(docs: DataFrame, source_col: str = "source", *, weights: dict | None = None, exponent: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """One row a source: __source, __rate (mean repetitions of its documents), __cdf (of a document's draw, or of each of its parts).

    weights: target share of the mix by source (a source without one gets 0);
    without weights the share is proportional to the source's rows to the power
    exponent.  The mix has epochs times the input's rows in expectation.
    A null source is a source like any other.
    """
    sizes = docs.groupBy(F.col(source_col).alias("__source")).agg(F.count(F.lit(1)).alias("__rows"))
    if weights is None:
        share = F.pow(F.col("__rows").cast("double"), F.lit(exponent))
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("__source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(share)
    sizes = sizes.withColumn("__share", share)
    total = sizes.agg(F.sum("__share"), F.sum("__rows")).first()
    shares, rows = (total[0] or 1.0), (total[1] or 0)
    rate = F.col("__share") / F.lit(float(shares)) * F.lit(float(rows) * epochs) / F.col("__rows")
    sizes = sizes.withColumn("__rate", rate)
    parts = F.greatest(F.lit(1), F.ceil(F.col("__rate") / F.lit(PART_RATE)).cast("int"))
    return sizes.withColumn("__cdf", poisson_cdf(F.col("__rate") / parts)).drop("__share", "__rows")


def row_key(docs: DataFrame) -> Column:
    """MD5 over all columns, each as its number of characters and its text; rows of one key are equal in every column."""
    parts = []
    for c, field in zip(hashable(docs), docs.schema.fields, strict=True):
        kind = field.dataType.simpleString()
        c = F.hex(c) if kind == "binary" else F.to_json(F.struct(c)) if "<" in kind and "map<" not in kind else c.cast("string")
        parts.append(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")))
    return F.md5(F.concat(*parts))


def drawn(rows: DataFrame, rates: DataFrame, seed: str) -> DataFrame:
    """rows (row, of, key, times, lot) with their rate and number of copies, without those that get none."""
    mean = F.col("__rate") * F.col("times")
    parts = F.greatest(F.lit(1), F.ceil(mean / F.lit(PART_RATE)).cast("int"))
    joined = rows.join(rates, F.col("of").eqNullSafe(F.col("__source")))
    # The distribution of one row is worked out once a source.
    joined = joined.withColumn("parts", parts).withColumn("cdf", F.when(F.col("times") == 1, F.col("__cdf")).otherwise(poisson_cdf(mean / F.col("parts"))))
    joined = joined.withColumn("u", unit(seed, F.col("key"), F.col("lot").cast("string"), F.lit("1")))
    draw = lambda part: F.size(F.filter(F.col("cdf"), lambda c: c <= unit(seed, F.col("key"), F.col("lot").cast("string"), part.cast("string"))))
    count = F.when(F.col("parts") == 1, F.size(F.filter(F.col("cdf"), lambda c: c <= F.col("u")))).otherwise(F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda n, part: n + draw(part)))
    return joined.select("row", "key", "lot", F.col("__rate").alias("rate"), count.alias("copies")).where("copies > 0")


def poisson_mix(docs: DataFrame, *, source_col: str = "source", weights: dict | None = None, exponent: float = 0.5, epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """All columns of docs, with mix_rate, mix_copies, mix_copy (from 0) and mix_key, dealt out and ordered by mix_key in each partition.

    The draw depends on seed and row: rows that share an id, or have none, are
    drawn for independently.  Rows equal in every column are drawn for in lots
    of LOT: mix_copies is what their lot gets, mix_copy counts through it.
    Null sources are a source.  Texts are only hashed and carried, so null,
    empty and long ones are as good as any; an empty table gives an empty
    table.  Columns of docs that are called as one of the new ones are replaced.
    """
    rates = source_rates(docs, source_col, weights=weights, exponent=exponent, epochs=epochs)
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    docs = docs.select(*[c for c in docs.columns if c not in ("mix_rate", "mix_copies", "mix_copy", "mix_key")])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(source_col).alias("of"), row_key(docs).alias("key"))
    # Only keys are shuffled to find equal rows, pre-aggregated; their rows are single ones from there on.
    equal = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    one = F.lit(1).cast("long")
    dealt = rows.select("row", "of", "key", one.alias("times"), F.lit(0).cast("long").alias("lot"))
    if not equal.isEmpty():
        mine = few(equal.select("key"))
        lots = rows.join(mine, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row"), F.first("of").alias("of")).join(equal, "key")
        lots = lots.select("row", "of", "key", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LOT))).alias("lot"))
        lots = lots.repartition("key", "lot").select("row", "of", "key", F.least(F.lit(LOT).cast("long"), F.col("n") - F.col("lot") * LOT).alias("times"), "lot")
        dealt = dealt.join(mine, "key", "left_anti").select(*dealt.columns).union(lots)
    mixed = drawn(dealt, rates, seed).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    at = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("place"), F.col("key"), F.col("lot").cast("string"), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    mixed = mixed.select("row", F.col("rate").alias("mix_rate"), F.col("copies").alias("mix_copies"), F.col("copy").alias("mix_copy"), at.alias("mix_key"))
    mixed = mixed.select("row.*", "mix_rate", "mix_copies", "mix_copy", "mix_key")
    return mixed.repartition("mix_key").sortWithinPartitions("mix_key")


def op2_poisson_mix(spark, sf_dir: str) -> DataFrame:
    """Documents mixed with shares proportional to the root of the sources' sizes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mixed = poisson_mix(docs)
    return mixed.select("doc_id", "source", F.round("mix_rate", 9).alias("mix_rate"), "mix_copies", "mix_copy", "mix_key", "text")


OP2_SQL = """
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
total AS (SELECT sum(pow(n, 0.5)) AS z, sum(n) AS n FROM sizes),
rates AS (SELECT source, pow(sizes.n, 0.5) / z * CAST(total.n AS DOUBLE) / sizes.n AS rate FROM sizes, total),
equal AS (SELECT doc_id, source, text, count(*) AS n FROM documents GROUP BY doc_id, source, text),
lots AS (SELECT doc_id, source, text, lot, least(1024, n - lot * 1024) AS times,
    md5(coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(length(source) || ':' || source, '-') || coalesce(length(text) || ':' || text, '-')) AS key
  FROM equal, unnest(range(0, (n - 1) // 1024 + 1)) AS t(lot)),
parts AS (SELECT source, times, rate, greatest(1, CAST(ceil(rate * times / 64.0) AS INT)) AS parts FROM (SELECT DISTINCT source, times FROM lots) l JOIN rates r USING (source)
  UNION ALL SELECT NULL, times, rate, greatest(1, CAST(ceil(rate * times / 64.0) AS INT)) FROM (SELECT DISTINCT times FROM lots WHERE source IS NULL) l, rates r WHERE r.source IS NULL),
cdf AS (
  WITH RECURSIVE steps AS (
    SELECT source, times, rate * times / parts AS r, 0 AS j, exp(-(rate * times / parts)) AS p, exp(-(rate * times / parts)) AS total FROM parts
    UNION ALL
    SELECT source, times, r, j + 1, p * r / (j + 1), total + p * r / (j + 1) FROM steps WHERE j < ceil(r + 12 * sqrt(r) + 30)
  ) SELECT source, times, list(total ORDER BY j) AS cdf FROM steps GROUP BY source, times),
draws AS (
  SELECT d.doc_id, d.source, d.text, rate, d.key, d.lot,
    CAST(list_sum(list_transform(range(1, parts + 1), lambda q: len(list_filter(cdf, lambda c: c <=
      CAST(CAST('0x' || substring(md5('mix:' || d.key || ':' || d.lot || ':' || q), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)))) AS INT) AS copies
  FROM lots d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source AND d.times = p.times JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND d.times = c.times)
SELECT doc_id, source, round(rate, 9) AS mix_rate, copies AS mix_copies, CAST(c AS INT) AS mix_copy,
  CAST('0x' || substring(md5('mix:place:' || key || ':' || lot || ':' || c), 1, 15) AS BIGINT) AS mix_key,
  text
FROM draws, unnest(range(0, copies)) AS t(c)
"""
