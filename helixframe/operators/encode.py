"""Encodings of sequences as rows: one-hot, chunks, k-mers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.functions import scalar


def positions(df: DataFrame, seq: str = "seq", pos: str = "pos") -> DataFrame:
    """A row for each letter's position."""
    return df.where(F.length(seq) > 0).withColumn(pos, F.explode(F.sequence(F.lit(0), F.length(seq) - 1)))


def one_hot(df: DataFrame, *, key: str = "example_idx", seq: str = "seq", alphabet: str = scalar.ALPHABET) -> DataFrame:
    """(key, pos, char_idx): the set entry of each one-hot column; unknown letters have no row, others raise."""
    letters = positions(df.select(key, seq), seq)
    at = scalar.char_index(F.substring(F.col(seq), F.col("pos") + 1, F.lit(1)), alphabet)
    return letters.select(key, "pos", at.alias("char_idx")).where("char_idx is not null")


def decode(df: DataFrame, *, key: str = "example_idx", alphabet: str = scalar.ALPHABET, length: str | None = None) -> DataFrame:
    """(key, seq) from one-hot rows; columns without a row are N (up to column length, else the last one set)."""
    letter = F.substring(F.lit(alphabet), F.col("char_idx") + 1, F.lit(1))
    rows = df.groupBy(key, *([length] if length else [])).agg(F.map_from_entries(F.collect_list(F.struct("pos", letter))).alias("m"))
    last = F.col(length) if length else F.array_max(F.map_keys("m")) + 1
    return rows.select(key, F.array_join(F.transform(F.sequence(F.lit(0), last - 1), lambda p: F.coalesce(F.element_at("m", p), F.lit(scalar.UNKNOWN))), "").alias("seq"))


def characters(df: DataFrame, *, key: str = "example_idx", alphabet: str = scalar.ALPHABET, force: bool = False, allow_n: bool = False) -> DataFrame:
    """(key, seq): the letter of greatest weight at each position of matrices (key, pos, probs), positions in order.

    Where letters tie for the greatest weight, this raises, unless force or
    allow_n lets the first one of the alphabet stand.  allow_n: a position whose
    weights sum to 0 is N.  A position of another number of weights than
    letters raises, one without weights or with a null among them too.
    """
    top = F.array_max("probs")
    right = (F.size("probs") == len(alphabet)) & ~F.exists("probs", lambda x: x.isNull())
    tied = F.size(F.filter("probs", lambda x: x == top)) > 1
    letter = F.substring(F.lit(alphabet), F.array_position("probs", top).cast("int"), F.lit(1))
    if allow_n:
        letter = F.when(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x) == 0, F.lit(scalar.UNKNOWN)).otherwise(letter)
    elif not force:
        letter = F.when(tied, F.raise_error(F.lit("letters of the same weight at a position")).cast("string")).otherwise(letter)
    letter = F.when(F.coalesce(right, F.lit(False)), letter).otherwise(F.raise_error(F.lit("weights and alphabet differ in size")).cast("string"))
    rows = df.select(key, "pos", letter.alias("c")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("x"))
    return rows.select(key, F.array_join("x.c", "").alias("seq"))


def chunk(df: DataFrame, size: int = 1024, overlap: int = 0, *, key: str = "example_idx", seq: str = "seq") -> DataFrame:
    """(key, chunk_idx, seq): windows of that size; what is left at the end is dropped."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    stride = size - overlap
    whole = df.select(key, seq).where(F.length(seq) >= size)
    starts = F.sequence(F.lit(0), F.length(seq) - size, F.lit(stride))
    return whole.select(key, F.posexplode(starts).alias("chunk_idx", "start"), seq).select(key, "chunk_idx", F.substring(seq, F.col("start") + 1, F.lit(size)).alias(seq))


def unchunk(df: DataFrame, overlap: int = 0, *, key: str = "example_idx", seq: str = "seq") -> DataFrame:
    """(key, seq): chunks joined again; of an overlap the left half comes from the left chunk.

    A single chunk of overlapping ones is trimmed on both sides.
    """
    left, right = overlap // 2, overlap - overlap // 2
    w = Window.partitionBy(key)
    n, i = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("chunk_idx"))
    rows = df.select(key, "chunk_idx", seq, n.alias("n"), i.alias("i"))
    begin = F.when((F.col("i") > 1) | (F.col("n") == 1), F.lit(left)).otherwise(F.lit(0))
    end = F.when((F.col("i") < F.col("n")) | (F.col("n") == 1), F.lit(right)).otherwise(F.lit(0))
    part = F.substring(seq, begin + 1, F.length(seq) - begin - end)
    parts = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_idx", part.alias("part")))).alias("parts"))
    return parts.select(key, F.array_join("parts.part", "").alias(seq))


def kmer_index(kmer: Column, k: int, alphabet: str = scalar.ALPHABET) -> Column:
    """Place of a k-mer, the first letter counting least; unknown letters count as the first."""
    out = F.lit(0).cast("long")
    for j in range(k):
        out = out + F.greatest(F.instr(F.lit(alphabet), F.substring(kmer, j + 1, 1)) - 1, F.lit(0)) * F.lit(len(alphabet) ** j)
    return out


def kmers(df: DataFrame, k: int, *, key: str = "example_idx", seq: str = "seq", scores: str | None = None, alphabet: str = scalar.ALPHABET) -> DataFrame:
    """(key, kmer_idx, value): number of each k-mer, or the sum of the scores (an array column) under its occurrences."""
    some = df.where(F.length(seq) >= k).withColumn("start", F.explode(F.sequence(F.lit(0), F.length(seq) - k)))
    at = kmer_index(F.substring(seq, F.col("start") + 1, F.lit(k)), k, alphabet).alias("kmer_idx")
    if scores is None:
        return some.select(key, at).groupBy(key, "kmer_idx").agg(F.count(F.lit(1)).alias("value"))
    under = F.aggregate(F.slice(F.col(scores), F.col("start") + 1, F.lit(k)), F.lit(0.0), lambda a, x: a + x)
    return some.select(key, at, under.alias("value")).groupBy(key, "kmer_idx").agg(F.sum("value").alias("value"))


def gapped_kmers(attr: DataFrame, *, key: str = "example_idx", min_k: int = 4, max_k: int = 8, max_gap: int = 2, max_len: int = 10, max_gkmers: int = 10, max_pos: int | None = None) -> DataFrame:
    """(key, gkmer, value, n): the strongest gapped k-mers of each example.

    attr: (key, pos, char_idx, value), one row a position.  Chains of
    positions at most max_gap apart and less than max_len long, of min_k to
    max_k letters; the code adds (char + 1) * 5 ** offset; equal codes add up
    their mean values.  max_pos keeps the positions of greatest value only.
    Each position has the few that a chain from it can reach beside it, by a
    window over the example, and all chains from it are made in its row: one
    shuffle by example, no join.
    """
    # By number, so that partitions are not put together by their size in bytes: a position is many chains.
    base = attr.select(key, "pos", "char_idx", "value").repartition(int(attr.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    if min_k > 1:
        base = base.where(F.col(key).isNotNull())
    if max_pos is not None:
        w = Window.partitionBy(key).orderBy(F.desc("value"), "pos")
        base = base.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_pos).drop("rn")
    code = lambda c, offset: (c + 1) * F.pow(F.lit(5.0), offset)
    w = Window.partitionBy(key).orderBy("pos").rangeBetween(1, max(1, max_len - 1))
    after = F.collect_list(F.struct("pos", "char_idx", F.col("value").cast("double").alias("value"))).over(w)
    first = F.struct(F.col("pos").alias("last"), code(F.col("char_idx"), F.lit(0.0)).alias("code"), F.col("value").cast("double").alias("total"))
    # Rows without an example are no chains of more than one position.
    rows = base.select(key, "pos", F.array(first).alias("of1"), F.filter(after, lambda b: F.col(key).isNotNull()).alias("after"))
    for k in range(2, max_k + 1):
        rows = rows.withColumn(f"of{k}", F.flatten(F.transform(f"of{k - 1}", lambda x: F.transform(
            F.filter("after", lambda b: (b["pos"] > x["last"]) & (b["pos"] <= x["last"] + max_gap) & (b["pos"] - F.col("pos") < max_len)),
            lambda b: F.struct(b["pos"].alias("last"), (x["code"] + code(b["char_idx"], (b["pos"] - F.col("pos")).cast("double"))).alias("code"), (x["total"] + b["value"]).alias("total")),
        ))))
    done = [F.transform(f"of{k}", lambda x: F.struct(x["code"].cast("long").alias("gkmer"), (x["total"] / k).alias("value"))) for k in range(min_k, max_k + 1)]  # noqa: B023
    found = rows.select(key, F.explode(F.concat(*done)).alias("x")).select(key, "x.gkmer", "x.value")
    sums = found.groupBy(key, "gkmer").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy(key).orderBy(F.desc(F.abs(F.round("value", 9))), "gkmer")
    return sums.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= max_gkmers).drop("rn")
