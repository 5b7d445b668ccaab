"""Exact search of integer vectors, a block of queries against a block of candidates at a time.

Queries and candidates are dealt into blocks of bounded size by hash.  Rounds
take ever more blocks of candidates (growth times as many as all before); what
a query has found by then narrows its windows for the next round, so that a
block sends on few rows a query, however many blocks there are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.llm.cluster import cut, few

#: Vectors of a block: what a task holds at once is a block of queries, a block of candidates and their scores.
BLOCK = 1024
GROWTH = 8
#: Squared length from which scores might not fit a long.
TOO_LONG = float(2**62)
LOW, HIGH = -(2**63), 2**63 - 1
NONE = np.iinfo(np.int64).max

#: (queries, candidates, first k of each window) -> (query, window, candidate, score) as arrays of positions and scores.
Searcher = Callable[["Side", "Side", int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x, as longs; null where the vector is null or a component is null or not finite."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x.cast("double")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def integer_rows(vectors: DataFrame, id_col: str, vec_col: str, scale: int, label: Column | None = None) -> DataFrame:
    """row, id (long), label, v of the rows that take part, kept in the shared folder; row tells rows apart that share an id.

    A vector whose squared length after scaling is 2**62 or more is an error: its scores need not fit a long.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), (F.lit(0) if label is None else label).alias("label"), quantised(F.col(vec_col), scale).alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.col("label").isNotNull())
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    v = F.when(length < TOO_LONG, F.col("v")).otherwise(F.raise_error(F.lit("a vector is too long for integer scores")))
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", v.alias("v")))


class Side:
    """One block's rows as arrays: row, id (null: after all others), label, v (short vectors end in zeros), low and high of each window."""

    def __init__(self, table: pa.Table, dims: int, exact: type):
        self.row = table.column("row").to_numpy()
        self.id = table.column("id").fill_null(NONE).to_numpy()
        self.label = table.column("label").to_numpy()
        lists = table.column("v").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = lists.value_lengths().to_numpy()
        self.v = np.zeros((len(sizes), dims), exact)
        self.v[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy()
        windows = {c: np.array(table.column(c).to_pylist(), np.int64).reshape(len(sizes), -1) for c in ("lows", "highs") if c in table.column_names}
        self.low, self.high = windows.get("lows"), windows.get("highs")
        self.table = table


def sides(left: pa.Table, right: pa.Table) -> tuple[Side, Side]:
    """Both blocks with as many dimensions, as doubles where all scores are exact in these, else as longs."""
    dims, longest = 1, 1.0
    for t in (left, right):
        lists = t.column("v").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = lists.value_lengths().to_numpy()
        of = np.repeat(np.arange(len(sizes)), sizes)
        dims = max(dims, int(sizes.max(initial=0)))
        longest *= max(1.0, np.bincount(of, lists.flatten().to_numpy().astype(float) ** 2, len(sizes)).max(initial=0.0))
    exact = np.float64 if longest < 2.0**104 else np.int64
    return Side(left, dims, exact), Side(right, dims, exact)


def firsts(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties by smaller id, in order."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _searching(searcher: Searcher, k: int, schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        q, c = sides(left, right)
        at, window, found, score = searcher(q, c, k)
        ids = right.column("id").combine_chunks().take(pa.array(found))
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        return pa.table([pa.array(q.row[at]), pa.array(window.astype(np.int32)), pa.array(score.astype(np.int64)), ids, pa.array(c.row[found])], schema=schema)

    return run


def search(queries: DataFrame, candidates: DataFrame, searcher: Searcher, k: int, *, within: str | None = None, block: int = BLOCK, growth: int = GROWTH) -> DataFrame:
    """query, window, rank (from 1), score, id, row: the k first candidates of each query and window (all, if fewer), by score, ties by smaller id.

    queries: row, lows and highs (arrays: the scores that each window takes)
    and what the searcher reads; candidates: row, id, label, v.  within: a
    column; only rows that agree on it meet.  Work is that of all pairs of
    blocks, as the searcher prunes it; shuffled are the candidates once for
    each block of queries, and the queries once for each block of candidates.
    """
    g = F.lit(0) if within is None else F.col(within)
    queries, candidates = queries.withColumn("g", g), candidates.withColumn("g", g)
    blocks = lambda rows, name: rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = cut(blocks(queries, "n_q").join(blocks(candidates, "n_c"), "g"))
    most = sizes.agg(F.max("n_c")).first()[0] or 0
    dealt = lambda rows, n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    queries = cut(queries.join(few(sizes), "g").withColumn("qb", dealt(queries, "n_q")))
    # Names of their own, as queries may be rows of the same table.
    candidates = candidates.select(*[F.col(c).alias(c) for c in candidates.columns])
    candidates = candidates.join(few(sizes), "g").withColumn("cb", dealt(candidates, "n_c"))
    schema = pa.schema([("query", pa.int64()), ("window", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("row", pa.int64())])
    order = Window.partitionBy("query", "window").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    best, start, end = None, 0, growth
    while best is None or start < most:
        asked = queries
        if best is not None:
            full = best.where(F.col("rank") == k).groupBy(F.col("query").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("floor"))
            asked = asked.join(full, "row", "left").withColumn("lows", F.transform("lows", lambda x, i: F.greatest(x, F.col("floor")[i]))).drop("floor")
        last = F.least(F.lit(end), F.col("n_c")) - 1
        left = asked.where(F.col("n_c") > start).withColumn("cb", F.explode(F.sequence(F.lit(start), last)))
        right = candidates.where((F.col("cb") >= start) & (F.col("cb") < end)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)))
        found = left.groupBy("g", "qb", "cb").cogroup(right.groupBy("g", "qb", "cb")).applyInArrow(_searching(searcher, k, schema), "query long, window int, score long, id long, row long")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        start, end = end, end * growth
    return best
