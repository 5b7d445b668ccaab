"""Exact top-k search by multi-resolution segment statistics.

Vectors are cut into segments, at each resolution into shorter ones, and a
segment of m components is known by its mean and deviation.  As

    |q - c|^2 >= sum over segments of m * ((mean_q - mean_c)^2 + (dev_q - dev_c)^2)

and |q|^2 is the sum of m * (mean_q^2 + dev_q^2), the inner product of q and c
is at most the sum of m * (mean_q * mean_c + dev_q * dev_c).  Candidates whose
bound lies below what a query already has go, coarse to fine; exact scores are
computed for those that are left.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm import blocks
from helixframe.llm.blocks import Side

#: Components of a segment, coarse to fine.
SEGMENTS = (32, 8, 2)


def segment_statistics(v: np.ndarray, length: int) -> np.ndarray:
    """For each row the means, then the deviations of its segments, each times the root of the segment's length; the last one is filled up with zeros."""
    v = np.pad(v.astype(np.float64), ((0, 0), (0, -v.shape[1] % length))).reshape(len(v), -1, length)
    mean = v.mean(2)
    return np.concatenate([mean, np.sqrt(((v - mean[:, :, None]) ** 2).mean(2))], axis=1) * np.sqrt(length)


def segment_search(q: Side, c: Side, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k first candidates of each query but its own row, from its lower limit on."""
    levels = [(segment_statistics(q.v, m), segment_statistics(c.v, m)) for m in SEGMENTS]
    # Bounds are rounded, scores are whole numbers: half of one is more than any rounding where scores are exact as doubles.
    lengths = np.sqrt((q.v.astype(float) ** 2).sum(1)), np.sqrt((c.v.astype(float) ** 2).sum(1))
    slack = 0.5 + 1e-12 * lengths[0] * lengths[1].max(initial=0.0)
    coarse = levels[0][0] @ levels[0][1].T
    floor = q.low[:, 0].astype(float)
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i in range(len(q.row)):
        left = np.flatnonzero(c.row != q.row[i])
        bound = coarse[i, left]
        for own, theirs in levels[1:]:
            left = left[bound >= floor[i] - slack[i]]
            bound = theirs[left] @ own[i]
        if len(left) > k:
            # Those of highest bound are scored first and set a limit for the others.
            some = np.argpartition(-bound, k - 1)[:k]
            floor[i] = max(floor[i], (c.v[left[some]] @ q.v[i]).min())
        left = left[bound >= floor[i] - slack[i]]
        scores = c.v[left] @ q.v[i]
        keep = scores >= floor[i] - slack[i]
        left, scores = left[keep], scores[keep]
        first = blocks.firsts(scores, c.id[left], k)
        out.append((i, left[first], scores[first]))
    at = np.repeat([x[0] for x in out], [len(x[1]) for x in out]).astype(np.int64)
    return at, np.zeros(len(at), np.int64), np.concatenate([x[1] for x in out]), np.concatenate([x[2] for x in out])


def top_k(vectors: DataFrame, k: int = 20, *, every: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", block: int = blocks.BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by every, the k rows of highest score but itself (all, if fewer), ties to smaller ids.

    Score: inner product of the vectors, each component x as floor(scale * x).
    Rows whose vector is null or holds a null, NaN or infinity take no part.
    Ids are integers; a null id is never a query and as a candidate comes after
    the others.  Rows that share an id are different rows, each with its own
    result, and find each other.  An empty vector scores 0 with all; a shorter
    one ends in zeros.  Other columns are ignored.  An empty table gives an empty table.
    """
    rows = blocks.integer_rows(vectors, id_col, vec_col, scale)
    queries = rows.where(F.col("id") % every == 0).withColumn("lows", F.array(F.lit(blocks.LOW))).withColumn("highs", F.array(F.lit(blocks.HIGH)))
    best = blocks.search(queries, rows, segment_search, k, block=block)
    ids = queries.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return best.join(ids, "query").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op13_segment_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM o WHERE rank <= 20
"""
