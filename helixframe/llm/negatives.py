"""Hard-negative mining by bounds along a spanning tree of the anchors.

The anchors of a block are joined by a minimum spanning tree.  The root is
scored against all candidates; a child's score differs from its parent's by at
most the length of their edge times the length of the candidate, so that what
is known of the parent, a score or an interval, gives an interval for the
child.  Only candidates whose interval overlaps a window that the child still
asks for are scored again; for the others the wider interval is handed down.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm import blocks
from helixframe.llm.blocks import Side
from helixframe.llm.cluster import cut


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's tree over the rows of v: the order in which they join, the parent of each (the root: itself), the length of the edge to it."""
    v = v.astype(np.float64)
    n = len(v)
    near, parent, open_ = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    order, at = np.zeros(n, np.int64), int(np.argmin((v**2).sum(1)))
    parent[at], near[at] = at, 0.0
    edge = np.zeros(n)
    for i in range(n):
        order[i], open_[at], edge[at] = at, False, near[at]
        d = np.sqrt(((v - v[at]) ** 2).sum(1))
        closer = open_ & (d < near)
        near[closer], parent[closer] = d[closer], at
        if i + 1 < n:
            at = int(np.where(open_, near, np.inf).argmin())
    return order, parent, edge


def _plant(table: pa.Table) -> pa.Table:
    """Adds the block's tree to its anchors: place in the order, place of the parent, length of the edge."""
    v = blocks.sides(table, table)[0].v
    order, parent, edge = spanning_tree(v)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return pa.table({"row": table.column("row"), "place": pa.array(place), "above": pa.array(place[parent]), "edge": pa.array(edge)})


def tree_search(same_label: bool):
    """A searcher: the k first candidates of each window among those of the anchor's label, or of other labels."""

    def run(q: Side, c: Side, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        # The rows of a block keep the tree of all its anchors, though some may ask for nothing more.
        place, above, edge = (q.table.column(x).to_numpy() for x in ("place", "above", "edge"))
        order = np.argsort(place)
        at = {int(place[i]): n for n, i in enumerate(order)}
        norm = np.sqrt((c.v.astype(float) ** 2).sum(1))
        low = np.empty((len(order), len(norm)))
        high = np.empty_like(low)
        out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for n, i in enumerate(order):
            fits = (c.label == q.label[i]) == same_label
            fits &= c.row != q.row[i]
            up = at.get(int(above[i]), n)
            if up == n:
                rescored = np.arange(len(norm))
            else:
                # Rounded lengths and products: a share of 1e-9 and half a score is more than they lose.
                reach = edge[i] * norm * (1 + 1e-9) + 0.5
                np.subtract(low[up], reach, out=low[n])
                np.add(high[up], reach, out=high[n])
                meets = np.zeros(len(norm), bool)
                for a, b in zip(q.low[i], q.high[i], strict=True):
                    meets |= (high[n] >= a) & (low[n] <= b) & (a <= b)
                rescored = np.flatnonzero(meets & fits)
            scores = c.v[rescored] @ q.v[i]
            low[n, rescored] = high[n, rescored] = scores
            if up == n:
                rescored, scores = rescored[fits], scores[fits]
            for w, (a, b) in enumerate(zip(q.low[i], q.high[i], strict=True)):
                inside = np.flatnonzero((scores >= a) & (scores <= b))
                first = inside[blocks.firsts(scores[inside], c.id[rescored[inside]], k)]
                if len(first):
                    out.append((i, w, rescored[first], scores[first]))
        if not out:
            return (np.zeros(0, np.int64),) * 4
        counts = [len(x[2]) for x in out]
        return np.repeat([x[0] for x in out], counts), np.repeat([x[1] for x in out], counts), np.concatenate([x[2] for x in out]), np.concatenate([x[3] for x in out])

    return run


def planted(anchors: DataFrame, within: str | None, block: int) -> DataFrame:
    """The anchors with their place in the spanning tree of their block."""
    g = [F.lit(0) if within is None else F.col(within)]
    sizes = anchors.groupBy(*[x.alias("g") for x in g]).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
    rows = anchors.withColumn("g", g[0]).join(sizes, "g")
    trees = rows.groupBy("g", F.pmod(F.xxhash64("row"), F.col("n")).alias("b")).applyInArrow(_plant, "row long, place long, above long, edge double")
    return anchors.join(trees, "row")


def hard_negatives(
    vectors: DataFrame, *, every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = blocks.BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by every.  An anchor's positives
    are the other rows of its label with the highest scores; for each of them
    the first rows of other labels are returned whose score is between least
    and most per cent of the positive's.  Score: inner product of the vectors,
    each component x as floor(scale * x); higher scores come first, ties by
    smaller id.  rank counts from 1 for each anchor and positive.

    Rows whose label or vector is null, or whose vector holds a null, NaN or
    infinity, take no part.  Ids are integers; a null id is never an anchor and
    comes after the others.  Rows that share an id are different rows.  An
    empty vector scores 0 with all; a shorter one ends in zeros.  Other columns
    are ignored.  An empty table, or one label only, gives an empty table.
    """
    rows = blocks.integer_rows(vectors, id_col, vec_col, scale, F.col(label_col))
    anchors = rows.where(F.col("id") % every == 0)
    asked = planted(anchors, "label", block).withColumn("lows", F.array(F.lit(blocks.LOW))).withColumn("highs", F.array(F.lit(blocks.HIGH)))
    near = blocks.search(asked, rows, tree_search(True), positives, within="label", block=block)
    # Whole numbers throughout: score from the least that reaches the lower share to the greatest within the upper one.
    lows = F.expr(f"cast((score * {least} + pmod(-score * {least}, 100)) div 100 as long)")
    highs = F.expr(f"cast((score * {most} - pmod(score * {most}, 100)) div 100 as long)")
    wanted = cut(near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", lows.alias("low"), highs.alias("high"), F.col("id").alias("positive_id"), "score"))).alias("of")))
    asked = anchors.join(wanted, F.col("row") == F.col("query")).withColumn("lows", F.col("of.low")).withColumn("highs", F.col("of.high")).drop("query", "of")
    # A window for each positive; anchors with fewer have empty windows up to the same number.
    filled = lambda c, x: F.concat(c, F.array_repeat(F.lit(x), positives - F.size(c)))
    asked = asked.withColumn("lows", filled(F.col("lows"), blocks.HIGH)).withColumn("highs", filled(F.col("highs"), blocks.LOW))
    found = blocks.search(planted(asked, None, block), rows, tree_search(False), negatives, block=block)
    out = found.join(wanted, "query").join(anchors.select(F.col("row").alias("query"), F.col("id").alias("anchor_id")), "query")
    of = F.element_at("of", F.col("window") + 1)
    return out.select("anchor_id", of["positive_id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), of["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def op11_anchor_tree(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; of every seventh the label is moved on by one first."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, a.label = c.label AS same, c.r AS cr, c.vec_id, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.cr ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
