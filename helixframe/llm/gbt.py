"""Quality rules: base rules, then gradient-boosted trees over document statistics.

Trees are trained on a bounded sample of labelled rows; splits on features
with a sign keep the prediction monotonic in them.  Trained trees are complete
binary trees in numpy node arrays, so that a batch of texts goes down all
trees by array indexing alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm import stats, text as tx

#: The better text never has more of these: symbols, repeated lines, repeated words, capitals, exclamation marks.
SIGNS = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "bang_share": -1}
#: At most so many labelled rows are sampled for training, those of least hash.
SAMPLE = 20_000


@dataclass
class Trees:
    """feature, threshold: [tree, inner node]; leaf: [tree, leaf]; node i has children 2i + 1 and 2i + 2, the right one for values above."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, signs: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 1.0, ridge: float = 1.0) -> Trees:
    """Boosting on logistic loss with histogram splits.  signs: 1 or -1 for features that the result must not fall or rise in."""
    n, d = x.shape
    inner = 2**depth - 1
    positive = (y.sum() + 0.5) / (n + 1.0)
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), float(np.log(positive / (1 - positive))))
    if not n or y.min() == y.max():
        return Trees(out.feature[:0], out.threshold[:0], out.leaf[:0], out.start)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = [np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]  # bin b: cuts[b-1] < x <= cuts[b]
    score = np.full(n, out.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        for level in range(depth):
            base = 2**level - 1
            width = 2**level
            best = np.full(width, 1e-6)
            pick = [None] * width
            for j in range(d):
                k = len(cuts[j]) + 1
                key = (node - base) * k + binned[j]
                gs = np.bincount(key, g, width * k).reshape(width, k)
                hs = np.bincount(key, h, width * k).reshape(width, k)
                gl, hl = np.cumsum(gs, 1)[:, :-1], np.cumsum(hs, 1)[:, :-1]
                gr, hr = gs.sum(1, keepdims=True) - gl, hs.sum(1, keepdims=True) - hl
                lo, hi = low[base : base + width, None], high[base : base + width, None]
                vl, vr = np.clip(gl / (hl + ridge), lo, hi), np.clip(gr / (hr + ridge), lo, hi)
                whole = np.clip((gl + gr) / (hl + hr + ridge), lo, hi)
                loss = lambda v, gg, hh: v * gg - 0.5 * v * v * (hh + ridge)
                gain = loss(vl, gl, hl) + loss(vr, gr, hr) - loss(whole, gl + gr, hl + hr)
                gain[(hl < least) | (hr < least)] = 0
                if signs[j]:
                    gain[(vr - vl) * signs[j] < 0] = 0
                if gain.shape[1]:
                    at = gain.argmax(1)
                    for i in np.flatnonzero(gain[np.arange(width), at] > best):
                        best[i] = gain[i, at[i]]
                        pick[i] = (j, cuts[j][at[i]], vl[i, at[i]], vr[i, at[i]])
            for i in range(width):
                k = base + i
                low[2 * k + 1 : 2 * k + 3], high[2 * k + 1 : 2 * k + 3] = low[k], high[k]
                if pick[i] is not None:
                    j, cut, vl, vr = pick[i]
                    out.feature[t, k], out.threshold[t, k] = j, cut
                    if signs[j]:
                        mid = (vl + vr) / 2
                        if signs[j] < 0:
                            low[2 * k + 1], high[2 * k + 2] = mid, mid
                        else:
                            high[2 * k + 1], low[2 * k + 2] = mid, mid
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.threshold[t, node])
        gs, hs = np.bincount(node - inner, g, inner + 1), np.bincount(node - inner, h, inner + 1)
        out.leaf[t] = rate * np.clip(gs / (hs + ridge), low[inner:], high[inner:])
        score += out.leaf[t, node - inner]
    return out


def _measurer(model):
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value if model is not None else None
        for batch in batches:
            for rows, data, offsets in tx.pieces(batch):
                s = stats.measure(data, offsets)
                columns = [rows.column(0)] + [pa.array(c.astype(np.int64)) for c in (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words)]
                if trees is not None:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(trees.probability(s.features))], names=[*names, "good"])
                else:
                    x = s.features
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([rows.column(0), lists], names=["id", "x"])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(key, y, text) of at most sample labelled ids, those of least hash; null ids and labels are left out.

    An id with several labels has the least, one with several rows the text of
    least hash, so that sample bounds rows too.
    """
    some = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.min("y").alias("y"))
    some = some.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(some), "id")
    one = F.min_by(F.struct("y", "text"), F.struct(F.xxhash64("text"), "text")).alias("one")
    return texts.groupBy("id").agg(one).select(F.xxhash64("id", "one.text").alias("key"), "one.*")


def train_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees fitted to a bounded sample of labelled rows; without labels of both kinds the probability is constant.  One pass over docs."""
    some = labelled_sample(docs, labels, id_col, text_col, label_col, sample)
    rows = some.select(F.struct("key", "y").alias("id"), "text").mapInArrow(_measurer(None), "id struct<key:long,y:int>, x array<double>").toArrow()
    ids = rows.column("id").combine_chunks() if len(rows) else pa.array([], pa.struct([("key", pa.int64()), ("y", pa.int32())]))
    order = np.argsort(ids.field("key").to_numpy(zero_copy_only=False), kind="stable")
    y = ids.field("y").to_numpy(zero_copy_only=False).astype(float)[order]
    x = np.array(rows.column("x").to_pylist(), float).reshape(len(y), len(stats.FEATURES))[order]
    return train(x, y, np.array([SIGNS.get(f, 0) for f in stats.FEATURES]))


def quality_rules(docs: DataFrame, trees: Trees, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, good, base_failed, kept), a row for each row of docs.

    base_failed: fewer than 50 words, or over half of the words in repeated
    three-word windows.  kept: passes that, and the trees' probability of good
    quality is at least least.  Null and empty texts have no words and fail.
    Repeated rows give repeated results; an empty table an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(trees)
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = some.schema["id"].dataType.simpleString()
    out = some.mapInArrow(_measurer(model), f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, good double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("good") >= least))


def op9_quality_gbt(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trees = train_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules(docs, trees).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("good", 6).alias("good"))
