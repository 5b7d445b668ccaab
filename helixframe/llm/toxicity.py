"""Toxicity by maximum-scoring segments.

Token log-odds between toxic and other labelled texts, with an informative
Dirichlet prior, are shifted so that ordinary text drifts down.  A linear scan
finds all maximal segments of a text (Ruzzo and Tompa); scores of the best
segment follow an extreme-value law that depends on the text's length, which
turns them into significance.  A small logistic model on these statistics
gives the probability.

A token's log-odds are those of the word or of one of its prefixes, whichever
tells most; words and prefixes are hashed to a table of fixed size, which is
what executors get.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm import text as tx
from helixframe.llm.cluster import cut

#: Slots of the table of log-odds.
SPACE = 1 << 20
#: At most so many labelled rows train the model, those whose id has the least hash.
SAMPLE = 20_000
#: Bytes of the prefixes of a token.
PREFIXES = (4, 5, 6, 7, 8)
#: Strength of the prior as a share of the training tokens.
PRIOR = 0.02
#: Slots seen in fewer training texts tell nothing.
LEAST = 3
#: What every token loses, so that ordinary text drifts down.
DRIFT = 0.5
#: Segments of at least this much normalised score (natural logarithm of one in so many) are significant.
SIGNIFICANT = 3.0


def slots(words: tx.Words) -> np.ndarray:
    """Table slots of each token: the word's, then its prefixes' (a prefix as long as the word or longer is the word)."""
    whole = words.hashes()
    out = [whole]
    for k in PREFIXES:
        end = np.minimum(words.starts + k, words.ends)
        out.append(np.where(end < words.ends, tx.mix(tx.span_hashes(words.data, words.starts, end) + np.uint64(k)), whole))
    return (np.stack(out) % np.uint64(SPACE)).astype(np.int32)


@dataclass
class Model:
    odds: np.ndarray
    #: Karlin-Altschul scale and the logarithm of K of the best segment of ordinary text.
    scale: float
    log_k: float
    weights: np.ndarray


def log_odds(toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float) -> np.ndarray:
    """Log-odds of texts with a slot, toxic against other, under a Dirichlet prior proportional to both, shrunk by their standard error."""
    both = toxic + other
    if not n_toxic or not n_other:
        return np.zeros(SPACE, np.float32)
    prior = np.maximum(PRIOR * both, 1e-3)
    strength = PRIOR * (n_toxic + n_other)
    a, b = toxic + prior * n_toxic / (n_toxic + n_other), other + prior * n_other / (n_toxic + n_other)
    d = np.log(a / (n_toxic + strength * n_toxic / (n_toxic + n_other))) - np.log(b / (n_other + strength * n_other / (n_toxic + n_other)))
    z2 = d * d / (1 / np.maximum(a, 0.5) + 1 / np.maximum(b, 0.5))
    return (np.clip(d, -6, 6) * z2 / (z2 + 16.0) * (both >= LEAST)).astype(np.float32)


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, start, end) of one text, in linear time, over its runs of one sign."""
    if not len(scores):
        return []
    up = scores > 0
    cut = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
    runs = np.add.reduceat(scores, cut).tolist()
    edges = np.r_[cut, len(scores)].tolist()
    total = 0.0
    found: list[list[float]] = []  # start, end, sum before it, sum at its end
    before: list[int] = []  # nearest earlier candidate with a smaller sum before it
    for i, s in enumerate(runs):
        left, total = total, total + s
        if s <= 0:
            continue
        new = [edges[i], edges[i + 1], left, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = before[j]
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                before.append(j)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:], before[j:]
    return [(x[3] - x[2], int(x[0]), int(x[1])) for x in found]


def token_scores(words: tx.Words, odds: np.ndarray) -> np.ndarray:
    """The most telling log-odds of each token, less the drift."""
    own = odds[slots(words)]
    pick = np.abs(own).argmax(0) if own.shape[1] else np.zeros(0, np.int64)
    return own[pick, np.arange(own.shape[1])].astype(np.float64) - DRIFT


def statistics(words: tx.Words, model: Model) -> tuple[np.ndarray, list[list[tuple[float, int, int]]]]:
    """Per text: normalised best score, logarithms of the number and total of significant segments, share of words in them, log length; and those segments."""
    n = len(words.ptr) - 1
    scores = token_scores(words, model.odds)
    out, found = np.zeros((n, 5)), []
    for i in range(n):
        own = scores[words.ptr[i] : words.ptr[i + 1]]
        size = np.log1p(len(own))
        best, keep = -size - model.log_k, []
        if len(own) and own.max() > 0:
            every = [(model.scale * s - size - model.log_k, a, b) for s, a, b in segments(own)]
            best = max(every)[0]
            keep = [x for x in every if x[0] >= SIGNIFICANT]
        out[i] = best, np.log1p(len(keep)), np.log1p(sum(x[0] for x in keep)), sum(b - a for _, a, b in keep) / max(1, len(own)), size
        found.append(keep)
    return out, found


def _design(x: np.ndarray) -> np.ndarray:
    return np.c_[np.ones(len(x)), np.clip(x[:, 0], -15, 15) / 5, np.clip(x[:, 0], 0, 15) / 5, x[:, 1], x[:, 2], x[:, 3], x[:, 4] / 5]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps on logistic loss."""
    w = np.zeros(x.shape[1])
    for _ in range(30 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each label and half in which a slot occurs, for a batch; slot -1 counts the texts."""
    for batch in batches:
        for rows, data, offsets in tx.pieces(batch):
            words = tx.split(data, offsets)
            kind = rows.column(0).to_numpy(zero_copy_only=False) * 2 + rows.column(1).to_numpy(zero_copy_only=False)
            doc = words.doc.astype(np.int64)
            key = np.unique(np.concatenate([doc * SPACE + s for s in slots(words)]))
            slot, of = np.r_[key % SPACE, np.full(len(kind), -1)], np.r_[kind[key // SPACE], kind]
            key, n = np.unique(slot * 4 + of, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((key // 4).astype(np.int32)), pa.array((key % 4).astype(np.int32)), pa.array(n.astype(np.int64))], names=["slot", "kind", "n"])


def _measurer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tx.pieces(batch):
                x, _ = statistics(tx.split(data, offsets), shared.value)
                yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(c) for c in x.T]], names=["y", "a", "b", "c", "d", "e"])

    return run


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for rows, data, offsets in tx.pieces(batch):
                x, found = statistics(tx.split(data, offsets), model)
                p = 1 / (1 + np.exp(-(_design(x) @ model.weights)))
                passages = [[{"start": a, "end": b, "score": s} for s, a, b in f] for f in found]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(p), pa.array(x[:, 0]), pa.array(passages, kind)], names=["id", "score", "best", "passages"])

    return run


def train_model(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Log-odds, extreme-value law and weights from at most sample labelled ids (of any type), a text each; null ids and labels are left out.

    An id with several labels has the least; one with several rows teaches with
    the text of least hash, so that sample bounds rows too.

    The law and the weights come from texts whose own half did not teach the
    log-odds they are measured with.
    """
    spark = docs.sparkSession
    some = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.min("y").alias("y"))
    some = some.orderBy(F.xxhash64("id"), "id").limit(sample)
    half = F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2)).cast("int").alias("half")
    # Read once: the labelled texts, few as they are, serve all passes below.
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(some), "id").select("id", "y", half, "text")
    one = F.min_by(F.struct("y", "half", "text"), F.struct(F.xxhash64("text"), "text")).alias("one")
    texts = cut(texts.groupBy("id").agg(one).select("one.*"))
    counted = texts.mapInArrow(_counter, "slot int, kind int, n long").groupBy("slot", "kind").agg(F.sum("n").alias("n")).toArrow()
    slot, kind, n = (counted.column(c).to_numpy() for c in ("slot", "kind", "n"))
    count, size = np.zeros((2, 2, SPACE)), np.zeros((2, 2))  # [label, half]
    for y in (0, 1):
        for h in (0, 1):
            own = (kind == 2 * y + h) & (slot >= 0)
            count[y, h, slot[own]] = n[own]
            size[y, h] = n[(kind == 2 * y + h) & (slot < 0)].sum()
    total = size.sum(1)
    model = Model(log_odds(count[1].sum(0), count[0].sum(0), total[1], total[0]), 1.0, 0.0, np.zeros(7))
    if not total[0] or not total[1]:
        model.weights[0] = -6.0 if total[0] else 6.0 if total[1] else 0.0
        return model
    halves = [log_odds(count[1, 1 - h], count[0, 1 - h], size[1, 1 - h], size[0, 1 - h]) for h in (0, 1)]
    raw = np.concatenate([measured(texts.where(F.col("half") == h), spark.sparkContext.broadcast(Model(halves[h], 1.0, 0.0, model.weights))) for h in (0, 1)])
    # Moments of the Gumbel law of the best score less log length: deviation pi / (scale sqrt 6), mean (log K + 0.5772) / scale.
    plain = raw[(raw[:, 0] == 0) & (raw[:, 1] > -raw[:, 5] + 1e-9)]
    if len(plain) > 20:
        model.scale = float(np.clip(np.pi / (np.sqrt(6) * max(plain[:, 1].std(), 0.1)), 0.3, 3.0))
        model.log_k = float((model.scale * (plain[:, 1] + plain[:, 5]) - plain[:, 5]).mean() - 0.5772)
        raw = np.concatenate([measured(texts.where(F.col("half") == h), spark.sparkContext.broadcast(Model(halves[h], model.scale, model.log_k, model.weights))) for h in (0, 1)])
    model.weights = fit_logistic(_design(raw[:, 1:]), raw[:, 0])
    return model


def measured(texts: DataFrame, shared) -> np.ndarray:
    rows = texts.select("y", "text").mapInArrow(_measurer(shared), "y int, a double, b double, c double, d double, e double").toArrow()
    out = np.stack([rows.column(c).to_numpy().astype(float) for c in rows.column_names], axis=1)
    return out[np.lexsort(out.T)]


def score_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, best, passages): probability, normalised best score, and all significant passages as word ranges.

    Null and empty texts have no passages and a score of their own.  Repeated
    rows give repeated results; an empty table an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = some.schema["id"].dataType.simpleString()
    return some.mapInArrow(_scorer(shared), f"id {kind}, score double, best double, passages array<struct<start:int,end:int,score:double>>")


def op3_toxic_segments(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 4 == 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~fold("doc_id"))
    out = score_toxicity(docs, train_model(docs, labels))
    return out.select(F.col("id").alias("doc_id"), F.coalesce(fold("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
