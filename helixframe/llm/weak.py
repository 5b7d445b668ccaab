"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.
Expectation-maximisation over the counts of all vote patterns (at most
3 ** labellers of them, counted over the whole table) estimates the share of
good documents and, for each class, how each labeller votes on it.  The
posterior labels that follow train a hashed linear scorer, which then scores
every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm import stats, text as tx

GOOD, BAD, NONE = 1, 2, 0
#: On texts of fewer words labellers of one statistic don't vote.
FEW = 5
#: Labellers of one statistic: good up to the first value, bad from the second.
ONE = {"capitals": ("upper_share", 0.15, 0.4), "symbols": ("symbol_share", 0.03, 0.15), "repeats": ("repeat_share", 0.3, 0.7), "lines": ("dup_line_share", 0.2, 0.5), "bangs": ("bang_share", 0.1, 0.5)}
#: Labellers of several: good if all these are at most so much, bad if any is over FAR times that.
ALL = {
    "prose": {"upper_share": 0.15, "bang_share": 0.1, "symbol_share": 0.02, "digit_share": 0.1, "repeat_share": 0.4},
    "varied": {"repeat_share": 0.2, "dup_line_share": 0.2, "symbol_share": 0.05, "upper_share": 0.3},
    "plain": {"symbol_share": 0.05, "bang_share": 0.2, "dup_line_share": 0.35, "repeat_share": 0.5, "upper_share": 0.25},
}
FAR = 4.0
LABELLERS = (*ONE, *ALL)
#: Hashed features of the linear scorer.
SPACE = 1 << 17
#: At most so many documents train the linear scorer, those whose id has the least hash: a documented bound, as votes are counted over all.
SAMPLE = 8192
#: Documents of at least this score are kept: below a half, so that clean documents that no labeller knows stay.
KEEP_FROM = 0.4
_SHAPE = np.arange(256)
_SHAPE = np.where((_SHAPE >= 65) & (_SHAPE <= 90), 65, np.where((_SHAPE >= 97) & (_SHAPE <= 122), 97, np.where((_SHAPE >= 48) & (_SHAPE <= 57), 48, np.where(_SHAPE >= 128, 97, _SHAPE)))).astype(np.uint8)


def votes(features: np.ndarray) -> np.ndarray:
    """A number for each text whose base-3 digits are the labellers' votes."""
    column = lambda name: features[:, stats.FEATURES.index(name)]
    out = np.zeros(len(features), np.int64)
    some = column("log_words") >= np.log1p(FEW)
    for name, good, bad in ONE.values():
        out = out * 3 + np.where(some & (column(name) >= bad), BAD, np.where(some & (column(name) <= good), GOOD, NONE))
    for limits in ALL.values():
        plain, far = np.ones(len(features), bool), np.zeros(len(features), bool)
        for name, most in limits.items():
            plain &= column(name) <= most
            far |= some & (column(name) > FAR * most)
        out = out * 3 + np.where(plain, GOOD, np.where(far, BAD, NONE))
    return out


def fit_labellers(pattern: np.ndarray, count: np.ndarray, *, rounds: int = 200, share: float = 0.5, right: float = 0.9, weight: float = 0.01) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of good for each of the 3 ** labellers vote patterns, the share of good texts, and [class, labeller] rates, by expectation-maximisation.

    Class 0 is bad, 1 good.  A rate is how often a labeller that votes calls
    texts of that class good.  It has a Beta prior of mean right for good texts
    and 1 - right for bad ones, and the share one of mean share; each is worth
    as much as weight times the votes, and one vote more, so that a labeller
    nobody overlaps keeps its prior.  Not to vote tells nothing: a text without
    votes has the share as posterior.  Without rows all are the priors.
    """
    m = len(LABELLERS)
    every = np.arange(3**m)
    digit = np.stack([every // 3 ** (m - 1 - j) % 3 for j in range(m)], axis=1)
    n = np.zeros(len(every))
    np.add.at(n, pattern, count)
    good, voted = (digit == GOOD).astype(float), (digit != NONE).astype(float)
    prior = np.array([1 - right, right])
    rates, p = np.repeat(prior[:, None], m, axis=1), share
    for _ in range(rounds + 1):
        like = [good @ np.log(rates[c]) + (voted - good) @ np.log(1 - rates[c]) for c in (0, 1)]
        post = 1 / (1 + np.exp(-np.clip(np.log(p / (1 - p)) + like[1] - like[0], -50, 50)))
        own = np.stack([n * (1 - post), n * post])
        extra = 1 + weight * (n @ voted)
        rates = np.clip((own @ good + extra * prior[:, None]) / (own @ voted + extra), 1e-4, 1 - 1e-4)
        p = float((own[1].sum() + (1 + weight * n.sum()) * share) / (n.sum() + 1 + weight * n.sum()))
    return post, p, rates


def hashed_features(s: stats.Stats, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (ptr, index, value): shares of lower-cased words and of word shapes, and ranges of the statistics."""
    words = s.words
    n = len(words.ptr) - 1
    lower = tx.span_hashes(tx.LOWER[data], words.starts, words.ends)
    cls = _SHAPE[data]
    keep = np.r_[True, cls[1:] != cls[:-1]] if len(cls) else np.zeros(0, bool)
    keep[words.starts] = True
    at = np.r_[0, np.cumsum(keep)]
    shape = tx.span_hashes(cls[keep], at[words.starts], at[words.ends]) if len(words.starts) else lower
    doc = words.doc
    f = s.features
    ranges = np.floor(np.clip(f[:, 1:] * [0.5, 20, 10, 10, 10, 4, 10, 10, 10], 0, 15)).astype(np.uint64)
    kinds = np.arange(ranges.shape[1], dtype=np.uint64)
    ranged = tx.mix(ranges + kinds * np.uint64(16) + np.uint64(1 << 40))
    rows = np.r_[doc, doc, np.repeat(np.arange(n), ranges.shape[1])]
    index = (np.r_[lower, tx.mix(shape + np.uint64(7)), ranged.reshape(-1)] % np.uint64(SPACE)).astype(np.int64)
    share = 1.0 / np.maximum(words.counts, 1)
    value = np.r_[share[doc], share[doc], np.full(ranged.size, 0.3)]
    return rows, index, value


def train_linear(rows: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, *, rounds: int = 150, rate: float = 0.5, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch AdaGrad."""
    w, b = np.zeros(SPACE), float(np.log((y.mean() + 0.01) / (1.01 - y.mean()))) if len(y) else 0.0
    g2, b2 = np.full(SPACE, 1e-8), 1e-8
    # Both classes weigh the same, however rare one is.
    balance = np.where(y > 0.5, 0.5 / max((y > 0.5).sum(), 1), 0.5 / max((y <= 0.5).sum(), 1))
    for _ in range(rounds if len(y) else 0):
        z = np.bincount(rows, value * w[index], minlength=len(y)) + b
        r = (1 / (1 + np.exp(-z)) - y) * balance
        g = np.bincount(index, value * r[rows], minlength=SPACE) + ridge * w
        g2 += g * g
        b2 += r.sum() ** 2
        w -= rate * g / np.sqrt(g2)
        b -= rate * r.sum() / np.sqrt(b2)
    return w.astype(np.float32), b


def _voter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in tx.pieces(batch):
            pattern, n = np.unique(votes(stats.measure(data, offsets).features), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n.astype(np.int64))], names=["pattern", "n"])


def _featurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in tx.pieces(batch):
            s = stats.measure(data, offsets)
            rows, index, value = hashed_features(s, data)
            n = len(offsets) - 1
            key, at = np.unique(rows * SPACE + index, return_inverse=True)
            total = np.bincount(at, value).astype(np.float32)
            ptr = np.searchsorted(key, np.arange(n + 1) * SPACE)
            lists = [pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), v) for v in (pa.array((key % SPACE).astype(np.int32)), pa.array(total))]
            yield pa.RecordBatch.from_arrays([pa.array(votes(s.features)), *lists], names=["pattern", "index", "value"])


def _trainer(post: np.ndarray):
    """One row with the scorer's weights and bias, from the texts of all batches in their order; none without texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(_featurer(batches))
        if found:
            rows = pa.Table.from_batches(found).combine_chunks()
            index, value = rows.column("index").combine_chunks(), rows.column("value").combine_chunks()
            y = post[rows.column("pattern").to_numpy()]
            order = np.repeat(np.arange(len(y), dtype=np.int32), index.value_lengths().to_numpy(zero_copy_only=False))
            w, b = train_linear(order, index.flatten().to_numpy(), value.flatten().to_numpy(), y)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([float(b)])], names=["weights", "bias"])

    return run


def _scorer(shared, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post, w, b = shared.value
        for batch in batches:
            name = batch.schema.field(text_at).name
            for some, data, offsets in tx.pieces(batch, name):
                s = stats.measure(data, offsets)
                rows, index, value = hashed_features(s, data)
                z = np.bincount(rows, value * w[index], minlength=len(offsets) - 1) + b
                pattern = votes(s.features)
                new = [pa.array(pattern.astype(np.int32)), pa.array(post[pattern]), pa.array(1 / (1 + np.exp(-z)))]
                yield pa.RecordBatch.from_arrays([*some.columns, *new], names=[*some.schema.names, "weak_votes", "weak_posterior", "weak_score"])

    return run


def train_classifier(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior by vote pattern, weights and bias.  Votes are counted over all rows; the scorer trains on at most sample of them.

    The sample's features stay in the task that trains; to the driver come the weights.
    """
    texts = docs.select(F.col(text_col).alias("text"))
    counted = texts.mapInArrow(_voter, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toArrow()
    post, _, _ = fit_labellers(counted.column("pattern").to_numpy(), counted.column("n").to_numpy().astype(float))
    key = F.xxhash64(F.col(id_col))
    least = docs.select(key.alias("key")).orderBy("key").limit(sample).agg(F.max("key")).first()[0]
    chosen = docs.where(key <= F.lit(least if least is not None else 0)).select(key.alias("key"), F.col(text_col).alias("text")).orderBy("key", F.xxhash64("text")).limit(sample)
    # One partition, as the limit leaves it, also where the plan drops the limit of a short table.
    model = chosen.select("text").coalesce(1).mapInArrow(_trainer(post), "weights binary, bias double").first()
    if model is None:
        none = np.zeros(0, np.int64)
        return post, *train_linear(none, none, np.zeros(0), np.zeros(0))
    return post, np.frombuffer(model["weights"], np.float32), model["bias"]


def classify(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], *, text_col: str = "text") -> DataFrame:
    """All columns of docs, with weak_votes, weak_posterior (of good, by votes) and weak_score (of good, by the linear scorer).

    Null and empty texts have no words: no labeller calls them bad, and they
    are scored by the bias and the ranges of their statistics.  Repeated rows
    give repeated results; an empty table an empty one.  Columns of docs called
    as one of the new ones are replaced.
    """
    out = docs.select(*[c for c in docs.columns if c not in ("weak_votes", "weak_posterior", "weak_score")])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = [T.StructField("weak_votes", T.IntegerType()), T.StructField("weak_posterior", T.DoubleType()), T.StructField("weak_score", T.DoubleType())]
    schema = T.StructType([*out.schema.fields, *new])
    return out.mapInArrow(_scorer(shared, out.columns.index(text_col)), schema)


def op10_weak_quality(spark, sf_dir: str) -> DataFrame:
    """Votes, posterior, score and class of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = classify(docs, train_classifier(docs))
    return out.select("doc_id", "weak_votes", F.round("weak_posterior", 6).alias("posterior"), F.round("weak_score", 6).alias("score"), (F.col("weak_score") >= KEEP_FROM).alias("kept"))
