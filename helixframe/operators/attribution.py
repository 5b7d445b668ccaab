"""Attribution: saturation mutagenesis in SQL, DeepLIFT/SHAP on small layer graphs in numpy batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from helixframe.functions import scalar
from helixframe.operators import edits, models
from helixframe.operators.order import checkpointed

#: Bytes of attributions that Python sends at once.
SENT = 4 << 20


def keys_of(df: DataFrame) -> list[str]:
    """What tells the sequences of df apart: all columns but seq, such as variant and the indices of an experiment."""
    return [c for c in df.columns if c != "seq"]


def saturation_mutagenesis(df: DataFrame, model: models.SqlModel, *, start: int = 0, end: int | None = None, head: str = "y") -> DataFrame:
    """(keys, pos, char_idx, is_ref, y0, y): the output of every single-letter edit in [start, end); keys are all columns but seq.

    The letter that is there already is not run again: its output is y0.  At
    an unknown letter all four are edits.  Rows are 4 a position; the model
    runs on 3 of them, in generated code, without a shuffle, and only on the
    letters within its reach where it is local.  Null sequences,
    and those with no position in [start, end), have no rows.
    """
    f = model.heads[head]
    stop = F.length("seq") if end is None else F.least(F.length("seq"), F.lit(end))
    base = df.where(F.col("seq").isNotNull() & (stop > start)).withColumn("y0", f(F.col("seq")))
    # The bound holds within the expression too, wherever a plan evaluates it.
    rows = base.withColumn("pos", F.explode(F.when(stop > start, F.sequence(F.lit(start), stop - 1))))
    rows = rows.withColumn("char_idx", F.explode(F.sequence(F.lit(0), F.lit(3))))
    letter = F.substring(F.lit(scalar.ALPHABET), F.col("char_idx") + 1, F.lit(1))
    same = F.substring("seq", F.col("pos") + 1, F.lit(1)) == letter
    edited = F.overlay("seq", letter, F.col("pos") + 1)
    y = model.after(head, F.col("y0"), F.col("seq"), edited, F.col("pos"), F.lit(1))
    return rows.select(*keys_of(df), "pos", "char_idx", same.alias("is_ref"), "y0", F.when(same, F.col("y0")).otherwise(y).alias("y"))


def mutagenesis_attribution(rows: DataFrame, *, hypothetical: bool = False) -> DataFrame:
    """(keys, pos, char_idx, value): each edit's change less the mean change at its position; only letters that are there unless hypothetical."""
    keys = [c for c in rows.columns if c not in ("pos", "char_idx", "is_ref", "y0", "y")]
    w = Window.partitionBy(*keys, "pos")
    delta = F.col("y") - F.col("y0")
    out = rows.select(*keys, "pos", "char_idx", "is_ref", (delta - F.avg(delta).over(w)).alias("value"))
    return (out if hypothetical else out.where("is_ref")).drop("is_ref")


def hypothetical_attributions(multipliers: DataFrame, references: DataFrame) -> DataFrame:
    """(example_idx, pos, char_idx, value): for each letter, its multiplier less what the reference's letters contribute.

    multipliers: (example_idx, pos, char_idx, m) with all letters; references:
    (example_idx, pos, char_idx, r), rows of zeros left out.
    """
    both = multipliers.join(references, ["example_idx", "pos", "char_idx"], "left")
    w = Window.partitionBy("example_idx", "pos")
    return both.select("example_idx", "pos", "char_idx", (F.col("m") - F.sum(F.col("m") * F.coalesce("r", F.lit(0.0))).over(w)).alias("value"))


@dataclass
class Layer:
    """forward(x) -> y; backward(gradient of y, x, y, reference's x, reference's y) -> gradient of x by the rescale rule."""

    forward: Callable[[np.ndarray], np.ndarray]
    backward: Callable[..., np.ndarray]


@dataclass
class Graph:
    """Layers in a row, from (n, 4, length) to (n, outputs)."""

    layers: list[Layer] = field(default_factory=list)

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for layer in self.layers:
            out.append(layer.forward(out[-1]))
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1]

    def multipliers(self, x: np.ndarray, r: np.ndarray, output: int) -> np.ndarray:
        xs, rs = self.forward(x), self.forward(r)
        g = np.zeros_like(xs[-1])
        g[:, output] = 1
        for i in range(len(self.layers) - 1, -1, -1):
            g = self.layers[i].backward(g, xs[i], xs[i + 1], rs[i], rs[i + 1])
        return g


def dense(weight: np.ndarray, bias: np.ndarray | float = 0.0) -> Layer:
    return Layer(lambda x: x @ weight.T + bias, lambda g, *_: g @ weight)


def flatten() -> Layer:
    return Layer(lambda x: x.reshape(len(x), -1), lambda g, x, *_: g.reshape(x.shape))


def conv(weight: np.ndarray) -> Layer:
    """Valid convolution over positions; weight: (filters, channels, width)."""
    width = weight.shape[2]

    def forward(x):
        windows = np.lib.stride_tricks.sliding_window_view(x, width, axis=2)
        return np.einsum("nclw,fcw->nfl", windows, weight)

    def backward(g, x, *_):
        out = np.zeros_like(x)
        for w in range(width):
            out[:, :, w : w + g.shape[2]] += np.einsum("nfl,fc->ncl", g, weight[:, :, w])
        return out

    return Layer(forward, backward)


def elementwise(f: Callable[[np.ndarray], np.ndarray], slope: Callable[[np.ndarray], np.ndarray]) -> Layer:
    """A nonlinearity: change of output over change of input, or the slope where the input hardly changes."""

    def backward(g, x, y, rx, ry):
        dx = x - rx
        flat = np.abs(dx) < 1e-6
        return g * np.where(flat, slope(x), (y - ry) / np.where(flat, 1, dx))

    return Layer(f, backward)


def relu() -> Layer:
    return elementwise(lambda x: np.maximum(x, 0), lambda x: (x > 0).astype(x.dtype))


def sigmoid() -> Layer:
    f = lambda x: 1 / (1 + np.exp(-x))
    return elementwise(f, lambda x: f(x) * (1 - f(x)))


def softmax() -> Layer:
    """Rescale rule, then less the mean over all elements."""

    def forward(x):
        e = np.exp(x - x.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    def backward(g, x, y, rx, ry):
        dx = x - rx
        flat = np.abs(dx) < 1e-6
        m = g * np.where(flat, y * (1 - y), (y - ry) / np.where(flat, 1, dx))
        return m - m.mean(-1, keepdims=True)

    return Layer(forward, backward)


def max_pool(width: int) -> Layer:
    """Maxima of adjacent windows; the change of each maximum goes to the positions that hold it in text or reference."""

    def forward(x):
        n = x.shape[2] // width
        return x[:, :, : n * width].reshape(*x.shape[:2], n, width).max(3)

    def backward(g, x, y, rx, ry):
        n = y.shape[2]
        cut = lambda a: a[:, :, : n * width].reshape(*a.shape[:2], n, width)
        a, b = cut(x), cut(rx)
        cross = np.maximum(y, ry)
        at_x, at_r = np.zeros_like(a), np.zeros_like(b)
        np.put_along_axis(at_x, a.argmax(3)[..., None], (g * (cross - ry))[..., None], 3)
        np.put_along_axis(at_r, b.argmax(3)[..., None], (g * (y - cross))[..., None], 3)
        total, dx = at_x + at_r, a - b
        flat = np.abs(dx) < 1e-7
        own = np.zeros_like(a)
        np.put_along_axis(own, a.argmax(3)[..., None], g[..., None], 3)
        out = np.zeros_like(x)
        out[:, :, : n * width] = np.where(flat, own, total / np.where(flat, 1, dx)).reshape(*x.shape[:2], n * width)
        return out

    return Layer(forward, backward)


def toy_graph(length: int, outputs: int = 2, seed: int = 0) -> Graph:
    """Convolution, ReLU, pooling and a dense layer with small random weights."""
    random = np.random.RandomState(seed)
    pooled = (length - 4) // 2
    return Graph([conv(random.randn(3, 4, 5) * 0.5), relu(), max_pool(2), flatten(), dense(random.randn(outputs, 3 * pooled) * 0.2)])


def deep_lift_shap(df: DataFrame, graph: Graph, *, outputs: list[int] | None = None, n_shuffles: int = 20, seed: int = 0, hypothetical: bool = False, references: DataFrame | None = None, warning: float = 1e-3) -> DataFrame:
    """(keys, output_idx, attribution, delta, converged): mean attributions over references; keys are all columns but seq.

    references: (example_idx, shuffle_idx, seq), and more keys if they differ
    in them; dinucleotide shuffles of each sequence by default.  attribution: array over letters and positions, letters first.
    delta: largest gap between the sum of contributions and the change of the
    output; converged: whether it is within the limit.  All outputs are the
    attribution maps of one position each for a model with one output a
    position.  Every row has its own result, also where rows share their keys;
    null and empty sequences have none.
    """
    outputs = [0] if outputs is None else outputs
    keys = keys_of(df)
    # Sequences of a length are neighbours, as they go through the graph together; the checkpoint fixes a row's number.
    df = df.where(F.length("seq") > 0).sortWithinPartitions(F.length("seq"))
    df = checkpointed(df.withColumn("__row", F.monotonically_increasing_id()))
    own = F.struct(*keys, "__row").alias("__keys")
    if references is None:
        shuffled = edits.dinucleotide_shuffle(df.select(F.col("example_idx").alias("__example"), own, "__row", "seq", F.col("seq").alias("__own")), n=n_shuffles, seed=seed, key="__example")
        pairs = shuffled.select("__row", F.col("__own").alias("seq"), F.col("seq").alias("ref"), "__keys")
    else:
        met = _with_references(df, references.hint("merge")).select("__row", "seq", "ref", own)
        # Letters are sent, not maps: a row's references follow each other, so that its sums are made up as they pass.
        pairs = met.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__row").sortWithinPartitions(F.length("seq"), "__row")
    found = ["output_idx", "attribution", "delta"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, size = [], 0
        row, sums, delta, n, of = None, None, None, 0, None

        def done() -> pa.RecordBatch:
            """The means of the rows that are complete, for each output."""
            key, sums, delta, n = (list(x) for x in zip(*ready, strict=True))
            ready.clear()
            value = [s[i] / m for s, m in zip(sums, n, strict=True) for i in range(len(outputs))]
            starts = np.r_[0, np.cumsum([len(v) for v in value])].astype(np.int32)
            each = pa.array(np.repeat(np.arange(len(key)), len(outputs)))
            columns = [pa.concat_arrays(key).take(each), pa.array(outputs * len(key), pa.int32()), pa.ListArray.from_arrays(starts, np.concatenate(value)), pa.array(np.concatenate(delta))]
            return pa.RecordBatch.from_arrays(columns, names=["__keys", *found])

        for batch in batches:
            numbers = batch.column(0).to_numpy()
            seq, ref = (batch.column(i).to_pylist() for i in (1, 2))
            i = 0
            while i < len(seq):
                stop = i + 1
                while stop < min(i + 64, len(seq)) and len(seq[stop]) == len(seq[i]):
                    stop += 1
                x, r = (models.one_hot_batch(c[i:stop]).astype(float) for c in (seq, ref))
                dy = graph(x) - graph(r)
                values, deltas = [], []
                for o in outputs:
                    m = graph.multipliers(x, r, o)
                    deltas.append(np.abs(dy[:, o] - ((x - r) * m).sum((1, 2))))
                    value = m - (r * m).sum(1, keepdims=True)
                    if not hypothetical:
                        value = value * x
                    values.append(value.reshape(len(value), -1))
                values, deltas = np.stack(values, 1), np.stack(deltas, 1)
                begins = np.flatnonzero(np.r_[True, numbers[i + 1 : stop] != numbers[i : stop - 1]])
                for k, (s, d, m) in enumerate(zip(np.add.reduceat(values, begins), np.maximum.reduceat(deltas, begins), np.diff(np.r_[begins, stop - i]), strict=True)):
                    at = i + int(begins[k])
                    if numbers[at] == row:
                        sums, delta, n = sums + s, np.maximum(delta, d), n + m
                        continue
                    if row is not None:
                        ready.append((of, sums, delta, n))
                        size += sums.nbytes
                    row, sums, delta, n, of = numbers[at], s, d, m, batch.column(3).slice(at, 1)
                if size > SENT:
                    yield done()
                    size = 0
                i = stop
        if row is not None:
            ready.append((of, sums, delta, n))
            yield done()

    kind = T.StructType([pairs.schema["__keys"], T.StructField("output_idx", T.IntegerType()), T.StructField("attribution", T.ArrayType(T.DoubleType())), T.StructField("delta", T.DoubleType())])
    out = pairs.mapInArrow(run, kind)
    return out.select(*[F.col("__keys")[c].alias(c) for c in keys], *found, (F.col("delta") <= warning).alias("converged"))


def _with_references(df: DataFrame, references: DataFrame) -> DataFrame:
    """(keys, seq, ref): each sequence with the references of its example, or of all keys that both tables have."""
    on = [c for c in keys_of(df) if c in references.columns and c != "shuffle_idx"]
    refs = references.select(*[F.col(c).alias(f"__{c}_r") for c in on], F.col("seq").alias("ref"))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}_r"))
    return df.join(refs, same).select(*keys_of(df), "seq", "ref")


def pisa(df: DataFrame, graph: Graph, n_outputs: int, **options) -> DataFrame:
    """Attributions of every output position."""
    return deep_lift_shap(df, graph, outputs=list(range(n_outputs)), **options)


def linear_deep_lift(df: DataFrame, references: DataFrame, weight: Callable[[Column, Column], Column]) -> DataFrame:
    """(keys, pos, value): attributions of a linear model in closed form: weight of the letter less the references' mean weight; keys are all columns but seq.

    References: (example_idx, shuffle_idx, seq), and more keys if they differ in
    them.  Null and empty sequences have no rows.
    """
    at = lambda c: F.instr(F.lit(scalar.ALPHABET), F.substring(F.col(c), F.col("pos") + 1, F.lit(1))) - 1
    w = lambda c: F.when(at(c) >= 0, weight(at(c), F.col("pos"))).otherwise(F.lit(0)).cast("double")
    rows = _with_references(df, references).withColumn("pos", F.explode(F.when(F.length("seq") > 0, F.sequence(F.lit(0), F.length("seq") - 1))))
    return rows.groupBy(*keys_of(df), "pos").agg(F.avg(w("seq") - w("ref")).alias("value"))
