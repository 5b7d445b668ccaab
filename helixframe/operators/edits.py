"""Edits that need rows or random numbers: shuffles, random regions, variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions import scalar


def whole_end(length: int, end: int) -> int:
    """A negative end counts from the right, -1 being the last position, included."""
    return length + 1 + end if end < 0 else end


def shuffle(df: DataFrame, *, start: int = 0, end: int, n: int = 1, seed: int = 0, seq: str = "seq") -> DataFrame:
    """n rows for each, with shuffle_idx: [start, end) in a random order that is the same for all rows of an iteration.

    The orders are as many as iterations, drawn on the driver and written into the plan.
    """
    if not 0 <= start < end:
        raise ValueError("start must be at least 0 and before end")
    random = np.random.RandomState(seed)
    orders = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[F.lit(int(x)) for x in random.permutation(end - start)]).alias("o")) for i in range(n)])
    rows = df.withColumn("__order", F.explode(orders))
    return rows.withColumn("shuffle_idx", F.col("__order.i")).withColumn(seq, scalar.permute(F.col(seq), F.col("__order.o"), start)).drop("__order")


def randomize(df: DataFrame, *, start: int, end: int, probs: list[float] | None = None, n: int = 1, seed: int = 0, key: str = "example_idx", seq: str = "seq") -> DataFrame:
    """n rows for each, with shuffle_idx: the letters of [start, end) drawn anew, by a hash of seed, key, iteration and position."""
    if not 0 <= start < end:
        raise ValueError("start must be at least 0 and before end")
    rows = df.withColumn("shuffle_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    letter = lambda p: scalar.draw_letter(scalar.hash_unit(seed, F.col(key), F.col("shuffle_idx"), p), probs)
    drawn = F.array_join(F.transform(F.sequence(F.lit(start), F.lit(end - 1)), letter), "")
    return rows.withColumn(seq, F.overlay(F.col(seq), drawn, F.lit(start + 1)))


def eulerian(letters: np.ndarray, n: int, seed: int, size: int = 5) -> list[np.ndarray]:
    """n random sequences with the same first and last letter and the same pairs of neighbours.

    Every letter's list of successors is shuffled but for its last member,
    which keeps the walk from ending early; then the walk follows the lists.
    """
    random = np.random.RandomState(seed)
    nexts = [np.flatnonzero(letters[:-1] == c) + 1 for c in range(size)]
    out = []
    for _ in range(n):
        for c in range(size):
            if len(nexts[c]) > 1:
                nexts[c] = np.append(nexts[c][:-1][random.permutation(len(nexts[c]) - 1)], nexts[c][-1])
        used = [0] * size
        at, walk = 0, [letters[0]] if len(letters) else []
        for _ in range(len(letters) - 1):
            c = letters[at]
            at = nexts[c][used[c]]
            used[c] += 1
            walk.append(letters[at])
        out.append(np.array(walk, dtype=letters.dtype))
    return out


#: Letters of shuffled sequences that a task walks at once.
WALKED = 1 << 21


def eulerian_batch(parts: list[np.ndarray], n: int, seeds: list[int], size: int = 5) -> list[np.ndarray]:
    """For each sequence the n walks of eulerian() with its seed, as rows of an array; all walks of the batch go forward in step.

    Each walk has its successor lists in one row, letter after letter, and a
    pointer into each of them; a step is one numpy operation for all walks that
    haven't ended.
    """
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    longest = len(parts[order[0]]) if order else 0
    if longest == 0:
        return [np.zeros((n, 0), np.int8) for _ in parts]
    letters = np.zeros((len(parts), longest), np.int8)
    nexts = np.zeros((len(parts) * n, max(1, longest - 1)), np.int32)
    pointer = np.zeros((len(parts) * n, size), np.int64)
    for row, i in enumerate(order):
        part, random = parts[i], np.random.RandomState(seeds[i])
        letters[row, : len(part)] = part
        lists = np.argsort(part[:-1], kind="stable").astype(np.int32) + 1
        ends = np.cumsum(np.bincount(part[:-1], minlength=size)) if len(part) > 1 else np.zeros(size, np.int64)
        starts = np.r_[0, ends[:-1]]
        pointer[row * n : row * n + n] = starts
        for k in range(n):
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                if b - a > 1:
                    lists[a : b - 1] = lists[a : b - 1][random.permutation(b - a - 1)]
            nexts[row * n + k, : len(lists)] = lists
    out = np.zeros((len(parts) * n, longest), np.int8)
    source = np.repeat(np.arange(len(parts)), n)
    lengths = np.array([len(parts[i]) for i in order])
    at, walks = np.zeros(len(source), np.int64), np.arange(len(source))
    out[:, 0] = letters[source, 0]
    for step in range(1, longest):
        m = int(np.searchsorted(-lengths, -step)) * n  # sequences are in order of length: the first ones go on
        letter = out[:m, step - 1]
        spot = pointer[walks[:m], letter]
        pointer[walks[:m], letter] += 1
        at[:m] = nexts[walks[:m], spot]
        out[:m, step] = letters[source[:m], at[:m]]
    found: list[np.ndarray] = [out[:0]] * len(parts)
    for row, i in enumerate(order):
        found[i] = out[row * n : row * n + n, : len(parts[i])]
    return found


def dinucleotide_shuffle(df: DataFrame, *, start: int = 0, end: int = -1, n: int = 20, seed: int = 0, key: str = "example_idx", seq: str = "seq") -> DataFrame:
    """(columns of df, shuffle_idx, seq): shuffles of [start, end) that keep all pairs of neighbours; row i uses the seed plus its key.

    A null key counts 0; the shuffles of a null sequence are null, those of an
    empty one empty.
    """
    others = [c for c in df.columns if c != seq]
    code = np.full(256, 4, np.int8)
    code[np.frombuffer(scalar.ALPHABET.encode(), np.uint8)] = range(len(scalar.ALPHABET))
    back = np.frombuffer((scalar.ALPHABET + scalar.UNKNOWN).encode(), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column(len(others)).to_pylist(), batch.column(len(others) + 1).to_pylist()
            sizes = [len(s or "") * n for s in texts]
            at = 0
            while at < len(texts):
                stop, total = at, 0
                while stop < len(texts) and (stop == at or total + sizes[stop] <= WALKED):
                    total += sizes[stop]
                    stop += 1
                some = [s or "" for s in texts[at:stop]]
                ends = [whole_end(len(s), end) for s in some]
                parts = [code[np.frombuffer(s[start:e].encode("ascii", "replace"), np.uint8)] for s, e in zip(some, ends, strict=True)]
                walks = eulerian_batch(parts, n, [(seed + int(k or 0)) % (1 << 32) for k in keys[at:stop]])
                new = []
                for text, s, e, w in zip(texts[at:stop], some, ends, walks, strict=True):
                    new += [None] * n if text is None else [s[:start] + x.tobytes().decode() + s[e:] for x in back[w]]
                rows = batch.slice(at, stop - at).take(pa.array(np.repeat(np.arange(stop - at), n)))
                numbers = pa.array(np.tile(np.arange(n, dtype=np.int32), stop - at))
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(others)], numbers, pa.array(new, pa.string())], names=[*others, "shuffle_idx", seq])
                at = stop

    kept = df.select(*others, seq, F.col(key).alias("__key"))
    return kept.mapInArrow(run, T.StructType([*[kept.schema[c] for c in others], T.StructField("shuffle_idx", T.IntegerType()), kept.schema[seq]]))


def _edit_map(edits: DataFrame, key: str, value: Column, *, all_of: bool = False) -> DataFrame:
    """(key, edits): position -> value; of edits at one position the greatest value counts, or all in order as one string."""
    at_once = F.array_join(F.array_sort(F.collect_list(value)), "") if all_of else F.max(value)
    once = edits.groupBy(key, "pos").agg(at_once.alias("v"))
    return once.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("edits"))


def _letters(seq: str) -> Column:
    return F.sequence(F.lit(0), F.length(seq) - 1)


def _with_edits(df: DataFrame, edits: DataFrame, key: str, kind: str) -> DataFrame:
    empty = F.expr(f"cast(map() as map<bigint,{kind}>)")
    return df.join(edits, key, "left").withColumn("edits", F.coalesce("edits", empty))


def apply_substitutions(df: DataFrame, edits: DataFrame, *, key: str = "example_idx", seq: str = "seq") -> DataFrame:
    """All of an example's point edits (key, pos, char_idx) at once."""
    letter = F.substring(F.lit(scalar.ALPHABET), F.col("char_idx") + 1, F.lit(1))
    rows = _with_edits(df.select(key, seq), _edit_map(edits, key, letter), key, "string")
    new = F.transform(_letters(seq), lambda p: F.coalesce(F.element_at("edits", p.cast("long")), F.substring(F.col(seq), p + 1, F.lit(1))))
    return rows.select(key, F.when(F.length(seq) > 0, F.array_join(new, "")).otherwise(F.col(seq)).alias(seq))


def apply_deletions(df: DataFrame, edits: DataFrame, *, left: bool = False, key: str = "example_idx", seq: str = "seq") -> DataFrame:
    """(key, before, after): positions (key, pos) deleted, then all examples trimmed to lose as many; before is trimmed on the same side.

    Trimming is on the right, or on the left if left.
    """
    rows = _with_edits(df.select(key, seq), _edit_map(edits, key, F.lit(1)), key, "int")
    most = edits.select(key, "pos").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    keep = F.filter(_letters(seq), lambda p: F.element_at("edits", p.cast("long")).isNull())
    short = F.array_join(F.transform(keep, lambda p: F.substring(F.col(seq), p + 1, F.lit(1))), "")
    size = F.length(seq) - most
    cut = lambda s: F.substring(s, F.length(s) - size + 1, size) if left else F.substring(s, F.lit(1), size)
    return rows.select(key, cut(F.col(seq)).alias("before"), cut(short).alias("after"))


def apply_insertions(df: DataFrame, edits: DataFrame, *, left: bool = False, key: str = "example_idx", seq: str = "seq") -> DataFrame:
    """Letters (key, pos, char_idx) put in before their positions, then trimmed to the old length on the right, or on the left if left; several at one position go in in the alphabet's order."""
    letter = F.substring(F.lit(scalar.ALPHABET), F.col("char_idx") + 1, F.lit(1))
    rows = _with_edits(df.select(key, seq), _edit_map(edits, key, letter, all_of=True), key, "string")
    new = F.transform(_letters(seq), lambda p: F.concat(F.coalesce(F.element_at("edits", p.cast("long")), F.lit("")), F.substring(F.col(seq), p + 1, F.lit(1))))
    long = F.array_join(new, "")
    size = F.length(seq)
    return rows.select(key, (F.substring(long, F.length(long) - size + 1, size) if left else F.substring(long, F.lit(1), size)).alias(seq))
