"""Models of sequences, in two forms: a Column expression, or a numpy function on one-hot batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import scalar


@dataclass
class Local:
    """How far an edit reaches: outputs before and after it differ as much as part(piece, place) does over the letters up to reach beyond it on either side.

    piece: a stretch of the sequence, place: where it begins.
    """

    reach: int
    part: Callable[[Column, Column], Column]


@dataclass
class SqlModel:
    """heads: outputs by name, each a function of the sequence column; local: for those of which edits reach only so far."""

    heads: dict[str, Callable[[Column], Column]]
    local: dict[str, Local] = field(default_factory=dict)

    def after(self, head: str, y0: Column, seq: Column, edited: Column, at: Column, width: Column) -> Column:
        """The output for edited, which differs from seq at most at width letters from place at on; y0 is that for seq.

        Where the head is local, only the letters within its reach are scored.
        """
        own = self.local.get(head)
        if own is None:
            return self.heads[head](edited)
        low = F.greatest(at - own.reach, F.lit(0))
        piece = lambda s: F.substring(s, (low + 1).cast("int"), (at + width + own.reach - low).cast("int"))
        return y0 + own.part(piece(edited), low) - own.part(piece(seq), low)


def linear(weight: Callable[[Column, Column], Column], seq: Column, place: Column | None = None) -> Column:
    """Sum over positions of weight(letter's index, position); N adds nothing.  place: the position of the first letter, if not 0."""
    at = F.instr
    inner = weight
    if place is not None:
        weight = lambda c, p: inner(c, p + place)
    return F.aggregate(
        F.transform(F.split(seq, ""), lambda c, p: F.when(at(F.lit(scalar.ALPHABET), c) > 0, weight(at(F.lit(scalar.ALPHABET), c) - 1, p)).otherwise(F.lit(0))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )


def toy_weight(c: Column, p: Column) -> Column:
    """Small integers that vary with letter and position."""
    return (c * 7 + p * 3) % 11 - 5


TOY = SqlModel({"y": lambda seq: linear(toy_weight, seq)}, {"y": Local(0, lambda piece, place: linear(toy_weight, piece, place))})
#: Counts of two motifs, which depend on neighbours.
COUNTER = SqlModel({"y": lambda seq: F.regexp_count(seq, F.lit("ACG")).cast("long") * 3 - F.regexp_count(seq, F.lit("TT")).cast("long")})


def _motifs(seq: Column) -> Column:
    return F.regexp_count(seq, F.lit("ACG")).cast("long") * 3 - F.regexp_count(seq, F.lit("TA")).cast("long")


#: Counts of motifs that don't overlap themselves, so that an edit reaches two letters.
MOTIFS = SqlModel({"y": _motifs}, {"y": Local(2, lambda piece, place: _motifs(piece))})


def predict(df: DataFrame, model: SqlModel, *, seq: str = "seq", prefix: str = "") -> DataFrame:
    """Adds a column for each head."""
    return df.withColumns({prefix + name: f(F.col(seq)) for name, f in model.heads.items()})


def one_hot_batch(seqs: list[str]) -> np.ndarray:
    """(n, 4, length) from equally long sequences; N is a column of zeros."""
    table = np.zeros((256, 4), np.float32)
    for i, c in enumerate(scalar.ALPHABET):
        table[ord(c), i] = 1
    if not seqs:
        return np.zeros((0, 4, 0), np.float32)
    return table[np.frombuffer("".join(seqs).encode(), np.uint8).reshape(len(seqs), -1)].transpose(0, 2, 1)


def predict_numpy(df: DataFrame, model: Callable[[np.ndarray], np.ndarray], *, seq: str = "seq", batch_size: int = 256) -> DataFrame:
    """Adds y (array of outputs) by a numpy function on one-hot batches; only keys, sequence and outputs pass through Python."""
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list = [None] * len(batch)
            by_length = batch.groupby(batch[seq].str.len()).indices if len(batch) else {}
            for at in by_length.values():
                for i in range(0, len(at), batch_size):
                    some = at[i : i + batch_size]
                    y = np.asarray(model(one_hot_batch(batch[seq].iloc[some].tolist()))).reshape(len(some), -1)
                    for j, row in zip(some, y, strict=True):
                        out[j] = row.astype(float).tolist()
            yield batch.assign(y=out)[[*columns, "y"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, y array<double>")
