"""Sequence design: the driver goes round by round, each round is one Spark job over all candidates.

Losses are Column functions of a model's output.  Ties go to the first motif
in the list, then to the first position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import scalar
from helixframe.operators import models
from helixframe.operators.order import checkpointed

Loss = Callable[[Column], Column]


def distance_to(y: float) -> Loss:
    return lambda out: F.pow(out - F.lit(float(y)), F.lit(2.0))


def highest() -> Loss:
    return lambda out: F.lit(0.0) - out.cast("double")


def random_sequences(df: DataFrame, length: int, *, seed: int = 0, key: str = "example_idx", probs: list[float] | None = None) -> DataFrame:
    """(key, seq): a sequence for each key, letters drawn by hash; of length 0 or less it is empty."""
    if length <= 0:
        return df.select(key, F.lit("").alias("seq"))
    letter = lambda p: scalar.draw_letter(scalar.hash_unit(seed, F.col(key), p), probs)
    return df.select(key, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), letter), "").alias("seq"))


def screen(df: DataFrame, model: models.SqlModel, loss: Loss, *, n_best: int = 1, key: str = "example_idx", head: str = "y") -> DataFrame:
    """(key, seq, loss): the n_best sequences of least loss, best first."""
    scored = df.select(key, "seq", loss(model.heads[head](F.col("seq"))).alias("loss"))
    return scored.orderBy("loss", key).limit(n_best)


def screen_rounds(keys: DataFrame, model: models.SqlModel, loss: Loss, generate: Callable[[DataFrame, int], DataFrame], *, n_best: int = 1, tol: float = 1e-3, max_iter: int = -1, seed: int = 0, key: str = "example_idx", head: str = "y") -> DataFrame:
    """(round, key, seq, loss): the n_best sequences of least loss among all that rounds of generate make, best first.

    generate(keys, seed) gives (key, seq), a sequence for each row of keys; the
    seed grows by one a round.  Rounds end when the worst of n_best sequences
    has a loss below tol, or after max_iter of them, if that is positive.  Each
    round is a job over all its sequences, of which n_best come to the driver;
    ties go to the earlier round, then by key.  Without keys, or with an n_best
    of 0, there is one round and no row.
    """
    schema = f"round int, {key} {keys.schema[key].dataType.simpleString()}, seq string, loss double"
    best: list[tuple] = []
    done, some = 0, n_best > 0 and not keys.isEmpty()
    while some:
        scored = generate(keys, seed + done).select(F.lit(done).alias("round"), key, "seq", loss(model.heads[head](F.col("seq"))).cast("double").alias("loss"))
        # Those that come in behind the worst kept one needn't be sorted.
        new = scored if len(best) < n_best else scored.where(F.col("loss") < best[-1][3])
        best = sorted([*best, *map(tuple, new.orderBy("loss", key).limit(n_best).collect())], key=lambda r: (r[3], r[0], r[1] is not None, r[1]))[:n_best]
        done += 1
        if done == max_iter or len(best) == n_best and best[-1][3] < tol:
            break
    return df_of(keys, best, schema)


def df_of(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def _tries(motifs: list[str] | None, reverse_complement: bool) -> list[str]:
    """Motifs to put in, with those of the other strand behind them; single letters if motifs is None."""
    if motifs is None:
        return list(scalar.ALPHABET)
    pairs = dict(zip("ACGTN", "TGCAN", strict=True))
    return [*motifs, *("".join(pairs[c] for c in reversed(m)) for m in motifs if reverse_complement)]


def _edited(seq: Column, motif: Column, pos: Column, tries: list[str]) -> Column:
    """seq with a motif, one of tries, written over it; the motif's unknown letters leave what is there."""
    put = motif
    if any(scalar.UNKNOWN in m for m in tries):
        # Letter by letter only for motifs that have some.
        known = F.transform(F.split(motif, ""), lambda c, i: F.when(c == scalar.UNKNOWN, F.substring(seq, pos + i + 1, F.lit(1))).otherwise(c))
        put = F.when(F.contains(motif, F.lit(scalar.UNKNOWN)), F.array_join(known, "")).otherwise(motif)
    return F.overlay(seq, put, pos + 1)


def _places(seq: Column, motif: Column, mask: list[int] | None, output_mask: list[int] | None) -> Column:
    """Where a motif may start: positions of mask, such that only those of output_mask change."""
    last = F.length(seq) - F.length(motif)
    some = F.sequence(F.lit(0), last) if mask is None else F.filter(F.array(*map(F.lit, mask)).cast("array<int>"), lambda p: p <= last)
    some = F.when(last >= 0, some).otherwise(F.array().cast("array<int>"))
    if output_mask is None:
        return some
    return F.filter(some, lambda p: F.forall(F.sequence(p, p + F.length(motif) - 1), lambda q: q.isin(*output_mask)))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), for which value is worked out once."""
    return F.get(F.transform(F.array(value), f), 0)


def over_edits(seq: Column, zero: Column, merge: Callable[[Column, Column], Column], loss: Callable[..., Column], motifs: list[str] | None, *, reverse_complement: bool = True, mask: list[int] | None = None, output_mask: list[int] | None = None) -> Column:
    """zero merged with (loss, motif_idx, pos, seq) of each edit in turn: every motif at every allowed place of seq; single letters if motifs is None.

    loss: a function of the edited sequence, the place and the motif's length.
    mask: positions at which a motif may start; output_mask: positions that may
    change.  Edits are made and merged one by one in the sequence's own row, so
    that none is sorted, sent or kept.
    """
    tries = _tries(motifs, reverse_complement)
    each = F.array(*[F.struct(F.lit(i).alias("motif_idx"), F.lit(m).alias("motif")) for i, m in enumerate(tries)])

    def step(acc: Column, t: Column, p: Column) -> Column:
        found = lambda e: F.struct(loss(e, p, F.length(t["motif"])).alias("loss"), t["motif_idx"].alias("motif_idx"), p.alias("pos"), e.alias("seq"))
        return _let(_edited(seq, t["motif"], p, tries), lambda e: _let(found(e), lambda new: merge(acc, new)))

    return F.aggregate(each, zero, lambda acc, t: F.aggregate(_places(seq, t["motif"], mask, output_mask), acc, lambda own, p: step(own, t, p)))


def _scored(df: DataFrame, model: models.SqlModel, loss: Loss, head: str) -> tuple[DataFrame, Callable[..., Column], str]:
    """df with y0 and loss, the loss of an edit of its seq (of the edited sequence, the place and the width), and the type of an edit."""
    now = df.withColumn("y0", model.heads[head](F.col("seq"))).withColumn("loss", loss(F.col("y0")))
    kind = now.schema["loss"].dataType.simpleString()
    after = lambda e, at, width: loss(model.after(head, F.col("y0"), F.col("seq"), e, at, width)).cast(kind)
    return now, after, f"struct<loss:{kind},motif_idx:int,pos:int,seq:string>"


def greedy_round(df: DataFrame, model: models.SqlModel, loss: Loss, motifs: list[str] | None = None, *, key: str = "example_idx", head: str = "y", **options) -> DataFrame:
    """(key, seq, loss): each sequence after its best edit, or as it was where no edit has a strictly lower loss.

    Each row is worked on by itself, also where rows share a key or have none.
    """
    now, after, kind = _scored(df.select(key, "seq"), model, loss, head)
    best = now.withColumn("best", over_edits(F.col("seq"), F.lit(None).cast(kind), F.least, after, motifs, **options))
    better = F.col("best.loss") < F.col("loss")
    return best.select(key, F.when(better, F.col("best.seq")).otherwise(F.col("seq")).alias("seq"), F.when(better, F.col("best.loss")).otherwise(F.col("loss")).alias("loss"))


def greedy_substitution(df: DataFrame, model: models.SqlModel, loss: Loss, motifs: list[str] | None = None, *, tol: float = 1e-3, max_iter: int = -1, key: str = "example_idx", **options) -> DataFrame:
    """Rounds until no sequence improves by more than tol, or max_iter of them.  As the default is -1, no round is run unless a number is given."""
    now = df.select(key, "seq")
    last = None
    done = 0
    while done < max_iter:
        now = checkpointed(greedy_round(now, model, loss, motifs, key=key, **options))
        total = now.agg(F.sum("loss")).first()[0]
        done += 1
        if last is not None and last - total <= tol:
            break
        last = total
    return now


def candidates(df: DataFrame, motifs: list[str] | None, *, reverse_complement: bool = True, mask: list[int] | None = None, output_mask: list[int] | None = None) -> DataFrame:
    """df with motif_idx, pos, new_seq and motif_length: every motif at every allowed place of every sequence, a row each; options as for over_edits."""
    tries = _tries(motifs, reverse_complement)
    each = F.array(*[F.struct(F.lit(i).alias("motif_idx"), F.lit(m).alias("motif")) for i, m in enumerate(tries)])
    rows = df.select("*", F.explode(each).alias("tried")).withColumn("motif_idx", F.col("tried.motif_idx")).withColumn("motif", F.col("tried.motif")).drop("tried")
    rows = rows.withColumn("pos", F.explode(_places(F.col("seq"), F.col("motif"), mask, output_mask)))
    return rows.withColumn("new_seq", _edited(F.col("seq"), F.col("motif"), F.col("pos"), tries)).withColumn("motif_length", F.length("motif")).drop("motif")


#: Beams of up to so many sequences are picked in each member's own row first.
FEW = 32


def _into_beam(beam: int) -> Callable[[Column, Column], Column]:
    """Merges an edit into the beam best distinct sequences so far, best first; of a sequence the least loss and the first edit count."""

    def merge(acc: Column, new: Column) -> Column:
        same = lambda x: x["seq"] == new["seq"]
        again = F.transform(acc, lambda x: F.when(same(x), F.struct(F.least(x["loss"], new["loss"]).alias("loss"), x["motif_idx"].alias("motif_idx"), x["pos"].alias("pos"), x["seq"].alias("seq"))).otherwise(x))
        more = F.when(F.exists(acc, same), again).otherwise(F.array_append(acc, new))
        return F.when((F.size(acc) < beam) | (new < F.get(acc, F.size(acc) - 1)), F.slice(F.sort_array(more), 1, beam)).otherwise(acc)

    return merge


def beam_round(df: DataFrame, model: models.SqlModel, loss: Loss, beam: int, motifs: list[str] | None = None, *, head: str = "y", **options) -> DataFrame:
    """(seq, loss, counter): the beam best distinct sequences among members and all their edits; members go first among equals.

    What is among the best of all is among those of the member it comes from,
    so a member sends on no more than beam rows.
    """
    now, after, kind = _scored(df.select("seq"), model, loss, head)
    if beam > FEW:
        tried = candidates(now.select("seq", "y0"), motifs, **options).select(F.col("new_seq").alias("seq"), after(F.col("new_seq"), F.col("pos"), F.col("motif_length")).alias("loss"), "motif_idx", "pos")
        all_of = now.select("seq", "loss", F.lit(-1).alias("motif_idx"), F.lit(-1).alias("pos")).union(tried.select("seq", "loss", "motif_idx", "pos"))
    else:
        member = F.array(F.struct(F.col("loss").alias("loss"), F.lit(-1).alias("motif_idx"), F.lit(-1).alias("pos"), F.col("seq").alias("seq"))).cast(f"array<{kind}>")
        # Never empty; of an inner explode Spark would look at the array first, and work it out again for that.
        best = now.select(over_edits(F.col("seq"), member, _into_beam(beam), after, motifs, **options).alias("best"))
        all_of = best.select(F.explode_outer("best").alias("x")).select("x.seq", "x.loss", "x.motif_idx", "x.pos")
    once = all_of.groupBy("seq").agg(F.min("loss").alias("loss"), F.min(F.struct("motif_idx", "pos")).alias("counter"))
    return once.orderBy("loss", "counter", "seq").limit(beam)


def beam_substitution(df: DataFrame, model: models.SqlModel, loss: Loss, motifs: list[str] | None = None, *, beam: int = 4, n_best: int = 1, tol: float = 1e-3, max_iter: int = -1, **options) -> DataFrame:
    """(seq, loss): the n_best of the last beam; rounds go on until the best loss improves by tol or less (or max_iter, if not negative)."""
    now, last, done = df.select("seq"), None, 0
    while max_iter < 0 or done < max_iter:
        now = checkpointed(beam_round(now, model, loss, beam, motifs, **options))
        best = now.agg(F.min("loss")).first()[0]
        done += 1
        if last is not None and last - best <= tol:
            break
        last = best
        now = now.select("seq", "loss")
    return now.select("seq", "loss").orderBy("loss", "seq").limit(n_best)


def greedy_marginalize(backgrounds: DataFrame, model: models.SqlModel, y: float, motifs: list[str], *, max_spacing: int = 12, max_iter: int = -1, tol: float = 1e-3, head: str = "y") -> tuple[str, int]:
    """The construct (letters, N for gaps) and its start that brings the mean effect on all backgrounds nearest to y, motif by motif.

    The first motif is tried at one place, the middle; later ones anywhere
    from max_spacing before the construct to max_spacing after it.
    """
    f = model.heads[head]
    length = backgrounds.agg(F.min(F.length("seq"))).first()[0]
    construct, start, last, done = "", length // 2 - 1, float(y) ** 2, 0
    while max_iter < 0 or done < max_iter:
        options = []
        for motif in motifs:
            places = [start] if not construct else range(max(0, start - max_spacing - len(motif)), min(length - len(motif), start + len(construct) + max_spacing) + 1)
            for p in places:
                low, high = min(start, p) if construct else p, max(start + len(construct), p + len(motif))
                if low < 0 or high > length:
                    continue
                letters = list("N" * (high - low))
                letters[start - low : start - low + len(construct)] = construct
                letters[p - low : p - low + len(motif)] = motif
                options.append(("".join(letters), low))
        if not options:
            break
        best, loss = best_effect(backgrounds, f, options, y)
        done += 1
        if last - loss <= tol:
            break
        (construct, start), last = options[best], loss
    return construct, start


def best_effect(backgrounds: DataFrame, f: Callable[[Column], Column], options: list[tuple[str, int]], y: float) -> tuple[int, float]:
    """The number of the option (construct, start) whose effect on the backgrounds is nearest to y in the mean of squares, and that mean; ties go to the first.

    Options are rows: each background meets each of them, and sums are made up before the shuffle.
    """
    table = df_of(backgrounds, [(i, c, at) for i, (c, at) in enumerate(options)], "i int, construct string, at int")
    each = backgrounds.select("seq", f(F.col("seq")).alias("y0")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(options) - 1))))
    put = F.col("construct")
    if any(scalar.UNKNOWN in c for c, _ in options):
        put = F.array_join(F.transform(F.split(put, ""), lambda c, j: F.when(c == scalar.UNKNOWN, F.substring(F.col("seq"), F.col("at") + j + 1, F.lit(1))).otherwise(c)), "")
    after = f(F.overlay("seq", put, F.col("at") + 1))
    losses = each.join(F.broadcast(table), "i").groupBy("i").agg(F.avg(F.pow(F.lit(float(y)) - (after - F.col("y0")), F.lit(2.0))).alias("loss"))
    best = losses.orderBy("loss", "i").first()
    return best["i"], best["loss"]
