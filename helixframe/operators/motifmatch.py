"""Names for spans: the motifs of a database that fit a sequence best, with exact p-values.

A column of a motif is scored against a letter by minus the distance between
its probabilities and the letter's own, in whole steps, less the letter's
median over all columns of the database, so that letters beyond a motif's ends
count nothing.  Under the null hypothesis each letter meets a column drawn from
the database; the distribution of an alignment's score is the convolution of
its letters' histograms, and depends only on how often each letter occurs in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.operators.order import checkpointed

#: Columns of motifs that are broadcast at once; a larger database takes a pass over the sequences for each such part.
COLUMNS = 1_000_000
#: Tables of densities and tails that a task keeps, by their size in numbers.
CACHE = 8_000_000
#: Motifs of a group, bytes of a block's table of words, letters of a word, and letters beyond which a sequence goes letter by letter.
GROUP, TABLE, WORD, LONG = 4, 24 << 20, 3, 128
#: Offsets and groups that are scored at once.
PAIRS = 20_000
#: Letters of sequences that go through all blocks together.
LETTERS = 100_000
#: Bits of each letter's number in the code of a composition; one of each letter, and of an unknown one.
COUNT = 15
UNITS = np.array([1 << COUNT * a for a in range(4)] + [0])
RESULT = "seq string, motif_idx long, strand int, offset int, score int, p_value double"


def column_steps(probs: Column, bins: int) -> Column:
    """For each of the four letters the score of a motif column, in steps from 0 to bins - 1; a column without weight is uniform."""
    total = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)
    share = F.transform(probs, lambda x: F.when(total > 0, x / total).otherwise(0.25))
    square = F.aggregate(share, F.lit(0.0), lambda a, x: a + x * x)
    near = F.transform(share, lambda x: 1 - F.sqrt(F.greatest(square - 2 * x + 1, F.lit(0.0)) / 2))
    return F.transform(near, lambda x: F.least(F.greatest(F.floor(x * (bins - 1) + 0.5), F.lit(0)), F.lit(bins - 1)).cast("int"))


class Null:
    """Tail probabilities of alignment scores: histogram[letter] holds the share of columns at each step, from -low[letter] on."""

    def __init__(self, histogram: np.ndarray, low: np.ndarray):
        self.histogram, self.low = histogram, low.tolist()
        self.cache: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        self.held = 0

    def of(self, code: int) -> tuple[np.ndarray, np.ndarray, int]:
        """For an alignment of so many letters of each kind (counts as COUNT bits each): the density of its score, -P(score >= least + i), and the least possible score.

        One letter after the other is folded in, in their order, from the longest start that is known.
        """
        found = self.cache.get(code)
        if found is not None:
            return found
        todo, density, least = [], np.ones(1), 0
        while code and code not in self.cache:
            last = (code.bit_length() - 1) // COUNT
            todo.append((code, last))
            code -= 1 << COUNT * last
        if code in self.cache:
            density, _, least = self.cache[code]
        else:
            todo.append((0, None))
        for key, last in reversed(todo):
            if last is not None:
                density, least = np.convolve(density, self.histogram[last]), least - self.low[last]
            self.cache[key] = density, -np.minimum(np.cumsum(density[::-1])[::-1], 1.0), least
            self.held += 2 * len(density)
        found = density, self.cache[key][1], least
        while self.held > CACHE and len(self.cache) > 1:
            self.held -= 2 * len(self.cache.pop(next(iter(self.cache)))[0])
        return found


def word_starts(longest: int) -> list[int]:
    """Where the words of each number of letters begin in a table of all words of up to so many."""
    return [0, *(sum(4**j for j in range(1, k)) for k in range(1, longest + 2))]


def words_of(letters: list[int], longest: int) -> list[tuple[int, int]]:
    """(place, row in a block's table) of the words that a sequence consists of; unknown letters (4) are between words."""
    starts, out, i = word_starts(longest), [], 0
    while i < len(letters):
        code = k = 0
        while k < longest and i + k < len(letters) and letters[i + k] < 4:
            code, k = code * 4 + letters[i + k], k + 1
        if k:
            out.append((i, starts[k] + code))
        i += k or 1
    return out


class Block:
    """Motifs of as many columns each, in groups of GROUP.

    most: for each word of up to longest letters the greatest score that a
    motif of a group gives it, at each place of the motifs with pad empty
    places on both sides; a row a word, places first, then groups.
    own: scores of single letters, a row a letter (the fifth is an unknown one)
    and column; then groups, then their motifs.  A last group that lacks motifs
    has the last one several times.
    """

    def __init__(self, steps: np.ndarray, motifs: np.ndarray, pad: int, longest: int, kind: type):
        columns, self.pad = steps.shape[1], pad
        self.groups = -(-len(motifs) // GROUP)
        full = np.minimum(np.arange(self.groups * GROUP), len(motifs) - 1)
        self.motifs = motifs[full].reshape(-1, GROUP)
        letters = steps[full].transpose(2, 1, 0).astype(kind)
        self.own = np.concatenate([letters, np.zeros_like(letters[:1])]).reshape(5 * columns, self.groups, GROUP)
        places = columns + 2 * pad
        one = np.zeros((4, GROUP, places + longest, self.groups), kind)
        one[:, :, pad : pad + columns] = letters.reshape(4, columns, self.groups, GROUP).transpose(0, 3, 1, 2)
        self.most = np.empty((word_starts(longest)[-1], places * self.groups), kind)
        row, words = 0, one
        for k in range(1, longest + 1):
            following = []
            for x in words:
                np.max(x[:, :places].reshape(GROUP, -1), axis=0, out=self.most[row])
                row += 1
            if k < longest:
                # A word of one letter more: its last letter stands k places on.
                for x in words:
                    for y in one:
                        longer = x.copy()
                        longer[:, :-k] += y[:, k:]
                        following.append(longer)
                words = following

    def bounds(self, x: Search, space: np.ndarray) -> np.ndarray:
        """For each strand and offset and each group no less than the best score there."""
        long = (x.columns + x.n - 1) * self.groups
        for s, words in enumerate(x.words):
            own, before = space[s * long : (s + 1) * long], None
            for place, word in words:
                start = (self.pad - x.n + 1 + place) * self.groups
                part = self.most[word, start : start + long]
                before = part if before is None else np.add(before, part, out=own)
            if before is not own:
                own[:] = before
        return space[: len(x.words) * long].reshape(-1, self.groups)

    def scores(self, x: Search, rows: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Scores of the motifs of some groups, each at a strand and offset of its own."""
        column = np.arange(x.columns)
        strand, offset = np.divmod(rows, x.columns + x.n - 1)
        letters = x.padded[strand[:, None], (x.n - 1 + x.columns - 1 - offset)[:, None] + column]
        return self.own[letters * x.columns + column, groups[:, None]].sum(1, dtype=np.int32)


class Search:
    """A sequence on its way through the blocks of motifs.

    best: up to n_nearest (p, motif, strand, offset, score), best first.
    limits: for each strand and offset the least score of an alignment that can still come among them.
    """

    def __init__(self, seq: str, letters: np.ndarray, both: bool, longest: int):
        self.seq, self.n = seq, len(letters)
        self.strands = [letters, np.where(letters < 4, 3 - letters, letters)[::-1]] if both else [letters]
        self.words = [words_of(x.tolist(), longest) for x in self.strands]
        self.best: list[tuple] = []
        self.columns, self.limits = None, None

    def enter(self, columns: int) -> None:
        """Motifs of so many columns are next: counts says how many letters of each kind meet a column, for each strand and offset."""
        if self.columns == columns:
            return
        shift = np.arange(1 - self.n, columns)
        first, last = np.maximum(0, -shift), np.minimum(self.n, columns - shift)
        codes = []
        self.padded = np.full((len(self.strands), self.n + 2 * (columns - 1)), 4, np.int16)
        for letters, padded in zip(self.strands, self.padded, strict=True):
            padded[columns - 1 : columns - 1 + self.n] = letters
            before = np.zeros(self.n + 1, np.int64)
            np.cumsum(UNITS[letters], out=before[1:])
            codes.append(before[last] - before[first])
        self.counts = np.concatenate(codes).tolist()
        self.columns, self.limits = columns, None

    def p_value(self, tail: np.ndarray) -> np.ndarray:
        """Of a motif whose best alignment has that tail probability: that of the least of so many."""
        return -np.expm1(len(self.counts) * np.log1p(-np.minimum(tail, 1 - 1e-16)))

    def limit(self, p: float, null: Null, kind: np.dtype) -> None:
        """From now on only alignments count whose p-value is not above p; a little more, as numbers are rounded."""
        p *= 1 + 1e-9
        tail = -math.expm1(math.log1p(-p) / len(self.counts)) * (1 + 1e-9) if p < 1 else 1.0
        known: dict[int, int] = {}
        for c in set(self.counts):
            _, minus, least = null.cache.get(c) or null.of(c)
            known[c] = int(minus.searchsorted(-tail)) + least
        self.limits = np.array([known[c] for c in self.counts], kind)

    def meet(self, block: Block, space: np.ndarray, n_nearest: int, null: Null) -> None:
        bounds = block.bounds(self, space)
        top = bounds.max(1)
        if self.limits is None:
            if len(self.best) < n_nearest:
                # The groups of the greatest bounds show what is to be reached.
                rows = np.arange(len(top))
                groups = bounds.argmax(1)
                self.limit(self._reached(block.scores(self, rows, groups), block.motifs[groups], n_nearest, null), null, bounds.dtype)
            else:
                self.limit(self.best[-1][0], null, bounds.dtype)
        rows = (top >= self.limits).nonzero()[0]
        if not len(rows):
            return
        at, groups = np.divmod(np.flatnonzero(bounds[rows] >= self.limits[rows, None]), block.groups)
        found = []
        for i in range(0, len(at), PAIRS):
            row, group = rows[at[i : i + PAIRS]], groups[i : i + PAIRS]
            score = block.scores(self, row, group)
            j, k = (score >= self.limits[row, None]).nonzero()
            found.append((block.motifs[group[j], k], row[j], score[j, k]))
        motif, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(motif):
            return
        tail = self._tails(row, score, null)
        # The best alignment of each motif, the first of equal ones.
        order = np.lexsort((row, tail, motif))
        order = order[np.r_[True, motif[order][1:] != motif[order][:-1]]]
        p = self.p_value(tail[order])
        for i in np.lexsort((motif[order], p))[:n_nearest]:
            strand, offset = divmod(int(row[order[i]]), self.columns + self.n - 1)
            self.best.append((float(p[i]), int(motif[order[i]]), strand, offset - (self.n - 1), int(score[order[i]])))
        self.best = sorted(self.best)[:n_nearest]
        self.limits = None

    def _tails(self, rows: np.ndarray, scores: np.ndarray, null: Null) -> np.ndarray:
        return np.array([-minus[s - least] for s, (_, minus, least) in ((s, null.of(self.counts[r])) for r, s in zip(rows.tolist(), scores.tolist(), strict=True))])

    def _reached(self, scores: np.ndarray, motifs: np.ndarray, n_nearest: int, null: Null) -> float:
        """A p-value that n_nearest motifs reach, by the scores of some for each strand and offset; 1 if these are fewer motifs."""
        most = scores.argmax(1)
        rows = np.arange(len(most))
        tail, motif = self._tails(rows, scores[rows, most], null), motifs[rows, most].tolist()
        some: set[int] = set()
        for r in np.argsort(tail, kind="stable").tolist():
            some.add(motif[r])
            if len(some) >= n_nearest:
                return float(self.p_value(tail[r : r + 1])[0])
        return 1.0


def nearest(seqs: list[str], motifs: np.ndarray, sizes: np.ndarray, steps: np.ndarray, null: Null, n_nearest: int, both: bool) -> Iterator[Search]:
    """The sequences that have a known letter, with their best motifs.

    Motifs go by in blocks of equally long ones.  The sum of a few numbers, one
    for each word of a sequence, bounds the scores of a whole group of motifs at
    an offset; only groups that can hold one of the best are scored.
    """
    code = np.full(256, 4, np.int8)
    code[np.frombuffer(b"ACGT", np.uint8)] = range(4)
    begins = np.r_[0, np.cumsum(sizes)]
    groups: dict[bool, list[Search]] = {False: [], True: []}
    for seq in seqs:
        letters = code[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
        if (letters < 4).any():
            groups[len(seq) > LONG].append(Search(seq, letters, both, 1 if len(seq) > LONG else WORD))
    for far, group in groups.items():
        if not group:
            continue
        longest, pad = 1 if far else WORD, max(x.n for x in group) - 1
        for m in np.unique(sizes).tolist():
            kind = np.int16 if m * int(np.abs(steps).max()) + 1 < 1 << 15 else np.int32
            same = np.flatnonzero(sizes == m)
            step = GROUP * max(16, TABLE // (np.dtype(kind).itemsize * word_starts(longest)[-1] * (m + 2 * pad)))
            for i in range(0, len(same), step):
                some = same[i : i + step]
                block = Block(steps[begins[some][:, None] + np.arange(m)], motifs[some], pad, longest, kind)
                space = np.empty(2 * (m + pad) * block.groups, kind)
                for x in group:
                    x.enter(m)
                    x.meet(block, space, n_nearest, null)
        yield from group


def _nearest(shared, null_of: tuple[np.ndarray, np.ndarray], n_nearest: int, both: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        null = Null(*null_of)

        def found(seqs: list[str]) -> pa.RecordBatch:
            rows = [(x.seq, motif, strand, offset, score, p) for x in nearest(seqs, *shared.value, null, n_nearest, both) for p, motif, strand, offset, score in x.best]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["seq", "motif_idx", "strand", "offset", "score", "p_value"])

        held, letters = [], 0
        for batch in batches:
            for seq in batch.column(0).to_pylist():
                held.append(seq)
                letters += len(seq)
                if letters >= LETTERS:
                    yield found(held)
                    held, letters = [], 0
        if held:
            yield found(held)

    return run


def annotate_seqlets(seqlets: DataFrame, motifs: DataFrame, *, n_nearest: int = 1, reverse_complement: bool = True, bins: int = 100, columns: int = COLUMNS) -> DataFrame:
    """(seqlet_idx, motif_idx, rank, p_value, score, strand, offset): the motifs that fit each sequence best.

    seqlets: (seqlet_idx, seq); motifs: (motif_idx, pos, probs), probs four
    weights.  All columns of all motifs are aligned at all offsets, on both
    strands if reverse_complement says so.  p_value: the probability that the
    best of as many alignments of this sequence with random columns of the
    database does as well (at equal p-values motifs go by number).  offset: the
    motif's column that the first letter (of strand 1: of the reverse
    complement) stands at.

    Equal sequences are matched once.  A null or empty sequence, or one without
    a known letter, has no row; unknown letters count nothing.  Without motifs
    there are no rows.  The driver sees a count for each letter and step, and
    up to columns columns of motifs at a time, which it broadcasts.
    """
    spark = seqlets.sparkSession
    steps = checkpointed(motifs.select(F.col("motif_idx").cast("long").alias("motif_idx"), "pos", column_steps(F.col("probs"), bins).alias("steps")))
    counted = steps.select(F.posexplode("steps").alias("letter", "step")).groupBy("letter", "step").count().collect()  # at most four times bins rows
    histogram = np.zeros((4, bins))
    for r in counted:
        histogram[r["letter"], r["step"]] = r["count"]
    total = int(histogram[0].sum())
    if not total:
        return seqlets.select("seqlet_idx").limit(0).selectExpr("seqlet_idx", "0L as motif_idx", "0 as rank", "0d as p_value", "0 as score", "0 as strand", "0 as offset")
    median = np.array([int(np.searchsorted(np.cumsum(h), total / 2)) for h in histogram])
    shared_null = (histogram / total, median)
    parts = -(-total // columns)
    whole = steps.groupBy("motif_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "steps"))).alias("of"))
    whole = checkpointed(whole.select("motif_idx", F.pmod(F.xxhash64("motif_idx"), F.lit(parts)).alias("part"), F.col("of.steps").cast("array<array<smallint>>").alias("steps")))
    seqlets = checkpointed(seqlets.select("seqlet_idx", F.upper("seq").alias("seq")).where(F.length("seq") > 0))
    # As many tasks whatever the table's size in bytes: each sequence meets every motif.
    seqs = seqlets.select("seq").distinct().repartition(4 * spark.sparkContext.defaultParallelism, "seq")
    found = None
    for part in range(parts):
        own = whole.where(F.col("part") == part).orderBy("motif_idx").select("motif_idx", F.size("steps").alias("size"), F.flatten("steps").alias("steps")).toArrow()
        if not own.num_rows:
            continue
        table = own.column("steps").combine_chunks().flatten().to_numpy().reshape(-1, 4) - median.astype(np.int16)
        shared = spark.sparkContext.broadcast((own.column("motif_idx").to_numpy(), own.column("size").to_numpy(), table))
        near = seqs.mapInArrow(_nearest(shared, shared_null, n_nearest, reverse_complement), RESULT)
        found = near if found is None else found.union(near)
    order = Window.partitionBy("seq").orderBy("p_value", "motif_idx")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_nearest)
    return seqlets.join(best, "seq").select("seqlet_idx", "motif_idx", "rank", "p_value", "score", "strand", "offset")
