"""Language-model scores by Katz backoff over word n-grams of any order.

    P(w | h) = d(r) r / (n(h) + 1)     n-gram hw seen r > 0 times
             = alpha(h) P(w | h')      not seen, but h was; h' is h without its first word
             = P(w | h')               h not seen either
    P(w)     = d(r) r / (N + 1)        word seen r > 0 times
             = what that leaves        any unknown word

d are Katz's Good-Turing discounts of counts up to five, of each order.
alpha(h) is the mass that the n-grams of h leave over the mass that the lower
order leaves to words not seen after h, so that every distribution sums to one.

Texts are written once as pieces, tables of word numbers.  A piece sends each
of its different n-grams once, with its count, to the part that the n-gram's
hash names; parts add up, store the counts and send the sums back.  With them a
piece has all that its texts need but the backoff weights.  As

    sum over seen w of f(hw) = sum over occurrences of hw of f(hw) / r,

pieces add up what weights need of each context from their own occurrences, and
parts add those sums up; contexts are asked for by the texts that back off from
them.  A piece is scored once, whatever ranges the weights come in.  So no n-gram, word or context, however frequent, has more than one entry
a piece, and nothing but a few figures of the corpus reaches the driver.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm import text as tx
from helixframe.llm.cluster import LARGE_VALUES, drop_table, freed_shuffles, new_table, settings

ORDER = 3
#: Tokens for each part; a part holds at most that many entries of each order.
GROUP_TOKENS = 2_000_000
#: Bytes of a piece, of a slice of a batch that goes into one, and those that a row counts beside its text.
PIECE, SLICE, ROW = 7 << 20, 1 << 19, 100
#: Keys that are worked on at once; bytes of a batch that goes back to the JVM.
KEYS, OUT = 1 << 16, 4 << 20
#: Tables of values that are large and compressed: small pages and row groups, not compressed again.
TABLE = {"compression": "uncompressed", "parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 16, "parquet.page.size.row.check.min": 4}
#: Ranges of keys that are counted, and weighed, one after the other, so that shuffles hold one range at a time; slices of the pieces that are scored one after the other.
COUNT_ROUNDS, WEIGHT_ROUNDS, SLICES = 4, 4, 4
#: Entries of a part that are sorted at once.
ENTRIES = 500_000
#: Largest discounted count.
K = 5
END = np.uint64(0x0123456789ABCDEF)
BEGIN = np.uint64(0xFEDCBA9876543210)
#: Low bits of a key that hold its order.
LEVEL = np.uint64(7)
_PIECE = "uid long, ids array<long>, held array<boolean>, sizes array<long>, words binary, stream binary"
_PART = "kind string, part int, uid long, keys binary, count binary, x binary, y binary, stat array<long>"
_DOCS = "turn int, ids array<long>, held array<boolean>, sizes array<long>, known array<long>, base array<double>, score array<double>, event_doc binary, event_at binary, event_n binary"


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing factors d[0..K] from n[r], the number of n-grams seen r times, r = 1 to K + 1; d[0] is unused.

    Where the counts give no factor in (0, 1], that of absolute discounting
    stands in; larger counts keep their value.
    """
    d = np.ones(K + 1)
    n1, n2 = float(n[1]), float(n[2])
    flat = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    cut = (K + 1) * n[K + 1] / n1 if n1 else 1.0
    for r in range(1, K + 1):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if n[r] and cut < 1 else 0.0
        d[r] = x if 0 < x <= 1 else (r - flat) / r
    return d


def pack(a: np.ndarray, level: int = 1) -> bytes:
    """The array by byte planes, compressed."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return len(a).to_bytes(8, "little") + (pa.Codec("zstd", level).compress(planes, asbytes=True) if planes else b"")


def unpack(b: bytes | memoryview, kind: type) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(b[8:], decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return planes.reshape(size, n).T.copy().view(kind).reshape(n)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(b: bytes | memoryview) -> np.ndarray:
    a = unpack(b, np.uint64)
    return np.cumsum(a, out=a)


def pack_few(a: np.ndarray) -> bytes:
    """An array of few different values."""
    values, at = np.unique(a, return_inverse=True)
    first = pack(values)
    return len(first).to_bytes(8, "little") + first + pack(at.astype(np.int32))


def unpack_few(b: bytes | memoryview, kind: type) -> np.ndarray:
    n = 8 + int.from_bytes(b[:8], "little")
    return unpack(b[8:n], kind)[unpack(b[n:], np.int32)]


def _longer(grams: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hashes of n-grams with one more word before."""
    out = np.empty_like(grams)
    for i in range(0, len(grams), KEYS):
        some = slice(i, i + KEYS)
        out[some] = tx.mix(grams[some] * np.uint64(0x9FB21C651E98DF25) + tx.mix(before[some] + np.uint64(1)))
    return out


def _begins(order: int) -> list[np.uint64]:
    """Keys of contexts of 1, 2, ... begins."""
    one = np.array([BEGIN])
    out, g = [], one
    for k in range(1, order):
        out.append((g & ~LEVEL | np.uint64(k))[0])
        g = _longer(g, one)
    return out


@dataclass
class Grams:
    """n-grams of a piece: keys[k - 1][i] is that of order k that ends at token i; first marks the texts' first tokens."""

    keys: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(words: np.ndarray, stream: np.ndarray, sizes: np.ndarray, order: int) -> Grams:
        tokens = words[stream]
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        keys, g = np.empty((order, len(tokens)), np.uint64), tokens
        for k in range(1, order + 1):
            if k > 1:
                before = np.full(len(tokens), BEGIN)
                before[k - 1 :] = tokens[: max(0, len(tokens) - k + 1)]
                for i in range(k - 1):  # the texts' first k - 1 tokens
                    at = starts[starts + i < len(tokens)] + i
                    before[at[doc[at] == doc[at - i]]] = BEGIN
                g = _longer(g, before)
            np.bitwise_and(g, ~LEVEL, out=keys[k - 1])
            keys[k - 1] |= np.uint64(k)
        first = np.zeros(len(tokens), bool)
        first[starts] = True
        return Grams(keys, doc, first)

    def of_context(self, values: np.ndarray, k: int, begin) -> np.ndarray:
        """For the n-grams of order k, what values (order, token) say of their contexts; begin where those are begins only."""
        out = np.empty_like(values[k - 2])
        out[1:] = values[k - 2][:-1]
        out[self.first] = begin
        return out


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition by pieces, whatever batches they come in."""
    have, n = [], 0
    for batch in batches:
        for rows, data, _ in tx.pieces(batch, size=SLICE):
            if have and n + len(data) + ROW * len(rows) > PIECE:
                yield pa.Table.from_batches(have).combine_chunks().to_batches()[0]
                have, n = [], 0
            have.append(rows)
            n += len(data) + ROW * len(rows)
    if have:
        yield pa.Table.from_batches(have).combine_chunks().to_batches()[0]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _filled(batches):
        for rows, data, offsets in tx.pieces(batch, size=2 * PIECE):
            words = tx.split(data, offsets)
            n = len(offsets) - 1
            tokens = np.full(len(words.starts) + n, END, np.uint64)
            tokens[np.arange(len(words.starts)) + words.doc] = words.hashes()
            vocabulary, stream, times = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            uid = int.from_bytes(os.urandom(8), "little", signed=True)  # stays as written
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x) for x in (rows.column(2), rows.column(1), pa.array(words.counts + 1))]
            one = [pa.array([uid]), *lists, pa.array([pack(vocabulary[order])]), pa.array([pack(rank[stream], 6)])]
            yield pa.RecordBatch.from_arrays(one, names=["uid", "ids", "held", "sizes", "words", "stream"])


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _in_turn(keys: np.ndarray, parts: int, turn: int, rounds: int) -> np.ndarray:
    """Places of keys whose parts' turn it is: part * rounds // parts == turn."""
    low, high = (-(-(-(-t * parts // rounds) << 32) // parts) << 32 for t in (turn, turn + 1))
    if low >= high:
        return np.zeros(0, np.int64)
    return np.flatnonzero((keys >= np.uint64(low)) & (keys <= np.uint64(high - 1)))


def _parts_of(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, begin, end) of sorted keys."""
    part = _part(keys, parts)
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(keys) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(part[a]), a, b


def _rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"kind": pa.string(), "part": pa.int32(), "uid": pa.int64(), "keys": pa.binary(), "count": pa.binary(), "x": pa.binary(), "y": pa.binary(), "stat": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in kinds.items()], names=list(kinds))


def _table(rows: list[dict], build: Callable[[list[dict]], pa.RecordBatch]) -> pa.Table:
    """Rows with binary values, in batches of about OUT bytes."""
    sizes = np.cumsum([sum(len(v) for v in r.values() if isinstance(v, bytes)) for r in rows]) // OUT
    edges = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1], True]).tolist()
    return pa.Table.from_batches([build(rows[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)])


def _blobs(table: pa.Table, column: str) -> list[memoryview | None]:
    """Binary values, not copied."""
    return [memoryview(x.as_buffer()) if x.is_valid else None for x in table.column(column)]


def _read(row: dict, order: int) -> tuple[Grams, np.ndarray]:
    """n-grams of a piece and, by token, whether it trains."""
    sizes = np.array(row["sizes"], np.int64)
    grams = Grams.of(unpack(row["words"], np.uint64), unpack(row["stream"], np.int32), sizes, order)
    return grams, ~np.array(row["held"], bool)[grams.doc]


def _send(order: int, parts: int, turn: int) -> Callable:
    """Each piece's different n-grams of one range by part: twice the training occurrences, and one more if held-out texts have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grams, learn = _read(row, order)
                keys = grams.keys.reshape(-1)
                del grams
                some = _in_turn(keys, parts, turn, COUNT_ROUNDS)
                keys, learn = keys[some], learn[some % len(learn)]
                del some
                keys, inverse, every = np.unique(keys, return_inverse=True, return_counts=True)
                train = np.bincount(inverse[learn], minlength=len(keys))
                count = train * 2 + (every > train)
                del inverse, every, train
                rows = [{"kind": "send", "part": p, "uid": row["uid"], "keys": pack_sorted(keys[a:b]), "count": pack(count[a:b])} for p, a, b in _parts_of(keys, parts)]
                for j in range(0, len(rows), 256):
                    yield _rows(rows[j : j + 256])

    return run


def _small(a: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as they need."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _cuts(part: int, parts: int, each: list[np.ndarray], entries: int) -> np.ndarray:
    """Places [lists, ranges + 1] at which ranges of a part's keys, of so many entries in all lists, begin in each sorted list."""
    ranges = max(1, -(-sum(map(len, each)) // entries))
    low, high = (-(-(p << 32) // parts) << 32 for p in (part, part + 1))
    edges = np.array([low + (high - low) * i // ranges for i in range(1, ranges)], np.uint64)
    return np.array([[0, *np.searchsorted(x, edges), len(x)] for x in each]).reshape(len(each), ranges + 1)


def _count(order: int, parts: int, entries: int) -> Callable:
    """One part: the counts of its n-grams, how many have each small count, and each piece's answer."""

    def run(table: pa.Table) -> pa.Table:
        part, uids = table.column("part")[0].as_py(), table.column("uid").to_pylist()
        each = [unpack_sorted(b) for b in _blobs(table, "keys")]
        count = [_small(unpack(b, np.int64)) for b in _blobs(table, "count")]
        most = sum(int(x.max(initial=0)) for x in count)
        count = [x.astype(np.int32 if most < 2**31 - 2 else np.int64) for x in count]  # and, range by range, the answer
        cuts = _cuts(part, parts, each, entries)
        stat = np.zeros((order, K + 3), np.int64)
        found = []
        for a, b in zip(cuts.T[:-1].tolist(), cuts.T[1:].tolist(), strict=True):
            keys, inverse = np.unique(np.concatenate([x[i:j] for x, i, j in zip(each, a, b, strict=True)]), return_inverse=True)
            own = np.concatenate([x[i:j] for x, i, j in zip(count, a, b, strict=True)])
            total = np.bincount(inverse, own >> 1, len(keys)).astype(np.int64)
            asked = np.bincount(inverse, own & 1, len(keys)) > 0
            answer, at = (total * 2 + asked).astype(count[0].dtype)[inverse], 0
            for x, i, j in zip(count, a, b, strict=True):
                x[i:j] = answer[at : at + j - i]
                at += j - i
            trained = total > 0
            level, own = (keys[trained] & LEVEL).astype(np.int64), total[trained]
            small = own <= K + 1
            np.add.at(stat, (level[small] - 1, own[small] - 1), 1)
            stat[:, K + 1] += np.bincount(level, minlength=order + 1)[1:]
            stat[:, K + 2] += np.bincount(level, own, order + 1)[1:].astype(np.int64)
            found.append((keys[trained], _small(own)))
        del each, keys, inverse, own, total, asked, answer, trained, level, small
        kept, times = zip(*found, strict=True)
        del found
        packed = pack(np.concatenate(times).astype(np.int64))
        kept = np.concatenate(kept)
        out = [{"kind": "ngrams", "part": part, "uid": 0, "keys": pack_sorted(kept), "count": packed, "stat": stat.reshape(-1).tolist()}]
        del kept, times
        out += [{"kind": "answer", "part": part, "uid": uid, "count": pack(x.astype(np.int64))} for uid, x in zip(uids, count, strict=True)]
        return _table(out, _rows)

    return run


@dataclass
class Model:
    """Figures of the whole corpus: order, parts, training texts, tokens and words, discounts of each order, probability of an unknown word."""

    order: int
    parts: int
    texts: int
    tokens: int
    vocabulary: int
    d: np.ndarray
    unknown: float

    def factor(self, k: int, r: np.ndarray) -> np.ndarray:
        return np.where(r <= K, self.d[k - 1][np.minimum(r, K)], 1.0)

    def seen(self, k: int, r: np.ndarray, n: np.ndarray | None) -> np.ndarray:
        """P of n-grams of order k seen r times, n times their contexts."""
        if k > 1:
            return self.factor(k, r) * r / (n + 1)
        return np.where(r > 0, self.factor(1, r) * r / (self.tokens + 1), self.unknown)


def _score(model: Model) -> Callable:
    """One piece: its texts' sums without backoff weights (turn -1); by range of contexts, what it gives to their weights and the contexts it asks for."""
    begins = _begins(model.order)

    def run(table: pa.Table) -> pa.Table:
        whole = np.flatnonzero(table.column("part").is_null().to_numpy())
        row = table.slice(int(whole[0]), 1).to_pylist()[0]
        grams, learn = _read(row, model.order)
        n_docs, doc = len(row["sizes"]), grams.doc
        answers = table.filter(table.column("part").is_valid())
        answers = sorted(zip(answers.column("part").to_pylist(), _blobs(answers, "count"), strict=True), key=lambda a: a[0])
        keys = grams.keys.reshape(-1)
        r, asked = np.empty(len(keys), np.int32 if model.tokens < 2**30 else np.int64), np.empty(len(keys), bool)
        for turn in range(COUNT_ROUNDS):
            order = _in_turn(keys, model.parts, turn, COUNT_ROUNDS)
            order = order[np.argsort(keys[order])]
            ordered = keys[order]
            begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
            answer = np.concatenate([np.zeros(0, np.int64), *[unpack(b, np.int64) for part, b in answers if part * COUNT_ROUNDS // model.parts == turn]])
            if len(begin) != len(answer):
                raise RuntimeError("counts of a piece are incomplete")
            times = np.diff(begin, append=len(ordered))
            r[order], asked[order] = np.repeat(answer >> 1, times), np.repeat((answer & 1).astype(bool), times)
        del answers, order, ordered, begin, answer, times
        r, asked = r.reshape(model.order, -1), asked.reshape(model.order, -1)
        amount, open_ = np.zeros(len(doc)), np.ones(len(doc), bool)
        events, givers = [], []
        for k in range(model.order, 1, -1):
            n = grams.of_context(r, k, model.texts)
            hit = np.flatnonzero(open_ & (r[k - 1] > 0))
            amount[hit] = np.log10(model.seen(k, r[k - 1][hit], n[hit]))
            open_[hit] = False
            back = np.flatnonzero(open_ & (n > 0))
            n = n[back]
            low = np.full(len(back), model.tokens, r.dtype) if k == 2 else grams.of_context(r, k - 1, model.texts)[back]
            events.append((doc[back], grams.of_context(grams.keys, k, begins[k - 2])[back], n, low))
            givers.append((k, learn & grams.of_context(asked, k, True)))
            del n, hit, back, low
        del asked
        amount[open_] = np.log10(model.seen(1, r[0][open_], None))
        base = np.log10((r[0] + 1.0) / (model.tokens + model.vocabulary + 1.0))
        base, amount = (np.bincount(doc, x, n_docs).tolist() for x in (base, amount))
        known = np.bincount(doc, r[0] > 0, n_docs).astype(np.int64).tolist()
        out = []
        for turn in range(WEIGHT_ROUNDS if givers else 0):
            gives = []
            for k, give in givers:
                context = grams.of_context(grams.keys, k, begins[k - 2])
                some = _in_turn(context, model.parts, turn, WEIGHT_ROUNDS)
                some = some[give[some]]
                high, low = r[k - 1][some], r[k - 2][some]
                gives.append((context[some], model.factor(k, high), model.factor(k - 1, low) * low / high))
            keys, x, y = (np.concatenate(c) for c in zip(*gives, strict=True))
            del gives, context, some, high, low
            keys, inverse = np.unique(keys, return_inverse=True)
            x, y = np.bincount(inverse, x, len(keys)), np.bincount(inverse, y, len(keys))
            out += [{"kind": "give", "turn": turn, "part": p, "uid": row["uid"], "keys": pack_sorted(keys[a:b]), "x": pack_few(x[a:b]), "y": pack_few(y[a:b])} for p, a, b in _parts_of(keys, model.parts)]
        del grams, r, givers
        e_doc, e_key, e_n, e_low = (np.concatenate(c) for c in zip(*events, strict=True)) if events else (np.zeros(0, np.int64),) * 4
        keys, at, inverse = np.unique(e_key.astype(np.uint64), return_index=True, return_inverse=True)
        asks = [(p, a, b) for p, a, b in _parts_of(keys, model.parts)]
        out += [{"kind": "ask", "turn": p * WEIGHT_ROUNDS // model.parts, "part": p, "uid": row["uid"], "keys": pack_sorted(keys[a:b]), "count": pack(e_n[at[a:b]].astype(np.int64)), "x": pack(e_low[at[a:b]].astype(np.int64))} for p, a, b in asks]
        pair, times = np.unique(e_doc.astype(np.int64) * max(len(keys), 1) + inverse, return_counts=True)
        own = {
            "ids": row["ids"], "held": row["held"], "sizes": row["sizes"],
            "known": known, "base": base, "score": amount,
            "event_doc": pack_sorted(pair // max(len(keys), 1)), "event_at": pack(pair % max(len(keys), 1)), "event_n": pack(times),
        }
        return _table([{"kind": "texts", "turn": -1, "uid": row["uid"]} | own, *out], _with_texts)

    return run


def _with_texts(rows: list[dict]) -> pa.RecordBatch:
    """Rows of parts and of texts."""
    kinds = dict(zip("turn ids held sizes known base score event_doc event_at event_n".split(), [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.float64())] * 2, *[pa.binary()] * 3], strict=True))
    first = _rows(rows)
    return pa.RecordBatch.from_arrays([*first.columns, *[pa.array([r.get(c) for r in rows], t) for c, t in kinds.items()]], names=[*first.schema.names, *kinds])


def _weigh(parts: int, entries: int) -> Callable:
    """One part: the weights of contexts that some text asks for, and each piece's answer."""

    def run(table: pa.Table) -> pa.Table:
        some = table.select(["kind", "part", "uid"]).to_pylist()
        for c in ("keys", "count", "x", "y"):
            for r, blob in zip(some, _blobs(table, c), strict=True):
                r[c] = blob
        rows = sorted(some, key=lambda r: r["uid"])
        asks = [r for r in rows if r["kind"] == "ask"]
        if not asks:
            return pa.Table.from_batches([_rows([])])
        part, gives = rows[0]["part"], [r for r in rows if r["kind"] == "give"]
        given, gx, gy = [unpack_sorted(r["keys"]) for r in gives], [unpack_few(r["x"], np.float64) for r in gives], [unpack_few(r["y"], np.float64) for r in gives]
        asked, an, al = [unpack_sorted(r["keys"]) for r in asks], [unpack(r["count"], np.int64) for r in asks], [unpack(r["x"], np.int64) for r in asks]
        cuts = _cuts(part, parts, [*given, *asked], entries)
        logs, found = [np.empty(len(x)) for x in asked], []
        for a, b in zip(cuts.T[:-1].tolist(), cuts.T[1:].tolist(), strict=True):
            at = list(zip(a, b, strict=True))
            own, wants = at[: len(given)], at[len(given) :]
            some = lambda of: np.concatenate([x[i:j] for x, (i, j) in zip(of, own, strict=True)])  # noqa: B023, E731
            keys, inverse = np.unique(some(given), return_inverse=True)
            x, y = np.bincount(inverse, some(gx), len(keys)), np.bincount(inverse, some(gy), len(keys))
            n, low = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            places = []
            for want, count, lower, (i, j) in zip(asked, an, al, wants, strict=True):
                place = np.searchsorted(keys, want[i:j])
                if (place == len(keys)).any() or (keys[place] != want[i:j]).any():
                    raise RuntimeError("sums of a context are missing")
                n[place], low[place] = count[i:j], lower[i:j]
                places.append(place)
            used = np.flatnonzero(n)
            alpha = np.ones(len(keys))
            alpha[used] = (1 - x[used] / (n[used] + 1.0)) / np.maximum(1 - y[used] / (low[used] + 1.0), 1e-12)
            for log, place, (i, j) in zip(logs, places, wants, strict=True):
                log[i:j] = np.log10(alpha[place])
            found.append((keys[used], alpha[used]))
        keys, alpha = (np.concatenate(x) for x in zip(*found, strict=True))
        out = [{"kind": "weights", "part": part, "uid": 0, "keys": pack_sorted(keys), "x": pack(alpha)}]
        out += [{"kind": "answer", "part": part, "uid": r["uid"], "x": pack(x)} for r, x in zip(asks, logs, strict=True)]
        return _table(out, _rows)

    return run


_OUT = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _finish(table: pa.Table) -> pa.Table:
    """The texts of one piece with the weights they back off by."""
    rows = table.to_pylist()
    texts = next(r for r in rows if r["kind"] == "texts")
    logs = [unpack(r["x"], np.float64) for r in sorted((r for r in rows if r["kind"] == "answer"), key=lambda r: r["part"])]
    score = np.array(texts["score"])
    if logs:
        doc, at, times = unpack_sorted(texts["event_doc"]).astype(np.int64), unpack(texts["event_at"], np.int64), unpack(texts["event_n"], np.int64)
        score += np.bincount(doc, np.concatenate(logs)[at] * times, len(score))
    columns = [pa.array(texts[c], t) for c, t in (("ids", pa.int64()), ("held", pa.bool_()), ("sizes", pa.int64()), ("known", pa.int64()), ("base", pa.float64()))]
    return pa.Table.from_arrays([*columns, pa.array(score)], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def katz_scores(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, order: int = ORDER, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs; the model learns from rows that are not held out.

    order: words of the longest n-grams, 1 to 7.  path: a new folder that
    executors share, for the tables: pieces (texts as word numbers), counts
    (kind=ngrams: counts of all n-grams of all orders, by part), sums (turn=-1:
    texts without their backoff weights, by piece) and scores
    (kind=weights: backoff weights of all contexts that some text backs off
    from, by part).  Keys are 61 bits of hash and the order.

    A null held_out trains.  Null and empty texts have the end as their one
    token.  Repeated rows are scored each for itself.  Ids are whole numbers
    or null.  Without training rows every token is unknown and has the
    probability of one unknown word, 1.  An empty table gives an empty table.
    """
    if not 1 <= order <= 7:
        raise ValueError("order must be 1 to 7")
    spark = docs.sparkSession
    path = path or new_table(spark, "katz")
    some = docs.select(F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(id_col).cast("long").alias("id"))
    some.mapInArrow(_pieces, _PIECE).write.options(**TABLE).parquet(f"{path}/pieces")
    pieces = spark.read.schema(_PIECE).parquet(f"{path}/pieces")
    size = pieces.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)).alias("tokens"), F.sum(F.size(F.filter("held", lambda h: ~h))).alias("texts")).first()
    parts = max(4, -(-int(size["tokens"] or 0) // group_tokens))

    for turn in range(COUNT_ROUNDS):
        sent = pieces.mapInArrow(_send(order, parts, turn), _PART)
        counted = sent.groupBy("part").applyInArrow(_count(order, parts, ENTRIES), _PART).withColumn("slice", F.pmod("uid", F.lit(SLICES)).cast("int"))
        counted.write.mode("append").options(**TABLE).partitionBy("kind", "slice").parquet(f"{path}/counts")
    counts = spark.read.schema(f"{_PART}, slice int").parquet(f"{path}/counts")
    sums = counts.where("kind = 'ngrams'").select(F.posexplode("stat")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    stat = np.zeros(order * (K + 3), np.int64)
    for r in sums:
        stat[r["pos"]] = r["n"]
    stat = stat.reshape(order, K + 3)
    tokens, vocabulary, n1 = int(stat[0, K + 2]), int(stat[0, K + 1]), stat[0, : K + 1]
    d = np.stack([discounts(np.r_[0.0, s[: K + 1]]) for s in stat])
    small = np.arange(1, K + 1)
    kept = float((d[0, 1:] * small * n1[:K]).sum() + tokens - (small * n1[:K]).sum())
    model = Model(order, parts, int(size["texts"] or 0), tokens, vocabulary, d, max(0.0, 1 - kept / (tokens + 1)))

    schema = f"{_PART}, {_DOCS}"
    for i in range(SLICES):
        back = counts.where((F.col("kind") == "answer") & (F.col("slice") == i)).select("uid", "part", "count")
        both = pieces.where(F.pmod("uid", F.lit(SLICES)) == i).unionByName(back, allowMissingColumns=True)
        scored = both.groupBy("uid").applyInArrow(_score(model), schema)
        scored.write.mode("append").options(**TABLE).partitionBy("turn").parquet(f"{path}/sums")
        drop_table(spark, f"{path}/counts/kind=answer/slice={i}")
    drop_table(spark, f"{path}/counts/kind=answer")
    sums = spark.read.schema(schema).parquet(f"{path}/sums")
    for turn in range(WEIGHT_ROUNDS):
        weighed = sums.where(F.col("turn") == turn).select("kind", "part", "uid", "keys", "count", "x", "y").groupBy("part").applyInArrow(_weigh(parts, ENTRIES), _PART)
        weighed.write.mode("append").options(**TABLE).partitionBy("kind").parquet(f"{path}/scores")
        drop_table(spark, f"{path}/sums/turn={turn}")
    texts = spark.read.schema(schema).parquet(f"{path}/sums").where("turn = -1")
    answers = spark.read.schema(_PART).parquet(f"{path}/scores").where("kind = 'answer'")
    scores = texts.unionByName(answers, allowMissingColumns=True)
    out = scores.groupBy("uid").applyInArrow(_finish, _OUT)
    return out.withColumn("train_tokens", F.lit(tokens).cast("long"))


def op1_katz_backoff(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; those whose hash falls into one of seven folds are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    with freed_shuffles(spark), settings(spark, LARGE_VALUES):
        out = katz_scores(docs, held)
    return out.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
