"""Benchmark decontamination by Wu-Manber search over words.

Patterns are windows of ten consecutive words of a benchmark item (an item of
fewer words is one window).  Windows of one length share a table of blocks of
two words with the shift each allows: a cursor in every text jumps over all
positions at which no window can end.  Where the shift is zero, the hash of
the window's words selects the windows to try, and all their words are
compared.  The cursors of a batch of texts advance together in numpy.

Benchmark items come to the driver in blocks of a fixed number of windows;
every block is one broadcast table.  A benchmark of one block is one pass.  Of
a larger one each block has a pass of its own, whose hits are written before
the next begins, so that no executor ever holds two tables; the hits of all
blocks meet by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm import text as tx
from helixframe.llm.cluster import cut

WINDOW = 10
#: Windows of one table: 200,000 of ten words are about 40 MB.
BLOCK_WINDOWS = 200_000


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return tx.mix(a * np.uint64(0x9FB21C651E98DF25) + b)


@dataclass
class Table:
    """Windows of one length: sorted blocks with shifts, and windows sorted by hash with the items that hold them."""

    length: int
    block: np.ndarray
    shift: np.ndarray
    window: np.ndarray
    words: np.ndarray
    item_ptr: np.ndarray
    items: list[str]

    @classmethod
    def build(cls, length: int, windows: np.ndarray, owners: list[str]) -> Table:
        """windows: a row of word hashes each; owners: their items."""
        key = tx.window_hashes(windows.reshape(-1), length)[::length] if len(windows) else np.zeros(0, np.uint64)
        order = np.lexsort((np.array(owners, dtype=object).astype(str), key))
        key, windows = key[order], windows[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        items = [owners[i] for i in order]
        uniq = windows[first]
        size = min(2, length)
        blocks = {}
        for j in range(length - size + 1):
            h = _pair(uniq[:, j], uniq[:, j + 1]) if size == 2 else uniq[:, j]
            for x in np.unique(h).tolist():
                blocks[x] = length - size - j  # later blocks overwrite with smaller shifts
        block = np.array(sorted(blocks), dtype=np.uint64)
        return cls(length, block, np.array([blocks[x] for x in block.tolist()], np.int64), key[first], uniq, np.r_[first, len(key)], items)

    def occurrences(self, h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of all occurrences in the texts, and which window each is."""
        m, size = self.length, min(2, self.length)
        doc = np.flatnonzero(np.diff(ptr) >= m)
        at, end = ptr[doc] + m - 1, ptr[doc + 1]
        starts, which = [], []
        while len(at):
            block = _pair(h[at - 1], h[at]) if size == 2 else h[at]
            k = np.minimum(np.searchsorted(self.block, block), len(self.block) - 1)
            known = self.block[k] == block
            shift = np.where(known, self.shift[k], m - size + 1)
            zero = np.flatnonzero(shift == 0)
            if len(zero):
                span = at[zero][:, None] + np.arange(1 - m, 1)
                words = h[span]
                key = tx.window_hashes(words.reshape(-1), m)[::m]
                w = np.minimum(np.searchsorted(self.window, key), len(self.window) - 1)
                hit = (self.window[w] == key) & (self.words[w] == words).all(axis=1)
                starts.append(span[hit, 0])
                which.append(w[hit])
            at = at + np.maximum(shift, 1)
            left = at < end
            at, end = at[left], end[left]
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(which)


def tables(items: list[tuple[str, str]], window: int = WINDOW) -> list[Table]:
    """A table for each length of windows in these (item, text)."""
    if not items:
        return []
    words = tx.split(*tx.flat(pa.array([t for _, t in items], pa.large_string())), tx.LOWER, tx.ALNUM)
    h = words.hashes()
    by: dict[int, tuple[list[np.ndarray], list[str]]] = {}
    for i, (item, _) in enumerate(items):
        own = h[words.ptr[i] : words.ptr[i + 1]]
        m = min(window, len(own))
        if m:
            some, owners = by.setdefault(m, ([], []))
            rows = np.lib.stride_tricks.sliding_window_view(own, m)
            some.append(rows)
            owners += [item] * len(rows)
    return [Table.build(m, np.concatenate(some), owners) for m, (some, owners) in sorted(by.items())]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, windows: int) -> Iterator[list[tuple[str, str]]]:
    """Items with their texts, so many that a block has about that number of windows (one item at least)."""
    block, size = [], 0
    for r in benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null").toLocalIterator():
        n = len(r["text"]) // 2
        if block and size + n > windows:
            yield block
            block, size = [], 0
        block.append((r["item"] if r["item"] is not None else "null", r["text"]))
        size += n
    if block:
        yield block


def _searched(found: list[Table], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Where each text's words begin and the last ends; which words are hit; items by text."""
    words = tx.split(data, offsets, tx.LOWER, tx.ALNUM)
    h, ptr = words.hashes(), words.ptr
    doc = words.doc
    change = np.zeros(len(h) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(len(ptr) - 1)]
    for table in found:
        starts, which = table.occurrences(h, ptr)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + table.length, -1)
        if len(starts):
            for d, w in np.unique(np.stack([doc[starts], which]), axis=1).T.tolist():
                items[d].update(table.items[table.item_ptr[w] : table.item_ptr[w + 1]])
    return ptr, np.cumsum(change)[: len(h)] > 0, items


def _columns(ptr: np.ndarray, hit: np.ndarray, items: list[set[str]]) -> list[pa.Array]:
    total = np.r_[0, np.cumsum(hit)]
    bits = [np.packbits(hit[a:b]).tobytes() if total[b] > total[a] else b"" for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
    return [pa.array(np.diff(ptr).astype(np.int64)), pa.array(total[ptr[1:]] - total[ptr[:-1]]), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(bits, pa.binary())]


NEW = ("hit_total", "hit_words", "hit_items", "hit_bits")


def _searcher(shared, text_at: int):
    """Rows with what one table finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, data, offsets in tx.pieces(batch, batch.schema.field(text_at).name):
                yield pa.RecordBatch.from_arrays([*some.columns, *_columns(*_searched(shared.value, data, offsets))], names=[*some.schema.names, *NEW])

    return run


def _hits(shared):
    """Key, bits and items of the texts (k1, k2, text) that one table finds something in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, data, offsets in tx.pieces(batch):
                _, words, items, bits = _columns(*_searched(shared.value, data, offsets))
                found = pa.array(np.flatnonzero(words.to_numpy()))
                yield pa.RecordBatch.from_arrays([x.take(found) for x in (some.column(0), some.column(1), bits, items)], names=["k1", "k2", "bits", "items"])

    return run


def _joiner(text_at: int):
    """Rows with all their hits: the last column has those of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, data, offsets in tx.pieces(batch, batch.schema.field(text_at).name):
                ptr, hit, items = _searched([], data, offsets)
                for i, blocks in enumerate(some.column(some.num_columns - 1)):
                    for x in blocks.as_py() or []:
                        hit[ptr[i] : ptr[i + 1]] |= np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=int(ptr[i + 1] - ptr[i])).astype(bool)
                        items[i].update(x["items"])
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *_columns(ptr, hit, items)], names=[*some.schema.names[:-1], *NEW])

    return run


def find_benchmark(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """All columns of docs, with hit_total (words), hit_words (words in some occurrence), hit_items (sorted ids) and hit_bits (a bit for each word, the first the highest; empty without hits).

    A null text has no words and no hits; a null or wordless item is no
    pattern; an item without an id goes by the name null.  Items that repeat
    an id or a text count once for each id.  Overlapping occurrences count
    each word once.  Empty tables are fine on either side.  Columns of docs
    called as one of the new ones are replaced; other names are free.
    """
    sc = docs.sparkSession.sparkContext
    out = docs.select(*[c for c in docs.columns if c not in NEW])
    extra = [T.StructField("hit_total", T.LongType()), T.StructField("hit_words", T.LongType()), T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("hit_bits", T.BinaryType())]
    schema = T.StructType([*out.schema.fields, *extra])
    text_at = out.columns.index(text_col)
    blocks = item_blocks(benchmark, item_col, item_text, block_windows)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return out.mapInArrow(_searcher(sc.broadcast(tables(first, window)), text_at), schema)
    keys = [F.xxhash64(F.lit("text"), F.col(text_col)).alias("k1"), F.xxhash64(F.lit("again"), F.col(text_col)).alias("k2")]
    every = None
    for block in chain([first, second], blocks):
        shared = sc.broadcast(tables(block, window))
        hits = cut(docs.select(*keys, F.col(text_col).alias("text")).mapInArrow(_hits(shared), "k1 long, k2 long, bits binary, items array<string>").dropDuplicates(["k1", "k2"]))
        shared.unpersist()
        every = hits if every is None else every.union(hits)
    # Kept apart from the join, so that adaptive execution can split a hot text there.
    met = cut(every.groupBy("k1", "k2").agg(F.collect_list(F.struct("bits", "items")).alias("hits")))
    row = F.struct(*[F.col(f"`{c}`") for c in out.columns]).alias("row")
    free = max(out.columns, key=len) + "_hits"  # longer than any, so no other is called so
    joined = out.select(row, *keys).join(met, ["k1", "k2"], "left").select("row", F.col("hits").alias(free)).select("row.*", free)
    return joined.mapInArrow(_joiner(text_at), schema)


def op8_wu_manber(spark, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        F.col("hit_total").alias("n_words"),
        F.col("hit_words").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("hit_words") > 0).alias("contaminated"),
    )
