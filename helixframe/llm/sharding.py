"""Sharding by histogram sort.

Rows are ordered by a 128-bit key: the hash of the text, then the hash of the
whole row.  Splitters between shards are found by counting the exact bytes
(and rows) below candidate key boundaries over all partitions and refining the
probes of those splitters that do not yet meet the tolerance; then the rows
are exchanged once.

Equal texts are neighbours in that order.  A splitter falls between two
different texts wherever that meets the tolerance; a group of equal texts is
split only if it is too large for that.  Rows equal in every column tie; where
they are many, one of them stands for all until they have positions.

Only the splitters between shards are searched for.  What a task of the
exchange holds is a part of a shard, by row hash; slots follow from exact
counts of the parts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.llm.cluster import cut, few, hashable

#: Bits of the key by which a round of probes is finer than the last.
ROUND_BITS = 12
#: Bytes of text that one task of the final exchange should hold.
TASK_BYTES = 16 << 20
#: Equal rows that are dealt out together.
STEP = 1000
#: What the splitter of a shard may be off, as a share of a shard's bytes.
TOLERANCE = 0.0025


def sort_key(docs: DataFrame, text_col: str) -> tuple[Column, Column]:
    """Hash of the text; hash of all columns, so that only rows equal in every column tie."""
    return F.xxhash64(F.lit("text"), F.col(text_col)), F.xxhash64(F.lit("row"), *hashable(docs))


def _prefix(bits: int) -> Column:
    """The first bits of the unsigned 128-bit key, as an unsigned number in two longs (high, low)."""
    k1, k2 = F.col("k1"), F.col("k2")
    if bits <= 64:
        return F.struct(F.shiftrightunsigned(k1, 64 - bits).alias("a"), F.lit(0).cast("long").alias("b"))
    return F.struct(k1.alias("a"), F.shiftrightunsigned(k2, 128 - bits).alias("b"))


def _whole(a: int, b: int, bits: int) -> int:
    """The prefix as a Python number of that many bits."""
    mask = (1 << 64) - 1
    return (a & mask) if bits <= 64 else ((a & mask) << (bits - 64)) | (b & mask)


def splitters(keys: DataFrame, targets: list[float], tolerance: float) -> list[tuple[int, int]]:
    """For each target number of bytes a boundary (128-bit key, n): rows of smaller keys lie before it, and the first n rows of that key.

    keys: k1, k2, size, times (how many rows of that key and size; over one only
    where those may be parted).  Each round counts the bytes by the next key
    bits, only within the cells that hold an unsettled splitter, and so brings
    at most 2**ROUND_BITS numbers a splitter to the driver, at any size of the
    table.
    """
    found: dict[int, tuple[int, int]] = {}
    # cell (prefix) -> (splitters in it, bytes below it)
    cells: dict[int, tuple[list[int], int]] = {0: (list(range(len(targets))), 0)}
    bits = 0
    while cells:
        finer = min(128, bits + ROUND_BITS)
        some = keys
        if bits:
            wanted = [[p >> max(0, bits - 64) if bits > 64 else p, p & ((1 << (bits - 64)) - 1) if bits > 64 else 0] for p in cells]
            wanted = [[a - (1 << 64) if a >= 1 << 63 else a, b] for a, b in wanted]
            at = keys.sparkSession.createDataFrame(wanted, "a long, b long")
            some = keys.withColumn("cell", _prefix(bits)).join(F.broadcast(at.select(F.struct("a", "b").alias("cell"))), "cell")
        counted = some.groupBy(_prefix(finer).alias("at")).agg(F.sum(F.col("size") * F.col("times")).alias("bytes"), F.max("times").alias("times"), F.max("size").alias("size")).collect()
        inside: dict[int, list[tuple[int, int, int, int]]] = {p: [] for p in cells}
        for r in counted:
            p = _whole(r["at"]["a"], r["at"]["b"], finer)
            inside[p >> (finer - bits)].append((p, r["bytes"], r["times"], r["size"]))
        nexts: dict[int, tuple[list[int], int]] = {}
        for p, (members, below) in cells.items():
            parts = sorted(inside[p])
            edges = np.cumsum([below] + [x[1] for x in parts])
            for i in members:
                if not parts:
                    found[i] = (0, 0)
                    continue
                k = min(max(int(np.searchsorted(edges, targets[i], side="right")) - 1, 0), len(parts) - 1)  # the target lies in parts[k]
                low, high = targets[i] - edges[k], edges[k + 1] - targets[i]
                if min(low, high) <= tolerance or finer == 128 and parts[k][2] == 1:
                    near = k if low <= high else k + 1
                    found[i] = (parts[near][0] << (128 - finer) if near < len(parts) else (parts[-1][0] + 1) << (128 - finer), 0)
                elif finer == 128:
                    found[i] = (parts[k][0], min(parts[k][2], max(0, round(low / parts[k][3]))))
                else:
                    nexts.setdefault(parts[k][0], ([], int(edges[k])))[0].append(i)
        cells, bits = nexts, finer
    return [found[i] for i in range(len(targets))]


def _behind(boundaries: list[tuple[int, int]]) -> Column:
    """How many boundaries lie at or before a row (k1, k2, place among its equals)."""
    unsigned = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
    out = F.lit(0)
    for key, n in boundaries:
        if key >= 1 << 128:
            continue
        a, b = ((key >> shift & (1 << 64) - 1) - (1 << 63) for shift in (64, 0))
        tie = (unsigned("k2") > b) | ((unsigned("k2") == b) & (F.col("place") >= n))
        out = out + F.when((unsigned("k1") > a) | ((unsigned("k1") == a) & tie), 1).otherwise(0)
    return out


def histogram_shards(docs: DataFrame, shards: int = 24, *, text_col: str = "text", overhead: int = 8, tolerance: float = TOLERANCE, task_bytes: int = TASK_BYTES, shuffled: bool = False) -> DataFrame:
    """All columns of docs, with shard_size, shard (0 to shards - 1) and slot (from 0, gapless in each shard).

    A row's size is the UTF-8 bytes of its text plus overhead; a null text has
    none.  Shards get equal bytes but for the tolerance, or but for one row
    where rows are larger than that.  Shards are ranges of the key.  Null and
    empty texts are two groups of equal texts.  Rows equal in every column tie:
    a group of them that is large is parted by position like others, a small
    one stays together.  An empty table gives an empty table.  Columns of docs
    called as one of the new ones are replaced; other names are free.

    shuffled: slots of a part (what a task holds) follow a hash of row and copy
    instead of the key, so that equal texts don't stand side by side.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("shard_size", "shard", "slot")])
    k1, k2 = sort_key(docs, text_col)
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + F.lit(overhead)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, k1.alias("k1"), k2.alias("k2"), size.alias("size"))
    keys = cut(rows.select("k1", "k2", "size"))
    total = int(keys.agg(F.sum("size")).first()[0] or 0)
    parts = max(1, -(-total // (shards * task_bytes)))
    allowed = tolerance * total / shards
    # Equal rows of at least half of what a task or the tolerance holds are parted.
    heavy = keys.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("times"), F.max("size").alias("size"))
    heavy = cut(heavy.where((F.col("times") > 1) & (F.col("times") * F.col("size") >= min(allowed, task_bytes) / 2)))
    some = not heavy.isEmpty()
    light = keys.withColumn("times", F.lit(1).cast("long"))
    if some:
        light = light.join(few(heavy.select("k1", "k2")), ["k1", "k2"], "left_anti").unionByName(heavy)
    light = light.select("k1", "k2", "size", "times")
    found = splitters(light, [total * i / shards for i in range(1, shards)], allowed)
    for i in range(1, len(found)):  # order holds where two targets meet in one large row
        found[i] = max(found[i], found[i - 1])

    placed = rows.withColumn("place", F.lit(0).cast("long"))
    counts = light.where("times = 1").select("k1", "k2", F.lit(0).cast("long").alias("place"))
    if some:
        mine = few(heavy.select("k1", "k2"))
        one = rows.join(mine, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("row").alias("row"), F.first("size").alias("size")).join(heavy.select("k1", "k2", "times"), ["k1", "k2"])
        placed = rows.join(mine, ["k1", "k2"], "left_anti").select("row", "k1", "k2", "size", F.lit(0).cast("long").alias("place")).union(_copies(one, "row", "k1", "k2", "size"))
        counts = counts.union(_copies(heavy, "k1", "k2"))
    # A part is what a task holds: different rows by their hash, equal ones by position.
    shard, part = _behind(found).alias("shard"), F.pmod(F.xxhash64("k2", F.floor(F.col("place") / STEP)), F.lit(parts)).alias("part")
    below = counts.groupBy(shard, part).agg(F.count(F.lit(1)).alias("n"))
    starts = below.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    placed = placed.select("row", "k1", "k2", "place", F.col("size").alias("shard_size"), shard, part)
    order = Window.partitionBy("shard", "part").orderBy("k1", "k2", "place")
    if shuffled:
        # Dealt out once: copies are numbered, and all ordered anew, within the part.
        equal = Window.partitionBy("shard", "part", "k1", "k2", "place").orderBy("place")
        placed = placed.repartition("shard", "part").withColumn("copy", F.row_number().over(equal))
        order = Window.partitionBy("shard", "part").orderBy(F.xxhash64(F.lit("slot"), "k1", "k2", "place", "copy"), "k1", "k2", "place", "copy")
    placed = placed.withColumn("number", F.row_number().over(order)).join(few(cut(starts)), ["shard", "part"])
    placed = placed.select("row", "shard_size", "shard", (F.col("before") + F.col("number") - 1).cast("long").alias("slot"))
    return placed.select("row.*", "shard_size", "shard", "slot")


def _copies(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns of each row as many times as its times says, with their place from 0; dealt out by steps of STEP copies."""
    steps = rows.select(*columns, "times", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(STEP).cast("long"))).alias("first"))
    steps = steps.repartition("k1", "k2", "first")
    return steps.select(*columns, F.explode(F.sequence(F.col("first"), F.least(F.col("times"), F.col("first") + STEP) - 1)).alias("place"))


def op4_histogram_shards(spark, sf_dir: str) -> DataFrame:
    """Documents in 24 shards of nearly equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = histogram_shards(docs, 24)
    return out.select("doc_id", F.col("shard_size").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
