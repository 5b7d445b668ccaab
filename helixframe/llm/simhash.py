"""SimHash near-duplicates with pigeonring filtering.

A fingerprint of 64 bits is cut into a ring of eight segments.  If two
fingerprints differ in at most t bits, some segment starts a chain whose first
l segments together differ in at most l * t / 8 bits, for every l: the
proportional budgets.  For t = 2 the first three segments of the chain agree
and the first seven differ in one bit at most, so that one of two fixed sets
of five segments agrees too.  Its 40 bits are the key by which candidates meet;
the chain's budgets prune them before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm import text as tx
from helixframe.llm.cluster import cut, few, hashable
from helixframe.llm.graph import components

SEGMENTS, WIDTH = 8, 8
#: Distinct fingerprints under one key that are compared pair by pair; larger keys are linked through common neighbours.
PAIRWISE = 64
#: Blocks of minima and minima in each, for similar texts whose fingerprints differ in more bits than chains link: a pair of similarity 0.8 shares none in 0.04 % of cases.
BLOCKS, MINIMA = 20, 5
#: Different texts of a block that are compared pair by pair; in larger blocks each is first compared with hubs.
FAMILY, HUBS = 16, 8
#: Hamming budget of the chains that choose which hubs a text is compared with.
BITS = 18
#: Shingles of the texts of a large block that one side of a tile holds (a text counts as TEXT at least), and columns of a tile at once.
TILE, TEXT, COLUMNS = 128_000, 500, 4096


def shingles(words: tx.Words, k: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts with single spaces between words; starts and ends of shingles in them; where those of each text begin.

    A text of fewer than k words is one shingle; one of none has none.
    """
    counts, ptr = words.counts, words.ptr
    length = words.ends - words.starts
    new = np.cumsum(length + 1) - (length + 1)
    joined = np.full(int(length.sum()) + len(length), 32, np.uint8)
    if len(length):
        inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        joined[np.repeat(new, length) + inner] = words.data[np.repeat(words.starts, length) + inner]
    full = tx.inside_text(words, k)
    short = np.flatnonzero((counts > 0) & (counts < k))
    first = np.concatenate([full, ptr[short]])
    last = np.concatenate([full + k - 1, ptr[short + 1] - 1])
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    return joined.tobytes(), new[first], new[last] + length[last], np.searchsorted(first, ptr)


def xxh64(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(data[s:e], seed) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.uint64)


def majority(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """For each text the bits that over half of its hashes set."""
    out = np.zeros(len(ptr) - 1, np.uint64)
    for i in range(len(ptr) - 1):
        own = h[ptr[i] : ptr[i + 1]]
        if len(own):
            total = np.zeros(64, np.int64)
            for at in range(0, len(own), 4096):
                some = own[at : at + 4096]
                total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
            out[i] = np.packbits(total * 2 > len(own), bitorder="little").view(np.uint64)[0]
    return out


def _fingerprinter(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tx.pieces(batch):
                fp = majority(*_hashed(data, offsets, k))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return run


def _hashed(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    joined, starts, ends, ptr = shingles(tx.split(data, offsets), k)
    return xxh64(joined, starts, ends), ptr


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id, fp): SimHash of each row's lower-cased k-word shingles; 0 for texts without words, nulls among them."""
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return some.mapInArrow(_fingerprinter(k), T.StructType([some.schema["id"], T.StructField("fp", T.LongType())]))


def _turned(fp: Column, i: int) -> Column:
    """The ring with segment i first."""
    return fp if i == 0 else F.shiftrightunsigned(fp, WIDTH * i).bitwiseOR(F.shiftleft(fp, 64 - WIDTH * i))


def _low(x: Column, segments: int) -> Column:
    return x if segments >= 8 else x.bitwiseAND(F.lit((1 << (WIDTH * segments)) - 1))


def chain_keys(fp: Column) -> Column:
    """The keys for two bits: of each start i, segments 0-4 and segments 0-2, 5, 6 of the chain, as (2i or 2i + 1, 40 bits)."""
    keys = []
    for i in range(SEGMENTS):
        x = _turned(fp, i)
        near = _low(x, 5)
        far = _low(x, 3).bitwiseOR(F.shiftleft(F.shiftrightunsigned(x, 40).bitwiseAND(F.lit(0xFFFF)), 24))
        for j, key in ((0, near), (1, far)):
            keys.append(F.shiftleft(F.lit(2 * i + j).cast("long"), 40).bitwiseOR(key))
    return F.array(*keys)


def chain_holds(a: Column, b: Column, start: Column | int, bits: int) -> Column:
    """Whether the chain from that segment keeps its proportional budgets at every length."""
    diff = a.bitwiseXOR(b)
    if isinstance(start, int):
        x = _turned(diff, start)
    else:  # shifts by 64 bits are none
        x = F.call_function("shiftrightunsigned", diff, start * WIDTH).bitwiseOR(F.call_function("shiftleft", diff, 64 - start * WIDTH))
    ok = F.lit(True)
    for length in range(1, SEGMENTS + 1):
        ok = ok & (F.bit_count(_low(x, length)) <= length * bits // SEGMENTS)
    return ok


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints linked at two bits or fewer; (fp) without repeats in.

    Keys with up to PAIRWISE fingerprints are compared pair by pair.  In larger
    ones each fingerprint goes to itself and its 64 neighbours at one bit:
    two fingerprints differ in two bits or fewer exactly if they meet there,
    so an edge to the least of those that meet keeps all components, in
    linear space.
    """
    keyed = cut(fps.select("fp", F.explode(chain_keys(F.col("fp"))).alias("key")))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = keyed.join(sizes, "key")
    few = keyed.where(F.col("n") <= PAIRWISE)
    a, b = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    pairs = a.join(b, "key").where("a < b")
    start = F.shiftright("key", 41).cast("int")
    pairs = pairs.where(chain_holds(F.col("a"), F.col("b"), start, 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    many = keyed.where(F.col("n") > PAIRWISE).select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) * (i == 63))) for i in range(64)])
    met = many.select("fp", F.explode(around).alias("at"))
    least = met.groupBy("at").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return pairs.union(met.join(least, "at").select(F.col("fp").alias("a"), "b").where("a <> b"))


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id, fp, component): component is the least id that links of two bits or fewer reach.

    Rows with the same fingerprint are one node of the graph, however many
    they are.  Rows that repeat an id stay as many rows.  Rows with a null id
    are linked like others; a component of such rows only is null.
    """
    found = cut(fingerprints(docs, id_col=id_col, text_col=text_col, k=k))
    nodes = cut(found.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(nodes.select("fp")))
    own = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = own.groupBy("root").agg(F.min("least").alias("component"))
    own = own.join(best, "root").select("fp", "component")
    return found.join(own, "fp").select("id", "fp", "component")


def op6_simhash_pigeonring(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = simhash_components(docs)
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


# Similarity of word shingles: candidates that chains link, then those that share a block of minima; sizes and exact check.

_TURNS = tx.mix(np.arange(1, BLOCKS * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _distinct(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes without repeats; where those of each text begin."""
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(ptr)))


def _sequence(words: tx.Words) -> np.ndarray:
    """A hash of each text's words in their order."""
    out = np.zeros(len(words.ptr) - 1, np.uint64)
    h = words.hashes()
    full = np.flatnonzero(words.counts)
    if len(full):
        place = tx.mix(h + tx.mix((np.arange(len(h)) - np.repeat(words.ptr[:-1], words.counts)).astype(np.uint64)))
        out[full] = np.add.reduceat(place, words.ptr[full])
    return tx.mix(out)


def _sketcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tx.pieces(batch):
                words = tx.split(data, offsets)
                h, ptr = _distinct(*_hashed(data, offsets, k))
                some = np.flatnonzero(np.diff(ptr))
                blocks = np.zeros((len(ptr) - 1, BLOCKS), np.uint64)
                if len(some):
                    for j, turn in enumerate(_TURNS):
                        blocks[some, j // MINIMA] = tx.mix(blocks[some, j // MINIMA] + np.minimum.reduceat(h * turn, ptr[some]))
                blocks = tx.mix(blocks + np.arange(BLOCKS, dtype=np.uint64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(blocks) + 1, dtype=np.int32) * BLOCKS), pa.array(blocks.reshape(-1).view(np.int64)))
                new = [majority(h, ptr).view(np.int64), _sequence(words).view(np.int64), np.diff(ptr).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *map(pa.array, new), lists], names=[*rows.schema.names[:-1], "fp", "same", "n", "blocks"])

    return run


def _shingler(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tx.pieces(batch):
                h, ptr = _hashed(data, offsets, k)
                sets = [np.unique((h[ptr[i] : ptr[i + 1]] >> np.uint64(32)).astype(np.uint32)).tobytes() for i in range(len(ptr) - 1)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sets, pa.binary())], names=["same", "shingles"])

    return run


def _comparer(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                sizes, keys = [], []
                for i in (2, 3):
                    ends = np.frombuffer(some.column(i).buffers()[1], np.int32)[some.column(i).offset :][: len(some) + 1]
                    size = np.diff(ends) // 4
                    values = np.frombuffer(some.column(i).buffers()[2], np.uint32, int(size.sum()), int(ends[0])) if size.sum() else np.zeros(0, np.uint32)
                    sizes.append(size)
                    keys.append(np.repeat(np.arange(len(some), dtype=np.uint64) << np.uint64(32), size) | values)
                # Each side's keys are sorted, by pair and by shingle.
                both = np.sort(np.concatenate(keys), kind="stable")
                hit = both[1:][both[1:] == both[:-1]] >> np.uint64(32)
                common = np.bincount(hit.astype(np.int64), minlength=len(some))
                near = common >= similarity * (sizes[0] + sizes[1] - common) - 1e-9
                yield some.select([0, 1]).take(pa.array(np.flatnonzero(near)))

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of the left sets has in common with each of the right ones."""
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    common = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(left), len(right)), np.float32)
    at = [np.searchsorted(common, x) for x, _ in sides]
    own = [(k < len(common)) & (common[np.minimum(k, len(common) - 1)] == x) if len(common) else np.zeros(len(x), bool) for k, (x, _) in zip(at, sides, strict=True)]
    for low in range(0, len(common), COLUMNS):
        dense = []
        for k, keep, (_, row), sets in zip(at, own, sides, (left, right), strict=True):
            some = keep & (k >= low) & (k < low + COLUMNS)
            side = np.zeros((len(sets), min(COLUMNS, len(common) - low)), np.float32)
            side[row[some], k[some] - low] = 1
            dense.append(side)
        out += dense[0] @ dense[1].T
    return out


def _tiler(similarity: float):
    """One tile (block, i, j): links that join the groups (root) of all similar texts of chunks i and j."""

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        chunk, nodes, root = (table.column(c).to_numpy() for c in ("chunk", "same", "root"))
        sets = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("shingles")]
        size = np.array([len(x) for x in sets])
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        both = _overlaps([sets[x] for x in left], [sets[x] for x in right])
        near = both >= similarity * (size[left][:, None] + size[right][None, :] - both) - 1e-9
        links, up = [], {}

        def top(x):
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for x, y in zip(*np.nonzero(near & (root[left][:, None] != root[right][None, :])), strict=True):
            a, b = top(root[left[x]]), top(root[right[y]])
            if a != b:
                up[a] = b
                links.append((nodes[left[x]], nodes[right[y]]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def _apart(many: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """Links (a, b) between texts of large blocks (block, same, n) that roots (node, root) leave in different groups: all pairs of a block are compared.

    None where every large block is one group.

    The texts of a block are dealt out to chunks: large groups have their own,
    texts of like size are together.  A tile is two chunks; those of one group
    only, or of sizes too far apart, need no comparison.  A task holds one
    tile, and no step gathers a block.
    """
    own = many.select("block", "same", "n").join(roots, F.col("same") == F.col("node"), "left").select("block", "same", "n", F.coalesce("root", "same").alias("root"))
    mixed = own.groupBy("block").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("block")
    mixed = cut(mixed)
    if not mixed.count():
        return None
    weight = F.greatest("n", F.lit(TEXT))
    range_of = F.floor(F.log("n") / F.log(F.lit(1 / similarity)) + 1e-9).cast("int")
    own = cut(own.join(mixed, "block").select("block", "same", "n", "root", range_of.alias("range")))
    inside = own.groupBy("block", "root").agg(F.sum(weight).alias("inside")).where(F.col("inside") >= TILE).select("block", "root", F.col("root").alias("large"))
    # Joined from short tables of counted size, so that a hot block is not dealt out by its key.
    own = own.join(few(cut(inside)), ["block", "root"], "left")
    loads = own.groupBy("block", "large", "range").agg(F.ceil(F.sum(weight) / TILE).alias("chunks"))
    same_group = F.col("l.block").eqNullSafe(F.col("r.block")) & F.col("l.large").eqNullSafe(F.col("r.large")) & (F.col("l.range") == F.col("r.range"))
    dealt = own.alias("l").join(few(cut(loads)).alias("r"), same_group)
    number = F.pmod(F.xxhash64(F.lit("chunk"), F.col("l.same")), F.col("r.chunks"))
    chunk = F.xxhash64(F.coalesce(F.col("l.large"), F.lit(0)), F.col("l.large").isNull(), F.col("l.range"), number)
    own = cut(dealt.select("l.block", "l.same", "l.n", "l.root", chunk.alias("chunk")))
    chunks = own.groupBy("block", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("root").alias("x"), F.max("root").alias("y"))
    a, b = (chunks.select("block", F.col("chunk").alias(i), *[F.col(c).alias(f"{c}_{i}") for c in ("lo", "hi", "x", "y")]) for i in ("i", "j"))
    sizes = (F.col("hi_i") >= similarity * F.col("lo_j") - 1e-9) & (F.col("hi_j") >= similarity * F.col("lo_i") - 1e-9)
    tiles = a.join(b, "block").where((F.col("i") <= F.col("j")) & sizes & (F.least("x_i", "x_j") != F.greatest("y_i", "y_j"))).select("block", "i", "j")
    sides = tiles.select("block", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk"))
    rows = sides.join(own, ["block", "chunk"]).join(sets, "same").select("block", "i", "j", "chunk", "same", "root", "shingles")
    return cut(rows.groupBy("block", "i", "j").applyInArrow(_tiler(similarity), "a long, b long"))


def _pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of rows (same, n, x: the same of another text) whose sizes let them be similar."""
    fit = F.least("n", "x.n") >= similarity * F.greatest("n", "x.n") - 1e-9
    return rows.where(fit & (F.col("same") != F.col("x.same"))).select(F.least("same", "x.same").alias("a"), F.greatest("same", "x.same").alias("b")).distinct()


def chain_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of texts (same, fp, n) that the chains of their fingerprints link, and whose sizes let them be similar.

    Texts of one fingerprint meet the least of them, which stands for all in links.
    """
    least = cut(nodes.groupBy("fp").agg(F.min_by(F.struct("same", "n"), "same").alias("x")))
    equal = nodes.join(least, "fp").select("same", "n", "x")
    ends = links(least.select("fp")).join(least.select(F.col("fp").alias("a"), F.col("x").alias("own")), "a").join(least.select(F.col("fp").alias("b"), "x"), "b")
    return _pairs(equal.union(ends.select("own.same", "own.n", "x")), similarity)


def _any_chain(a: Column, b: Column, bits: int) -> Column:
    """Whether fingerprints differ in at most so many bits and a chain from some segment keeps its proportional budgets."""
    out = F.lit(False)
    for i in range(SEGMENTS):
        out = out | chain_holds(a, b, i, bits)
    return out & (F.bit_count(a.bitwiseXOR(b)) <= bits)


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets of shingles are similar."""
    both = pairs.join(sets.select(F.col("same").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("same").alias("b"), F.col("shingles").alias("sb")), "b")
    return cut(both.select("a", "b", "sa", "sb").mapInArrow(_comparer(similarity), "a long, b long"))


def _row_keys(docs: DataFrame) -> list[Column]:
    """128 hashed bits of all columns: rows equal in every column, and only those, agree."""
    columns = hashable(docs)
    return [F.xxhash64(F.lit("row"), *columns).alias("k1"), F.xxhash64(F.lit("again"), *columns).alias("k2")]


def row_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(k1, k2, id, same, root): a row for each row of docs, with its key, its text's hash, and the group of near-duplicates.

    Texts are grouped by Jaccard similarity of their sets of k-word shingles.
    Candidates are texts whose fingerprints the pigeonring chains link, as in
    simhash_components; those whose numbers of different shingles allow the
    similarity are compared exactly.  Similar texts may differ in up to a
    quarter of the 64 bits, of which no exact segment is a usable key.  For
    those beyond the chains' two bits candidates also share one of BLOCKS
    blocks of MINIMA minima of the shingle hashes.

    In a block of up to FAMILY different texts all pairs are compared.  In a
    larger one each text is first compared with HUBS texts of the block, of
    which the chain's budgets and the Hamming check choose the likely ones;
    this joins large families in linear work.  Then all pairs of the block
    that are still in different groups are compared exactly.
    """
    rows = docs.select(*_row_keys(docs), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kept = T.StructType([*rows.schema.fields[:3], *[T.StructField(c, t) for c, t in (("fp", T.LongType()), ("same", T.LongType()), ("n", T.IntegerType()), ("blocks", T.ArrayType(T.LongType())))]])
    sketches = cut(rows.mapInArrow(_sketcher(k), kept))
    one = F.struct("k1", "k2", "n", "fp", "blocks")
    nodes = cut(sketches.where("n > 0").groupBy("same").agg(F.min_by(one, F.struct("k1", "k2")).alias("one")).select("same", "one.*"))
    blocks = nodes.select("same", "fp", "n", F.explode("blocks").alias("block"))
    other = F.struct("same", "fp", "n")
    shared = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("in_block")).where("in_block > 1")
    blocks = cut(blocks.join(shared, "block"))
    small, many = blocks.where(F.col("in_block") <= FAMILY), blocks.where(F.col("in_block") > FAMILY)
    # Kept apart from the join below, so that adaptive execution can split a hot block there.
    hubs = cut(many.groupBy("block").agg(F.array_distinct(F.array(*[F.min_by(other, F.xxhash64(F.lit(i), "same")) for i in range(HUBS)])).alias("hubs")))

    chained = cut(chain_pairs(nodes.select("same", "fp", "n"), similarity))
    wanted = blocks.select("same").union(chained.select("a")).union(chained.select("b")).distinct().join(nodes.select("same", "k1", "k2"), "same")
    texts = rows.select("k1", "k2", "text").join(few(cut(wanted)), ["k1", "k2"]).select("same", "text")
    sets = cut(texts.mapInArrow(_shingler(k), "same long, shingles binary").dropDuplicates(["same"]))

    near = small.select("block", "same", "n").join(small.select("block", other.alias("x")), "block").where("same < x.same")
    far = many.join(hubs, "block").select("same", "fp", "n", F.explode("hubs").alias("x")).where(_any_chain(F.col("fp"), F.col("x.fp"), BITS))
    others = _pairs(near.select("same", "n", "x").union(far.select("same", "n", "x")), similarity)
    found = _similar(chained.union(others).distinct(), sets, similarity)
    roots = components(found)
    rest = _apart(many, roots, sets, similarity)
    if rest is not None and rest.count():
        of = roots.select("node", "root")
        a, b = (of.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        joined = rest.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        over = components(joined).select(F.col("node").alias("root"), F.col("root").alias("top"))
        every = of.union(rest.select("a", "a").union(rest.select("b", "b")).join(of.select(F.col("node").alias("a")), "a", "left_anti")).distinct()
        roots = cut(every.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
    # Copies follow their text; only different texts go through the graph.
    return sketches.select("k1", "k2", "id", "same").join(roots.withColumnRenamed("node", "same"), "same", "left").select("k1", "k2", "id", "same", F.coalesce("root", "same").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, group): a row for each row of docs; group is the least id of its near-duplicates (row_groups), itself included.

    Texts without words, nulls among them, are one group of equal texts.  Rows
    that repeat an id each have the group of their own text.  Ids of any type
    and null ids are fine; a group of rows without ids has a null group.  An
    empty table gives an empty table.
    """
    rows = cut(row_groups(docs, id_col=id_col, text_col=text_col, k=k, similarity=similarity))
    least = cut(rows.groupBy("root").agg(F.min("id").alias("group")))
    return rows.select("id", "root").join(least, "root").select("id", "group")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The columns of docs; of each group of near-duplicates (row_groups) one row: the one of least id, nulls last, then of least row hash.

    Rows are told apart by all their columns: rows that share an id but not a
    text are different documents, and rows equal in every column are one.
    Texts without words are one group, so one of them stays.
    """
    rows = cut(row_groups(docs, id_col=id_col, text_col=text_col, k=k, similarity=similarity))
    times = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("times"), F.first("root").alias("root"), F.first("id").alias("id"))
    best = cut(rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "k1", "k2")).alias("best")))
    marked = times.join(best, "root").select("k1", "k2", "times", ((F.col("k1") == F.col("best.k1")) & (F.col("k2") == F.col("best.k2"))).alias("stays"))
    marked = cut(marked.where("not stays or times > 1"))
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *_row_keys(docs))
    once = keyed.join(few(marked.select("k1", "k2")), ["k1", "k2"], "left_anti").select("row.*")
    # Rows that are there several times: equal ones meet after partial aggregation, so a hot one is no burden.
    again = keyed.join(few(marked.where("stays").select("k1", "k2")), ["k1", "k2"], "left_semi")
    first = again.groupBy("k1", "k2").agg(F.first("row").alias("row")).select("row.*")
    return once.union(first)
