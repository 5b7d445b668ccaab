"""FASTA files read by byte ranges: tiles of long records, by an index of where each record's letters lie.

Lines of a record are of one length, but for its last one, as indexed FASTA
files have them; so a position's byte follows by arithmetic, and a task reads
only the bytes of its tiles.  No row is longer than a tile.  Filters on
chromosome and tile decide which ranges are read at all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.window import Window

#: Letters that a task reads, and bytes that a task looks through for headers.
TASK, BLOCK = 1 << 22, 1 << 24
INDEX = "file string, chrom string, length long, first_byte long, line_bases long, line_bytes long"
SCHEMA = "chrom string, tile_start long, seq string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder but those that begin with a dot or underscore."""
    files, inner = _opened(path)
    info = files.get_file_info(inner)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if info.type != pafs.FileType.Directory:
        return [(path, info.size)]
    found = files.get_file_info(pafs.FileSelector(inner))
    return sorted((prefix + f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._" and f.size)


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, size, at, name, first_byte, line_bases, line_bytes) of the records whose header begins in a block."""
    for batch in batches:
        rows = []
        for file, size, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            files, inner = _opened(file)
            with files.open_input_file(inner) as f:
                data = f.read_at(stop - start + 1, max(0, start - 1)) if start else b"\n" + f.read_at(stop, 0)
                at = data.find(b"\n>")
                while at >= 0:
                    head = start + at  # of the header's sign
                    line, step = b"", 4096
                    while b"\n" not in line and head + len(line) < size:
                        line += f.read_at(step, head + len(line))
                        step *= 2
                    title, _, _ = line.partition(b"\n")
                    first = head + len(title) + 1
                    body, step = b"", 4096
                    while b"\n" not in body and first + len(body) < size:
                        body += f.read_at(step, first + len(body))
                        step *= 2
                    letters, newline, _ = body.partition(b"\n")
                    bases = len(letters.rstrip(b"\r"))
                    if letters.startswith(b">"):  # a record without letters
                        bases, letters, newline = 0, b"", b""
                    name = title[1:].strip().split()
                    rows.append((file, size, head, name[0].decode() if name else "", first, bases, len(letters) + len(newline)))
                    at = data.find(b"\n>", at + 1)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "size", "at", "chrom", "first_byte", "line_bases", "line_bytes"])


def fasta_index(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, chrom, length, first_byte, line_bases, line_bytes) of all records of a file or folder, found in blocks of bytes in parallel."""
    blocks = [(f, size, a, min(size, a + block)) for f, size in files_of(path) for a in range(0, size, block)]
    if not blocks:
        return spark.createDataFrame([], INDEX)
    dealt = spark.createDataFrame(blocks, "file string, size long, start long, stop long").repartition(len(blocks))
    found = dealt.mapInArrow(_headers, "file string, size long, at long, chrom string, first_byte long, line_bases long, line_bytes long")
    ends = F.coalesce(F.lead("at").over(Window.partitionBy("file").orderBy("at")), F.col("size"))
    body = F.greatest(ends - F.col("first_byte"), F.lit(0))
    rest = F.least(F.when(F.col("line_bytes") > 0, body % F.col("line_bytes")), F.col("line_bases"))
    # What follows the last whole line is letters and at most one line's end; its length is settled by the bytes themselves.
    found = found.withColumn("__body", body).withColumn("__rest", F.coalesce(rest, F.lit(0)))
    return found.mapInArrow(_measured, INDEX)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lengths: whole lines by arithmetic, the last one by its bytes."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            length = 0
            if r["line_bytes"]:
                whole = r["__body"] // r["line_bytes"]
                # Empty lines may follow a record: the last few lines tell where its letters end.
                keep = max(0, whole - 1)
                files, inner = _opened(r["file"])
                with files.open_input_file(inner) as f:
                    tail = f.read_at(r["__body"] - keep * r["line_bytes"], r["first_byte"] + keep * r["line_bytes"])
                length = keep * r["line_bases"] + len(tail.translate(None, b"\r\n \t"))
            rows.append((r["file"], r["chrom"], length, r["first_byte"], r["line_bases"], r["line_bytes"]))
        if rows:
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "chrom", "length", "first_byte", "line_bases", "line_bytes"])


@dataclass
class Stretch(InputPartition):
    """Tiles first to last (exclusive) of a record."""

    file: str
    chrom: str
    length: int
    first_byte: int
    line_bases: int
    line_bytes: int
    first: int
    last: int


class GenomeReader(DataSourceReader):
    """Plans stretches of tiles; filters on chrom and tile_start leave out those that can't hold a row."""

    def __init__(self, options: dict[str, str]):
        self.tile, self.task, self.upper = int(options["tile"]), int(options.get("task", TASK)), options.get("upper", "true") == "true"
        self.index = options["index"]
        self.chroms: set[str] | None = None
        self.low, self.high = 0, None  # tile_start from low to high, both included

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("chrom",) and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.chroms = own if self.chroms is None else self.chroms & own
            elif column == ("tile_start",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    top = f.value - isinstance(f, LessThan)
                    self.high = top if self.high is None else min(self.high, top)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        import pyarrow.parquet as pq

        files, inner = _opened(self.index)
        out, step = [], max(1, self.task // self.tile)
        for r in pq.read_table(inner, filesystem=files).to_pylist():
            if self.chroms is not None and r["chrom"] not in self.chroms:
                continue
            stop = -(-r["length"] // self.tile)
            if self.high is not None:
                stop = min(stop, self.high // self.tile + 1)
            for first in range(max(0, -(-self.low // self.tile)), stop, step):
                out.append(Stretch(**r, first=first, last=min(stop, first + step)))
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        p = partition
        if p is None:  # what Spark asks for where nothing is planned
            return
        byte = lambda x: p.first_byte + x // p.line_bases * p.line_bytes + x % p.line_bases
        start, stop = p.first * self.tile, min(p.length, p.last * self.tile)
        files, inner = _opened(p.file)
        with files.open_input_file(inner) as f:
            data = f.read_at(byte(stop - 1) + 1 - byte(start), byte(start))
        seq = data.translate(None, b"\r\n")
        if len(seq) != stop - start or b">" in seq:
            raise ValueError(f"{p.chrom} in {p.file} has lines of different lengths")
        text = (seq.upper() if self.upper else seq).decode("ascii")
        at = range(start, stop, self.tile)
        yield pa.RecordBatch.from_arrays([pa.array([p.chrom] * len(at)), pa.array(list(at), pa.int64()), pa.array([text[x - start : x - start + self.tile] for x in at])], names=["chrom", "tile_start", "seq"])


class Genome(DataSource):
    @classmethod
    def name(cls) -> str:
        return "indexed_fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> GenomeReader:
        return GenomeReader(self.options)


def write_index(spark: SparkSession, path: str, index: str) -> str:
    """Writes the index of path's records as a Parquet folder and returns its path; the planner reads a row a record."""
    fasta_index(spark, path).write.parquet(index)
    return index


def read_genome(spark: SparkSession, index: str, *, tile: int = 65_536, upper: bool = True, task: int = TASK) -> DataFrame:
    """(chrom, tile_start, seq): tiles of all indexed records, the last of each shorter; records without letters have none.

    where() on chrom (= or IN) and tile_start (=, <, <=, >, >=) reaches the
    planner, so that other ranges aren't opened; it needs PUSHDOWN, which is
    set in the session.  Files and index must be where pyarrow can read byte
    ranges: a mounted folder or an object store.  A record whose lines are not
    of one length is an error as it is read.  The planner holds a row for each
    record: files of very many short records are better read by read_fasta.
    """
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Genome)
    return spark.read.format("indexed_fasta").options(index=index, tile=str(tile), upper=str(upper).lower(), task=str(task)).load()
