"""bigWig signal files as (chrom, start, end, value).

A file is read as one binary value (up to 2 GB); one step follows its index
to the compressed sections, which are then dealt out and decoded in parallel.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: signatures of the file, the chromosome tree and the section index.
FILE, CHROMS, INDEX = 0x888FFC26, 0x78CA8C91, 0x2468ACE0


def _nodes(data: bytes, at: int, order: str, leaf: int, inner: int) -> Iterator[bytes]:
    """All leaf items of a tree of fixed-size items; an inner item ends with its child's offset."""
    todo = [at]
    while todo:
        at = todo.pop()
        is_leaf, _, n = struct.unpack_from(f"{order}BBH", data, at)
        size = leaf if is_leaf else inner
        for i in range(n):
            item = data[at + 4 + i * size : at + 4 + (i + 1) * size]
            if is_leaf:
                yield item
            else:
                todo.append(struct.unpack(f"{order}Q", item[-8:])[0])


def sections(data: bytes) -> Iterator[tuple[str, bytes, bool, str]]:
    """(chromosome, section, compressed, byte order) of a file's sections."""
    order = next((o for o in "<>" if struct.unpack_from(f"{o}I", data)[0] == FILE), None)
    if order is None:
        raise ValueError("not a bigWig file")
    _, _, chrom_at, _, index_at = struct.unpack_from(f"{order}HHQQQ", data, 4)
    packed = struct.unpack_from(f"{order}I", data, 52)[0] > 0
    magic, _, key, _ = struct.unpack_from(f"{order}IIII", data, chrom_at)
    if magic != CHROMS or struct.unpack_from(f"{order}I", data, index_at)[0] != INDEX:
        raise ValueError("broken bigWig file")
    names = {}
    for item in _nodes(data, chrom_at + 32, order, key + 8, key + 8):
        names[struct.unpack(f"{order}I", item[key : key + 4])[0]] = item[:key].rstrip(b"\0").decode()
    for item in _nodes(data, index_at + 48, order, 32, 24):
        chrom, _, _, _, at, size = struct.unpack(f"{order}IIIIQQ", item)
        yield names[chrom], data[at : at + size], packed, order


def decode(section: bytes, packed: bool, order: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and values of a section, whichever of the three layouts it has."""
    data = zlib.decompress(section) if packed else section
    _, start, _, step, span, kind, _, n = struct.unpack_from(f"{order}IIIIIBBH", data)
    columns = {1: [("s", "u4"), ("e", "u4"), ("v", "f4")], 2: [("s", "u4"), ("v", "f4")], 3: [("v", "f4")]}[kind]
    rows = np.frombuffer(data, np.dtype([(c, order + t) for c, t in columns]), n, 24)
    starts = rows["s"].astype(np.int64) if kind < 3 else start + step * np.arange(n, dtype=np.int64)
    return starts, rows["e"].astype(np.int64) if kind == 1 else starts + span, rows["v"].astype(np.float64)


def read_bigwig(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, chrom, start, end, value): the intervals of bigWig files."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(path, *s) for s in sections(bytes(content))]
                for i in range(0, len(rows), 256):
                    yield pd.DataFrame(rows[i : i + 256], columns=["path", "chrom", "section", "packed", "byte_order"])

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, chrom, section, packed, order in batch.itertuples(index=False):
                s, e, v = decode(bytes(section), packed, order)
                yield pd.DataFrame({"path": path, "chrom": chrom, "start": s, "end": e, "value": v})

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    found = files.mapInPandas(find, "path string, chrom string, section binary, packed boolean, byte_order string")
    dealt = found.repartition(F.xxhash64("path", "section"))
    return dealt.mapInPandas(unpack, "path string, chrom string, start long, end long, value double")
