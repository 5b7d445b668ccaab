"""bigWig files written here, section by section, and read again."""

from __future__ import annotations

import struct
import zlib

import pytest
from pyspark.errors import PySparkException

from helixframe.sources.bigwig import CHROMS, FILE, INDEX, read_bigwig


def written(order: str, packed: bool) -> bytes:
    head = lambda chrom, start, end, step, span, kind, n: struct.pack(f"{order}IIIIIBBH", chrom, start, end, step, span, kind, 0, n)
    parts = [
        head(0, 0, 20, 0, 0, 1, 2) + struct.pack(f"{order}IIfIIf", 0, 5, 1.5, 10, 20, -2.0),
        head(0, 30, 44, 0, 4, 2, 2) + struct.pack(f"{order}IfIf", 30, 1.0, 40, 2.0),
        head(1, 100, 130, 10, 5, 3, 3) + struct.pack(f"{order}fff", 7.0, 8.0, 9.0),
    ]
    parts = [zlib.compress(p) if packed else p for p in parts]
    chrom_at = 64
    tree = struct.pack(f"{order}IIIIQQ", CHROMS, 2, 5, 8, 2, 0) + struct.pack(f"{order}BBH", 1, 0, 2)
    tree += b"chr1\0" + struct.pack(f"{order}II", 0, 1000) + b"chrX\0" + struct.pack(f"{order}II", 1, 500)
    data_at = chrom_at + len(tree)
    offsets, at = [], data_at + 4
    for p in parts:
        offsets.append(at)
        at += len(p)
    index_at = at
    index = struct.pack(f"{order}IIQIIIIQII", INDEX, 2, 3, 0, 0, 1, 130, at, 1, 0)
    # One inner node with two leaves.
    leaf_at = index_at + 48 + 4 + 2 * 24
    leaf = lambda items: struct.pack(f"{order}BBH", 1, 0, len(items)) + b"".join(struct.pack(f"{order}IIIIQQ", *i) for i in items)
    first = leaf([(0, 0, 0, 20, offsets[0], len(parts[0])), (0, 30, 0, 44, offsets[1], len(parts[1]))])
    second = leaf([(1, 100, 1, 130, offsets[2], len(parts[2]))])
    inner = struct.pack(f"{order}BBH", 0, 0, 2) + struct.pack(f"{order}IIIIQ", 0, 0, 0, 44, leaf_at) + struct.pack(f"{order}IIIIQ", 1, 100, 1, 130, leaf_at + len(first))
    header = struct.pack(f"{order}IHHQQQHHQQIQ", FILE, 4, 0, chrom_at, data_at, index_at, 0, 0, 0, 0, 4096 if packed else 0, 0)
    assert len(header) == 64
    return header + tree + struct.pack(f"{order}I", 3) + b"".join(parts) + index + inner + first + second


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("packed", [True, False])
def test_read(spark, tmp_path, order, packed):
    (tmp_path / "a.bw").write_bytes(written(order, packed))
    got = [tuple(r) for r in read_bigwig(spark, str(tmp_path / "a.bw")).drop("path").orderBy("chrom", "start").collect()]
    assert got == [("chr1", 0, 5, 1.5), ("chr1", 10, 20, -2.0), ("chr1", 30, 34, 1.0), ("chr1", 40, 44, 2.0), ("chrX", 100, 105, 7.0), ("chrX", 110, 115, 8.0), ("chrX", 120, 125, 9.0)]


def test_other_files_raise(spark, tmp_path):
    (tmp_path / "a.bw").write_bytes(b"nothing like it" * 10)
    with pytest.raises(PySparkException):
        read_bigwig(spark, str(tmp_path / "a.bw")).collect()
