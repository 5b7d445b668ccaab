"""FASTA files by byte ranges against the files as text."""

from __future__ import annotations

import random

import pytest

from helixframe.sources import genome, readers


def write(folder, name, records, width, end="\n", last="\n"):
    text = ""
    for title, seq in records:
        lines = [seq[i : i + width] for i in range(0, len(seq), width)]
        text += f">{title}{end}" + "".join(x + end for x in lines)
    (folder / name).write_bytes((text[: -len(end)] + last).encode())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r = random.Random(6)
    f = tmp_path_factory.mktemp("fasta")
    letters = lambda n: "".join(r.choice("acgtACGTN") for _ in range(n))
    one = [("chr1 some words", letters(1000)), ("empty", ""), ("chr2", letters(60)), (" chr3", letters(61))]
    two = [("short", letters(7)), ("chrX\tx", letters(345)), ("none at the end", "")]
    write(f, "a.fa", one, 60)
    write(f, "b.fa", two, 50, "\r\n", "\r\n\r\n\r\n")
    write(f, "c.fa", [("chrY", letters(100))], 10, last="")
    (f / "_SUCCESS").write_text("")
    return f, {t.split()[0]: s.upper() for t, s in [*one, *two]} | {"chrY": (f / "c.fa").read_text().split("\n", 1)[1].replace("\n", "").upper()}


@pytest.mark.parametrize("block", [5, 61, 1 << 24])
def test_index(spark, folder, block):
    path, seqs = folder
    got = {x["chrom"]: x for x in genome.fasta_index(spark, str(path), block).collect()}
    assert {c: x["length"] for c, x in got.items()} == {c: len(s) for c, s in seqs.items()}
    assert (got["chr1"]["line_bases"], got["chr1"]["line_bytes"], got["chrX"]["line_bases"], got["chrX"]["line_bytes"]) == (60, 61, 50, 52)


@pytest.mark.parametrize("tile", [1, 13, 60, 65_536])
def test_tiles(spark, folder, tmp_path, tile):
    path, seqs = folder
    index = genome.write_index(spark, str(path), f"{tmp_path}/index")
    df = genome.read_genome(spark, index, tile=tile, task=100)
    got = {(x["chrom"], x["tile_start"]): x["seq"] for x in df.collect()}
    assert got == {(c, i): s[i : i + tile] for c, s in seqs.items() for i in range(0, len(s), tile)}
    plain = readers.genome_tiles(readers.read_fasta(spark, f"{path}/a.fa"), tile)
    own = {(x["chrom"], x["tile_start"]): x["seq"] for x in plain.collect() if x["seq"]}
    assert own.items() <= got.items()
    for where, keep in (("chrom = 'chr1' and tile_start > 26 and tile_start <= 130", lambda c, i: c == "chr1" and 26 < i <= 130), ("chrom in ('chr2', 'chrY') and tile_start = 0", lambda c, i: c in ("chr2", "chrY") and i == 0), ("tile_start < 13 and length(seq) < 13", lambda c, i: i < 13 and len(got[c, i]) < 13), ("chrom = 'gone'", lambda c, i: False)):
        assert {(x["chrom"], x["tile_start"]) for x in df.where(where).collect()} == {k for k in got if keep(*k)}


def test_a_region_opens_only_its_ranges(spark, tmp_path):
    """Of a file whose other parts are broken, a region is read; the number of tasks follows the region."""
    seq = "ACGT" * 2500
    write(tmp_path, "g.fa", [("chr1", seq), ("chr2", seq), ("chr3", seq)], 100)
    index = genome.write_index(spark, f"{tmp_path}/g.fa", f"{tmp_path}/index")
    data = bytearray((tmp_path / "g.fa").read_bytes())
    data[50], data[9000], data[-60] = (ord("\n"),) * 3  # lines of other lengths in chr1 and chr3
    (tmp_path / "g.fa").write_bytes(data)
    df = genome.read_genome(spark, index, tile=100, task=1000)
    assert df.rdd.getNumPartitions() == 30
    some = df.where("chrom = 'chr2'")
    assert some.rdd.getNumPartitions() == 10 and "".join(x["seq"] for x in some.orderBy("tile_start").collect()) == seq
    near = df.where("chrom = 'chr1' and tile_start >= 2000 and tile_start < 4000")
    assert near.rdd.getNumPartitions() == 2 and "".join(x["seq"] for x in near.orderBy("tile_start").collect()) == seq[2000:4000]
    with pytest.raises(Exception, match="different lengths"):
        df.where("chrom = 'chr1'").collect()
