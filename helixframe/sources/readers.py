"""BED, VCF, FASTA, MEME and bedGraph files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VCF = "CHROM string, POS int, ID string, REF string, ALT string, QUAL string, FILTER string, INFO string, FORMAT string"


def read_bed(spark: SparkSession, paths: str | list[str], *, summits: bool = False) -> DataFrame:
    """(chrom, start, end) without header; with summits also the tenth column."""
    columns = ["chrom string", "start bigint", "end bigint"]
    if summits:
        columns += [f"c{i} string" for i in range(3, 9)] + ["summit bigint"]
    df = spark.read.csv(paths, sep="\t", schema=", ".join(columns), comment="#")
    return df.select("chrom", "start", "end", *(["summit"] if summits else []))


def read_vcf(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The nine fixed columns of variants; sample columns are dropped; gzip is fine."""
    return spark.read.csv(paths, sep="\t", schema=VCF, comment="#")


def read_fasta(spark: SparkSession, paths: str | list[str], *, upper: bool = True) -> DataFrame:
    """(chrom, seq): a row a record, split at the header sign, so that large files are read in parallel."""
    records = spark.read.text(paths, lineSep=">").where(F.length(F.trim("value")) > 0)
    lines = F.split("value", "\r?\n")
    seq = F.array_join(F.transform(F.slice(lines, 2, F.size(lines)), F.trim), "")
    return records.select(F.split(F.trim(F.get(lines, F.lit(0))), r"\s+")[0].alias("chrom"), (F.upper(seq) if upper else seq).alias("seq"))


def genome_tiles(genome: DataFrame, tile: int = 65_536) -> DataFrame:
    """(chrom, tile_start, seq): sequences cut into tiles of a fixed width, the last one shorter."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.length("seq") - 1, F.lit(0)).cast("long"), F.lit(tile).cast("long")))
    return genome.select("chrom", starts.alias("tile_start"), "seq").select("chrom", "tile_start", F.substring("seq", (F.col("tile_start") + 1).cast("int"), F.lit(tile)).alias("seq"))


def chrom_sizes(genome: DataFrame) -> DataFrame:
    return genome.select("chrom", F.length("seq").cast("long").alias("size"))


def read_meme(spark: SparkSession, paths: str | list[str], n_motifs: int | None = None) -> DataFrame:
    """(motif_idx, name, pos, probs): motifs of MEME files in file order, the first n_motifs of them if given."""
    parts = spark.read.text(paths, wholetext=True).select(F.posexplode(F.split("value", r"(?m)^MOTIF\s+")).alias("i", "part")).where("i > 0")
    name = F.split(F.trim(F.get(F.split("part", "\r?\n"), F.lit(0))), r"\s+")
    rows = F.regexp_extract_all("part", F.lit(r"(?m)^\s*((?:[0-9.eE+-]+\s+){3}[0-9.eE+-]+)\s*$"), F.lit(1))
    motifs = parts.select((F.col("i") - 1).alias("motif_idx"), F.array_join(name, " ").alias("name"), F.posexplode(rows).alias("pos", "row"))
    if n_motifs is not None:
        motifs = motifs.where(F.col("motif_idx") < n_motifs)
    return motifs.select("motif_idx", "name", "pos", F.transform(F.split(F.trim("row"), r"\s+"), lambda x: x.cast("double")).alias("probs"))


def read_bedgraph(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(chrom, start, end, value) of signal tracks; track and browser lines are left out."""
    df = spark.read.csv(paths, sep="\t", schema="chrom string, start bigint, end bigint, value double", comment="#")
    return df.where("start is not null and end is not null")


def fasta_record(header: Column, seq: Column, width: int = 80) -> Column:
    """A header line, then lines of a fixed width, then a line's end of its own."""
    return F.concat(F.lit("> "), header, F.lit("\n"), F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n"), F.lit("\n"))


def write_fasta(df: DataFrame, path: str, *, header: str = "header", seq: str = "seq", width: int = 80, mode: str = "append") -> None:
    """Records with an empty line between them."""
    df.select(fasta_record(F.col(header), F.col(seq), width).alias("value")).write.mode(mode).text(path)
