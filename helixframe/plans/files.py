"""Queries of the sources: a file is written from a given table and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators.order import scratch
from helixframe.plans import views
from helixframe.plans.catalog import query
from helixframe.sources import genome, readers


@query('SELECT chrom, "start", "end", count(*) AS n FROM loci GROUP BY ALL', views.LOCI)
def s01_bed(spark, sf_dir):
    """Loci by way of a BED file."""
    path = scratch(spark)
    views.loci(spark, sf_dir).select("chrom", "start", "end").write.csv(path, sep="\t")
    return readers.read_bed(spark, path).groupBy("chrom", "start", "end").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(example_idx AS VARCHAR) AS chrom, seq FROM nseqs", views.NSEQS)
def s02_fasta(spark, sf_dir):
    """Sequences by way of FASTA files of lines of 30 letters."""
    path = scratch(spark)
    readers.write_fasta(views.nseqs(spark, sf_dir), path, header="example_idx", width=30)
    return readers.read_fasta(spark, path)


@query('SELECT track, chrom, pos AS "start", pos + 1 AS "end", value FROM signal', views.SIGNAL)
def s04_bedgraph(spark, sf_dir):
    """All signal tracks by way of bedGraph files, a folder for each."""
    path = scratch(spark)
    views.signal(spark, sf_dir).select("track", "chrom", "pos", F.col("pos") + 1, "value").write.partitionBy("track").csv(path, sep="\t")
    return readers.read_bedgraph(spark, path).select("track", "chrom", "start", "end", "value")


PROBS = "greatest(0.001, round(abs(CAST(embedding[CAST(4 * p + {} AS INT)] AS DOUBLE)), 3))"


@query(f"SELECT 'm' || vec_id AS name, CAST(p AS INT) AS pos, {' + '.join(PROBS.format(i) for i in (1, 2, 3, 4))} AS total FROM embeddings, generate_series(0, 15) AS t(p)")
def s05_meme(spark, sf_dir):
    """Motifs of 16 positions by way of MEME files, and the sum of each position's weights."""
    path = scratch(spark)
    cell = lambda p, i: F.format_string("%.3f", F.greatest(F.lit(0.001), F.round(F.abs(F.get("embedding", p * 4 + i).cast("double")), 3)))
    rows = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.concat_ws(" ", *[cell(p, F.lit(i)) for i in range(4)]))
    text = F.concat(F.lit("MOTIF m"), F.col("vec_id").cast("string"), F.lit("\nletter-probability matrix: alength= 4 w= 16\n"), F.array_join(rows, "\n"), F.lit("\n"))
    views.read(spark, sf_dir, "embeddings").select(text).write.text(path)
    motifs = readers.read_meme(spark, path)
    return motifs.select("name", "pos", sum((F.get("probs", F.lit(i)) for i in range(1, 4)), F.get("probs", F.lit(0))).alias("total"))


@query("SELECT 'p' || example_idx AS chrom, CAST(pos + 1 AS INT) AS pos, substring('ACGT', char_idx + 1, 1) AS alt FROM variants", views.VARIANTS)
def s06_vcf(spark, sf_dir):
    """Variants by way of a VCF file with a sample column."""
    path = scratch(spark)
    v = views.variants(spark, sf_dir)
    alt = F.substring(F.lit("ACGT"), F.col("char_idx") + 1, F.lit(1))
    rows = v.select(F.concat(F.lit("p"), "example_idx"), F.col("pos") + 1, F.lit("."), F.lit("N"), alt, F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), F.lit("0/1"))
    rows.write.csv(path, sep="\t")
    return readers.read_vcf(spark, path).select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), F.col("ALT").alias("alt"))


GENOME = "genome AS (SELECT chrom, string_agg(seq, '' ORDER BY tile_start) AS g FROM tiles GROUP BY chrom)"


def indexed(spark, sf_dir):
    """Index of FASTA files of the derived genome, a record a chromosome, lines of a tile."""
    folder = scratch(spark)
    tiles = views.tiles(spark, sf_dir)
    heads = tiles.select("chrom").distinct().select("chrom", F.lit(-1).cast("long").alias("tile_start"), F.concat(F.lit(">"), "chrom").alias("seq"))
    lines = tiles.union(heads).repartition("chrom").sortWithinPartitions("chrom", "tile_start")
    lines.select("seq").write.text(f"{folder}/fasta")
    return genome.write_index(spark, f"{folder}/fasta", f"{folder}/index")


@query("SELECT chrom, CAST(s AS BIGINT) AS tile_start, substring(g, s + 1, 1000) AS seq FROM genome, unnest(range(0, length(g), 1000)) AS t(s)", views.TILES, GENOME)
def s03_fasta_ranges(spark, sf_dir):
    """Tiles of 1000 of a genome's FASTA files, read by byte ranges."""
    return genome.read_genome(spark, indexed(spark, sf_dir), tile=1000)


@query("SELECT chrom, CAST(s AS BIGINT) AS tile_start, substring(g, s + 1, 100) AS seq FROM genome, unnest(range(0, length(g), 100)) AS t(s) WHERE chrom IN ('chr1', 'chr4') AND s >= 300 AND s < 1200", views.TILES, GENOME)
def s03_fasta_regions(spark, sf_dir):
    """Regions of two chromosomes, of which alone the bytes are read."""
    return genome.read_genome(spark, indexed(spark, sf_dir), tile=100).where("chrom IN ('chr1', 'chr4') AND tile_start >= 300 AND tile_start < 1200")
