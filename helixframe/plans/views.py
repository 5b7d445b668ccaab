"""Sequence tables derived from the given tables, by expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.order import spread

HEX, LETTERS, WITH_N = "0123456789abcdef", "ACGTACGTACGTACGT", "NCGTACGTACGTACGT"
TILE = 64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example_idx, lang, seq: the letters A, C, G and T of each document."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    return docs.select(F.col("doc_id").alias("example_idx"), "lang", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


def kseqs(spark: SparkSession, sf_dir: str, letters: str = LETTERS) -> DataFrame:
    """example_idx, seq: 64 letters from hashes of each part's key; with N for one hex digit if letters say so."""
    key = F.col("p_partkey").cast("string")
    digest = F.concat(F.md5(F.concat(F.lit("a:"), key)), F.md5(F.concat(F.lit("b:"), key)))
    parts = spread(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    return parts.select(F.col("p_partkey").alias("example_idx"), F.translate(digest, HEX, letters).alias("seq"))


def backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """background_idx, seq: 64 letters from hashes of each region's key."""
    key = F.col("r_regionkey").cast("string")
    digest = F.concat(F.md5(F.concat(F.lit("c:"), key)), F.md5(F.concat(F.lit("d:"), key)))
    return read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("background_idx"), F.translate(digest, HEX, LETTERS).alias("seq"))


def nseqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kseqs(spark, sf_dir, WITH_N)


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, tile_start, seq: a genome of seven chromosomes, laid out of the parts' sequences."""
    k = F.col("example_idx")
    return nseqs(spark, sf_dir).select(F.concat(F.lit("chr"), (k % 7).cast("string")).alias("chrom"), (F.floor(k / 7) * TILE).cast("long").alias("tile_start"), "seq")


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir).groupBy("chrom").agg((F.max("tile_start") + TILE).alias("size"))


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """locus_idx, chrom, start, end: an interval for each line item, inside the genome or just beyond."""
    line = read(spark, sf_dir, "lineitem")
    start = F.floor(F.col("l_partkey") / 7) * TILE + F.col("l_suppkey") % TILE
    return line.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("locus_idx"), F.concat(F.lit("chr"), (F.col("l_partkey") % 7).cast("string")).alias("chrom"),
        start.cast("long").alias("start"), (start + F.col("l_quantity").cast("long") * 2 + 1).cast("long").alias("end"),
    ).groupBy("locus_idx").agg(F.min(F.struct("chrom", "start", "end")).alias("x")).select("locus_idx", "x.*")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, start, end: zones to keep out of, one for each supplier, all over the genome."""
    o = read(spark, sf_dir, "supplier")
    start = F.floor(F.col("s_suppkey") / 7) * (20 * TILE)
    return o.select(F.concat(F.lit("chr"), (F.col("s_suppkey") % 7).cast("string")).alias("chrom"), start.cast("long").alias("start"), (start + 150).cast("long").alias("end"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, chrom, pos, value: a signal for each event, in whole hundredths."""
    e = read(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(F.col("event_type").alias("track"), F.concat(F.lit("chr"), (k % 7).cast("string")).alias("chrom"), F.floor(k / 7).cast("long").alias("pos"), F.round(F.col("value") * 100).alias("value"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, chrom, start, end, value: a stretch of up to forty positions for each event, in whole hundredths; stretches overlap."""
    e = read(spark, sf_dir, "events")
    k = F.col("event_id")
    start = (F.floor(k / 7) * 3).cast("long")
    return e.select(F.col("event_type").alias("track"), F.concat(F.lit("chr"), (k % 7).cast("string")).alias("chrom"), start.alias("start"), (start + k % 40 + 1).alias("end"), F.round(F.col("value") * 100).alias("value"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example_idx, annotation_idx, start, end: spans of orders, one of seven kinds for each line item."""
    line = read(spark, sf_dir, "lineitem")
    start = (F.col("l_partkey") * 7 + F.col("l_linenumber") * 31) % 44
    return line.select(F.col("l_orderkey").alias("example_idx"), (F.col("l_suppkey") % 7).alias("annotation_idx"), start.alias("start"), (start + F.col("l_quantity").cast("long") % 20 + 1).alias("end"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example_idx, values: attribution tracks of 64 values, in whole thousandths."""
    e = spread(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    return e.select(F.col("vec_id").cast("long").alias("example_idx"), F.transform("embedding", lambda x: F.round(x.cast("double") * 1000) + F.lit(0.0)).alias("values"))


def attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example_idx, pos, value."""
    return tracks(spark, sf_dir).select("example_idx", F.posexplode("values").alias("pos", "value"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example_idx, pos, char_idx: edits of the parts' sequences from all line items, once a position."""
    line = read(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_partkey").alias("example_idx"), ((F.col("l_orderkey") * 13 + F.col("l_linenumber")) % 64).alias("pos"), (F.col("l_suppkey") % 4).cast("int").alias("char_idx"))
    return rows.groupBy("example_idx", "pos").agg(F.max("char_idx").alias("char_idx"))


def inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example_idx, pos, char_idx: a letter to put in for each line item, several at a position."""
    line = read(spark, sf_dir, "lineitem")
    return line.select(F.col("l_partkey").alias("example_idx"), ((F.col("l_orderkey") * 13 + F.col("l_linenumber")) % 16).alias("pos"), (F.col("l_suppkey") % 4).cast("int").alias("char_idx"))


DOC_SEQS = "doc_seqs AS (SELECT doc_id AS example_idx, lang, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"
KSEQS = f"kseqs AS (SELECT p_partkey AS example_idx, translate(md5('a:' || p_partkey) || md5('b:' || p_partkey), '{HEX}', '{LETTERS}') AS seq FROM part)"
BACKGROUNDS = f"backs AS (SELECT r_regionkey AS background_idx, translate(md5('c:' || r_regionkey) || md5('d:' || r_regionkey), '{HEX}', '{LETTERS}') AS seq FROM region)"
NSEQS = f"nseqs AS (SELECT p_partkey AS example_idx, translate(md5('a:' || p_partkey) || md5('b:' || p_partkey), '{HEX}', '{WITH_N}') AS seq FROM part)"
TILES = f"{NSEQS}, tiles AS (SELECT 'chr' || (example_idx % 7) AS chrom, CAST(example_idx // 7 * {TILE} AS BIGINT) AS tile_start, seq FROM nseqs), sizes AS (SELECT chrom, max(tile_start) + {TILE} AS size FROM tiles GROUP BY chrom)"
LOCI = f"""loci AS (SELECT locus_idx, x.chrom AS chrom, x."start" AS "start", x."end" AS "end" FROM (SELECT locus_idx, min({{'chrom': chrom, 'start': "start", 'end': "end"}}) AS x FROM (
  SELECT l_orderkey * 8 + l_linenumber AS locus_idx, 'chr' || (l_partkey % 7) AS chrom, CAST(l_partkey // 7 * {TILE} + l_suppkey % {TILE} AS BIGINT) AS "start",
  CAST(l_partkey // 7 * {TILE} + l_suppkey % {TILE} + CAST(l_quantity AS BIGINT) * 2 + 1 AS BIGINT) AS "end" FROM lineitem) GROUP BY locus_idx))"""
ZONES = f"""zones AS (SELECT 'chr' || (s_suppkey % 7) AS chrom, CAST(s_suppkey // 7 * {20 * TILE} AS BIGINT) AS "start", CAST(s_suppkey // 7 * {20 * TILE} + 150 AS BIGINT) AS "end" FROM supplier)"""
SIGNAL = "signal AS (SELECT event_type AS track, 'chr' || (event_id % 7) AS chrom, CAST(event_id // 7 AS BIGINT) AS pos, round(value * 100) AS value FROM events)"
INTERVALS = """intervals AS (SELECT event_type AS track, 'chr' || (event_id % 7) AS chrom, CAST(event_id // 7 * 3 AS BIGINT) AS "start", CAST(event_id // 7 * 3 + event_id % 40 + 1 AS BIGINT) AS "end", round(value * 100) AS value FROM events)"""
ANNOTATIONS = """annotations AS (SELECT l_orderkey AS example_idx, l_suppkey % 7 AS annotation_idx, (l_partkey * 7 + l_linenumber * 31) % 44 AS "start",
  (l_partkey * 7 + l_linenumber * 31) % 44 + CAST(l_quantity AS BIGINT) % 20 + 1 AS "end" FROM lineitem)"""
ATTR = "attr AS (SELECT CAST(vec_id AS BIGINT) AS example_idx, CAST(p - 1 AS INT) AS pos, round(CAST(embedding[p] AS DOUBLE) * 1000) + 0.0 AS value FROM embeddings, generate_series(1, 64) AS t(p))"
INSERTS = "inserts AS (SELECT l_partkey AS example_idx, (l_orderkey * 13 + l_linenumber) % 16 AS pos, CAST(l_suppkey % 4 AS INT) AS char_idx FROM lineitem)"
VARIANTS = "variants AS (SELECT l_partkey AS example_idx, (l_orderkey * 13 + l_linenumber) % 64 AS pos, CAST(max(l_suppkey % 4) AS INT) AS char_idx FROM lineitem GROUP BY 1, 2)"
