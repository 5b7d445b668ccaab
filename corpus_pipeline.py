"""The corpus pipeline: quality classifier, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs.  The
first four return the columns they got; the last adds where a row is stored.
Rows without an id are their own documents: no stage drops them for that.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.llm import decontam, mixing, sharding, simhash, weak
from helixframe.llm.cluster import new_table, small_batches


def quality(spark, docs, sf_dir):
    """Drops documents that the quality classifier calls bad."""
    small_batches(spark)
    scored = weak.classify(docs, weak.train_classifier(docs))
    return scored.where(F.col("weak_score") >= weak.KEEP_FROM).select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """Of each group of near-duplicates (sets of five-word shingles, Jaccard 0.8 or more) only one document stays, that of least id.

    Rows are told apart by all their columns, so a text stays whatever id it
    shares with another, and of rows equal in every column one stays.
    """
    small_batches(spark)
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark, docs, sf_dir):
    """Drops documents that hold a window of ten words of some benchmark item."""
    small_batches(spark)
    found = decontam.find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("hit_words = 0").select(*docs.columns)


def mix(spark, docs, sf_dir):
    """Documents repeated by Poisson draws whose mean evens out the sources, in shuffled order."""
    return mixing.poisson_mix(docs).select(*docs.columns)


def shard(spark, docs, sf_dir):
    """Documents with the shard (of 24, by bytes) and slot they are stored in; slots keep copies apart that the mix has made."""
    return sharding.histogram_shards(docs, 24, shuffled=True)


STAGES = [("quality classifier", quality), ("near-duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]
#: Trained models, fingerprints and hash keys have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in turn, over the whole documents table; what a stage kept is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        if i:
            path = new_table(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        docs = stage(spark, docs, sf_dir)
    return docs
