"""All registered corpus queries over empty tables; recall of the near-duplicate stage on isolated pairs."""

from __future__ import annotations

import random

import corpus_pipeline
from helixframe.llm import registry, simhash

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def test_empty_tables(spark, tmp_path):
    for table, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    for name, query in (registry.QUERIES | {"pipeline": corpus_pipeline.run}).items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_isolated_pairs_are_found(spark):
    """Pairs of similarity 86/106 that share nothing with other texts: all of them are found (by calculation 0.04 % of pairs at 0.8 are not)."""
    r = random.Random(12)
    rows = []
    for i in range(600):
        one = [f"{r.choice('abcdefgh')}{i}x{j}" for j in range(100)]
        two = list(one)
        for j in (r.randrange(10, 40), r.randrange(50, 90)):
            two[j] = f"other{i}y{j}"
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two))]
    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(96)}
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert len(a & b) == 86 and len(a | b) == 106
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted(x["doc_id"] for x in simhash.drop_near_duplicates(docs).collect())
    assert kept == list(range(0, 1200, 2))
