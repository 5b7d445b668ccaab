"""The pipeline's stages on small tables with planted rows."""

from __future__ import annotations

import random

import corpus_pipeline
from helixframe.llm import registry


def words(r, n):
    return " ".join(r.choice("plain prose words make a text that nobody minds reading twice".split()) + str(r.randrange(99)) for _ in range(n))


def test_stages(spark, tmp_path):
    r = random.Random(1)
    bench = [(i, words(r, 25)) for i in range(4)]
    rows = [(i, words(r, r.randrange(60, 200)), "en", f"s{i % 4}", 0) for i in range(300)]
    clean = {x[0] for x in rows}
    rows += [(1000 + i, " ".join(x.upper() + "!!" for x in words(r, 80).split()), "en", "s1", 0) for i in range(60)]
    rows += [(2000 + i, rows[i][1], "en", "s2", 0) for i in range(20)]
    rows += [(3000 + i, rows[i][1].rsplit(" ", 1)[0] + " changed", "en", "s2", 0) for i in range(20, 40)]
    rows += [(4000 + i, f"{words(r, 40)} {bench[i % 4][1]} {words(r, 30)}", "en", "s0", 0) for i in range(20)]
    rows += [(None, "a row without an id that is plain prose", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    left = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        assert set(columns) <= set(docs.columns) and (i == 4 or docs.columns == columns), name
        docs.write.parquet(f"{tmp_path}/stage{i}")
        docs = spark.read.parquet(f"{tmp_path}/stage{i}")
        left.append([x["doc_id"] for x in docs.select("doc_id").collect()])
    assert clean <= set(left[0]) and not any(x and 1000 <= x < 2000 for x in left[0])
    assert clean <= set(left[1]) and not any(x and 2000 <= x < 4000 for x in left[1]) and None in left[1]
    assert clean <= set(left[2]) and not any(x and x >= 4000 for x in left[2])
    assert 0.7 * len(left[2]) < len(left[3]) < 1.3 * len(left[2])
    assert sorted(map(str, left[4])) == sorted(map(str, left[3]))
    whole = [x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()]
    assert sorted(map(str, whole)) == sorted(map(str, left[4]))


def test_registered():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(registry.SQL) <= set(registry.QUERIES)
