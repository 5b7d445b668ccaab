"""Every registered sequence query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from helixframe.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region customer supplier part orders lineitem events documents embeddings".split()


def plain(frame):
    columns = sorted(frame.columns)
    frame = frame[columns].astype(str)
    return columns, frame.sort_values(columns).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    assert len(got)
    if name not in catalog.SQL:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    columns, want = plain(con.execute(catalog.SQL[name]).df())
    own, got = plain(got)
    assert own == columns
    assert len(got) == len(want)
    assert not (got != want).any().any()
