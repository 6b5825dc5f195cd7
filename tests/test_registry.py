"""Registered queries against DuckDB, value by value."""

from __future__ import annotations

import os

import duckdb
import pytest

from nearfield.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
SOME = ("knn_exact_top10", "knn_probes_2", "route_top3", "recall_at_10", "quantize_u8", "bucket_centroids", "insert_accept", "bulk_ingest_batches", "log_newest_wins", "shard_assignment", "snapshot_replay")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test data isn't there")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want, got = c.sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, DATA).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda f: sorted(map(str, f[cols].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
