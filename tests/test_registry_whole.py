"""Queries over whole tables against DuckDB, value by value."""

from __future__ import annotations

import os

import duckdb
import pytest

from nearfield.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"
#: Searches, and rows that each query by itself has to bring.
SEARCHES = {"knn_exact_top10": 10, "knn_with_vectors": 3 * 64, "route_top3": 3, "dedupe_keep_nearest": 15}
#: Queries with a result for each row, and the column of its id.
COVERING = {"center_i8": "vec_id", "l2_pairwise": "a", "l2sq_pairwise": "a"}
WHOLE = (
    "knn_exact_top10 knn_with_vectors knn_probes_1 knn_probes_2 knn_probes_5 knn_probes_10 route_top3 routing_distance recall_at_10 recall_reachable dedupe_keep_nearest"
    " l2_pairwise l2sq_pairwise center_i8 running_mean_insert insert_accept insert_reject batch_duplicates bulk_ingest_batches bucket_meta_latest active_buckets snapshot_replay install_snapshot build_clusters rebalance_split"
).split()


def connected():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test data isn't there")
@pytest.mark.parametrize("name", WHOLE)
def test_against_sql(spark, name):
    c = connected()
    want, got = c.sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, DATA).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda f: sorted(map(str, f[cols].itertuples(index=False, name=None)))
    assert rows(got) == rows(want) and len(got)
    ids = {r[0] for r in c.sql("SELECT vec_id FROM embeddings").fetchall()}
    if name in SEARCHES:
        n = got.groupby("qid").size()
        assert set(n.index) == {i for i in ids if i % 100 == 0} and (n == SEARCHES[name]).all()
    if name in COVERING:
        assert set(got[COVERING[name]]) == ids
