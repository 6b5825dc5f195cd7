from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from nearfield.operators import clustering, search

VEC = "vec_id long, embedding array<float>"
CENT = "bucket_id long, centroid array<double>"


def test_routing_of_a_line_of_centroids(spark, monkeypatch):
    centroids = spark.createDataFrame([(i, [float(i), i / 2]) for i in range(50)], CENT)
    q = spark.createDataFrame([(0, [5.2, 2.6])], "qid long, embedding array<double>")
    monkeypatch.setattr(search, "bounds_of", lambda _: (0.0, 10.0))
    got = search.route(q, centroids, 4, 2).orderBy("rank").collect()
    assert [r["bucket_id"] for r in got] == [5, 6, 4, 7]


def test_merge_of_near_and_far_buckets(spark):
    rows = [(0, 1, [100.0, 100.0]), (0, 2, [101.0, 101.0]), (1, 10, [1.0, 1.0]), (1, 11, [2.0, 2.0]), (1, 12, [0.5, 0.5])]
    vectors = spark.createDataFrame(rows, "bucket_id long, " + VEC)
    q = spark.createDataFrame([(7, [1.0, 1.0])], "qid long, embedding array<double>")
    assert [r["vec_id"] for r in search.knn_exact(vectors, q, 3).orderBy("rank").collect()] == [10, 12, 11]
    got = search.knn_probed(vectors, q, clustering.centroids(vectors), 3, 9, 2)
    assert [r["vec_id"] for r in got.orderBy("rank").collect()] == [10, 12, 11]


def test_exact_against_numpy_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    vectors = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, [1.0]), (901, None)], VEC).repartition(5)
    q = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(20)], "qid long, embedding array<double>")
    got = search.knn_exact(vectors, q, 6).collect()
    for i in range(20):
        d = np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(1))
        want = np.lexsort((np.arange(400), d))[:6].tolist()
        assert [r["vec_id"] for r in sorted(got) if r["qid"] == i] == want
    assert search.knn_exact(vectors, q.where("false"), 3).count() == 0


def test_splits_and_clusters(spark):
    same = spark.createDataFrame([(0, i, [1.0, 1.0]) for i in range(4)], "bucket_id long, " + VEC)
    sizes = [r["count"] for r in clustering.split_buckets(same, [0], 5).groupBy("bucket_id").count().collect()]
    assert sorted(sizes) == [2, 2]
    assert clustering.build_clusters(same.where("false"), 3).count() == 0
    assert clustering.build_clusters(same, 0).count() == 0
    ragged = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], VEC)
    assert clustering.build_clusters(ragged, 1).count() == 0
    two = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.2, 0.1]), (101, [10.0, 10.0]), (102, [9.8, 10.1])], VEC)
    got = {r["vec_id"]: r["bucket_id"] for r in clustering.build_clusters(two, 2, seed=1).collect()}
    assert got[1] == got[2] != got[101] == got[102]
    means = clustering.centroids(spark.createDataFrame([(0, 1, [1.0, 3.0]), (0, 2, [3.0, 5.0])], "bucket_id long, " + VEC)).first()
    assert means["centroid"] == [2.0, 4.0] and means["n"] == 2


def test_large_buckets_are_split_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(clustering, "WHOLE", 5)
    far = [(7, i, [float(i % 2) * 100 + 0.01 * i, 0.0]) for i in range(40)]
    equal = [(8, 2 * i, [1.0, 1.0]) for i in range(40)]
    rest = [(9, i, [5.0, 5.0]) for i in range(200, 204)] + [(3, 300, [0.0, 0.0])] + [(7, 99, [1.0]), (7, 98, None)]
    rows = spark.createDataFrame(far + equal + rest, "bucket_id long, " + VEC).repartition(4)
    got = {r["vec_id"]: r["bucket_id"] for r in clustering.split_buckets(rows.where("bucket_id <> 8"), [7, 9], 20).collect()}
    assert len(got) == 47 and got[300] == 3 and {got[i] for i in range(200, 204)} == {22, 23}
    assert len({got[i] for i in range(0, 40, 2)}) == 1 and len({got[i] for i in range(1, 40, 2)}) == 1 and got[0] != got[1]
    assert {got[98], got[99]} == {20}
    sizes = [r["count"] for r in clustering.split_buckets(rows, [8], 20).where("bucket_id >= 20").groupBy("bucket_id").count().collect()]
    assert len(sizes) == 2 and sum(sizes) == 40


def test_placement(spark):
    buckets = spark.range(200).select(F.col("id").alias("bucket_id"))
    four = {r["bucket_id"]: r["shard"] for r in clustering.place_buckets(buckets, 4).collect()}
    five = {r["bucket_id"]: r["shard"] for r in clustering.place_buckets(buckets, 5).collect()}
    assert set(four.values()) == {0, 1, 2, 3}
    assert all(four[b] == five[b] or five[b] == 4 for b in four)
    assert {r["shard"] for r in clustering.place_buckets(buckets, 0).collect()} == {0}


def test_route_all_in_several_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(60, 4)))], "vec_id long, embedding array<double>")
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(11, 4)))], "bucket_id long, centroid array<double>")
    want = sorted(map(tuple, search.route_all(v, c, 4).collect()))
    monkeypatch.setattr(search, "CODES", 12)  # three centroids at a time
    assert sorted(map(tuple, search.route_all(v, c, 4).collect())) == want and len(want) == 60
