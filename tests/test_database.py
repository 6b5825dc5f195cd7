from __future__ import annotations

import pytest

from nearfield.plans.database import Options, VectorEngine

VEC = "vec_id long, embedding array<float>"


def ids(df):
    return [r["vec_id"] for r in df.collect()]


def test_lifecycle(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError, match="workers"):
        Options(root, shards=0)
    db = VectorEngine.open(spark, "my db", root)
    with pytest.raises(RuntimeError, match="not initialized"):
        db.query([1.0, 0.0, 0.0], 1)
    assert db.stats() == {"ready": False, "buckets": 0, "vectors": 0, "inserted_total": 0, "pending_updates": 0}
    db.insert(spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0])], VEC))
    assert ids(db.query([1.0, 0.1, 0.1], 1)) == [1]
    for rows, text in (([(1, [0.0, 0.0, 0.0])], "already exists"), ([(7, [1.0, 1.0, 1.0]), (7, [1.0, 1.0, 2.0])], "already exists"), ([(8, [1.0])], "dimension"), ([(-1, [1.0, 1.0, 1.0])], "ids")):
        with pytest.raises(ValueError, match=text):
            db.insert(spark.createDataFrame(rows, VEC))
    assert db.stats()["vectors"] == 3
    assert ids(db.get([3, 999, 1, 3])) == [3, 1, 3]
    assert db.query_with_vectors([0.0, 1.0, 0.0], 1).first()["embedding"] == [0.0, 1.0, 0.0]
    db.delete([2, 12345])
    assert ids(db.get([2])) == [] and ids(db.query([0.0, 1.0, 0.0], 3)) == [1, 3]
    db.insert(2, [0.0, 0.5, 0.0])
    again = VectorEngine.open(spark, "my db", root)
    assert again.stats() == {"ready": True, "buckets": 1, "vectors": 3, "inserted_total": 4, "pending_updates": 1}
    assert ids(again.query([0.0, 1.0, 0.0], 1)) == [2]
    again.insert(4, [1.0, 1.0, 0.0])
    with pytest.raises(RuntimeError, match="another writer"):
        db.insert(5, [1.0, 1.0, 0.0])


def test_rebuild_policy(spark, tmp_path):
    db = VectorEngine.open(spark, "y", str(tmp_path), rebuild_every=3)
    db.insert(1, [0.0, 0.0])
    db.insert(2, [10.0, 10.0])
    assert db.stats()["pending_updates"] == 1
    moved = db.centroids().first()  # a running mean until the rebuild
    assert moved["n"] == 2 and moved["centroid"] == [5.0, 5.0]
    assert ids(db.query([9.0, 9.0], 1)) == [2]
    db.insert(spark.createDataFrame([(3, [1.0, 1.0]), (4, [2.0, 2.0])], VEC))
    assert db.stats()["pending_updates"] == 0 and db.centroids().first()["n"] == 4
    db.insert(spark.createDataFrame([(5, [3.0, 3.0], 7)], VEC + ", home long"), bucket_col="home")
    assert db.stats()["buckets"] == 2 and db.resolve_buckets([5]).first()["bucket_id"] == 7


def test_rebalance_and_vacuum(spark, tmp_path):
    db = VectorEngine.open(spark, "x", str(tmp_path))
    rows = [(i, [0.01 * i, 0.0]) for i in range(4)] + [(100 + i, [100.0 + i, 100.0]) for i in range(4)]
    db.insert(spark.createDataFrame(rows, VEC))
    assert db.rebalance(threshold=4) == 1
    stats = db.stats()
    assert stats["vectors"] == 8 and stats["buckets"] == 2
    assert {r["bucket_id"]: r["status"] for r in db.bucket_status().collect()} == {0: "Retired", 1: "Active", 2: "Active"}
    assert ids(db.query_with_probes([0.0, 0.0], 1, 1))[0] < 50
    near = db.resolve_buckets([0, 100, 7]).collect()
    assert len(near) == 2 and near[0]["bucket_id"] != near[1]["bucket_id"]
    assert ids(db.fetch_vectors(near[0]["bucket_id"], [0, 100])) == [0]
    db.delete(0)
    db.vacuum()
    assert db.stats()["vectors"] == 7 and db.shards().count() == 2
    assert VectorEngine.open(spark, "x", str(tmp_path)).log().count() == 7


def test_a_commit_that_breaks_off_loses_nothing(spark, tmp_path):
    db = VectorEngine.open(spark, "torn", str(tmp_path))
    db.insert(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], VEC))
    version = db._state["version"]
    (tmp_path / "torn" / f"MANIFEST-{version + 1}").write_text('{"version": ')  # a writer that ended half way
    again = VectorEngine.open(spark, "torn", str(tmp_path))
    assert again._state["version"] == version and again.stats()["vectors"] == 2
    again.insert(3, [1.0, 1.0])
    assert VectorEngine.open(spark, "torn", str(tmp_path)).stats()["vectors"] == 3
    with pytest.raises(RuntimeError, match="another writer"):
        db.delete([1])
    again.vacuum()
    assert ids(VectorEngine.open(spark, "torn", str(tmp_path)).query_many(spark.createDataFrame([(0, [1.0, 0.1])], "qid long, embedding array<float>"), 2, 1)) == [1, 3]


def test_deletes_and_commits(spark, tmp_path, monkeypatch):
    db = VectorEngine.open(spark, "d", str(tmp_path))
    rows = [(i, [float(i), 0.0], i % 3) for i in range(12)]
    db.insert(spark.createDataFrame(rows, VEC + ", home long"), bucket_col="home")
    before = {r["bucket_id"]: (r["centroid"], r["n"]) for r in db.centroids().collect()}
    db.delete([0, 3, 1, 4, 7, 10])
    after = {r["bucket_id"]: (r["centroid"], r["n"]) for r in db.centroids().collect()}
    assert after == {0: ([7.5, 0.0], 2), 2: before[2]}  # bucket 1 is empty and gone
    db.insert(spark.createDataFrame([(0, [1.0, 1.0], 2)], VEC + ", home long"), bucket_col="home")  # into another bucket
    assert db.resolve_buckets([0, 3]).collect() == [(0, 2)] and ids(db.fetch_vectors(0, [0, 6])) == [6]
    commits = []
    real = VectorEngine._commit
    monkeypatch.setattr(VectorEngine, "_commit", lambda self, **c: commits.append(c) or real(self, **c))
    db.insert(50, [2.0, 2.0])
    db.delete(50)
    db.rebalance(threshold=4)
    assert commits and all("log" in c and "centroids" in c for c in commits)  # no version has rows without their centroids
