from __future__ import annotations

from nearfield.streaming.ingest import ingest_stream, running_centroids, stored_vectors


def test_ingest_once(spark, tmp_path):
    base = str(tmp_path)
    kind = "vec_id long, embedding array<float>"
    rows = [(i, [float(i), 0.0]) for i in range(40)]
    spark.createDataFrame(rows, kind).repartition(4).write.parquet(f"{base}/in")
    spark.createDataFrame(rows[:5], kind).write.mode("append").parquet(f"{base}/in")
    centroids = spark.createDataFrame([(0, [0.0, 0.0]), (1, [40.0, 0.0])], "bucket_id long, centroid array<double>")
    for _ in range(2):  # the second start finds nothing new
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
        ingest_stream(stream, centroids, 2, f"{base}/out", f"{base}/check").awaitTermination()
    got = stored_vectors(spark, f"{base}/out")
    assert sorted(r["vec_id"] for r in got.collect()) == list(range(40))
    assert got.where("batch > 0").count() > 0 and {r["bucket_id"] for r in got.collect()} <= {0, 1}


def test_running_centroids(spark, tmp_path):
    base = str(tmp_path)
    kind = "bucket_id long, embedding array<float>"
    spark.createDataFrame([(i % 2, [float(i), 1.0]) for i in range(10)], kind).repartition(5).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    q = running_centroids(stream).writeStream.format("memory").queryName("means").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.sql("select bucket_id, max_by(centroid, n) c, max(n) n from means group by bucket_id order by bucket_id").collect()
    assert [(r["bucket_id"], r["c"], r["n"]) for r in last] == [(0, [4.0, 1.0], 5), (1, [5.0, 1.0], 5)]
