"""Streams of vectors: routed ingest with exactly-once commits, and running centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import search
from ..shipping import ship


def ingest_stream(stream: DataFrame, centroids: DataFrame, dim: int, target: str, checkpoint: str) -> StreamingQuery:
    """Route each micro-batch of (vec_id, embedding) to its nearest bucket and append it.

    A batch is written to a folder of its own number, replaced if the batch is run again, so
    that each vector is stored once whatever fails in between. Ids that an earlier batch has
    stored are left out; of an id that repeats within one the smallest vector stays.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))  # the same however often it is computed
        stored = stored_vectors(spark, target, batch_id)
        if stored is not None:
            known = stored.select("vec_id").join(first.select("vec_id"), "vec_id", "left_semi")  # a small batch goes to what is stored
            first = first.join(known, "vec_id", "left_anti")
        own = search.route_all(first, centroids, dim)
        first.join(own, "vec_id").select("vec_id", "embedding", "bucket_id").write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_vectors(spark, target: str, before: int | None = None) -> DataFrame | None:
    """What batches, those before a number if one is given, have stored; None if nothing is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not len(fs.listStatus(path)):
        return None
    rows = spark.read.schema("vec_id long, embedding array<float>, bucket_id long, batch long").parquet(target)
    return rows if before is None else rows.where(F.col("batch") < before)


def running_centroids(stream: DataFrame) -> DataFrame:
    """bucket_id, centroid, n after each micro-batch of (bucket_id, embedding).

    State is the sum and number of a bucket's vectors, so that the mean doesn't hang on the order.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sums, n = state.get if state.exists else ([], 0)
        total = np.array(sums, np.float64)
        for frame in frames:
            x = np.array(frame["embedding"].tolist(), np.float64)
            total = x.sum(axis=0) + (total if len(total) else 0)
            n += len(x)
        state.update((total.tolist(), n))
        yield pd.DataFrame({"bucket_id": [key[0]], "centroid": [(total / n).tolist()], "n": [n]})

    ship(stream.sparkSession)
    return stream.groupBy("bucket_id").applyInPandasWithState(
        update, "bucket_id long, centroid array<double>, n long", "sums array<double>, n long", "update", GroupStateTimeout.NoTimeout
    )
