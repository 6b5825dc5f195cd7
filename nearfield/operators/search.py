"""Exact and two-tier nearest-neighbour search, lookups and recall."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..shipping import ship

#: Queries that one pass over the vectors serves; more are taken in blocks of this size.
QUERY_BLOCK = 2048
#: Bytes of centroids' codes that are broadcast at once; more are taken in several passes.
CODES = 256 << 20
#: Probed buckets that are listed in a filter, so that other partitions aren't read.
LISTED = 1000


def dimension(vectors: DataFrame, column: str = "embedding") -> int:
    """Dimension of any row; 0 without rows."""
    row = vectors.select(F.size(column).alias("n")).where("n > 0").first()
    return row["n"] if row else 0


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dim)
    return column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim), at


def _best(own: np.ndarray, far: np.ndarray, ids: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of those kept so far and of a batch; ties go to the smaller id."""
    if len(row) > k:
        take = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1])
        ids, row = ids[take], row[take]
    own, far = np.concatenate([own, ids]), np.concatenate([far, row])
    order = np.lexsort((own, far))[:k]
    return own[order], far[order]


def _l2_rows(x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact distances of the rows that can be among the k nearest of q."""
    d = (x * x).sum(1) - 2 * (x @ q)
    take = np.arange(len(d))
    if len(d) > k:  # keep rows within rounding of the k-th
        edge = np.partition(d, k - 1)[k - 1]
        take = np.flatnonzero(d <= edge + 1e-9 * (1 + abs(edge)))
    return take, np.sqrt(((x[take] - q) ** 2).sum(axis=1))


def _partial(held, k: int):
    """The k nearest rows of each task per query, so that its output doesn't grow with its input.

    held: query ids, query vectors and, for a probed search, the queries that probe each bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, probing = held.value
        best = [(np.empty(0, np.int64), np.empty(0))] * len(qids)
        for batch in batches:
            x, at = _matrix(batch.column(1), q.shape[1])
            ids = batch.column(0).to_numpy()[at]
            if probing is None:
                groups = [(x, ids, range(len(qids)))]
            else:
                buckets = batch.column(2).to_numpy()[at]
                groups = [(x[buckets == b], ids[buckets == b], probing.get(int(b), ())) for b in np.unique(buckets)]
            for rows, names, asking in groups:
                for i in asking:
                    take, far = _l2_rows(rows, q[i], k)
                    best[i] = _best(*best[i], names[take], far, k)
        for qid, (own, far) in zip(qids.tolist(), best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), qid), pa.int64()), pa.array(own, pa.int64()), pa.array(far, pa.float64())], ["qid", "vec_id", "distance"])

    return run


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of queries (qid, embedding), QUERY_BLOCK at a time."""
    block: list = []
    for row in queries.select(F.col("qid").cast("long"), "embedding").toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            yield np.array([r["qid"] for r in block], np.int64), np.array([r["embedding"] for r in block], np.float64)
            block = []
    if block:
        yield np.array([r["qid"] for r in block], np.int64), np.array([r["embedding"] for r in block], np.float64)


def _union(frames: list[DataFrame], spark, kind: str) -> DataFrame:
    out = spark.createDataFrame([], kind) if not frames else frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("distance", "vec_id")
    return candidates.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def knn_exact(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, rank, vec_id, distance of each query's k nearest vectors; ties go to the smaller vec_id.

    Vectors of another dimension than the queries' are left out. Queries (qid, embedding) are
    broadcast in blocks of QUERY_BLOCK; each pass reads the vectors once and shuffles at most k
    rows per query and task.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = "qid long, vec_id long, distance double"
    rows = vectors.select("vec_id", "embedding")
    found = [rows.mapInArrow(_partial(spark.sparkContext.broadcast((ids, q, None)), k), kind) for ids, q in query_blocks(queries)]
    return _ranked(_union(found, spark, kind), k).select("qid", "rank", "vec_id", "distance")


def coded_centroids(centroids: DataFrame, dim: int) -> DataFrame:
    """Centroids (bucket_id, centroid) with their centred codes, squares and the bounds used."""
    ends = V.bounds(centroids, "centroid")
    rows = centroids.crossJoin(F.broadcast(ends))  # one row
    lo, hi = F.coalesce("lo", F.lit(0.0)), F.coalesce("hi", F.lit(1.0))
    rows = rows.withColumns({"lo": lo, "hi": hi})
    rows = rows.withColumn("code", V.centre(V.quantise(F.col("centroid"), F.col("lo"), F.col("hi"))))
    return rows.withColumn("square", V.code_dot(F.col("code"), F.col("code"), dim))


def _codes(x: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Centred codes of vectors, as V.quantise and V.centre make them."""
    span = hi - lo
    if not 1.1920929e-07 <= span < np.inf:
        return np.full_like(x, -128.0)
    return np.floor(np.clip((np.where(np.isnan(x), lo, x) - lo) * (255.0 / span), 0, 255)) - 128


def _routing(a: np.ndarray, b: np.ndarray, pad: float) -> np.ndarray:
    """Routing distances of each row of codes a to each of b."""
    inverse = lambda c: np.where((s := (c * c).sum(1) + pad) > 0, 1 / np.sqrt(np.maximum(s, 1)), 0.0)
    u, v = inverse(a)[:, None], inverse(b)[None, :]
    return np.where((u == 0) | (v == 0), 1.0, 1 - (a @ b.T + pad) * u * v)


def _nearest_buckets(held, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, codes, lo, hi, pad = held.value
        best = [(np.empty(0, np.int64), np.empty(0))] * len(qids)
        for batch in batches:
            x, at = _matrix(batch.column(1), codes.shape[1])
            ids, own = batch.column(0).to_numpy()[at], _codes(x, lo, hi)
            for start in range(0, len(qids), 64):
                for i, row in enumerate(_routing(codes[start : start + 64], own, pad), start):
                    best[i] = _best(*best[i], ids, row, probes)
        for qid, (own, far) in zip(qids.tolist(), best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), qid), pa.int64()), pa.array(own, pa.int64()), pa.array(far, pa.float64())], ["qid", "bucket_id", "distance"])

    return run


def bounds_of(centroids: DataFrame) -> tuple[float, float]:
    row = V.bounds(centroids, "centroid").first()
    return (0.0, 1.0) if row["lo"] is None else (row["lo"], row["hi"])


def route(queries: DataFrame, centroids: DataFrame, probes: int, dim: int) -> DataFrame:
    """qid, bucket_id, distance, rank of each query's nearest buckets by cosine of centred codes.

    Queries are broadcast in blocks; each task over the centroids keeps `probes` rows per query.
    """
    spark = queries.sparkSession
    ship(spark)
    lo, hi = bounds_of(centroids)
    kind = "qid long, bucket_id long, distance double"
    rows = centroids.select(F.col("bucket_id").cast("long"), "centroid")
    found = []
    for ids, q in query_blocks(queries.where(F.size("embedding") == dim)):
        held = spark.sparkContext.broadcast((ids, _codes(q, lo, hi), lo, hi, float(V.padding(dim))))
        found.append(rows.mapInArrow(_nearest_buckets(held, probes), kind))
    order = Window.partitionBy("qid").orderBy("distance", "bucket_id")
    return _union(found, spark, kind).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= probes)


def _routed(held):
    """The nearest bucket of each row of a batch, found without leaving the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, codes, lo, hi, pad = held.value
        codes = codes.astype(np.float64)
        for batch in batches:
            x, at = _matrix(batch.column(1), codes.shape[1])
            own, far = np.empty(len(x), np.int64), np.empty(len(x))
            for start in range(0, len(x), 1024):
                d = _routing(_codes(x[start : start + 1024], lo, hi), codes, pad)
                own[start : start + 1024] = d.argmin(axis=1)
                far[start : start + 1024] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(buckets[own], pa.int64()), pa.array(far)], ["vec_id", "bucket_id", "distance"])

    return run


def route_all(vectors: DataFrame, centroids: DataFrame, dim: int) -> DataFrame:
    """vec_id, bucket_id: the bucket to which each vector is nearest, as route() with one probe has it.

    For many vectors, which never leave their tasks. Centroids are broadcast as codes of a byte a
    dimension, CODES bytes at a time by ranges of bucket_id; if there are more, each vector keeps the
    nearest of the passes. Vectors of another dimension get no row.
    """
    spark = vectors.sparkSession
    ship(spark)
    lo, hi = bounds_of(centroids)
    most = max(1, CODES // max(1, dim))
    rest, passes = centroids.select(F.col("bucket_id").cast("long"), "centroid").where(F.size("centroid") == dim), []
    while True:
        rows = rest.orderBy("bucket_id").limit(most).toArrow()
        if not rows.num_rows:
            break
        ids = rows["bucket_id"].to_numpy()
        held = spark.sparkContext.broadcast((ids, _codes(_matrix(rows["centroid"], dim)[0], lo, hi).astype(np.int8), lo, hi, float(V.padding(dim))))
        passes.append(vectors.select("vec_id", "embedding").mapInArrow(_routed(held), "vec_id long, bucket_id long, distance double"))
        if len(ids) < most:
            break
        rest = rest.where(F.col("bucket_id") > int(ids[-1]))
    if not passes:
        return spark.createDataFrame([], "vec_id long, bucket_id long")
    if len(passes) == 1:
        return passes[0].select("vec_id", "bucket_id")
    best = _union(passes, spark, "").groupBy("vec_id").agg(F.min(F.struct("distance", "bucket_id")).alias("best"))
    return best.select("vec_id", "best.bucket_id")


def knn_probed(vectors: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, probes: int, dim: int, live: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Two-tier search: the nearest `probes` buckets of each query, scanned exactly.

    `vectors` has bucket_id; stored partitioned by it, only probed buckets are read. `live` is applied
    to the rows of the probed buckets, such as a log's newest-wins rule.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = "qid long, vec_id long, distance double"
    live = live or (lambda rows: rows)
    found = []
    for ids, q in query_blocks(queries):
        block = spark.createDataFrame(pa.table({"qid": ids, "embedding": list(q)}))
        near = route(block, centroids, probes, dim).select("qid", "bucket_id").toArrow()  # QUERY_BLOCK * probes rows
        place = {qid: i for i, qid in enumerate(ids.tolist())}
        probing: dict[int, list[int]] = {}
        for qid, bucket in zip(near["qid"].to_pylist(), near["bucket_id"].to_pylist(), strict=True):
            probing.setdefault(bucket, []).append(place[qid])
        part = vectors.where(F.col("bucket_id").isin(sorted(probing))) if len(probing) <= LISTED else vectors
        part = live(part).select("vec_id", "embedding", F.col("bucket_id").cast("long").alias("bucket_id"))
        found.append(part.mapInArrow(_partial(spark.sparkContext.broadcast((ids, q, probing)), k), kind))
    return _ranked(_union(found, spark, kind), k).select("qid", "rank", "vec_id", "distance")


def with_vectors(results: DataFrame, vectors: DataFrame) -> DataFrame:
    return results.join(vectors.select("vec_id", "embedding"), "vec_id").select("qid", "rank", "vec_id", "distance", "embedding")


def get(vectors: DataFrame, wanted: DataFrame, column: str = "embedding") -> DataFrame:
    """Of wanted (pos, vec_id): pos, vec_id and `column`; missing ids give no row, repeated ones a row each."""
    return wanted.join(vectors.select("vec_id", column), "vec_id").select("pos", "vec_id", column)


def fetch_in_bucket(vectors: DataFrame, bucket_id: int, ids: DataFrame) -> DataFrame:
    return vectors.where(F.col("bucket_id") == bucket_id).join(ids.select("vec_id").distinct(), "vec_id", "left_semi")


def keep_nearest(candidates: DataFrame) -> DataFrame:
    """One row per qid and vec_id: the smallest distance."""
    return candidates.groupBy("qid", "vec_id").agg(F.min("distance").alias("distance"))


def recall(found: DataFrame, truth: DataFrame, reachable: int | None = None) -> DataFrame:
    """hits, reachable and recall of found (qid, vec_id) against truth (qid, vec_id) with vec_id < reachable."""
    truth = truth.select("qid", "vec_id").distinct()
    if reachable is not None:
        truth = truth.where(F.col("vec_id") < reachable)
    hit = found.select("qid", "vec_id").distinct().withColumn("hit", F.lit(1))
    sums = truth.join(hit, ["qid", "vec_id"], "left").agg(F.count("hit").alias("hits"), F.count("*").alias("reachable"))
    return sums.withColumn("recall", F.when(F.col("reachable") > 0, F.col("hits") / F.col("reachable")))
