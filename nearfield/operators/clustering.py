"""Centroids, k-means, splits of large buckets and their placement on shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import naming
from ..functions import vectors as V
from ..shipping import ship
from .search import _matrix, dimension

#: Rows of a bucket that one task splits; larger buckets are split without being gathered.
WHOLE = 50_000
#: Larger buckets whose two centres are broadcast at once.
APART = 1000


def centroids_long(vectors: DataFrame) -> DataFrame:
    """bucket_id, pos, mean: partial sums meet before the shuffle, one row per bucket and dimension."""
    parts = vectors.select("bucket_id", F.posexplode("embedding").alias("pos", "x"))
    return parts.groupBy("bucket_id", F.col("pos").cast("long").alias("pos")).agg(F.avg(F.col("x").cast("double")).alias("mean"))


def centroids(vectors: DataFrame, digits: int = 9) -> DataFrame:
    """bucket_id, centroid, n; rounded so that the order of sums can't tip a truncated code."""
    means = centroids_long(vectors).groupBy("bucket_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.round("mean", digits).alias("m")))).alias("ms"))
    counts = vectors.groupBy("bucket_id").agg(F.count("*").alias("n"))
    return means.select("bucket_id", F.transform("ms", lambda z: z["m"]).alias("centroid")).join(counts, "bucket_id")


def moved(cents: DataFrame, added: DataFrame, digits: int = 9) -> DataFrame:
    """bucket_id, centroid, n after rows `added` (bucket_id, embedding): running means, without a look at older rows.

    Buckets without a centroid so far start from the rows added.
    """
    new = centroids(added, digits).withColumnsRenamed({"centroid": "own", "n": "m"})
    both = F.zip_with("centroid", "own", lambda c, x: F.round((c * F.col("n") + x * F.col("m")) / (F.col("n") + F.col("m")), digits))
    rows = cents.select("bucket_id", "centroid", "n").join(new, "bucket_id", "full")
    return rows.select("bucket_id", F.when(F.col("own").isNull(), F.col("centroid")).when(F.col("centroid").isNull(), F.col("own")).otherwise(both).alias("centroid"), (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))


def assign(vectors: DataFrame, seeds: DataFrame, dim: int) -> DataFrame:
    """vec_id, bucket_id: the nearest of k seeds (bucket_id, centroid), ties to the smaller bucket_id.

    Seeds are broadcast, k being a parameter; rows stay in their tasks.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = seeds.select("bucket_id", "centroid").orderBy("bucket_id").toArrow()
    held = spark.sparkContext.broadcast((rows["bucket_id"].to_numpy(), _matrix(rows["centroid"], dim)[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = held.value
        for batch in batches:
            x, at = _matrix(batch.column(1), dim)
            own = np.empty(len(x), np.int64)
            for i in range(0, len(x), 256):
                own[i : i + 256] = ((x[i : i + 256, None] - c[None]) ** 2).sum(2).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(ids[own], pa.int64())], ["vec_id", "bucket_id"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, bucket_id long")


def _labelled(held):
    """The nearest centroid's number for every row of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches:
            x, at = _matrix(batch.column(1), c.shape[1])
            own = ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(axis=1) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], ["bucket_id", "vec_id", "embedding"])

    return run


def _summed(held):
    """Per task and centroid the sum and, last, the number of its rows: k rows leave a task, whatever it read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        sums, n = np.zeros_like(c), np.zeros(len(c), np.int64)
        for batch in batches:
            x, _ = _matrix(batch.column(1), c.shape[1])
            if len(x):
                own = ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(axis=1)
                np.add.at(sums, own, x)
                n += np.bincount(own, minlength=len(c))
        some = np.flatnonzero(n)
        both = np.concatenate([sums[some], n[some, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(both.tolist(), pa.list_(pa.float64()))], ["bucket_id", "sums"])

    return run


def build_clusters(vectors: DataFrame, k: int, seed: int = 0, steps: int = 20, spread: float = 1.2) -> DataFrame:
    """vec_id, embedding, bucket_id by k-means; no rows if there is nothing to cluster.

    Starts from k rows in seeded order, reseeds empty clusters, ends when no mean moves, drops
    empty clusters, splits in two what holds over `spread` times the average and numbers
    buckets from 0. Vectors must agree in length: if one doesn't, there are no rows. Sums of tasks meet in a
    shuffle, so that only k x dim numbers reach the driver in each step.
    """
    kind = "bucket_id long, vec_id long, embedding array<float>"
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>").alias("embedding"))
    dim = dimension(rows)
    if k <= 0 or not dim or rows.where(F.size("embedding") != dim).take(1):
        return spark.createDataFrame([], kind)
    picks = [r["embedding"] for r in rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(2 * k).collect()]
    c, spare = np.array(picks[:k], np.float64), picks[k:]
    for _ in range(steps):
        held = spark.sparkContext.broadcast(c)
        parts = rows.select("vec_id", "embedding").mapInArrow(_summed(held), "bucket_id long, sums array<double>")
        parts = parts.select("bucket_id", F.posexplode("sums").alias("pos", "x"))
        got = parts.groupBy("bucket_id", "pos").agg(F.sum("x").alias("x")).toArrow()  # k x (dim + 1) numbers
        both = np.zeros((len(c), dim + 1))
        both[got["bucket_id"].to_numpy(), got["pos"].to_numpy()] = got["x"].to_numpy()
        sums, n = both[:, :dim], both[:, dim].astype(np.int64)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        reseeded = False
        for i in np.flatnonzero(n == 0):
            if spare:
                new[i], reseeded = spare.pop(), True
        if not reseeded and np.allclose(new, c, atol=1e-12):
            break
        c = new
    labelled = rows.select("vec_id", "embedding").mapInArrow(_labelled(spark.sparkContext.broadcast(c)), kind)
    counts = {r["bucket_id"]: r["n"] for r in labelled.groupBy("bucket_id").agg(F.count("*").alias("n")).collect()}
    limit = spread * sum(counts.values()) / len(counts)
    large = [b for b, n in counts.items() if n > limit and n > 2]
    return renumber(split_buckets(labelled, large, len(c)), kind)


def renumber(rows: DataFrame, kind: str) -> DataFrame:
    ids = sorted(r["bucket_id"] for r in rows.select("bucket_id").distinct().collect())
    names = rows.sparkSession.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), "bucket_id long, new long")
    return rows.join(F.broadcast(names), "bucket_id").select(F.col("new").alias("bucket_id"), "vec_id", "embedding")


def _halves(x: np.ndarray, steps: int = 8) -> np.ndarray:
    """Two-means from a far pair; by position if one side stays empty."""
    first = ((x - x[0]) ** 2).sum(1).argmax()
    second = ((x - x[first]) ** 2).sum(1).argmax()
    c = x[[first, second]].copy()
    own = np.zeros(len(x), np.int64)
    for _ in range(steps):
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        if not 0 < own.sum() < len(x):
            break
        new = np.stack([x[own == i].mean(0) for i in (0, 1)])
        if np.array_equal(new, c):
            break
        c = new
    return own if 0 < own.sum() < len(x) else (np.arange(len(x)) >= len(x) // 2).astype(np.int64)


def _by_bucket(batches: Iterator[pa.RecordBatch], numbers: dict[int, int], dim: int):
    """Of batches (bucket_id, vec_id, embedding): the bucket's number and the places, ids and vectors of its rows of `dim`."""
    for batch in batches:
        x, at = _matrix(batch.column(2), dim)
        buckets, ids = batch.column(0).to_numpy()[at], batch.column(1).to_numpy()[at]
        yield batch, [(numbers[b], at[own], ids[own], x[own]) for b in np.unique(buckets).tolist() for own in [buckets == b]]


def _farthest(held):
    """Per task and bucket the row farthest from the bucket's reference, ties to the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, refs = held.value
        best: dict[int, tuple] = {}
        for _, groups in _by_bucket(batches, {b: i for i, b in enumerate(names)}, refs.shape[1]):
            for i, _, ids, x in groups:
                d = ((x - refs[i]) ** 2).sum(1)
                j = np.lexsort((ids, -d))[0]
                best[i] = max(best.get(i, (-1.0, 0, None)), (float(d[j]), -int(ids[j]), x[j].tolist()), key=lambda t: t[:2])
        rows = [{"bucket_id": names[i], "far": d, "back": back, "embedding": x} for i, (d, back, x) in best.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket_id", pa.int64()), ("far", pa.float64()), ("back", pa.int64()), ("embedding", pa.list_(pa.float64()))]))

    return run


def _side_sums(held):
    """Per task, bucket and side the sum and, last, the number of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c = held.value
        sums = np.zeros((len(names), 2, c.shape[2] + 1))
        for _, groups in _by_bucket(batches, {b: i for i, b in enumerate(names)}, c.shape[2]):
            for i, _, _, x in groups:
                own = _side(x, c[i])
                for side in (0, 1):
                    sums[i, side, :-1] += x[own == side].sum(0)
                    sums[i, side, -1] += (own == side).sum()
        some = [(i, side) for i in range(len(names)) for side in (0, 1) if sums[i, side, -1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i, _ in some], pa.int64()), pa.array([z for _, z in some], pa.int64()), pa.array([sums[i, z].tolist() for i, z in some], pa.list_(pa.float64()))],
            ["bucket_id", "side", "sums"],
        )

    return run


def _side(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (((x - c[1]) ** 2).sum(1) < ((x - c[0]) ** 2).sum(1)).astype(np.int64)


def _sided(held, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c, new, equal = held.value
        for batch, groups in _by_bucket(batches, {b: i for i, b in enumerate(names)}, c.shape[2]):
            side = np.zeros(batch.num_rows, np.int64)  # rows of another dimension go to the first half
            for i, at, ids, x in groups:
                side[at] = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63)).astype(np.int64) if names[i] in equal else _side(x, c[i])
            to = np.array([new[b] for b in batch.column(0).to_pylist()], np.int64) + side
            yield pa.RecordBatch.from_arrays([pa.array(to), batch.column(1), batch.column(2)], fields)

    return run


def _split_apart(rows: DataFrame, buckets: list[int], new: dict[int, int], steps: int = 8) -> DataFrame:
    """Halves of buckets that are too large for a task, by two-means whose sums meet in a shuffle.

    Rows stay in their tasks; two centres a bucket are broadcast. Where all rows are equal, a hash of the id parts them.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col("bucket_id").isin(buckets)).select("bucket_id", "vec_id", "embedding")
    dim = dimension(rows)
    share = spark.sparkContext.broadcast

    def farthest(refs: np.ndarray) -> np.ndarray:
        kind = "bucket_id long, far double, back long, embedding array<double>"
        each = rows.mapInArrow(_farthest(share((buckets, refs))), kind)
        got = {r["bucket_id"]: r["x"] for r in each.groupBy("bucket_id").agg(F.max_by("embedding", F.struct("far", "back")).alias("x")).collect()}
        return np.array([got[b] for b in buckets], np.float64)

    base = rows.where(F.size("embedding") == dim).groupBy("bucket_id").agg(F.min_by("embedding", "vec_id").alias("x"))
    refs = {r["bucket_id"]: r["x"] for r in base.collect()}  # a row a bucket
    buckets = [b for b in buckets if b in refs]
    one = farthest(np.array([refs[b] for b in buckets], np.float64))
    c = np.stack([one, farthest(one)], axis=1)
    equal: set[int] = set()
    for _ in range(steps):
        parts = rows.mapInArrow(_side_sums(share((buckets, c))), "bucket_id long, side long, sums array<double>")
        parts = parts.select("bucket_id", "side", F.posexplode("sums").alias("pos", "x")).groupBy("bucket_id", "side", "pos").agg(F.sum("x").alias("x")).toArrow()
        both = np.zeros((len(buckets), 2, dim + 1))
        place = {b: i for i, b in enumerate(buckets)}
        both[[place[b] for b in parts["bucket_id"].to_pylist()], parts["side"].to_numpy(), parts["pos"].to_numpy()] = parts["x"].to_numpy()
        n = both[:, :, dim]
        equal |= {b for b, least in zip(buckets, n.min(1).tolist(), strict=True) if least == 0}
        means = np.where(n[:, :, None] > 0, both[:, :, :dim] / np.maximum(n, 1)[:, :, None], c)
        if np.allclose(means, c, atol=1e-12):
            break
        c = means
    return rows.mapInArrow(_sided(share((buckets, c, new, equal)), ["bucket_id", "vec_id", "embedding"]), "bucket_id long, vec_id long, embedding array<float>")


def split_buckets(rows: DataFrame, large: list[int], first_new: int) -> DataFrame:
    """Split each of the buckets `large` once; its halves get new ids from `first_new`.

    A bucket of at most WHOLE rows goes to one task; larger ones are halved where their rows lie.
    """
    if not large:
        return rows
    ship(rows.sparkSession)
    new = {b: first_new + 2 * i for i, b in enumerate(sorted(large))}
    rows = rows.select(F.col("bucket_id").cast("long").alias("bucket_id"), "vec_id", "embedding")
    some = rows.where(F.col("bucket_id").isin(large))
    huge = sorted(r["bucket_id"] for r in some.groupBy("bucket_id").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE).collect())

    def split(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        if len(frame) > 1:
            frame["bucket_id"] = new[key[0]] + _halves(np.array(frame["embedding"].tolist(), np.float64))
        return frame

    out = rows.where(~F.col("bucket_id").isin(large))
    if len(huge) < len(large):
        out = out.unionByName(some.where(~F.col("bucket_id").isin(huge)).groupBy("bucket_id").applyInPandas(split, some.schema))
    for i in range(0, len(huge), APART):
        out = out.unionByName(_split_apart(rows, huge[i : i + APART], new))
    return out


def farthest_pair(vectors: DataFrame, dim: int) -> DataFrame:
    """bucket_id, first, second: farthest from the bucket's first row, and farthest from that one."""
    base = vectors.groupBy("bucket_id").agg(F.min_by("embedding", "vec_id").alias("base"))
    pick = lambda ref: F.max_by(F.struct("vec_id", "embedding"), F.struct(V.l2_squared(F.col("embedding"), F.col(ref), dim), -F.col("vec_id")))
    one = vectors.join(base, "bucket_id").groupBy("bucket_id").agg(pick("base").alias("a"))
    two = vectors.join(one.select("bucket_id", "a", F.col("a.embedding").alias("far")), "bucket_id").groupBy("bucket_id", F.col("a.vec_id").alias("first")).agg(pick("far").alias("b"))
    return two.select("bucket_id", "first", F.col("b.vec_id").alias("second"))


def ring(shards: int, virtual_nodes: int = 8) -> list[tuple[int, int]]:
    """(shard, virtual node) of the consistent-hash ring."""
    return [(s, v) for s in range(shards) for v in range(max(1, virtual_nodes))]


def place_buckets(buckets: DataFrame, shards: int, virtual_nodes: int = 8) -> DataFrame:
    """bucket_id, shard: the first ring token at or after the bucket's hash, the first of all beyond the last."""
    if shards <= 0:
        return buckets.select("bucket_id", F.lit(0).cast("long").alias("shard"))
    tokens = sorted((naming.ring_token(f"node:{s}:{v}"), s) for s, v in ring(shards, virtual_nodes))
    held = F.array(*[F.struct(F.lit(t).cast("long").alias("token"), F.lit(s).cast("long").alias("shard")) for t, s in tokens])  # shards x virtual nodes entries
    after = F.filter(held, lambda x: x["token"] >= F.col("h"))
    keyed = buckets.select("bucket_id", naming.ring_hash(F.concat_ws(":", F.lit("bucket"), "bucket_id")).alias("h")).distinct()
    return keyed.select("bucket_id", F.coalesce(F.get(after, F.lit(0)), F.get(held, F.lit(0)))["shard"].alias("shard"))
