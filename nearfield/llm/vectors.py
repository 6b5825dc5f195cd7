"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are turned by a random rotation, so that a few of their dimensions tell about the
rest, and dealt to the lists of the nearest centroids, whose number grows with the square root of
the table. A list's rows and the queries that probe it meet in cells of bounded size. In a cell,
rows are taken in runs; distances grow block of dimensions by block, and after each block a
hypothesis test drops candidates whose partial distance is already too large for the query's
bound: the smaller of the distance of its k-th neighbour in the sample, which the true one
can't exceed, and of its k-th in the cell so far. Survivors are measured exactly on the original
vectors. All results come from lists; the sample only bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard, small_batches

#: Rows for each list on which centroids are fitted and which bound the queries' distances, and least number of such rows.
SAMPLE, LEAST = 16, 1024
#: Bytes of centroids at most, as doubles; below, there are as many lists as the square root of the number of rows.
CENTROIDS = 4 << 20
#: Rows of a list, and queries that probe it, that meet in one cell, about.
PART, QUERIES = 8192, 8192
#: Dimensions of a block, and rows that are scanned before bounds are drawn in.
STEP, RUN = 16, 512
#: Queries scanned side by side.
ABREAST = 64
#: Strictness of the test: a candidate is dropped if it exceeds its bound by this many spreads.
SPREADS = 3.0
#: Rounding of a square distance against the squares of its two vectors, at most.
ROUNDING = 1e-12
#: Sample queries by which the number of probed lists is set, and the recall it must reach there.
TRIAL, RECALL = 256, 0.99
#: Rows whose distances to centroids or to the sample are held at a time.
_CHUNK = 2048


@dataclass
class Index:
    """What workers need of the fit; its size depends on the sample and the dimension alone."""

    dim: int
    rotation: np.ndarray
    centroids: np.ndarray
    ids: np.ndarray
    sample: np.ndarray  # rotated
    probes: int = 1

    def own(self, x: np.ndarray) -> np.ndarray:
        """The nearest list of each rotated row."""
        parts = [_squares(x[at : at + _CHUNK], self.centroids).argmin(axis=1) for at in range(0, len(x), _CHUNK)]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column whose rows all have `dim` components."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _fit(ids: np.ndarray, sample: np.ndarray, lists: int, seed: int) -> Index:
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    x = sample @ rotation
    _, first = np.unique(x, axis=0, return_index=True)  # copies would make equal centroids
    distinct = x[np.sort(first)]
    index = Index(dim, rotation, distinct[rng.permutation(len(distinct))[:lists]].copy(), ids, x)
    for _ in range(12):
        own = index.own(distinct)
        sums = np.zeros_like(index.centroids)
        np.add.at(sums, own, distinct)
        n = np.bincount(own, minlength=len(sums))
        index.centroids[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return index


def _assigned(held):
    """(list, vec_id, embedding) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            own = index.own(_matrix(batch.column(1), index.dim) @ index.rotation)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *batch.columns], ["list", "vec_id", "embedding"])

    return run


def _tried(held, k):
    """The k nearest rows of a batch for each trial query, as (trial, vec_id, list, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        trial = index.sample[:TRIAL]
        for batch in batches:
            ids = batch.column(1).to_numpy()
            if not len(ids):
                continue
            d = _squares(trial, _matrix(batch.column(2), index.dim) @ index.rotation)
            d[index.ids[:TRIAL, None] == ids[None, :]] = np.inf
            top = np.argpartition(d, min(k, len(ids)) - 1, axis=1)[:, :k]
            q = np.repeat(np.arange(len(trial)), top.shape[1])
            top = top.reshape(-1)
            own = batch.column(0).to_numpy()[top]
            good = np.isfinite(d[q, top])
            yield pa.RecordBatch.from_arrays([pa.array(q[good], pa.int32()), pa.array(ids[top][good]), pa.array(own[good], pa.int32()), pa.array(d[q, top][good])], ["trial", "vec_id", "list", "d"])

    return run


def _probes(index: Index, true: pd.DataFrame, recall: float) -> int:
    """How many of a query's nearest lists hold `recall` of the trial's true neighbours."""
    order = np.argsort(_squares(index.sample[:TRIAL], index.centroids), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
    needed = np.sort(rank[true["trial"].to_numpy(), true["list"].to_numpy()])
    return int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)]) + 1 if len(needed) else order.shape[1]


def _asked(held, k):
    """Each query once for every list that it probes, with its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids = part.column(0).to_numpy()
                y = _matrix(part.column(1), index.dim) @ index.rotation
                d = _squares(y, index.sample)
                d[ids[:, None] == index.ids[None, :]] = np.inf
                bound = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(ids), np.inf)
                far = _squares(y, index.centroids)
                lists = np.argpartition(far, index.probes - 1, axis=1)[:, : index.probes] if index.probes < far.shape[1] else np.tile(np.arange(far.shape[1]), (len(ids), 1))
                row = np.repeat(np.arange(len(ids)), lists.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists.reshape(-1), pa.int32()), *(c.take(pa.array(row)) for c in part.columns), pa.array(bound[row])], ["list", "query_id", "embedding", "bound"]
                )

    return run


def scan(blocks: list[np.ndarray], queries: np.ndarray, bounds: np.ndarray, spreads: float = SPREADS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that no test dropped. blocks: candidates' rotated dimensions, cut.

    After d of D dimensions a partial square distance s speaks for s * D / d in all, with a
    relative spread of the square root of 2 / d; beyond bound * (1 + spreads * that) the
    candidate is dropped. After the last block the bound itself holds. Each test allows for
    the rounding of _squares, which grows with the vectors' own squares: a copy whose bound is
    0 stays.
    """
    dim = queries.shape[1]
    upto = blocks[0].shape[1]
    part = _squares(queries[:, :upto], blocks[0])
    own, other = (queries * queries).sum(axis=1), sum((block * block).sum(axis=1) for block in blocks)
    rounding = 1e-9 + ROUNDING * (dim / upto) * (own[:, None] + other[None, :])
    q, c = np.nonzero(part * (dim / upto) <= bounds[:, None] * (1 + (spreads * np.sqrt(2 / upto) if upto < dim else 1e-9)) + rounding)
    s, rounding = part[q, c], rounding[q, c]
    for block in blocks[1:]:
        s = s + ((queries[q, upto : upto + block.shape[1]] - block[c]) ** 2).sum(axis=1)
        upto += block.shape[1]
        slack = bounds[q] * (1 + (spreads * np.sqrt(2 / upto) if upto < dim else 1e-9)) + rounding
        keep = s * (dim / upto) <= slack
        q, c, s, rounding = q[keep], c[keep], s[keep], rounding[keep]
    return q, c


def search(ids: np.ndarray, x: np.ndarray, own: np.ndarray, z: np.ndarray, bounds: np.ndarray, k: int, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of queries (own, z, square bounds) the k nearest rows (ids, x) found: query's place, row's place, distance.

    Rows are scanned in runs; after each the bound of a query that has k rows is drawn in to its k-th.
    """
    y, turned, bounds = x @ rotation, z @ rotation, bounds.copy()
    best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    for at in range(0, len(ids), RUN):
        run = y[at : at + RUN]
        q, c = scan([np.ascontiguousarray(run[:, i : i + STEP]) for i in range(0, y.shape[1], STEP)], turned, bounds)
        c += at
        other = own[q] != ids[c]
        q, c = q[other], c[other]
        q, c, d = (np.concatenate(pair) for pair in zip(best, (q, c, np.sqrt(((z[q] - x[c]) ** 2).sum(axis=1))), strict=True))
        order = np.lexsort((ids[c], d, q))
        q, c, d = q[order], c[order], d[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        bounds[q[place == k - 1]] = np.minimum(bounds[q[place == k - 1]], d[place == k - 1] ** 2)
        best = (q[place < k], c[place < k], d[place < k])
    return best


def _scanned(held, k):
    def run(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rotation = held.value.rotation
        out = [pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})]
        if len(rows):
            ids, x = rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), np.float64)
            for at in range(0, len(asked), ABREAST):
                some = asked.iloc[at : at + ABREAST]
                own = some["query_id"].to_numpy()
                q, c, d = search(ids, x, own, np.array(some["embedding"].tolist(), np.float64), some["bound"].to_numpy(), k, rotation)
                out.append(pd.DataFrame({"query_id": own[q], "vec_id": ids[c], "score": d}))
        return pd.concat(out)

    return run


def nearest(table: DataFrame, k: int = 10, every: int = 100, recall: float = RECALL, sample: int = SAMPLE, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`.

    Candidates are all rows with another vec_id; score is their Euclidean distance in double
    precision, ties go to the smaller vec_id. Vectors that are null, zero, or hold a null or
    non-finite component take no part, nor do rows without a vec_id, nor vectors of another
    length than most have (the shorter of equally many). Rows that agree in vec_id and
    vector count once; if the vectors of a vec_id differ, the smallest in order counts. A query with
    fewer than k candidates gets all; an empty table gives no rows. Only vec_id and embedding are read.

    The index is fitted on `sample` rows for each list, LEAST at least, and holds every row but those that
    can be nobody's neighbour: of equal vectors the k + 1 smallest ids stand for all as candidates.
    """
    spark = table.sparkSession
    small_batches(spark)
    sc = spark.sparkContext
    kind = "query_id long, rank int, vec_id long, score double"
    single = isinstance(table.schema["embedding"].dataType, T.ArrayType) and isinstance(table.schema["embedding"].dataType.elementType, T.FloatType)
    number = "array<float>" if single else "array<double>"
    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast(number).alias("embedding")).where("vec_id is not null and embedding is not null")
    lengths = rows.where("size(embedding) > 0 and exists(embedding, x -> x <> 0)").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    common = lengths.orderBy(F.desc("n"), "dim").first()
    if common is None:
        return spark.createDataFrame([], kind)
    dim = common["dim"]
    fine = f"size(embedding) = {dim} and exists(embedding, x -> x <> 0) and forall(embedding, x -> x is not null and x > double('-inf') and x < double('inf'))"
    rows = cut(rows.where(fine).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    n = rows.count()
    lists = int(np.clip(round(n**0.5), 1, max(1, CENTROIDS // (8 * dim))))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(LEAST, sample * lists)).toArrow()  # bounded as lists are
    if not picked.num_rows:
        return spark.createDataFrame([], kind)
    index = _fit(picked["vec_id"].to_numpy(), _matrix(picked["embedding"].combine_chunks(), dim), lists, seed)

    held = sc.broadcast(index)
    copies = Window.partitionBy("embedding").orderBy("vec_id")  # limited in each task before rows move
    single_out = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    stored = cut(single_out.select("vec_id", "embedding").mapInArrow(_assigned(held), f"list int, vec_id long, embedding {number}"), "lists")
    best = Window.partitionBy("trial").orderBy("d", "vec_id")
    tried = stored.mapInArrow(_tried(held, k), "trial int, vec_id long, list int, d double")
    true = tried.withColumn("at", F.row_number().over(best)).where(f"at <= {k}").select("trial", "list").toPandas()  # TRIAL * k rows
    index.probes = _probes(index, true, recall)
    held = sc.broadcast(index)
    queries = rows.where(F.col("vec_id") % every == 0)
    asked = cut(queries.mapInArrow(_asked(held, k), f"list int, query_id long, embedding {number}, bound double"), "asked")
    discard(rows)

    # a list with many rows or queries is cut into cells, its rows by their parts and its queries by theirs
    many = lambda c, most: F.greatest(F.ceil(F.col(c) / most), F.lit(1)).cast("int")
    rows_of, queries_of = (x.groupBy("list").agg(F.count("*").alias(c)) for x, c in ((stored, "rows"), (asked, "queries")))
    cells = cut(rows_of.join(queries_of, "list").select("list", many("rows", PART).alias("parts"), many("queries", QUERIES).alias("turns")), "cells")  # one row per list
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blocks = stored.join(F.broadcast(cells), "list").select("list", deal("vec_id", "parts").alias("part"), every_one("turns").alias("turn"), "vec_id", "embedding")
    asked = asked.join(F.broadcast(cells), "list").select("list", every_one("parts").alias("part"), deal("query_id", "turns").alias("turn"), "query_id", "embedding", "bound")
    cell = ["list", "part", "turn"]
    found = blocks.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInPandas(_scanned(held, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
