"""A vector database on Parquet files with atomic commits.

Every change writes new files and then a manifest of its own, which lists the files that count; the
highest whole one is in force. Readers resolve it once per call, so that a call sees one version. The log is
partitioned by bucket; a query reads only the buckets it probes.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming
from ..functions import vectors as V
from ..operators import clustering, ingest, search
from ..sources import log as vlog


@dataclass
class Options:
    path: str
    shards: int = 4
    virtual_nodes: int = 8
    rebuild_every: int = 1000  # inserted vectors after which centroids are made anew; until then they follow as running means

    def __post_init__(self):
        if self.shards <= 0:
            raise ValueError("workers must be > 0")


class VectorEngine:
    """Open, insert, delete, query. Use as a context manager or call close()."""

    def __init__(self, spark: SparkSession, options: Options):
        self.spark, self.options = spark, options
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(options.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._state = self._load()

    @classmethod
    def open(cls, spark: SparkSession, name: str, root: str = "vector_files", **options) -> VectorEngine:
        return cls(spark, Options(f"{root}/{naming.namespace(name)}", **options))

    # -- commits ---------------------------------------------------------------------------

    def _load(self) -> dict:
        """The newest manifest that was written whole; `top` is the highest number that any has."""
        folder = self._fs_path(self.options.path)
        found = []
        if self._fs.exists(folder):
            names = (status.getPath().getName() for status in self._fs.listStatus(folder))
            found = sorted((int(name.removeprefix("MANIFEST-")) for name in names if re.fullmatch(r"MANIFEST-[0-9]+", name)), reverse=True)
        for n in found:
            stream = self._fs.open(self._fs_path(f"{self.options.path}/MANIFEST-{n}"))
            try:
                state = json.loads(bytes(stream.readAllBytes()).decode())
            except ValueError:  # its writer ended before it was whole
                continue
            finally:
                stream.close()
            return state | {"version": n, "top": found[0]}
        return {"version": 0, "top": max(found, default=0), "seq": 0, "log": [], "centroids": [], "meta": [], "inserted": 0, "pending": 0, "dim": 0}

    def _commit(self, **changes) -> None:
        """Write the next manifest, a file that no one else may have made; older ones stay until vacuum().

        A writer that ends at any point leaves the newest whole manifest in force.
        """
        if self._load()["version"] != self._state["version"]:
            raise RuntimeError("another writer has committed; reopen and retry")
        n = max(self._load()["top"], self._state["version"]) + 1
        state = self._state | changes | {"version": n, "top": n}
        try:
            out = self._fs.create(self._fs_path(f"{self.options.path}/MANIFEST-{n}"), False)
        except Py4JJavaError as e:
            raise RuntimeError("another writer has committed; reopen and retry") from e
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self._state = state

    def _write(self, df: DataFrame, kind: str) -> str:
        path = f"{self.options.path}/{kind}/{self._state['version'] + 1}-{uuid.uuid4().hex}"
        if kind == "log":  # rebalanced, so that Spark splits a large bucket over tasks and files
            df.hint("rebalance", "bucket_id").write.partitionBy("bucket_id").parquet(path)
        else:
            df.write.parquet(path)
        return path

    def _read(self, kind: str, schema: str, more: list[str] | None = None) -> DataFrame:
        parts = [*self._state[kind], *(more or [])]
        if not parts:
            return self.spark.createDataFrame([], schema)
        out = None
        for path in parts:
            df = self.spark.read.schema(schema).parquet(path)
            out = df if out is None else out.unionByName(df)
        return out

    # -- reading ---------------------------------------------------------------------------

    def log(self) -> DataFrame:
        return self._read("log", vlog.SCHEMA)

    def vectors(self) -> DataFrame:
        return vlog.live(self.log()).select("vec_id", "embedding", "bucket_id")

    def _known(self, ids: DataFrame, column: str | None = None) -> DataFrame:
        """vec_id, bucket_id and `column` of what is stored of `ids`, a few against the log.

        Ids meet the log before newest-wins, so that only their rows are shuffled, and other columns aren't read.
        """
        columns = list(dict.fromkeys(["seq", "op", "vec_id", "bucket_id", *([column] if column else [])]))
        rows = self.log().select(*columns).join(ids.select("vec_id").distinct(), "vec_id", "left_semi")
        return vlog.live(rows).drop("seq", "op")

    def centroids(self) -> DataFrame:
        return self._read("centroids", "bucket_id long, centroid array<double>, n long")

    def query(self, vector: list[float], k: int, probes: int | None = None) -> DataFrame:
        """rank, vec_id, distance. By default clamp(20 k, 50, 500) buckets are probed."""
        return self._query(vector, k, probes).select("rank", "vec_id", "distance")

    query_with_probes = query

    def query_with_vectors(self, vector: list[float], k: int) -> DataFrame:
        found = self._query(vector, k, None)
        return search.with_vectors(found, self._probed).select("rank", "vec_id", "distance", "embedding")

    def _query(self, vector, k, probes):
        cents = self.centroids()
        dim = self._state["dim"]
        if not self._state["centroids"] or not dim:
            raise RuntimeError("router not initialized")
        probes = V.default_probes(k) if probes is None else probes
        q = self.spark.createDataFrame([(0, [float(x) for x in vector])], "qid long, embedding array<double>")
        rows = self.log()
        if probes < cents.count():  # else the scan is exact
            near = [r["bucket_id"] for r in search.route(q, cents, probes, dim).collect()]  # `probes` rows
            rows = rows.where(F.col("bucket_id").isin(near))  # prunes partitions
        self._probed = vlog.live(rows).select("vec_id", "embedding", "bucket_id")
        return search.knn_exact(self._probed, q, k)

    def query_many(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """qid, rank, vec_id, distance for queries (qid, embedding)."""
        return search.knn_probed(self.log(), queries, self.centroids(), k, probes, self._state["dim"], vlog.live)

    def get(self, ids: list[int]) -> DataFrame:
        """vec_id, embedding in the order asked for; missing ids are left out."""
        wanted = self._wanted(ids)
        return search.get(self._known(wanted, "embedding"), wanted).orderBy("pos").select("vec_id", "embedding")

    def resolve_buckets(self, ids: list[int]) -> DataFrame:
        wanted = self._wanted(ids)
        return search.get(self._known(wanted), wanted, "bucket_id").orderBy("pos").select("vec_id", "bucket_id")

    def fetch_vectors(self, bucket_id: int, ids: list[int]) -> DataFrame:
        rows = vlog.live(self.log().where(F.col("bucket_id") == bucket_id))  # one partition: a move leaves a tombstone behind
        return search.fetch_in_bucket(rows, bucket_id, self._wanted(ids)).select("vec_id", "embedding")

    def _wanted(self, ids: list[int]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(map(int, ids))), "pos long, vec_id long")

    def stats(self) -> dict:
        row = vlog.live(self.log().drop("embedding")).agg(F.countDistinct("bucket_id").alias("buckets"), F.count("*").alias("vectors")).first()
        return {"ready": bool(self._state["centroids"]), "buckets": row["buckets"], "vectors": row["vectors"], "inserted_total": self._state["inserted"], "pending_updates": self._state["pending"]}

    # -- writing ---------------------------------------------------------------------------

    def insert(self, rows: DataFrame | int, vector: list[float] | None = None, bucket_col: str | None = None) -> int:
        """Insert a DataFrame (vec_id, embedding) or one vector, all or nothing; how many entered.

        Ids that exist or repeat, negative ids and other dimensions are errors, found before
        anything is written. bucket_col names a column that bypasses routing.
        """
        if vector is not None:
            rows = self.spark.createDataFrame([(int(rows), [float(x) for x in vector])], "vec_id long, embedding array<float>")
        hint = F.col(bucket_col).cast("long") if bucket_col else F.lit(None).cast("long")
        rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>"), hint.alias("hint"))
        seen = rows.agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")).first()
        if not seen["n"]:
            return 0
        if seen["low"] < 0:
            raise ValueError("ids must be between 0 and 2**63 - 1")
        dim = self._state["dim"] or seen["a"]
        if seen["a"] != seen["b"] or seen["a"] != dim or not dim:
            raise ValueError(f"dimension mismatch: expected {dim}")
        clash = ingest.duplicates(rows).select("vec_id").unionByName(ingest.rejected(rows, self._known(rows)).select("vec_id")).first()
        if clash:
            raise ValueError(f"id {clash['vec_id']} already exists")
        placed = self._placed(rows, dim)
        path = self._write(placed.select(F.lit(self._state["seq"] + 1).cast("long").alias("seq"), F.lit("I").alias("op"), "vec_id", "embedding", "bucket_id"), "log")
        pending = self._state["pending"] + seen["n"]
        if not self._state["centroids"] or pending >= self.options.rebuild_every:
            pending, cents = 0, clustering.centroids(vlog.live(self._read("log", vlog.SCHEMA, [path])))
        else:
            cents = clustering.moved(self.centroids(), self.spark.read.schema(vlog.SCHEMA).parquet(path))
        self._commit(log=[*self._state["log"], path], seq=self._state["seq"] + 1, inserted=self._state["inserted"] + seen["n"], pending=pending, dim=dim, centroids=[self._snapshot(cents)])
        return seen["n"]

    def _placed(self, rows: DataFrame, dim: int) -> DataFrame:
        if not self._state["centroids"]:
            return rows.withColumn("bucket_id", F.coalesce("hint", F.lit(0).cast("long"))).drop("hint")
        own = search.route_all(rows.where("hint is null"), self.centroids(), dim)
        return rows.join(own, "vec_id", "left").withColumn("bucket_id", F.coalesce("hint", "bucket_id")).drop("hint")

    def delete(self, ids: list[int] | int | DataFrame) -> None:
        """Unknown ids are ignored. Centroids of the buckets that lose rows are made anew, others stay."""
        if not isinstance(ids, DataFrame):
            ids = self._wanted([ids] if isinstance(ids, int) else ids)
        hit = self._known(ids)
        seq = self._state["seq"] + 1
        path = self._write(hit.select(F.lit(seq).cast("long").alias("seq"), F.lit("D").alias("op"), "vec_id", F.lit(None).cast("array<float>").alias("embedding"), "bucket_id"), "log")
        touched = self.spark.read.schema(vlog.SCHEMA).parquet(path).select("bucket_id").distinct()
        if not touched.take(1):
            return
        rows = vlog.live(self._read("log", vlog.SCHEMA, [path]).join(touched, "bucket_id", "left_semi"))
        kept = self.centroids().join(touched, "bucket_id", "left_anti")
        cents = kept.select("bucket_id", "centroid", "n").unionByName(clustering.centroids(rows).select("bucket_id", "centroid", "n"))
        self._commit(log=[*self._state["log"], path], seq=seq, centroids=[self._snapshot(cents)])

    def _snapshot(self, cents: DataFrame) -> str:
        return self._write(cents.select("bucket_id", F.col("centroid").cast("array<double>").alias("centroid"), F.col("n").cast("long").alias("n")), "centroids")

    def flush(self) -> None:
        """Write a new version of the centroids from what is stored."""
        self._commit(centroids=[self._snapshot(clustering.centroids(self.vectors()))], pending=0)

    def install_snapshot(self, centroids: DataFrame) -> None:
        """Replace all centroids (bucket_id, centroid, n)."""
        self._commit(centroids=[self._snapshot(centroids)])

    def _replace(self, rows: DataFrame, retired: list[int]) -> None:
        seq = self._state["seq"] + 1
        path = self._write(rows.select(F.lit(seq).cast("long").alias("seq"), F.lit("I").alias("op"), "vec_id", "embedding", "bucket_id"), "log")
        stored = self.spark.read.schema(vlog.SCHEMA).parquet(path)
        fresh = stored.select("bucket_id").distinct()
        meta = fresh.select(F.lit(seq).cast("long").alias("seq"), "bucket_id", F.lit("Active").alias("status"))
        if retired:
            gone = self.spark.createDataFrame([(b,) for b in retired], "bucket_id long")
            meta = meta.unionByName(gone.join(fresh, "bucket_id", "left_anti").select(F.lit(seq).cast("long").alias("seq"), "bucket_id", F.lit("Retired").alias("status")))
        meta = [*self._state["meta"], self._write(meta, "meta")]
        self._commit(log=[path], seq=seq, meta=meta, centroids=[self._snapshot(clustering.centroids(stored))], pending=0)

    def build_index(self, k: int, seed: int = 0) -> None:
        """Cluster all that is stored into about k buckets."""
        before = [r[0] for r in self.vectors().select("bucket_id").distinct().collect()]
        self._replace(clustering.build_clusters(self.vectors(), k, seed), before)

    def rebalance(self, threshold: int = 2000, max_rounds: int = 32) -> int:
        """Split buckets of more than `threshold` vectors until none is left; rounds it took."""
        for done in range(max_rounds):
            sizes = {r["bucket_id"]: r["n"] for r in self.vectors().groupBy("bucket_id").agg(F.count("*").alias("n")).collect()}
            large = [b for b, n in sizes.items() if n > threshold]
            if not large:
                return done
            rows = clustering.split_buckets(self.vectors().select("bucket_id", "vec_id", "embedding"), large, max(sizes) + 1)
            self._replace(rows, large)
        return max_rounds

    def bucket_status(self) -> DataFrame:
        return vlog.latest_status(self._read("meta", "seq long, bucket_id long, status string"))

    def shards(self) -> DataFrame:
        return clustering.place_buckets(self.centroids(), self.options.shards, self.options.virtual_nodes)

    def vacuum(self) -> None:
        """Compact the log to what is stored and delete files that no version counts any more."""
        if self._state["log"]:
            self._replace(self.vectors(), [])
        held = {p for kind in ("log", "centroids", "meta") for p in self._state[kind]}
        for kind in ("log", "centroids", "meta"):
            folder = self._fs_path(f"{self.options.path}/{kind}")
            if self._fs.exists(folder):
                for status in self._fs.listStatus(folder):
                    path = status.getPath()
                    if not any(p.endswith(path.getName()) for p in held):
                        self._fs.delete(path, True)
        for status in self._fs.listStatus(self._fs_path(self.options.path)):
            number = re.fullmatch(r"MANIFEST-([0-9]+)", status.getPath().getName())
            if number and int(number[1]) < self._state["version"]:
                self._fs.delete(status.getPath(), False)

    def close(self) -> None:
        self._state = self._load()

    def __enter__(self) -> VectorEngine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

