"""Queries over `embeddings`, with the label as a deterministic bucket, and the same in DuckDB SQL.

All take the whole table; searches ask for every row whose id is divisible by 100.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming
from ..functions import vectors as V
from ..operators import clustering, ingest, search
from ..sources import log as vlog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIM = 64


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = "WITH " + ",\n".join(text for key, text in _CTES if key in _needed(sql)) + "\n" + sql if _needed(sql) else sql
        return f

    return add


_CTES = [
    ("e", "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS bucket_id FROM embeddings)"),
    ("cl", "cl AS (SELECT bucket_id, pos, round(avg(x), 9) AS m FROM (SELECT bucket_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM e) GROUP BY bucket_id, pos)"),
    ("c", "c AS (SELECT bucket_id, list(m ORDER BY pos) AS cv FROM cl GROUP BY bucket_id)"),
    ("b", "b AS (SELECT min(m) - greatest((max(m) - min(m)) * 0.001::DOUBLE, 0.001::DOUBLE) AS lo, max(m) + greatest((max(m) - min(m)) * 0.001::DOUBLE, 0.001::DOUBLE) AS hi FROM cl)"),
    ("cc", "cc AS (SELECT bucket_id, list_transform(cv, lambda x: floor(least(greatest((x - lo) * (255::DOUBLE / (hi - lo)), 0), 255)) - 128) AS code FROM c, b)"),
    ("ec", "ec AS (SELECT vec_id, bucket_id, list_transform(v, lambda x: floor(least(greatest((x - lo) * (255::DOUBLE / (hi - lo)), 0), 255)) - 128) AS code FROM e, b)"),
    ("lg", """lg AS (SELECT 1::BIGINT AS seq, 'I' AS op, vec_id, bucket_id, v FROM e
  UNION ALL SELECT 2, 'I', vec_id, bucket_id, list_transform(v, lambda x: x * 2) FROM e WHERE vec_id % 7 = 0
  UNION ALL SELECT 3, 'D', vec_id, bucket_id, NULL FROM e WHERE vec_id % 10 = 0)"""),
    ("nw", "nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY seq DESC) AS at_ FROM lg) WHERE at_ = 1)"),
    ("s", "s AS (SELECT vec_id AS seed, v AS sv FROM e WHERE vec_id < 10)"),
    ("ka", "ka AS (SELECT vec_id, arg_min(seed, (list_distance(v, sv), seed)) AS bucket_id FROM e, s GROUP BY vec_id)"),
    ("w", "w AS (SELECT i AS pos, (i * 37) % 700 AS vec_id FROM generate_series(0, 39) t(i) UNION ALL SELECT 40, 37 UNION ALL SELECT 41, 999999)"),
    ("q", "q AS (SELECT vec_id AS qid, v AS qv FROM e WHERE vec_id % 100 = 0)"),
    ("qc", "qc AS (SELECT vec_id AS qid, code FROM ec WHERE vec_id % 100 = 0)"),
    ("r", "r AS (SELECT qid, bucket_id, CASE WHEN list_dot_product(qc.code, qc.code) <= 0 OR list_dot_product(cc.code, cc.code) <= 0 THEN 1::DOUBLE ELSE 1 - list_dot_product(qc.code, cc.code) * (1 / sqrt(list_dot_product(qc.code, qc.code))) * (1 / sqrt(list_dot_product(cc.code, cc.code))) END AS d FROM qc, cc)"),
    ("rr", "rr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, bucket_id) AS rank FROM r)"),
    ("x", "x AS (SELECT qid, vec_id, list_distance(qv, v) AS d, row_number() OVER (PARTITION BY qid ORDER BY list_distance(qv, v), vec_id) AS rank FROM q, e)"),
    ("inc", """inc AS (SELECT vec_id * 2 AS vec_id, vec_id AS seq, bucket_id FROM e
  UNION ALL SELECT vec_id * 2 + 1, vec_id + 1000000000, bucket_id FROM e WHERE vec_id % 10 = 0
  UNION ALL SELECT vec_id * 2 + 1, vec_id + 2000000000, bucket_id FROM e WHERE vec_id % 10 = 0)"""),
    ("fp", "fp AS (SELECT bucket_id, arg_min(v, vec_id) AS base FROM e GROUP BY bucket_id)"),
    ("f1", "f1 AS (SELECT e.bucket_id, arg_max(vec_id, (list_distance(v, base), -vec_id)) AS a, arg_max(v, (list_distance(v, base), -vec_id)) AS av FROM e JOIN fp USING (bucket_id) GROUP BY e.bucket_id)"),
    ("f2", "f2 AS (SELECT e.bucket_id, any_value(a) AS a, any_value(av) AS av, arg_max(vec_id, (list_distance(v, av), -vec_id)) AS b, arg_max(v, (list_distance(v, av), -vec_id)) AS bv FROM e JOIN f1 USING (bucket_id) GROUP BY e.bucket_id)"),
]
_USES = {
    "q": "e", "cl": "e", "c": "e cl", "b": "e cl", "cc": "e cl c b", "ec": "e cl b", "qc": "e cl b ec", "r": "e cl c b cc ec qc", "rr": "e cl c b cc ec qc r",
    "x": "e q", "lg": "e", "nw": "e lg", "s": "e", "ka": "e s", "inc": "e", "fp": "e", "f1": "e fp", "f2": "e fp f1",
}


def _needed(sql: str) -> set[str]:
    import re

    names = set(re.findall(r"(?:FROM|JOIN|,)\s+(\w+)\b", sql)) & {k for k, _ in _CTES}
    return names | {x for n in names for x in _USES.get(n, "").split()}


# -- what the queries start from ------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", "embedding", F.col("label").cast("long").alias("bucket_id"))


def asked(rows: DataFrame) -> DataFrame:
    return rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def synthetic_log(rows: DataFrame) -> DataFrame:
    """Every row, every 7th again with doubled values, every 10th deleted."""
    row = lambda seq, op, v: (F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), "vec_id", v.alias("embedding"), "bucket_id")
    v = F.col("embedding")
    again = F.transform(v, lambda x: (x.cast("double") * 2).cast("float"))
    log = rows.select(*row(1, "I", v)).unionByName(rows.where("vec_id % 7 = 0").select(*row(2, "I", again)))
    return log.unionByName(rows.where("vec_id % 10 = 0").select(*row(3, "D", F.lit(None).cast("array<float>"))))


def wanted(spark: SparkSession) -> DataFrame:
    pos = spark.range(40).select(F.col("id").alias("pos"), (F.col("id") * 37 % 700).alias("vec_id"))
    return pos.unionByName(spark.createDataFrame([(40, 37), (41, 999999)], "pos long, vec_id long"))


def _fix(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# -- search ---------------------------------------------------------------------------------


@query("default_probe_rule", "SELECT k, least(greatest(20 * k, 50), 500) AS probes FROM generate_series(1, 50) t(k)")
def default_probe_rule(spark, sf_dir):
    return spark.range(1, 51).select(F.col("id").alias("k"), V.probe_count(F.col("id")).cast("long").alias("probes"))


@query(
    "route_ingest_top1",
    "SELECT bucket_id, count(*) AS n FROM (SELECT ec.vec_id, arg_min(cc.bucket_id, (1 - list_dot_product(ec.code, cc.code) * (1 / sqrt(list_dot_product(ec.code, ec.code))) * (1 / sqrt(list_dot_product(cc.code, cc.code))), cc.bucket_id)) AS bucket_id FROM ec, cc GROUP BY ec.vec_id) t GROUP BY bucket_id",
)
def route_ingest_top1(spark, sf_dir):
    rows = table(spark, sf_dir)
    return search.route_all(rows, clustering.centroids(rows), DIM).groupBy("bucket_id").agg(F.count("*").alias("n"))


# -- vector functions -------------------------------------------------------------------------


@query("quantizer_bounds", "SELECT round(min(u) - greatest((max(u) - min(u)) * 0.001::DOUBLE, 0.001::DOUBLE), 9) AS lo, round(max(u) + greatest((max(u) - min(u)) * 0.001::DOUBLE, 0.001::DOUBLE), 9) AS hi FROM (SELECT unnest(v) AS u FROM e) t")
def quantizer_bounds(spark, sf_dir):
    return V.bounds(table(spark, sf_dir)).select(_fix("lo", 9).alias("lo"), _fix("hi", 9).alias("hi"))


def _coded(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir)
    ends = search.coded_centroids(clustering.centroids(rows), DIM).select("lo", "hi").limit(1)
    return rows.crossJoin(F.broadcast(ends)).select("vec_id", "bucket_id", V.quantise(F.col("embedding"), F.col("lo"), F.col("hi")).alias("u8"))


@query("quantize_u8", "SELECT vec_id, CAST(list_sum(list_transform(code, lambda z: z + 128)) AS BIGINT) AS total, CAST(list_sum(list_transform(code, lambda z: (z + 128) * (z + 128))) AS BIGINT) AS squares FROM ec")
def quantize_u8(spark, sf_dir):
    u = F.col("u8")
    zero = F.lit(0).cast("long")
    return _coded(spark, sf_dir).select("vec_id", F.aggregate(u, zero, lambda s, x: s + x).alias("total"), F.aggregate(u, zero, lambda s, x: s + x * x).alias("squares"))


@query("int8_norm", "SELECT vec_id, CAST(list_dot_product(code, code) AS BIGINT) AS square, round(CASE WHEN list_dot_product(code, code) <= 0 THEN 0 ELSE 1 / sqrt(list_dot_product(code, code)) END, 9) AS inverse FROM ec")
def int8_norm(spark, sf_dir):
    rows = _coded(spark, sf_dir).select("vec_id", V.centre(F.col("u8")).alias("c"))
    rows = rows.select("vec_id", V.code_dot(F.col("c"), F.col("c"), DIM).alias("square"))
    return rows.select("vec_id", "square", _fix(V.inverse_norm(F.col("square")), 9).alias("inverse"))


@query("int8_dot", "SELECT t.vec_id, CAST(list_dot_product(t.code, o.code) AS BIGINT) AS product FROM ec t JOIN ec o ON o.vec_id = 0")
def int8_dot(spark, sf_dir):
    rows = _coded(spark, sf_dir).select("vec_id", V.centre(F.col("u8")).alias("c"))
    first = rows.where("vec_id = 0").select(F.col("c").alias("o"))
    return rows.crossJoin(F.broadcast(first)).select("vec_id", V.code_dot(F.col("c"), F.col("o"), DIM).alias("product"))


@query("padded_dot", "SELECT t.vec_id, CAST(list_dot_product(t.code[1:40], o.code[1:40]) AS BIGINT) + 24 * 16384 AS product FROM ec t JOIN ec o ON o.vec_id = 0")
def padded_dot(spark, sf_dir):
    """40 dimensions: 24 pad lanes, each the product of two centred zeros."""
    rows = _coded(spark, sf_dir).select("vec_id", F.slice(V.centre(F.col("u8")), 1, 40).alias("c"))
    first = rows.where("vec_id = 0").select(F.col("c").alias("o"))
    return rows.crossJoin(F.broadcast(first)).select("vec_id", V.code_dot(F.col("c"), F.col("o"), 40).alias("product"))


@query("dim_mismatch_filter", "SELECT vec_id FROM (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN v[1:32] ELSE v END AS u FROM e) t WHERE len(u) = 64")
def dim_mismatch_filter(spark, sf_dir):
    cut = F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    return table(spark, sf_dir).withColumn("embedding", cut).where(F.size("embedding") == DIM).select("vec_id")


# -- buckets --------------------------------------------------------------------------------


@query("bucket_centroids", "SELECT bucket_id, pos, round(m, 6) AS mean FROM cl")
def bucket_centroids(spark, sf_dir):
    return clustering.centroids_long(table(spark, sf_dir)).select("bucket_id", "pos", _fix(F.round("mean", 9)).alias("mean"))


@query("bucket_counts", "SELECT bucket_id, count(*) AS n FROM e GROUP BY bucket_id")
def bucket_counts(spark, sf_dir):
    return table(spark, sf_dir).groupBy("bucket_id").agg(F.count("*").alias("n"))


@query("stats", "SELECT count(*) > 0 AS ready, count(DISTINCT bucket_id) AS buckets, count(*) AS vectors FROM e")
def stats(spark, sf_dir):
    return table(spark, sf_dir).agg((F.count("*") > 0).alias("ready"), F.countDistinct("bucket_id").alias("buckets"), F.count("*").alias("vectors"))


@query("oversized_buckets", "SELECT bucket_id, count(*) AS n FROM e GROUP BY bucket_id HAVING count(*) > 50")
def oversized_buckets(spark, sf_dir):
    return bucket_counts(spark, sf_dir).where("n > 50")


@query("largest_bucket", "SELECT arg_max(bucket_id, (n, -bucket_id)) AS bucket_id, max(n) AS n FROM (SELECT bucket_id, count(*) AS n FROM e GROUP BY bucket_id) t")
def largest_bucket(spark, sf_dir):
    return bucket_counts(spark, sf_dir).agg(F.max_by("bucket_id", F.struct("n", -F.col("bucket_id"))).alias("bucket_id"), F.max("n").alias("n"))


@query("farthest_pair", "SELECT bucket_id, a AS first, b AS second FROM f2")
def farthest_pair(spark, sf_dir):
    return clustering.farthest_pair(table(spark, sf_dir), DIM)


def _seeds(rows: DataFrame) -> DataFrame:
    return rows.where("vec_id < 10").select(F.col("vec_id").alias("bucket_id"), F.col("embedding").alias("centroid"))


@query("kmeans_assign_step", "SELECT vec_id, bucket_id FROM ka")
def kmeans_assign_step(spark, sf_dir):
    rows = table(spark, sf_dir)
    return clustering.assign(rows, _seeds(rows), DIM)


@query("kmeans_update_step", "SELECT bucket_id, pos, round(avg(u), 6) AS mean FROM (SELECT ka.bucket_id, unnest(v) AS u, generate_subscripts(v, 1) - 1 AS pos FROM ka JOIN e USING (vec_id)) t GROUP BY bucket_id, pos")
def kmeans_update_step(spark, sf_dir):
    rows = table(spark, sf_dir)
    moved = rows.drop("bucket_id").join(clustering.assign(rows, _seeds(rows), DIM), "vec_id")
    return clustering.centroids_long(moved).select("bucket_id", "pos", _fix("mean").alias("mean"))


@query("split_once_assign", "SELECT e.bucket_id, vec_id, CASE WHEN list_distance(v, bv) < list_distance(v, av) THEN 1 ELSE 0 END::BIGINT AS side FROM e JOIN f2 USING (bucket_id)")
def split_once_assign(spark, sf_dir):
    rows = table(spark, sf_dir)
    pair = clustering.farthest_pair(rows, DIM)
    a = rows.select(F.col("vec_id").alias("first"), F.col("embedding").alias("av"))
    b = rows.select(F.col("vec_id").alias("second"), F.col("embedding").alias("bv"))
    ends = pair.join(a, "first").join(b, "second").select("bucket_id", "av", "bv")
    both = rows.join(ends, "bucket_id")
    side = V.l2_squared(F.col("embedding"), F.col("bv"), DIM) < V.l2_squared(F.col("embedding"), F.col("av"), DIM)
    return both.select("bucket_id", "vec_id", side.cast("long").alias("side"))


@query(
    "shard_assignment",
    """SELECT bucket_id, coalesce(arg_min(shard, token) FILTER (token >= h), arg_min(shard, token)) AS shard
FROM (SELECT DISTINCT bucket_id, CAST(concat('0x', substr(md5('bucket:' || bucket_id), 1, 15)) AS BIGINT) AS h FROM e) t,
 (SELECT s AS shard, CAST(concat('0x', substr(md5('node:' || s || ':' || n), 1, 15)) AS BIGINT) AS token FROM generate_series(0, 3) a(s), generate_series(0, 7) b2(n)) u GROUP BY bucket_id""",
)
def shard_assignment(spark, sf_dir):
    return clustering.place_buckets(table(spark, sf_dir).select("bucket_id").distinct(), 4, 8)


# -- lookups, inserts, log --------------------------------------------------------------------


@query("get_by_ids", "SELECT w.pos, vec_id, p, round(u, 6) AS value FROM (SELECT w.pos, vec_id, unnest(v) AS u, generate_subscripts(v, 1) - 1 AS p FROM w JOIN e USING (vec_id)) w")
def get_by_ids(spark, sf_dir):
    found = search.get(table(spark, sf_dir), wanted(spark)).select("pos", "vec_id", F.posexplode("embedding").alias("p", "x"))
    return found.select("pos", "vec_id", F.col("p").cast("long").alias("p"), _fix(F.col("x").cast("double")).alias("value"))


@query("resolve_buckets", "SELECT pos, vec_id, bucket_id FROM w JOIN e USING (vec_id)")
def resolve_buckets(spark, sf_dir):
    return search.get(table(spark, sf_dir), wanted(spark), "bucket_id")


@query("fetch_in_bucket", "SELECT DISTINCT vec_id, bucket_id FROM w JOIN e USING (vec_id) WHERE bucket_id = 3")
def fetch_in_bucket(spark, sf_dir):
    return search.fetch_in_bucket(table(spark, sf_dir), 3, wanted(spark)).select("vec_id", "bucket_id")


@query("log_live_rows", "SELECT count(*) AS n FROM nw WHERE op <> 'D'")
def log_live_rows(spark, sf_dir):
    return vlog.live(synthetic_log(table(spark, sf_dir))).agg(F.count("*").alias("n"))


@query("log_newest_wins", "SELECT vec_id, seq, round(v[1], 6) AS first FROM nw WHERE op <> 'D'")
def log_newest_wins(spark, sf_dir):
    return vlog.live(synthetic_log(table(spark, sf_dir))).select("vec_id", "seq", _fix(F.get("embedding", F.lit(0)).cast("double")).alias("first"))


@query("log_deleted", "SELECT vec_id FROM nw WHERE op = 'D'")
def log_deleted(spark, sf_dir):
    return vlog.deleted(synthetic_log(table(spark, sf_dir)))


@query("log_topic_counts", "SELECT bucket_id, count(*) AS entries, CAST(sum(24 + 4 * coalesce(len(v), 0)) AS BIGINT) AS bytes FROM lg GROUP BY bucket_id")
def log_topic_counts(spark, sf_dir):
    return vlog.entry_counts(synthetic_log(table(spark, sf_dir)))


@query("stats_after_deletes", "SELECT count(DISTINCT bucket_id) AS buckets, count(*) AS vectors, (SELECT count(*) FROM lg WHERE op = 'I') AS inserted_total FROM nw WHERE op <> 'D'")
def stats_after_deletes(spark, sf_dir):
    log = synthetic_log(table(spark, sf_dir))
    total = log.where("op = 'I'").agg(F.count("*").alias("inserted_total"))
    return vlog.live(log).agg(F.countDistinct("bucket_id").alias("buckets"), F.count("*").alias("vectors")).crossJoin(F.broadcast(total))


@query("install_snapshot", "SELECT bucket_id + 100 AS bucket_id, count(*) AS n FROM e WHERE bucket_id % 2 = 0 GROUP BY bucket_id")
def install_snapshot(spark, sf_dir):
    """Two snapshots installed after each other: only the second's buckets are left."""
    from .database import VectorEngine
    from .scratch import folder

    means = clustering.centroids(table(spark, sf_dir))
    db = VectorEngine.open(spark, "installed", folder(spark))
    db.install_snapshot(means)
    db.install_snapshot(means.where("bucket_id % 2 = 0").withColumn("bucket_id", F.col("bucket_id") + 100))
    return db.centroids().select("bucket_id", "n")


@query("namespace_names", r"SELECT source, regexp_replace(source || ' / ' || lang || '.v1', '[^A-Za-z0-9._-]', '_', 'g') AS name FROM (SELECT DISTINCT source, lang FROM documents) t")
def namespace_names(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang").distinct()
    return rows.select("source", naming.namespace_column(F.concat("source", F.lit(" / "), "lang", F.lit(".v1"))).alias("name"))


@query("sample_by_hash_order", "SELECT count(*) AS n, count(DISTINCT vec_id) AS ids FROM (SELECT vec_id FROM e ORDER BY hash(vec_id) LIMIT 40) t")
def sample_by_hash_order(spark, sf_dir):
    from ..functions.sampling import sample_rows

    return sample_rows(table(spark, sf_dir).select("vec_id"), 40, 5, "vec_id").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids"))


# -- searches, pairs, inserts and metadata ----------------------------------------------------


@query("knn_exact_top10", "SELECT qid, rank, vec_id, round(d, 6) AS distance FROM x WHERE rank <= 10")
def knn_exact_top10(spark, sf_dir):
    rows = table(spark, sf_dir)
    return search.knn_exact(rows, asked(rows), 10).withColumn("distance", _fix("distance"))


@query("knn_with_vectors", "SELECT qid, rank, vec_id, pos, round(x1, 6) AS value FROM (SELECT x.qid, x.rank, x.vec_id, unnest(v) AS x1, generate_subscripts(v, 1) - 1 AS pos FROM x JOIN e USING (vec_id) WHERE rank <= 3)")
def knn_with_vectors(spark, sf_dir):
    rows = table(spark, sf_dir)
    found = search.with_vectors(search.knn_exact(rows, asked(rows), 3), rows)
    return found.select("qid", "rank", "vec_id", F.posexplode("embedding").alias("pos", "x")).select("qid", "rank", "vec_id", F.col("pos").cast("long").alias("pos"), _fix(F.col("x").cast("double")).alias("value"))


def _probed(probes: int):
    @query(
        f"knn_probes_{probes}",
        f"SELECT qid, rank, vec_id, round(d, 6) AS distance FROM (SELECT q.qid, vec_id, list_distance(qv, v) AS d, row_number() OVER (PARTITION BY q.qid ORDER BY list_distance(qv, v), vec_id) AS rank FROM q JOIN rr ON q.qid = rr.qid AND rr.rank <= {probes} JOIN e ON e.bucket_id = rr.bucket_id) t WHERE rank <= 10",
    )
    def run(spark, sf_dir):
        rows = table(spark, sf_dir)
        return search.knn_probed(rows, asked(rows), clustering.centroids(rows), 10, probes, DIM).withColumn("distance", _fix("distance"))


for _p in (1, 2, 5, 10):
    _probed(_p)


@query("route_top3", "SELECT qid, rank, bucket_id, round(d, 6) AS distance FROM rr WHERE rank <= 3")
def route_top3(spark, sf_dir):
    rows = table(spark, sf_dir)
    return search.route(asked(rows), clustering.centroids(rows), 3, DIM).select("qid", "rank", "bucket_id", _fix("distance").alias("distance"))


@query("routing_distance", "SELECT qid, bucket_id, round(d, 6) AS distance FROM r")
def routing_distance(spark, sf_dir):
    rows = table(spark, sf_dir)
    return search.route(asked(rows), clustering.centroids(rows), 1 << 30, DIM).select("qid", "bucket_id", _fix("distance").alias("distance"))


@query(
    "recall_at_10",
    "SELECT count(f.vec_id) AS hits, count(*) AS reachable, round(count(f.vec_id) / count(*), 6) AS recall FROM (SELECT qid, vec_id FROM x WHERE rank <= 10) t LEFT JOIN (SELECT qid, vec_id FROM (SELECT q.qid, vec_id, row_number() OVER (PARTITION BY q.qid ORDER BY list_distance(qv, v), vec_id) AS rank FROM q JOIN rr ON q.qid = rr.qid AND rr.rank <= 3 JOIN e ON e.bucket_id = rr.bucket_id) u WHERE rank <= 10) f ON f.qid = t.qid AND f.vec_id = t.vec_id",
)
def recall_at_10(spark, sf_dir):
    rows = table(spark, sf_dir)
    q = asked(rows)
    found = search.knn_probed(rows, q, clustering.centroids(rows), 10, 3, DIM)
    return search.recall(found, search.knn_exact(rows, q, 10)).withColumn("recall", _fix("recall"))


@query(
    "recall_reachable",
    "SELECT count(*) FILTER (rank <= 5) AS hits, count(*) AS reachable, round(count(*) FILTER (rank <= 5) / count(*), 6) AS recall FROM x WHERE rank <= 10 AND vec_id < (SELECT max(vec_id) * 3 // 5 FROM e)",
)
def recall_reachable(spark, sf_dir):
    """Of the ids below three fifths of the largest."""
    rows = table(spark, sf_dir)
    best = search.knn_exact(rows, asked(rows), 10)
    top = rows.agg(F.max("vec_id")).first()[0] or 0
    return search.recall(best.where("rank <= 5"), best, top * 3 // 5).withColumn("recall", _fix("recall"))


@query("dedupe_keep_nearest", "SELECT qid, vec_id, round(min(d), 6) AS distance FROM (SELECT qid, vec_id, d + 0.5 AS d FROM x WHERE rank <= 10 UNION ALL SELECT qid, vec_id, d FROM x WHERE rank <= 15) t GROUP BY qid, vec_id")
def dedupe_keep_nearest(spark, sf_dir):
    rows = table(spark, sf_dir)
    best = search.knn_exact(rows, asked(rows), 15)
    twice = best.where("rank <= 10").withColumn("distance", F.col("distance") + 0.5).unionByName(best)
    return search.keep_nearest(twice).withColumn("distance", _fix("distance"))


def _with_first(rows: DataFrame) -> DataFrame:
    """Each row beside row 0."""
    first = rows.where("vec_id = 0").select(F.col("vec_id").alias("b"), F.col("embedding").alias("bv"))
    return rows.select(F.col("vec_id").alias("a"), F.col("embedding").alias("av")).crossJoin(F.broadcast(first))


_WITH_FIRST = "(SELECT a.vec_id AS a, b.vec_id AS b, a.v AS av, b.v AS bv FROM e a, e b WHERE b.vec_id = 0) t"


@query("l2_pairwise", f"SELECT a, b, round(list_distance(av, bv), 6) AS distance FROM {_WITH_FIRST}")
def l2_pairwise(spark, sf_dir):
    return _with_first(table(spark, sf_dir)).select("a", "b", _fix(V.l2(F.col("av"), F.col("bv"), DIM)).alias("distance"))


@query("l2sq_pairwise", f"SELECT a, b, round(list_sum(list_transform(list_zip(av, bv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS distance FROM {_WITH_FIRST}")
def l2sq_pairwise(spark, sf_dir):
    return _with_first(table(spark, sf_dir)).select("a", "b", _fix(V.l2_squared(F.col("av"), F.col("bv"))).alias("distance"))


@query("center_i8", "SELECT vec_id, pos, CAST(code1 AS BIGINT) AS code FROM (SELECT vec_id, unnest(code) AS code1, generate_subscripts(code, 1) - 1 AS pos FROM ec)")
def center_i8(spark, sf_dir):
    rows = _coded(spark, sf_dir).select("vec_id", F.posexplode(V.centre(F.col("u8"))).alias("pos", "code"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("code").cast("long").alias("code"))


@query("running_mean_insert", "SELECT bucket_id, pos, round(avg(u), 6) AS mean FROM (SELECT bucket_id, unnest(v) AS u, generate_subscripts(v, 1) - 1 AS pos FROM e) t GROUP BY bucket_id, pos")
def running_mean_insert(spark, sf_dir):
    """Centroids of four rows in five moved on by the fifth: (c n + sum) / (n + m)."""
    rows = table(spark, sf_dir)
    first, new = rows.where("vec_id % 5 <> 4"), rows.where("vec_id % 5 = 4")
    n = first.groupBy("bucket_id").agg(F.count("*").alias("n"))
    added = clustering.centroids_long(new).withColumnRenamed("mean", "new").join(new.groupBy("bucket_id").agg(F.count("*").alias("m")), "bucket_id")
    both = clustering.centroids_long(first).join(n, "bucket_id").join(added, ["bucket_id", "pos"], "full")
    a, b = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    return both.select("bucket_id", "pos", _fix((F.coalesce("mean", F.lit(0.0)) * a + F.coalesce("new", F.lit(0.0)) * b) / (a + b)).alias("mean"))


def _incoming(rows: DataFrame) -> DataFrame:
    """Every row by an even id, every 10th twice more by an odd one; about half of the ids are stored."""
    one = rows.select((F.col("vec_id") * 2).alias("vec_id"), F.col("vec_id").alias("seq"), "bucket_id")
    two = rows.where("vec_id % 10 = 0").select((F.col("vec_id") * 2 + 1).alias("vec_id"), (F.col("vec_id") + 1_000_000_000).alias("seq"), "bucket_id")
    return one.unionByName(two).unionByName(two.withColumn("seq", F.col("seq") + 1_000_000_000))


@query("insert_accept", "SELECT vec_id, min(seq) AS seq FROM inc WHERE vec_id NOT IN (SELECT vec_id FROM e) GROUP BY vec_id")
def insert_accept(spark, sf_dir):
    rows = table(spark, sf_dir)
    return ingest.accepted(_incoming(rows), rows).select("vec_id", "seq")


@query("insert_reject", "SELECT vec_id, seq FROM inc WHERE vec_id IN (SELECT vec_id FROM e)")
def insert_reject(spark, sf_dir):
    rows = table(spark, sf_dir)
    return ingest.rejected(_incoming(rows), rows).select("vec_id", "seq")


@query("batch_duplicates", "SELECT vec_id, count(*) AS n FROM inc GROUP BY vec_id HAVING count(*) > 1")
def batch_duplicates(spark, sf_dir):
    return ingest.duplicates(_incoming(table(spark, sf_dir)))


@query(
    "bulk_ingest_batches",
    "SELECT vec_id // 100 AS batch_id, bucket_id, count(*) AS n FROM inc GROUP BY ALL HAVING count(*) = count(DISTINCT vec_id) AND count(*) FILTER (vec_id IN (SELECT vec_id FROM e)) = 0",
)
def bulk_ingest_batches(spark, sf_dir):
    rows = table(spark, sf_dir)
    batches = _incoming(rows).withColumn("batch_id", F.floor(F.col("vec_id") / 100).cast("long"))
    return ingest.accepted_batches(batches, rows).groupBy("batch_id", "bucket_id").agg(F.count("*").alias("n"))


_META = "(SELECT vec_id AS seq, bucket_id, CASE WHEN vec_id % 3 = 0 THEN 'Retired' ELSE 'Active' END AS status FROM e)"


def _meta(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("vec_id").alias("seq"), "bucket_id", F.when(F.col("vec_id") % 3 == 0, "Retired").otherwise("Active").alias("status"))


@query("bucket_meta_latest", f"SELECT bucket_id, arg_max(status, seq) AS status FROM {_META} t GROUP BY bucket_id")
def bucket_meta_latest(spark, sf_dir):
    return vlog.latest_status(_meta(table(spark, sf_dir)))


@query("active_buckets", f"SELECT bucket_id FROM {_META} t GROUP BY bucket_id HAVING arg_max(status, seq) <> 'Retired'")
def active_buckets(spark, sf_dir):
    return vlog.latest_status(_meta(table(spark, sf_dir))).where("status <> 'Retired'").select("bucket_id")


@query(
    "snapshot_replay",
    "SELECT bucket_id, arg_max(n, seq) AS n FROM (SELECT -1 AS seq, bucket_id, count(*) AS n FROM e GROUP BY bucket_id UNION ALL SELECT vec_id, bucket_id, vec_id * 10 FROM e WHERE bucket_id % 3 <> 0) t GROUP BY bucket_id",
)
def snapshot_replay(spark, sf_dir):
    """A snapshot of all buckets; every row of two buckets in three updates it, the third keep their count."""
    rows = table(spark, sf_dir)
    updates = rows.where("bucket_id % 3 <> 0").select(F.col("vec_id").alias("seq"), "bucket_id", (F.col("vec_id") * 10).alias("n"))
    return vlog.replay(bucket_counts(spark, sf_dir), updates)


# -- procedures: what holds of their results -------------------------------------------------


@query("build_clusters", "SELECT vec_id, 1::BIGINT AS copies, true AS same_vector, true AS numbered FROM e")
def build_clusters(spark, sf_dir):
    """Each vector once and unchanged, in buckets numbered from 0 without a gap."""
    rows = table(spark, sf_dir)
    found = clustering.build_clusters(rows, 10)
    ends = found.agg((F.count_distinct("bucket_id") == F.max("bucket_id") + 1).alias("dense"), (F.min("bucket_id") == 0).alias("first"))
    one = found.join(rows.select("vec_id", F.col("embedding").alias("stored")), "vec_id").crossJoin(F.broadcast(ends))  # one row
    return one.groupBy("vec_id").agg(F.count("*").alias("copies"), F.every(F.col("embedding") == F.col("stored")).alias("same_vector"), F.every(F.col("dense") & F.col("first")).alias("numbered"))


@query("rebalance_split", "SELECT vec_id, bucket_id AS parent, CASE WHEN count(*) OVER (PARTITION BY bucket_id) > 50 THEN 2 ELSE 1 END::BIGINT AS parts FROM e")
def rebalance_split(spark, sf_dir):
    """Each vector, the bucket that it comes from, and the number of that bucket's parts: two if it was too large."""
    rows = table(spark, sf_dir).select("bucket_id", "vec_id", "embedding")
    large = sorted(r["bucket_id"] for r in oversized_buckets(spark, sf_dir).collect())
    names = spark.createDataFrame([(10 + 2 * i + side, b) for i, b in enumerate(large) for side in (0, 1)], "bucket_id long, was long")
    found = clustering.split_buckets(rows, large, 10).join(F.broadcast(names), "bucket_id", "left")
    found = found.select("vec_id", "bucket_id", F.coalesce("was", "bucket_id").alias("parent"))
    parts = found.groupBy("parent").agg(F.count_distinct("bucket_id").alias("parts"))
    return found.join(F.broadcast(parts), "parent").select("vec_id", "parent", "parts")


@query("stream_ingest", "SELECT vec_id FROM e")
def stream_ingest(spark, sf_dir):
    from ..streaming.ingest import ingest_stream, stored_vectors
    from .scratch import folder

    rows = table(spark, sf_dir)
    base = folder(spark)
    rows.select("vec_id", "embedding").repartition(4).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("vec_id long, embedding array<float>").option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    ingest_stream(stream, clustering.centroids(rows), DIM, f"{base}/out", f"{base}/check").awaitTermination()
    return stored_vectors(spark, f"{base}/out").select("vec_id")
