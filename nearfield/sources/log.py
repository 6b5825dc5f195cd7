"""The append-only vector log: bucket_id, seq, op ('I' or 'D'), vec_id, embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "seq long, op string, vec_id long, embedding array<float>, bucket_id long"


def newest(log: DataFrame) -> DataFrame:
    """The latest row of each vec_id, tombstones included; one partial aggregate, one shuffle."""
    rest = [c for c in log.columns if c not in ("vec_id", "seq")]
    return log.groupBy("vec_id").agg(F.max_by(F.struct(*rest), "seq").alias("r"), F.max("seq").alias("seq")).select("vec_id", "seq", *[F.col(f"r.{c}").alias(c) for c in rest])


def live(log: DataFrame) -> DataFrame:
    """What is stored: newest wins, and a tombstone hides what is older."""
    return newest(log).where(F.col("op") != "D")


def deleted(log: DataFrame) -> DataFrame:
    return newest(log).where(F.col("op") == "D").select("vec_id")


def entry_counts(log: DataFrame) -> DataFrame:
    """Per bucket the entries, tombstones included, and the bytes they take as records."""
    size = F.lit(24) + 4 * F.coalesce(F.size("embedding"), F.lit(0))
    return log.groupBy("bucket_id").agg(F.count("*").alias("entries"), F.sum(size).cast("long").alias("bytes"))


def latest_status(meta: DataFrame) -> DataFrame:
    """The latest status of each bucket of meta (seq, bucket_id, status)."""
    return meta.groupBy("bucket_id").agg(F.max_by("status", "seq").alias("status"))


def replay(snapshot: DataFrame, updates: DataFrame) -> DataFrame:
    """bucket_id, n of a snapshot and the updates after it; the latest update of a bucket wins."""
    both = snapshot.select(F.lit(-1).cast("long").alias("seq"), "bucket_id", "n").unionByName(updates.select("seq", "bucket_id", "n"))
    return both.groupBy("bucket_id").agg(F.max_by("n", "seq").alias("n"))
