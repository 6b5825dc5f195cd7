"""What may enter: duplicate ids within a batch or against what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(batch: DataFrame) -> DataFrame:
    """vec_id, n of ids that a batch holds more than once."""
    return batch.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1")


def accepted(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of new ids; of an id that the batch repeats the first by `seq` enters."""
    fresh = batch.join(stored.select("vec_id"), "vec_id", "left_anti")
    rest = [c for c in batch.columns if c not in ("vec_id", "seq")]
    return fresh.groupBy("vec_id").agg(F.min_by(F.struct("seq", *rest), "seq").alias("r")).select("vec_id", "r.seq", *[f"r.{c}" for c in rest])


def rejected(batch: DataFrame, stored: DataFrame) -> DataFrame:
    return batch.join(stored.select("vec_id"), "vec_id", "left_semi")


def accepted_batches(batches: DataFrame, stored: DataFrame) -> DataFrame:
    """Whole batches (batch_id, bucket_id, ...) without a repeated or a stored id."""
    key = ["batch_id", "bucket_id"]
    twice = batches.groupBy(*key, "vec_id").agg(F.count("*").alias("n")).where("n > 1").select(*key)
    known = batches.join(stored.select("vec_id"), "vec_id", "left_semi").select(*key)
    return batches.join(twice.unionByName(known).distinct(), key, "left_anti")
