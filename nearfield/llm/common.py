"""What the operators share: the scratch area, cut lineage, bounded bitmaps."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Slots of a membership bitmap: 2 MiB, whatever the input.
BITMAP_BITS = 24

_own_dir: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, the folder all executors share.

    Where the setting is absent, a temporary folder is made if everything runs on one machine;
    on a cluster, whose executors wouldn't share it, the call fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="nearfield-"))
        base = "file://" + _own_dir[0]
    return f"{base.rstrip('/')}/nearfield-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch area and read it back: later jobs restart from the files."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._cut = path
    return held


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(spark: SparkSession, path: str) -> int:
    """When a file was written, by the clock of where it is stored."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime()


def discard(*tables: DataFrame) -> None:
    """Remove tables that `cut` has written and nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table._cut)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of documents can hold in a Python worker, and bring it this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bitmap(df: DataFrame, key: Column, bits: int = BITMAP_BITS) -> np.ndarray:
    """Which slots of 2**bits the long `key` takes; at most 2**(bits-6) rows reach the driver."""
    slot = F.pmod(key, F.lit(1 << bits))
    words = (
        df.select(slot.alias("slot"))
        .where("slot is not null")
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("mask"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each 64-bit key's slot is set; no false negatives."""
    slot = keys.view(np.uint64) & np.uint64(len(table) * 64 - 1)
    word = table[(slot >> np.uint64(6)).astype(np.int64)]
    return (word >> (slot & np.uint64(63))) & np.uint64(1) == 1


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add each row's 0-based global position without gathering the rows in one task.

    Rows are range-partitioned, sorted and written once; only one count per partition reaches
    the driver. Ties in `order` take any order.
    """
    spark = df.sparkSession
    keys = [f"_k{i}" for i in range(len(order))]
    dealt = df.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    placed = cut(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, at = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND((1 << 33) - 1)
    before, offsets = 0, []
    for row in sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        offsets.append((row["part"], before))
        before += row["n"]
    base = spark.createDataFrame(offsets, "_part int, _before long")
    return placed.join(F.broadcast(base), part == base["_part"]).withColumn(name, F.col("_before") + at).drop("_part", "_before", "_at")
