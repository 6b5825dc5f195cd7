"""A training corpus from `documents`: five stages, each over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import common, decontaminate, mixing, near_duplicates, quality, queries, tokens

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Names a row of a stage's input: doc_ids can be null, repeated, or shared by different texts.
ROW = "_row"


#: Keyed copies that the stages so far have left, by application.
_left: dict[str, list[DataFrame]] = {}


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs with a key of each row, written once so that every reader sees the same.

    A task's number is spread over the key's low bits, by which near_duplicates fills a bitmap. A copy
    that an earlier stage left goes once docs comes from files written after it: that stage's result
    has been written by then, and mustn't be read again. Where docs isn't read from files, copies stay.
    """
    spark, read = docs.sparkSession, docs.inputFiles()
    left = _left.setdefault(spark.sparkContext.applicationId, [])
    since = min((common.written(spark, file) for file in (read[0], read[-1])), default=0) if read else 0
    for old in [x for x in left if common.written(spark, x._cut) < since and not any(x._cut.rpartition("/")[2] in file for file in read)]:
        left.remove(old)
        common.discard(old)
    spread = (F.spark_partition_id().cast("long") * 0x9E3779B1).bitwiseAND((1 << 33) - 1)
    left.append(common.cut(docs.select(*COLUMNS, F.monotonically_increasing_id().bitwiseXOR(spread).alias(ROW)), name))
    return left[-1]


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return docs.join(rows.select(ROW), ROW, "left_anti").select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, as poor or toxic, go."""
    docs = _keyed(docs, "judged")
    return _without(docs, quality.classify(docs, common.read(spark, sf_dir, "labels"), key=ROW).where("rejected"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays, that of the smallest doc_id, null last.

    A text without words is in no class but with rows of the same doc_id and text.
    """
    docs = _keyed(docs, "compared")
    found = near_duplicates.near_duplicates(docs.select(F.col(ROW).alias("doc_id"), "text")).withColumnRenamed("doc_id", ROW)
    ids = docs.select(ROW, "doc_id", F.xxhash64("text").alias("same"))
    alone = F.col("doc_id").isNotNull() & (F.col("class_id") == F.col(ROW)) & (F.col("n_links") == 0) & (F.col("n_same") == 0)
    classes = found.join(ids, ROW).groupBy(F.when(alone, F.col("doc_id")).alias("own"), F.when(alone, F.col("same")).otherwise(F.col("class_id")).alias("class"))
    kept = classes.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return docs.join(kept, ROW, "left_semi").select(*COLUMNS)


def clear_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any whole window of a benchmark item, or with two items, go."""
    docs = _keyed(docs, "searched")
    found = decontaminate.decontaminate(docs.select(F.col(ROW).alias("doc_id"), "text"), common.read(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated or n_long_items > 0").withColumnRenamed("doc_id", ROW))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; picks go by a hash of the whole row, so that a rerun's are alike."""
    docs = _keyed(docs, "weighed")
    taken = mixing.mix(docs.withColumn("doc_id", F.xxhash64(*COLUMNS)), carry=(ROW,)).where("repeats > 0").select(ROW, "repeats")
    return docs.join(taken, ROW).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files, as they read back."""
    return tokens.token_files(docs, queries.tokenizer_json())


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", clear_of_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", encoded),
]

#: A trained classifier and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.cut(docs, f"stage{i + 1}")
    return docs
