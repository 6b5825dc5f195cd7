"""Vector benchmark files. Ids are the 0-based place of a record within its file.

Files are read through Spark's binaryFile source, so that any store it reaches will do, and
parsed in workers. A format whose records can't be told apart without reading from the start
takes one task per file. Unpacked record files of over WHOLE bytes are read by ranges instead, whose
records must then be of one length; compressed and f32bin files end at 2 GB.
"""

from __future__ import annotations

import gzip
import io
import struct
import tarfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

#: Vectors of one parsed batch.
BATCH = 10_000
#: Bytes of a file that a task takes whole.
WHOLE = 512 << 20
_VECTORS = "vec_id long, embedding array<float>"


def _vectors(start: int, x: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(x.reshape(-1).astype(np.float32))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(x))), lists], ["vec_id", "embedding"])


def _records(data: bytes, dtype: str) -> Iterator[np.ndarray]:
    """Of {u32 n, n values} repeated, runs of records of one length; a torn record is an error."""
    item, at, run = np.dtype(dtype).itemsize, 0, []
    while at < len(data):
        if len(data) - at < 4:
            raise ValueError("truncated header")
        (n,) = struct.unpack_from("<I", data, at)
        if at + 4 + n * item > len(data):
            raise ValueError("truncated record")
        row = np.frombuffer(data, dtype, n, at + 4)
        if run and (len(run[-1]) != n or len(run) == BATCH):
            yield np.stack(run)
            run = []
        run.append(row)
        at += 4 + n * item
    if run:
        yield np.stack(run)


def parse_records(data: bytes, dtype: str) -> Iterator[pa.RecordBatch]:
    at = 0
    for x in _records(data, dtype):
        yield _vectors(at, x)
        at += len(x)


def parse_flat(data: bytes) -> Iterator[pa.RecordBatch]:
    """u32 dim, u64 count, count x dim f32; bytes beyond are ignored."""
    if len(data) < 12:
        raise ValueError("file too small for its header")
    dim, count = struct.unpack_from("<IQ", data)
    if 12 + 4 * dim * count > len(data):
        raise ValueError("payload truncated")
    x = np.frombuffer(data, "<f4", dim * count, 12).reshape(count, dim) if dim else np.empty((0, 1), np.float32)
    for at in range(0, len(x), BATCH):
        yield _vectors(at, x[at : at + BATCH])


def parse_truth(data: bytes) -> Iterator[pa.RecordBatch]:
    """qid, rank, vec_id of the first *.ivecs member of a gzipped tar."""
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as tar:
        member = next((m for m in tar if m.name.endswith(".ivecs")), None)
        if member is None:
            raise ValueError("no ivecs member")
        body = tar.extractfile(member).read()
    at = 0
    for x in _records(body, "<u4"):
        n, k = x.shape
        qid, rank = np.repeat(np.arange(at, at + n), k), np.tile(np.arange(1, k + 1), n)
        yield pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(rank, pa.int64()), pa.array(x.reshape(-1).astype(np.int64))], ["qid", "rank", "vec_id"])
        at += n


def _read(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[pa.RecordBatch]], kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from parse(content.as_py())

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, kind)


def _placed(dtype: str, n: int):
    """Vectors of records of n values, which come with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([("n", "<u4"), ("x", dtype, (n,))])
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), kind)
            if (rows["n"] != n).any():
                raise ValueError("records of several lengths in a file that is read by ranges")
            flat = pa.array(rows["x"].reshape(-1).astype(np.float32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * n, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["vec_id", "embedding"])

    return run


def _by_ranges(spark: SparkSession, path: str, length: int, dtype: str) -> DataFrame:
    """A file of records of one length, in as many tasks as it has blocks, whatever its size."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        (n,) = struct.unpack("<I", bytes(stream.readNBytes(4)))
    finally:
        stream.close()
    size = 4 + n * np.dtype(dtype).itemsize
    if length % size:
        raise ValueError("truncated record, or records of several lengths in a file that is read by ranges")
    form = "org.apache.spark.input.FixedLengthBinaryInputFormat"
    records = spark.sparkContext.newAPIHadoopFile(path, form, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={f"{form}.recordLength": str(size)})
    rows = spark.createDataFrame(records.map(lambda r: (r[0], bytearray(r[1]))), "at long, record binary")
    return rows.mapInArrow(_placed(dtype, n), _VECTORS)


def _read_records(spark: SparkSession, path: str, dtype: str) -> DataFrame:
    """Files of {u32 n, n values} repeated."""
    ship(spark)
    every = spark.read.format("binaryFile").load(path)
    large = every.where(every["length"] > WHOLE).select("path", "length").collect()  # names only, one a file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from parse_records(content.as_py(), dtype)

    out = every.where(every["length"] <= WHOLE).select("content").mapInArrow(run, _VECTORS)
    for file in large:
        out = out.unionByName(_by_ranges(spark, file["path"], file["length"], dtype))
    return out


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    return _read_records(spark, path, "<f4")


def read_bvecs_gz(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, lambda data: parse_records(gzip.decompress(data), "u1"), _VECTORS)


def read_f32bin(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, parse_flat, _VECTORS)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, parse_truth, "qid long, rank long, vec_id long")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By the name's ending: .fvecs, .bvecs (either gzipped) or .bin."""
    plain = path.removesuffix(".gz")
    dtype = "<f4" if plain.endswith(".fvecs") else "u1" if plain.endswith(".bvecs") else None
    if dtype and path.endswith(".gz"):
        return _read(spark, path, lambda data: parse_records(gzip.decompress(data), dtype), _VECTORS)
    if dtype:
        return _read_records(spark, path, dtype)
    if path.endswith(".bin"):
        return read_f32bin(spark, path)
    raise ValueError(f"unknown extension: {path}")


def convert(spark: SparkSession, source: str, target: str) -> int:
    """Read a vector file and write it as Parquet; its number of vectors. Mixed dimensions or none are errors."""
    from pyspark.sql import functions as F

    rows = read_any(spark, source)
    sizes = rows.agg(F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b"), F.count("*").alias("n")).first()
    if not sizes["n"]:
        raise ValueError("empty input")
    if sizes["a"] != sizes["b"]:
        raise ValueError("dimension changes within the input")
    rows.write.mode("overwrite").parquet(target)
    return sizes["n"]


def flat_bytes(x: np.ndarray) -> bytes:
    """The f32bin file of a matrix; for fixtures."""
    return struct.pack("<IQ", x.shape[1], x.shape[0]) + x.astype("<f4").tobytes()


def encode_record(vec_id: int, v: list[float]) -> bytes:
    """A log record: u64 payload length, u64 id, u64 dimension, f32 components."""
    return struct.pack("<QQQ", 16 + 4 * len(v), vec_id, len(v)) + np.asarray(v, "<f4").tobytes()


def decode_records(data: bytes) -> Iterator[tuple[int, list[float]]]:
    """Records of a log; malformed ones are skipped, a torn end is left out."""
    at = 0
    while at + 8 <= len(data):
        (size,) = struct.unpack_from("<Q", data, at)
        payload = data[at + 8 : at + 8 + size]
        at += 8 + size
        if len(payload) < size or size < 16:
            continue
        vec_id, dim = struct.unpack_from("<QQ", payload)
        if 16 + 4 * dim <= size:
            yield vec_id, np.frombuffer(payload, "<f4", dim, 16).tolist()
