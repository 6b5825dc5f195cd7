"""Token ids as entropy-coded blocks.

Texts are encoded by the tokenizers library and laid out in ascending document order. One
frequency table, counted over all ids, is shared by blocks of whole documents, which are
written as rows of a Parquet table (`blocks`) beside the table of frequencies (`table`).
See rans.py for the coder. Anything that Spark can read can so hold the files, and each
block decodes by itself.
"""

from __future__ import annotations

import codecs
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .common import remove, scratch, small_batches

#: Ids from which on a block is closed at the next document's end.
BLOCK = 1 << 17
#: Pieces whose ids a worker remembers, in each of two generations.
MEMO = 400_000
#: Blocks that a worker codes side by side.
ABREAST = 8
#: Stretches of document ids for each shuffle partition.
STRETCHES = 8

#: Letters of scripts whose texts take the quick way; other texts go to the library whole.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ʯΑ-ΡΣ-ώА-я"
_PLAIN = re.compile(f"[\t\n\r\x20-~¡¿«»‐-―‘-•…€{_LETTERS}]*")
#: The tokenizer's pre-tokens, as they are where no other characters occur.
_PIECES = re.compile(rf" ?[{_LETTERS}]++|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]++| ?[^\s0-9{_LETTERS}]++|\s+(?!\S)|\s+")


class Encoder:
    """Ids of texts as bytes, with a memory of the pieces between which no merge reaches.

    A byte-level tokenizer without a normalizer merges within pre-tokens only, so that equal
    pre-tokens always give equal ids: each is put through the library's model once while
    remembered, in one of two generations.
    """

    def __init__(self, spec: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        parsed = json.loads(spec)
        pre = parsed.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not parsed.get("normalizer")
        self.by_piece &= not parsed.get("truncation") and not parsed.get("padding")
        self.added = [x["content"] for x in parsed.get("added_tokens", [])]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.shown = "".join(chr(c if c in shown else next(other)) for c in range(256))
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        mapped = codecs.charmap_decode(piece.encode(), "strict", self.shown)[0]
        return array(self.kind.char, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _pieces(self, text: str) -> bytes:
        pieces = _PIECES.findall(text)
        newer, older = self.newer, self.older
        out = list(map(newer.get, pieces))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    piece = pieces[i]
                    ids = newer.get(piece) or older.get(piece) or self._piece(piece)
                    newer[piece] = out[i] = ids
            if len(newer) >= MEMO:
                self.newer, self.older = {}, newer
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Null counts as empty."""
        if not text:
            return b""
        if not self.by_piece or any(x in text for x in self.added) or not _PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return self._pieces(text)


_encoders: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]


#: Stands for a null doc_id, which comes first.
_NULL = -(1 << 63)


def stretches(quantiles: list[float], ids: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The stretch of each id, ascending with the ids.

    Quantiles cut the ids into even shares. An id that takes several of them holds that many shares of the
    rows, and gets as many stretches, dealt by the row's turn.
    """
    cuts, shares = np.unique(np.array(quantiles, np.int64), return_counts=True)
    own = np.where(shares > 1, shares, 0)  # stretches of the id itself, before those of the ids after it
    first = np.concatenate([[0], 1 + np.cumsum(np.concatenate([[0], own + 1]))[:-1]])
    at = np.searchsorted(cuts, ids, side="right")
    own = np.concatenate([[0], own])
    hot = (own[at] > 0) & (ids == np.concatenate([[0], cuts])[at])
    return first[at] + np.where(hot, turn % np.maximum(own[at], 1), own[at])


def _tokenise(spec, quantiles, end_id):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = _encoder(spec.value), 0
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            ids = [encoder.encode(x.as_py()) + end for x in batch.column(1)]
            doc = batch.column(0)
            part = stretches(quantiles, np.asarray(doc.fill_null(_NULL), np.int64), np.arange(seen, seen + len(doc)))
            seen += len(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), doc, pa.array([len(x) // encoder.kind.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["part", "doc_id", "n_tokens", "ids"],
            )

    return run


def _tally(kind, size):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return run


_BLOCK = "first long, lanes int, n long, doc_ids array<long>, lengths array<long>, words binary, states binary, places binary, crc32 long"
_BLOCK_ARROW = pa.schema(
    [("first", pa.int64()), ("lanes", pa.int32()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("states", pa.binary()), ("places", pa.binary()), ("crc32", pa.int64())]
)


def _blocks(freq, kind, offsets):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(freq.value)
        ready: list[tuple[int, list]] = []  # blocks not coded yet: their first id's place and documents
        held: list[tuple[int | None, bytes]] = []
        first, upto = 0, None

        def flush():
            coded = rans.encode([np.frombuffer(b"".join(x for _, x in docs), kind) for _, docs in ready], table)
            rows = [
                block | {"first": start, "doc_ids": [d for d, _ in docs], "lengths": [len(x) // kind.itemsize for _, x in docs]}
                for (start, docs), block in zip(ready, coded, strict=True)
            ]
            ready.clear()
            return pa.RecordBatch.from_pylist(rows, schema=_BLOCK_ARROW)

        for batch in batches:
            for part, before, doc, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                start = offsets[part] + before
                if held and (start != upto or upto - first >= BLOCK):
                    ready.append((first, held))
                    held = []
                    if len(ready) == ABREAST:
                        yield flush()
                if not held:
                    first = start
                held.append((doc, ids))
                upto = start + len(ids) // kind.itemsize
        if held:
            ready.append((first, held))
        if ready:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, spec: str, end_id: int = 0) -> None:
    """Encode each row's whole text, append end_id, and write the files below `path`.

    `spec` is the tokenizer's JSON. Rows are laid out by ascending doc_id, null first, ties by
    their ids; a repeated row is written again. Rows of one doc_id, or of none, that make up several shares of the
    table are dealt over that many stretches in the order of the input's files, each sorted by itself. Null and empty texts are just end_id. An empty
    table gives files without blocks. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sc = spark.sparkContext
    size = max(end_id, *map(int, re.findall(r'":\s*(\d+)', spec))) + 1  # ids of vocabulary and added tokens, without parsing them all
    kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = width * STRETCHES
    ids = source.select(F.coalesce("doc_id", F.lit(_NULL)).cast("double").alias("id"))
    quantiles = ids.approxQuantile("id", [i / n for i in range(1, n)], 1 / (4 * n))
    tokens = source.mapInArrow(_tokenise(sc.broadcast(spec), quantiles, end_id), "part int, doc_id long, n_tokens long, ids binary")
    order = Window.partitionBy("part").orderBy("doc_id", "n_tokens", "ids")
    ahead = F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    held = f"{path}/ids"
    tokens.repartition(width, "part").select("part", ahead, "doc_id", "ids", "n_tokens").write.option("compression", "zstd").parquet(held)
    tokens = spark.read.schema("part int, before long, doc_id long, ids binary, n_tokens long").parquet(held)

    offsets, before = {}, 0  # one number for each stretch, whose count is a parameter
    for row in sorted(tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        offsets[row["part"]] = before
        before += row["n"]
    counts = np.zeros(size, np.int64)  # one number for each entry of the vocabulary
    tally = tokens.select("ids").mapInArrow(_tally(kind, size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts[tally["id"].to_numpy()] = tally["n"].to_numpy()
    freq = rans.scale(counts)
    spark.createDataFrame(pa.table({"id": np.flatnonzero(freq), "freq": freq[freq > 0]})).coalesce(1).write.parquet(f"{path}/table")
    blocks = tokens.select("part", "before", "doc_id", "ids").mapInArrow(_blocks(sc.broadcast(freq), kind, offsets), _BLOCK)
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    remove(spark, held)


def _decoded(freq, with_ids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(freq.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ABREAST):
                blocks = batch.slice(at, ABREAST).to_pylist()
                for block, ids in zip(blocks, rans.decode(blocks, table), strict=True):
                    raw = ids.astype("<u4").tobytes()
                    ends = np.cumsum(np.array(block["lengths"], np.int64))
                    starts = ends - np.array(block["lengths"], np.int64)
                    each = [raw[4 * a : 4 * z] for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                    columns = {
                        "doc_id": pa.array(block["doc_ids"], pa.int64()),
                        "start": pa.array(starts + block["first"], pa.int64()),
                        "n_tokens": pa.array(ends - starts, pa.int64()),
                        "ids_crc32": pa.array(list(map(zlib.crc32, each)), pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array(each, pa.binary())
                    yield pa.RecordBatch.from_pydict(columns)

    return run


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian 32-bit)."""
    small_batches(spark)
    table = spark.read.schema("id long, freq long").parquet(f"{path}/table").toArrow()  # at most the vocabulary
    freq = np.zeros(int(np.max(table["id"].to_numpy(), initial=-1)) + 1, np.int64)
    freq[table["id"].to_numpy()] = table["freq"].to_numpy()
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    return blocks.mapInArrow(_decoded(spark.sparkContext.broadcast(freq), ids), kind)


def token_files(docs: DataFrame, spec: str, end_id: int = 0) -> DataFrame:
    """Write the ids of docs to the shared scratch area and read them back."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, spec, end_id)
    return read_tokens(docs.sparkSession, path)
