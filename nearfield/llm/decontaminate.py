"""Benchmark decontamination by winnowing.

Every run of GRAM words is hashed, and of each WINDOW consecutive hashes the smallest is
selected, the first of equal ones; each selected run is a fingerprint. A text's equal fingerprints
between equal words are one, with all their places. A
span of GRAM + WINDOW - 1 = 8 words selects the same run wherever it stands, so that equal spans
of eight words or more always share a fingerprint. Documents' fingerprints are first held against
bitmaps of fixed size made of all the benchmark's; the survivors, distinct ones once, are joined
with the benchmark's and extended to both sides, word by word, as far as a window of eight can reach.
Where eight words or more agree the stretch is hit.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, cut, discard, in_bitmap, small_batches
from .words import kgrams, words_of

#: Words of a window, words of a hashed run and hashes of which the smallest is kept.
SPAN, GRAM, WINDOW = 8, 5, 4
#: Words by which a window can exceed a run.
REACH = SPAN - GRAM
#: Fingerprints that a scan holds as Python objects, and after which it passes on its rows.
PRINTS = 4096

_PRINT = pa.struct(
    [("fp", pa.int64()), ("at", pa.list_(pa.int32())), ("n", pa.int32()), ("run", pa.binary()), ("before", pa.list_(pa.binary())), ("after", pa.list_(pa.binary())), ("context", pa.binary())]
)
_DOC = "uid long, doc_id long, n_words long, prints array<struct<fp:long,at:array<int>,n:int,run:binary,before:array<binary>,after:array<binary>,context:binary>>"


def selected(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs that winnowing keeps; none below SPAN words."""
    grams = kgrams(words, GRAM)
    if len(grams) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = np.lib.stride_tricks.sliding_window_view(grams, WINDOW).argmin(axis=1) + np.arange(len(grams) - WINDOW + 1)
    at = least[np.append(True, least[1:] != least[:-1])]  # places never fall back
    return at, grams[at]


def _print(words: list[bytes], fp: int, at: array, n: int) -> dict:
    """A fingerprint with the words around it, the nearest first; n tells whole windows from shorter items."""
    size, reach = (GRAM, REACH) if n == SPAN else (n, 0)
    i = at[0]
    run, before, after = b" ".join(words[i : i + size]), words[max(0, i - reach) : i][::-1], words[i + size : i + size + reach]
    context = hashlib.blake2b(b"%d %d %b\n%b\n%b" % (n, fp, run, b" ".join(before), b" ".join(after)), digest_size=16).digest()
    return {"fp": fp, "at": np.frombuffer(at, np.int32), "n": n, "run": run, "before": before, "after": after, "context": context}


def _prints(words: list[bytes], fps: np.ndarray, at: np.ndarray, n: int) -> Iterator[dict]:
    """Each fingerprint between the same words once with its places; anew after PRINTS others."""
    size, reach = (GRAM, REACH) if n == SPAN else (n, 0)
    places: dict[tuple[int, bytes], tuple[int, array]] = {}
    for begin in range(0, len(at), PRINTS):
        part = slice(begin, begin + PRINTS)
        for i, fp in zip(at[part].tolist(), fps[part].view(np.int64).tolist(), strict=True):
            around = min(i, reach), b" ".join(words[max(0, i - reach) : i + size + reach])
            if around in places:
                places[around][1].append(i)
            else:
                places[around] = fp, array("i", [i])
        if len(places) >= PRINTS or part.stop >= len(at):
            for fp, each in places.values():
                yield _print(words, fp, each, n)
            places = {}


def _scan(spans, known, windows):
    """A function for mapInArrow: fingerprints that are in `known` and near a window in `windows` (None: all)."""

    def prints(words: list[bytes], span: int) -> Iterator[dict]:
        at, fps = selected(words) if span == SPAN else (np.arange(max(0, len(words) - span + 1)), kgrams(words, span))
        if known is not None and len(fps):
            hit = in_bitmap(known.value, fps)
            at, fps = at[hit], fps[hit]
            if span == SPAN and len(fps):
                upto = np.append(0, np.cumsum(in_bitmap(windows.value, kgrams(words, SPAN))))
                near = upto[np.minimum(at + 1, len(upto) - 1)] > upto[np.maximum(at - REACH, 0)]
                at, fps = at[near], fps[near]
        return _prints(words, fps, at, span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            begin, counts, upto, done, loose = 0, [], [0], [], []
            for row, text in enumerate(batch.column(1), 1):
                words = words_of(text.as_py())
                own = spans if spans is not None else [min(SPAN, len(words))] if words else []
                counts.append(len(words))
                for p in (p for span in own for p in prints(words, span)):
                    loose.append(p)
                    if len(loose) >= PRINTS:
                        done.append(pa.array(loose, _PRINT))
                        loose = []
                upto.append(sum(map(len, done)) + len(loose))
                if upto[-1] >= PRINTS or row == batch.num_rows:
                    found = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.concat_arrays([*done, pa.array(loose, _PRINT)]))
                    uids = np.arange(uid + begin, uid + row)
                    yield pa.RecordBatch.from_arrays([pa.array(uids), batch.column(0)[begin:row], pa.array(counts, pa.int64()), found], ["uid", "doc_id", "n_words", "prints"])
                    begin, counts, upto, done, loose = row, [], [0], [], []
            uid += batch.num_rows

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        each = [np.empty(0, np.uint64), *(kgrams(words_of(text.as_py()), SPAN) for text in batch.column(1))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each).view(np.int64))], ["w"])


def _agreeing(a: str, b: str) -> Column:
    """How many words two arrays agree in from the start on, REACH at most."""
    out = F.lit(0)
    for i in range(REACH - 1, -1, -1):
        out = F.when(F.get(a, F.lit(i)) == F.get(b, F.lit(i)), 1 + out).otherwise(0)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = 2) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_long_items.

    Null, empty and wordless texts have no words and no hits. Items without words have no
    window; a repeated item_id counts once. Repeated documents get a row each. An empty
    benchmark or table gives zero hits or no rows. Only doc_id, text and item_id, text are
    read, so further columns never clash. n_long_items counts only items of whole windows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    held = cut(items.mapInArrow(_scan(None, None, None), _DOC).select(F.col("doc_id").alias("item"), F.explode("prints").alias("p")).select("item", "p.*"), "held")
    entries = cut(held.groupBy("context").agg(*[F.first(c).alias(c) for c in ("fp", "n", "run", "before", "after")]), "entries")
    spans = sorted(r["n"] for r in entries.select("n").distinct().collect())  # at most SPAN values
    known = spark.sparkContext.broadcast(bitmap(entries, F.col("fp")))
    windows = spark.sparkContext.broadcast(bitmap(items.mapInArrow(_windows, "w long"), F.col("w")))
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    seen = cut(source.mapInArrow(_scan(spans, known, windows), _DOC), "scanned")

    # each distinct context of a fingerprint is held against the benchmark's once, however many documents have it
    prints = seen.where(F.size("prints") > 0).select("uid", F.explode("prints").alias("p")).select("uid", "p.*")
    asked = cut(prints.groupBy("context").agg(*[F.first(c).alias(c) for c in ("fp", "n", "run", "before", "after")]), "asked")
    there = entries.select("fp", "n", "run", F.col("context").alias("entry"), F.col("before").alias("b"), F.col("after").alias("a"))
    both = asked.join(there, ["fp", "n", "run"]).select("context", "entry", "n", _agreeing("before", "b").alias("back"), _agreeing("after", "a").alias("on"))
    size = F.when(F.col("n") == SPAN, GRAM).otherwise(F.col("n"))
    both = both.where((F.col("n") < SPAN) | (F.col("back") + F.col("on") >= REACH)).select("context", "entry", "back", (F.col("on") + size).alias("on"))
    # what agrees around one run is one stretch, as far as the farthest entries reach
    met = both.groupBy("context").agg(F.max("back").alias("back"), F.max("on").alias("on"), F.array_sort(F.collect_set("entry")).alias("entries"))
    met = cut(met.withColumn("set", F.sha2(F.array_join(F.transform("entries", F.hex), ","), 256)), "met")
    hits = prints.select("uid", "at", "context").join(met.drop("entries"), "context")
    stretches = F.transform("at", lambda at: F.struct((at - F.col("back")).alias("s"), (at + F.col("on")).alias("e")))
    covered = F.expr(
        "aggregate(array_sort(flatten(stretches)), struct(0L as n, 0 as upto),"
        " (a, x) -> struct(a.n + greatest(0, x.e - greatest(x.s, a.upto)) as n, greatest(a.upto, x.e) as upto)).n"
    )
    per = hits.groupBy("uid").agg(F.collect_list(stretches).alias("stretches"), F.array_sort(F.collect_set("set")).alias("sets"))
    per = cut(per.select("uid", covered.alias("n_hit"), "sets", F.sha2(F.array_join("sets", ","), 256).alias("group")), "per")

    # items are gathered once for all documents that hit the same sets of entries
    members = held.select(F.col("context").alias("entry"), "item", "n").distinct()
    entries_of = met.groupBy("set").agg(F.first("entries").alias("entries"))
    groups = per.groupBy("group").agg(F.first("sets").alias("sets")).select("group", F.explode("sets").alias("set")).join(entries_of, "set")
    groups = groups.select("group", F.explode("entries").alias("entry")).join(members, "entry")
    groups = groups.groupBy("group").agg(F.collect_set("item").alias("items"), F.count_distinct(F.when(F.col("n") == SPAN, F.col("item"))).alias("n_long_items"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    groups = cut(groups.select("group", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), "n_long_items"), "groups")
    discard(asked, entries, met)
    zero = F.lit(0).cast("long")
    kept = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "n_long_items"]
    some = seen.where(F.size("prints") > 0).select("uid", "doc_id", "n_words").join(per.join(groups, "group"), "uid", "left").select(*kept)
    none = seen.where(F.size("prints") == 0).select("doc_id", "n_words")
    return some.unionByName(none, allowMissingColumns=True).select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", zero).cast("long").alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.coalesce("n_items", zero) >= min_items).alias("contaminated"),
        F.coalesce("n_long_items", zero).alias("n_long_items"),
    )
