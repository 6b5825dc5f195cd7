"""N-gram Jaccard join by a MinHash LSH forest.

Each text is the set of its five-word shingles. In each of TREES trees it has a leaf: its first
minima in a fixed order, as a key whose prefixes are the nodes on the way up, so that the leaves
in order of their keys are the tree's trie. Texts that share the deepest nodes are compared
first, exactly. What these links say of the similarities that occur gives the recall reached at
that depth, band by band; while it is below the target, matched prefixes are shortened to the depth
that should reach it, at most to the one that does so for any pair at the threshold.

Texts are compared in blocks of bounded size, laid out so that those that meet lie together, and
with those of another block only if a node has texts of both: a group of any size is spread over
tasks, a long chain of groups isn't compared all with all, and no list of pairs of texts is ever made. A
comparison yields the links it found per text and a spanning forest of them. Components of these
are the classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, cut, discard, in_bitmap, ranked, small_batches
from .words import mix, shingles, words_of

#: Words of a shingle, and the similarity from which texts are linked.
WORDS, SIMILARITY = 5, 0.8
#: Trees, their greatest depth, and the depths kept above the floor; a label of one has 16 bits.
TREES, DEPTH, LEVELS = 48, 12, 4
#: Share of the links in each band of similarity that has to be found, by estimate.
RECALL = 0.9995
#: Similarities are counted in hundredths; so many make a band.
BAND = 5
#: A block has 2**BLOCK texts, or fewer if they are long: about 2**SHINGLES shingles at most, one text at least.
BLOCK, SHINGLES = 8, 19
#: Rounds in which hubs pass on to texts that meet; they serve the layout alone.
ROUNDS = 2
#: Blocks whose texts meet in a node from which on the blocks are compared as wholes.
WIDE = 4
#: Shingles of a block that are laid out as bits at a time.
CODES = 1 << 15

_MULTIPLY = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_ADD = mix(np.arange(1 << 20, (1 << 20) + TREES * DEPTH, dtype=np.uint64)).astype(np.uint32)


def chance(similarity, depth: int, trees: int = TREES):
    """That two texts share a node of `depth` in any tree."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** trees


def depth_for(similarity: float, recall: float, trees: int = TREES, deepest: int = DEPTH) -> int:
    """The longest prefix at which a pair at the similarity is found with a chance of `recall`; 1 at least."""
    depth = deepest
    while depth > 1 and chance(similarity, depth, trees) < recall:
        depth -= 1
    return depth


def shortened(links: dict[int, int], depth: int, floor: int, recall: float) -> int:
    """The longest prefix, `depth` at most, at which each band of similarity should reach the recall.

    `links` counts the links found at `depth` by hundredths of similarity. A link counts as many times as
    pairs like it are to be expected for one that is found (Horvitz and Thompson's estimate).
    """
    bands: dict[int, list[tuple[float, float]]] = {}
    for hundredths, n in links.items():
        s = min(hundredths, 100) / 100
        bands.setdefault(hundredths // BAND, []).append((s, n / float(chance(s, depth))))
    while depth > floor and any(sum(w * chance(s, depth) for s, w in band) < recall * sum(w for _, w in band) for band in bands.values()):
        depth -= 1
    return depth


def signature(hashes: np.ndarray, floor: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Each tree's leaf: a 64-bit hash of the first `floor` minima, and the labels of `levels` more."""
    depth = floor + levels
    low = np.full(TREES * depth, 0xFFFFFFFF, np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 256):
        part = x[at : at + 256, None] * _MULTIPLY[: len(low)] + _ADD[: len(low)]
        np.minimum(low, part.min(axis=0), out=low)
    rows = low.reshape(TREES, depth).astype(np.uint64)
    node = mix(np.arange(1, TREES + 1, dtype=np.uint64))
    for i in range(floor):
        node = mix(node ^ (rows[:, i] + np.uint64((i + 1) << 32)))
    labels = np.zeros(TREES, np.uint64)
    for i in range(floor, depth):
        labels = (labels << np.uint64(16)) | (rows[:, i] & np.uint64(0xFFFF))
    return node, labels


def _signed(words: int, floor: int, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, nodes, labels, sizes = [], [], [], []
            for text in batch.column(1):
                s = shingles(words_of(text.as_py()), words)
                node, label = signature(s, floor, levels) if len(s) else (None, None)
                sizes.append(len(s))
                sets.append(_name(s) if len(s) else None)
                nodes.append(node.view(np.int64) if len(s) else None)
                labels.append(label.view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.binary()), pa.array(sizes, pa.int32()), pa.array(nodes, pa.list_(pa.int64())), pa.array(labels, pa.list_(pa.int64()))],
                ["doc_id", "text_set", "n", "nodes", "labels"],
            )

    return run


def _name(s: np.ndarray) -> bytes:
    """16 bytes that tell sets of shingles apart."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _shingled(words: int, wanted):
    """Sets of the documents whose id may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wanted.value
        for batch in batches:
            hit = in_bitmap(table, np.asarray(batch.column(0).fill_null(-1), np.int64))
            sets, names = [], []
            for i in np.flatnonzero(hit).tolist():
                s = shingles(words_of(batch.column(1)[i].as_py()), words)
                if len(s):
                    names.append(_name(s))
                    sets.append(s.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.binary())], ["text_set", "shingles"])

    return run


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b): one row per node, `node` and `root`, the smallest node of its component.

    Large-star and small-star steps in turn; each halves the distances that are left and writes
    its links, so that lineage stays short. Smallest neighbours are written before they are joined
    with the links, so that Spark can split a hub's links over tasks. Nothing but one row of counts
    reaches the driver.
    """
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large, "large")
        discard(links, low)
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small")
        discard(large, low)
        row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == before:
            break
        before = (row["n"], row["h"])
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def _compared(similarity: float):
    """Compares one block of texts with another, or with itself."""

    def shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many shingles each text of the left has in common with each of the right."""
        values, flat, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        place = np.cumsum(times > 1) - 1  # a shingle of one text only is shared by none
        keep = (times > 1)[flat]
        rows, codes = rows[keep], place[flat[keep]]
        out = np.zeros((len(left), len(right)), np.int32)
        for at in range(0, int((times > 1).sum()), CODES):
            here = (codes >= at) & (codes < at + CODES)
            dense = np.zeros((len(sets), min(CODES, -(-(int(codes.max()) + 1 - at) // 64) * 64)), bool)
            dense[rows[here], codes[here] - at] = True
            bits = np.packbits(dense, axis=1).view(np.uint64)
            those = bits[right]
            for k, i in enumerate(left):
                out[k] += np.bitwise_count(those & bits[i]).sum(axis=1, dtype=np.int32)
        return out

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        first, second = key
        names = frame["name"].tolist()
        sets = [np.frombuffer(x, "<u8") for x in frame["shingles"]]
        side = frame["block"].to_numpy()
        sizes = np.array([len(s) for s in sets])
        left, right = np.flatnonzero(side == first), np.flatnonzero(side == second)
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "links": [], "hundredths": []})
        common = shared(sets, left, right)
        either = sizes[left][:, None] + sizes[right][None, :] - common
        alike = common >= similarity * either - 1e-9
        if first == second:
            alike &= left[:, None] < right[None, :]
        seen = np.bincount((100 * common[alike] + either[alike] // 100) // either[alike], minlength=101)
        links = np.zeros(len(names), np.int64)
        root = list(range(len(names)))
        forest: list[tuple[bytes, bytes]] = []

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        np.add.at(links, left, alike.sum(axis=1))
        np.add.at(links, right, alike.sum(axis=0))
        for i, row in zip(left.tolist(), alike, strict=True):
            for j in right[row].tolist():
                a, b = top(i), top(j)
                if a != b:
                    root[b] = a
                    forest.append((names[i], names[j]))
        some, bins = np.flatnonzero(links), np.flatnonzero(seen)
        return pd.DataFrame(
            {
                "a": [names[i] for i in some] + [a for a, _ in forest] + [None] * len(bins),
                "b": [None] * len(some) + [b for _, b in forest] + [None] * len(bins),
                "links": [*links[some].tolist(), *[0] * len(forest), *seen[bins].tolist()],
                "hundredths": [-1] * (len(some) + len(forest)) + bins.tolist(),
            }
        )

    return run


def _found(met: DataFrame, sets: DataFrame, key: Column, similarity: float) -> DataFrame:
    """The links among the texts that share a value of `key`: rows of _compared."""
    keyed = met.select("id", key.alias("key"))
    nodes = cut(keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").select("key", "hub"), "nodes")
    ties = cut(keyed.join(nodes, "key"), "ties")
    hubs = cut(ties.groupBy("id").agg(F.min("hub").alias("hub")), "hubs")
    for _ in range(ROUNDS):  # texts that meet by way of others get one hub, and so lie together
        low = cut(ties.select("id", "key").join(hubs, "id").groupBy("key").agg(F.min("hub").alias("hub")), "low")
        fewer = cut(ties.select("id", "key").join(low, "key").groupBy("id").agg(F.min("hub").alias("hub")), "hubs")
        discard(hubs, low)
        hubs = fewer

    # long texts fill blocks of their own, as two that differ much in length aren't alike
    bits = F.least(F.greatest(F.lit(SHINGLES) - F.ceil(F.log2(F.col("n"))), F.lit(0)), F.lit(BLOCK)).cast("int")
    dealt = ranked(hubs.join(sets.select("id", bits.alias("bits")).distinct(), "id"), [F.col("bits"), F.col("hub"), F.col("id")])
    block = F.shiftleft(F.call_function("shiftright", F.col("rank"), F.col("bits")), 4) + F.col("bits")
    placed = cut(dealt.select("id", block.alias("block")), "placed")

    # blocks between which a node lies: a text goes where its own nodes lead, or, if a node has
    # texts of many blocks, with its whole block
    at = cut(ties.join(placed, "id").select("key", "id", "block"), "at")
    spans = cut(at.select("key", F.col("block").alias("other")).distinct(), "spans")
    widths = cut(spans.groupBy("key").agg(F.count("*").alias("width")).where("width > 1"), "widths")
    spans = cut(spans.join(widths, "key"), "across")
    few = at.join(spans.where(F.col("width") <= WIDE), "key").where("block <> other").select("id", "block", "other")
    wide = spans.where(F.col("width") > WIDE).select("key", "other")
    many = wide.withColumnRenamed("other", "block").join(wide, "key").where("block <> other").select("block", "other").distinct()
    sent = placed.withColumn("other", F.col("block")).unionByName(few).unionByName(placed.join(many, "block")).distinct()
    sent = sent.select("id", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    spread = sent.join(sets.select("id", "name", "shingles"), "id").select("first", "second", "block", "name", "shingles")
    found = cut(spread.groupBy("first", "second").applyInPandas(_compared(similarity), "a binary, b binary, links long, hundredths int"), "found")
    discard(nodes, ties, hubs, placed, at, spans, widths)
    return found


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, n_same.

    Two texts are linked if the Jaccard similarity of their sets of `words`-word shingles is at
    least `similarity`; class_id is the smallest doc_id among all that links connect. n_links
    counts the other texts, different as sets, to which a document is linked, n_same the further
    rows of the same set. A text of fewer words than a shingle has, but not none, is one shingle;
    null, empty and wordless texts are linked to nothing and are their own class. A row without a
    doc_id has the class of its text. Prefixes are shortened until `recall` of the links in each band
    of similarity should be found, at most to the depth at which any pair at the threshold is found
    with that chance; what is found is exact. Only doc_id and text are read. Which texts are shingled
    again is told by a bitmap of fixed size; when more than some millions meet, further texts are
    shingled in vain, once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    floor = depth_for(similarity, recall)
    levels = min(LEVELS, DEPTH - floor)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = cut(source.mapInArrow(_signed(words, floor, levels), "doc_id long, text_set binary, n int, nodes array<long>, labels array<long>"), "signed")
    texts = signed.where("text_set is not null").groupBy("text_set").agg(*[F.min("doc_id").alias("first_id"), F.count("*").alias("rows")], *[F.first(c).alias(c) for c in ("n", "nodes", "labels")])
    # a name orders texts by first_id, those without last: a class's smallest name has its class_id.
    # Leaves go by a 64-bit hash; two texts that share one would only be compared needlessly
    first = F.coalesce(F.hex(F.col("first_id").bitwiseXOR(F.lit(-1 << 63))), F.lit(""))
    name = F.unhex(F.concat(F.when(F.col("first_id").isNull(), "01").otherwise("00"), F.lpad(first, 16, "0"), F.hex("text_set")))
    texts = cut(texts.withColumns({"name": name, "id": F.xxhash64("text_set")}), "texts")
    rows = cut(signed.select("doc_id", "text_set"), "rows")
    discard(signed)

    leaves = texts.select("id", F.explode(F.arrays_zip("nodes", "labels")).alias("leaf")).select("id", F.col("leaf.nodes").alias("node"), F.col("leaf.labels").alias("labels"))
    shared = cut(leaves.groupBy("node").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("node"), "shared")
    met = cut(leaves.join(shared, "node", "left_semi"), "met")
    some = cut(met.select("id").distinct().join(texts.select("id", "text_set", "first_id", "name", "n"), "id"), "some")
    wanted = spark.sparkContext.broadcast(bitmap(some, F.coalesce("first_id", F.lit(-1))))
    sets = source.mapInArrow(_shingled(words, wanted), "text_set binary, shingles binary")
    sets = cut(some.select("id", "text_set", "name", "n").join(sets, "text_set").dropDuplicates(["text_set"]).drop("text_set"), "sets")
    discard(shared, some)

    depth = floor + levels
    while True:
        prefix = F.shiftrightunsigned("labels", 16 * (floor + levels - depth)) if depth > floor else F.lit(0)
        found = _found(met, sets, F.xxhash64("node", prefix), similarity)
        seen = found.where("hundredths >= 0").groupBy("hundredths").agg(F.sum("links").alias("n")).collect()  # 101 rows at most
        lower = shortened({r["hundredths"]: r["n"] for r in seen}, depth, floor, recall)
        if lower == depth:
            break
        depth = lower
        discard(found)
    discard(met, sets)

    counts = found.where("b is null and hundredths < 0").groupBy(F.col("a").alias("name")).agg(F.sum("links").alias("n_links"))
    classes = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "name")
    named = texts.select("text_set", "name", "rows").join(classes, "name", "left").join(counts, "name", "left").withColumn("root", F.coalesce("root", "name"))
    least = F.conv(F.hex(F.substring("root", 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-1 << 63))
    class_id = F.when(F.hex(F.substring("root", 1, 1)) == "00", least).alias("class_id")
    named = cut(named.select("text_set", class_id, (F.col("rows") - 1).alias("n_same"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "named")
    discard(texts, found)
    own = F.when(F.col("text_set").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    zero = F.lit(0).cast("long")
    return rows.join(named, "text_set", "left").select(
        "doc_id", own.alias("class_id"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_same", zero).alias("n_same")
    )
