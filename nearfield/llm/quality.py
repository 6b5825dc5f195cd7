"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A document's own evidence comes from two logistic models, one for poor and one for toxic
text, fitted on a bounded sample of labelled documents: how a text is written (case, signs,
repetition) and which words and word beginnings it uses. Evidence is summed by host and by
path within host; each host's rate of bad documents is shrunk towards the global one and each
path's towards its host's, with strengths that the spread between groups itself gives. The
document's evidence and its path's posterior, the document itself left out, then decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .words import distinct, hashes, words_of

#: Labelled documents fitted on at most, picked by the hash of their ids; the one bound here.
SAMPLE = 6_000
#: Slots of hashed words and word beginnings.
SLOTS = 1 << 18
#: Slots of a labelled document that are fitted on at most, the same ones of all documents first; others are scored with all.
FITTED = 1 << 12
#: Bytes of a word's beginning.
BEGIN = 4
#: Strongest words of a text that are weighed one by one.
TOP = 6
#: Parts into which labelled documents fall while words are weighed.
FOLDS = 5
#: Logit where labels of both kinds are missing: nothing speaks against a document.
NO_EVIDENCE = -20.0
#: Part of a path's posterior that is added to the document's own evidence.
TRUST = 0.5

_PLAIN = bytes(c for c in range(256) if c not in b"!*#%$&|<>=_{}[]/\\@~^+")
_NO_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """How a text is written, and the distinct slots of its words and their beginnings.

    Both are sums over the whole text.
    """
    raw = text.encode("utf-8", "replace")
    words = words_of(text)
    size, n = len(raw) or 1, len(words) or 1
    seen, pairs, starts = hashes(words, (1, 2), BEGIN)
    whole, starts = distinct(seen), distinct(starts)
    signs = len(raw.translate(None, _PLAIN))
    tokens = text.split()
    upper = sum(map(str.isupper, tokens))
    repeated = int((seen[1:] == seen[:-1]).sum()) if len(seen) > 1 else 0
    digits = len(raw.translate(None, _NO_DIGITS))
    lines = text.split("\n")
    style = np.array(
        [
            np.log(n),
            signs / size,
            signs / n,
            upper / n,
            repeated / n,
            len(whole) / n,
            len(distinct(pairs)) / max(1, len(pairs)),
            digits / size,
            size / n / 10,
            len(tokens) / n,
            len(set(lines)) / len(lines),
            len(lines) / n,
            (text.count(".") + text.count(",")) / n,
        ]
    )
    slots = np.concatenate([whole & np.uint64(SLOTS // 2 - 1), (starts[starts > 0] & np.uint64(SLOTS // 2 - 1)) + np.uint64(SLOTS // 2)])
    return style, distinct(slots).astype(np.int64)


class Labelled:
    """Fitted documents: style is a matrix, the slots of row i are flat[starts[i]:starts[i + 1]]."""

    def __init__(self, style: np.ndarray, flat: np.ndarray, starts: np.ndarray):
        self.style, self.flat, self.starts = style, flat, starts
        self.row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))

    def slots(self, i: int) -> np.ndarray:
        return self.flat[self.starts[i] : self.starts[i + 1]]

    def weights(self, bad: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Log odds of slots among the documents `which`, 0 for those that tell little."""
        counts = [np.bincount(self.flat[(which & (bad == b))[self.row]], minlength=SLOTS) for b in (False, True)]
        rate = [(c + 0.5) / (max(1, (which & (bad == b)).sum()) + 1) for b, c in enumerate(counts)]
        odds = np.log(rate[1] / rate[0])
        spread = np.sqrt(1 / (counts[0] + 0.5) + 1 / (counts[1] + 0.5))
        return np.where((counts[1] >= 3) & (odds > 2 * spread), odds, 0.0).astype(np.float32)


class Model:
    """One logistic model over how a text is written and the weights of its words."""

    def __init__(self, docs: Labelled, bad: np.ndarray):
        self.known = bool(0 < bad.sum() < len(bad))  # both kinds are labelled
        fold = np.arange(len(bad)) % FOLDS
        x = np.zeros((len(bad), docs.style.shape[1] + TOP + 1))
        for f in range(FOLDS):  # a document's words are weighed without itself
            self.weights = docs.weights(bad, fold != f)
            for i in np.flatnonzero(fold == f):
                x[i] = self.row(docs.style[i], docs.slots(i))
        self.weights = docs.weights(bad, fold >= 0)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z, y = self._wide(x), bad.astype(float)
        self.beta = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], 1.0)
        ridge[0] = 1e-6
        for _ in range(30):  # Newton's steps
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(h, z.T @ (y - p) - ridge * self.beta)
            self.beta += step
            if np.abs(step).max() < 1e-6:
                break

    def row(self, style: np.ndarray, slots: np.ndarray) -> np.ndarray:
        found = np.sort(self.weights[slots])[::-1][:TOP]
        top = np.zeros(TOP)
        top[: len(found)] = found
        return np.concatenate([style, top, [np.log1p((self.weights[slots] > 0).sum())]])

    def _wide(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.ones((len(z), 1)), z, z**2 / 4], axis=1)

    def logit(self, style: np.ndarray, slots: np.ndarray) -> float:
        return NO_EVIDENCE if not self.known else float(np.clip(self._wide(self.row(style, slots)[None])[0] @ self.beta, -20, 20))


def fit(docs: Labelled, quality: np.ndarray, toxic: np.ndarray) -> tuple[Model, Model] | None:
    """Models of poor and of toxic text; None without labelled documents."""
    return (Model(docs, quality == 0), Model(docs, toxic == 1)) if len(docs.style) else None


def _bounded(slots: np.ndarray) -> np.ndarray:
    """At most FITTED slots, in an order that is the same for all documents."""
    if len(slots) <= FITTED:
        return slots
    return np.sort(slots[np.argsort(slots * 0x9E3779B1 & 0xFFFFFFFF, kind="stable")[:FITTED]])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [features(t.as_py() or "") for t in batch.column(3)]
        kept = [pa.array([s.tolist() for s, _ in made], pa.list_(pa.float64())), pa.array([_bounded(k).astype("<i4").tobytes() for _, k in made], pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *kept], ["doc_id", "quality", "toxic", "style", "slots"])


def _fitted(made: pa.Table) -> tuple[Model, Model] | None:
    """Fit on rows of _featured; the slots stay in the one buffer in which they came."""
    slots = made["slots"].combine_chunks() if made.num_rows else pa.array([], pa.binary())
    slots = slots.cast(pa.large_binary())
    starts = np.frombuffer(slots.buffers()[1], np.int64)[slots.offset : slots.offset + len(slots) + 1] // 4 if len(slots) else np.zeros(1, np.int64)
    flat = np.frombuffer(slots.buffers()[2], "<i4") if len(slots) else np.empty(0, np.int32)
    style = np.array(made["style"].to_pylist() or np.empty((0, 0)), np.float64)
    return fit(Labelled(style, flat[starts[0] : starts[-1]], starts - starts[0]), made["quality"].to_numpy(), made["toxic"].to_numpy())


def _scored(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = models.value
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1):
                made = features(text.as_py() or "")
                out.append([m.logit(*made) for m in held] if held else [NO_EVIDENCE] * 2)
            poor, toxic = np.array(out).T if out else (np.empty(0), np.empty(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(poor), pa.array(toxic)], ["doc_id", "host", "path", "poor", "toxic"])

    return run


def _rate(logit: str) -> Column:
    return 1 / (1 + F.exp(-F.col(logit)))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, level: float) -> float:
    """Documents that the prior counts as: the larger, the less groups differ (method of moments)."""
    row = groups.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (F.col("bad") / F.col("n") - level) ** 2).alias("ss"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not row["n"] or row["k"] < 2:
        return 1e6
    within = level * (1 - level)
    between = (row["ss"] - (row["k"] - 1) * within) / (row["n"] - row["nn"] / row["n"]) if row["n"] > row["nn"] / row["n"] else 0.0
    return float(np.clip(within / between - 1, 2.0, 1e6)) if between > 0 else 1e6


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, sample: int = SAMPLE, key: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, p_document, p_host, p_path, p_bad, rejected.

    `host` and `path` name the columns that stand for a document's site and the part of it; null
    is a site like another. The p columns are probabilities that a document is poor or toxic:
    from its text, of its host, of its path within the host, and all taken together; rejected
    says whether the last is at least `threshold`. Null and empty texts are judged as texts of no words.
    Labels with a null in any column don't count; what isn't labelled in both ways, good and bad, is never held against a document. Of a
    repeated doc_id each row gets its own result. At most `sample` labelled documents are fitted
    on, the smallest by hash of doc_id, with at most FITTED slots of words each, so that what the driver
    holds is bounded in bytes; everything else covers all rows. If a doc_id has several labels, each counts. With `key`, a long column
    of docs, results bear that column in place of doc_id; labels are still found by doc_id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col("text").cast("string")
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), F.col("toxic").cast("int")).dropna()
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic").limit(sample)  # at most `sample` narrow rows
    texts = docs.select(F.col("doc_id").cast("long"), text.alias("text")).join(F.broadcast(picked), "doc_id")
    made = texts.select("doc_id", "quality", "toxic", "text").mapInArrow(_featured, "doc_id long, quality int, toxic int, style array<double>, slots binary")
    made = made.orderBy(F.xxhash64("doc_id"), "doc_id", "slots", "quality", "toxic").limit(sample).toArrow()
    models = spark.sparkContext.broadcast(_fitted(made))
    del made
    pa.default_memory_pool().release_unused()
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), text.alias("text"))
    scored = cut(source.mapInArrow(_scored(models), "doc_id long, host string, path string, poor double, toxic double"), "scored")

    own = 1 - (1 - _rate("poor")) * (1 - _rate("toxic"))
    scored = scored.withColumn("p", own)
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("bad"))
    paths = cut(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    level = float(np.clip((total["bad"] or 0.0) / (total["n"] or 1), 1e-6, 1 - 1e-6))
    k_host, k_path = _strength(hosts, level), _strength(paths, level)

    shrunk = hosts.select(F.col("host").alias("h_host"), ((F.col("bad") + k_host * level) / (F.col("n") + k_host)).alias("p_host"))
    sites = paths.join(shrunk, paths["host"].eqNullSafe(shrunk["h_host"])).select(paths["host"].alias("s_host"), paths["path"].alias("s_path"), "n", "bad", "p_host")
    each = scored.join(sites, scored["host"].eqNullSafe(sites["s_host"]) & scored["path"].eqNullSafe(sites["s_path"]))
    p_path = (F.col("bad") - F.col("p") + k_path * F.col("p_host")) / (F.col("n") - 1 + k_path)
    p_bad = 1 / (1 + F.exp(-(_logit(F.col("p")) + TRUST * (_logit(F.col("p_path")) - _logit(F.lit(level))))))
    return (
        each.withColumn("p_path", p_path)
        .withColumn("p_bad", p_bad)
        .select(F.col("doc_id").alias(key), F.col("p").alias("p_document"), "p_host", "p_path", "p_bad", (F.col("p_bad") >= threshold).alias("rejected"))
    )
