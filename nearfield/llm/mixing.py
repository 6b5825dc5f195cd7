"""Mixing sources to target weights by subset-sum fitting of word budgets.

Sizes are counted into one number of documents per source and exact length. A source is
taken whole as often as its target allows; for what remains, lengths are taken in proportion
with the error carried on, and a bounded-knapsack dynamic program spends the rest as exactly
as the lengths left allow. Documents of a length are then picked in seeded hash order by
counts of hash digits, so that no group of equal lengths has to meet in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ranked, small_batches

WORD = r"[^\x20\x09-\x0D]+"
#: Words that are kept back for the dynamic program; a budget of no more is fitted exactly.
BUDGET = 1 << 16
#: Bits of a hash digit, and digits after which the few documents left are ordered.
DIGIT, DIGITS = 8, 3
#: Parts into which the documents of one source and length are dealt to meet their length's plan.
PARTS = 16


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each length to take, so that their words come nearest to budget from below.

    A budget of at most BUDGET words is spent by the program alone: no choice comes nearer. Of a larger one
    BUDGET words are kept back for the program, which spends them as exactly as the documents that the
    proportional part leaves allow.
    """
    order = np.argsort(lengths, kind="stable")
    out = np.zeros(len(lengths), np.int64)
    total = float((lengths * counts).sum())
    share = min(1.0, max(0.0, budget - BUDGET) / total) if total else 0.0
    wanted = spent = 0
    for i in order:
        if lengths[i] > 0:
            wanted += share * int(lengths[i]) * int(counts[i])
            out[i] = min(int(counts[i]), max(0, int((wanted - spent) // int(lengths[i]))))
            spent += int(out[i]) * int(lengths[i])
    left = min(int(budget), int(total)) - spent  # less than BUDGET and the longest document together
    if left <= 0:
        return out
    spare = counts - out
    via = np.full(left + 1, -1, np.int32)  # the item by which a sum was first reached
    via[0] = 0
    items: list[tuple[int, int]] = [(0, 0)]
    for i in order:
        size, n, step = int(lengths[i]), int(spare[i]), 1
        if size <= 0 or size > left:
            continue
        n = min(n, left // size)
        while n > 0 and via[left] < 0:  # powers of two stand for any number up to n
            take = min(step, n)
            weight = take * size
            fresh = np.flatnonzero((via[weight:] < 0) & (via[: left + 1 - weight] >= 0)) + weight
            via[fresh] = len(items)
            items.append((i, take))
            n, step = n - take, step * 2
        if via[left] >= 0:
            break
    at = int(np.flatnonzero(via >= 0)[-1])
    while at:
        i, take = items[via[at]]
        out[i] += take
        at -= take * int(lengths[i])
    return out


def targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Each source's target: sources (source, source_size) share the sum of sizes by weight.

    Weights repeat over the sources by code point, null last. A target stops at `most` times
    its source's size; the excess is reshared by weight until none is above.
    """
    placed = ranked(sources, [F.col("source").isNull(), F.col("source")])
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    placed = cut(placed.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most), "weights")
    level = 0.0  # words per unit of weight; grows as sources reach their limits
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    full = F.col("limit") <= F.col("weight") * F.lit(level)
    while True:
        row = placed.agg(
            F.sum(F.when(full, F.col("limit")).otherwise(0)).alias("fixed"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight")
        ).first()
        if not row["weight"]:
            break
        higher = (total - row["fixed"]) / row["weight"]
        if higher <= level:
            break
        level = higher
        full = F.col("limit") <= F.col("weight") * F.lit(level)
    target = F.when(full, F.col("limit")).otherwise(F.col("weight") * F.lit(level)).cast("double")
    return placed.select("source", "source_size", target.alias("target"))


def _quotas(frame: pd.DataFrame) -> pd.DataFrame:
    size, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
    base = int(target // size) if size else 0
    extra = fit(frame["size"].to_numpy(), frame["n"].to_numpy(), target - base * size)
    return pd.DataFrame({"source": frame["source"], "size": frame["size"], "base": base, "quota": extra, "source_size": size, "target": target})


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, repeats.

    size counts words parted by ASCII white space (null: 0). repeats says how often the mix
    takes the document, at most `most` times, and taken the words that makes. Null is a source
    of its own, last in order. Documents of no words are never taken beyond their source's
    whole passes. A rerun picks the same documents; rows that agree in doc_id, source and size
    are alike, whichever is picked. Empty tables give no rows. Only doc_id, source and text are read,
    and the columns named in `carry`, which follow doc_id in the result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", *carry, F.col("source").cast("string"), size_of(F.col("text").cast("string")).alias("size"))
    rows = cut(rows.withColumn("hash", F.xxhash64(F.lit(seed), F.col("doc_id"))).withColumn("row", F.monotonically_increasing_id()), "sizes")
    digit = lambda i: F.shiftrightunsigned("hash", 64 - DIGIT * (i + 1)).bitwiseAND((1 << DIGIT) - 1)
    tally = cut(rows.groupBy("source", "size", digit(0).alias("digit")).agg(F.count("*").alias("n")), "tally")
    lengths = tally.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")), weights, most)
    same = lengths["source"].eqNullSafe(sources["source"])
    kind = "source string, size long, base long, quota long, source_size long, target double"
    # a source's group holds one row for each distinct length
    quotas = cut(lengths.join(sources, same).select(lengths["source"], "size", "n", "source_size", "target").groupBy("source").applyInPandas(_quotas, kind), "quotas")

    key = ["source", "size"]
    on = lambda a, b: a["source"].eqNullSafe(b["source"]) & (a["size"] == b["size"])
    # narrow down, one hash digit after another, where each length's quota ends
    held = rows.select("row", "doc_id", "hash", *key)
    e = quotas.where("quota > 0").select(*key, "quota", F.lit(0).cast("long").alias("cutoff"))
    counts = tally.join(e, on(tally, e)).select(tally["source"], tally["size"], "quota", "cutoff", "digit", "n")
    for i in range(DIGITS):
        if i:
            inside = held.join(e, on(held, e) & (F.shiftrightunsigned("hash", 64 - DIGIT * i) == e["cutoff"]))
            counts = inside.select(held["source"], held["size"], "quota", "cutoff", digit(i).alias("digit")).groupBy(*key, "quota", "cutoff", "digit").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*key).orderBy("digit"))
        counts = counts.withColumn("upto", upto).where("upto >= quota and upto - n < quota")
        e = cut(counts.select(*key, (F.col("quota") - F.col("upto") + F.col("n")).alias("quota"), (F.col("cutoff") * (1 << DIGIT) + F.col("digit")).alias("cutoff")), "edge")
    e = e.withColumnRenamed("quota", "last")
    prefix = F.shiftrightunsigned("hash", 64 - DIGIT * DIGITS)
    at_edge = held.join(e, on(held, e) & (prefix == e["cutoff"])).select(held["source"], held["size"], "last", "row", "doc_id", "hash")
    order = Window.partitionBy(*key).orderBy("hash", "doc_id", "row")
    last = at_edge.withColumn("at", F.row_number().over(order)).where("at <= last").select("row", F.lit(1).alias("picked"))
    plan = quotas.join(e, quotas["source"].eqNullSafe(e["source"]) & (quotas["size"] == e["size"]), "left").select(
        quotas["source"], quotas["size"], "base", "source_size", "target", F.coalesce("cutoff", F.lit(-1)).alias("cutoff")
    )
    plan = plan.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    rows = rows.withColumn("part", digit(0).bitwiseAND(PARTS - 1).cast("int"))
    taken = rows.join(plan, on(rows, plan) & (rows["part"] == plan["part"])).select(rows["row"], "doc_id", *carry, rows["source"], rows["size"], "source_size", "target", "base", (prefix < F.col("cutoff")).cast("int").alias("below"))
    repeats = (F.col("base") + F.col("below") + F.coalesce("picked", F.lit(0))).cast("long")
    return taken.join(last, "row", "left").select("doc_id", *carry, "source", "size", "source_size", "target", (F.col("size") * repeats).cast("long").alias("taken"), repeats.alias("repeats"))
