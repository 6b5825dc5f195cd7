from __future__ import annotations

import math
import random

import numpy as np

from nearfield.llm import quality
from nearfield.llm.quality import classify

RNG = random.Random(9)
SYLLABLES = ["the", "on", "er", "an", "ti", "re", "he", "in", "st"]


def good():
    return " ".join("".join(RNG.choices(SYLLABLES, k=RNG.randrange(1, 4))) for _ in range(RNG.randrange(30, 120))).capitalize() + "."


def poor():
    return RNG.choice([lambda: good().upper().replace(" ", "!! "), lambda: " ".join([good().split()[0]] * 80), lambda: good().replace(" ", "*** ")])()


def toxic():
    w = good().split()
    for _ in range(4):
        w.insert(RNG.randrange(len(w)), RNG.choice(["vilea", "vileb", "nasty"]))
    return " ".join(w)


def table(spark, n=900):
    made = [(i, RNG.choices([good, poor, toxic], [8, 1, 1])[0]) for i in range(n)]
    docs = spark.createDataFrame([(i, f(), RNG.choice(["s1", "s1", "s2", None]), RNG.choice(["en", None]), 0.5) for i, f in made], "doc_id long, text string, source string, lang string, p double")
    labels = [(i, int(f is not poor), int(f is toxic)) for i, f in made]
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = table(spark)
    known = spark.createDataFrame([x for x in labels if x[0] % 2] + [(None, 1, 1), (2, None, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in classify(docs, known).collect()}
    assert len(got) == len(labels)
    bad = {i for i, q, t in labels if not q or t}
    held = [i for i, _, _ in labels if i % 2 == 0]
    assert sum(got[i]["rejected"] for i in held if i in bad) >= 0.9 * sum(i in bad for i in held)
    assert sum(got[i]["rejected"] for i in held if i not in bad) <= 0.03 * len(held)
    # the posteriors follow from the evidence
    rows = docs.select("doc_id", "source", "lang").collect()
    level = sum(r["p_document"] for r in got.values()) / len(got)
    for host in ("s1", "s2", None):
        ids = [r["doc_id"] for r in rows if r["source"] == host]
        own = sum(got[i]["p_document"] for i in ids) / len(ids)
        (p,) = {round(got[i]["p_host"], 9) for i in ids}
        assert min(own, level) - 1e-9 <= p <= max(own, level) + 1e-9
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for r in got.values():
        want = 1 / (1 + math.exp(-(logit(r["p_document"]) + 0.5 * (logit(r["p_path"]) - logit(level)))))
        assert abs(want - r["p_bad"]) < 1e-6 and r["rejected"] == (r["p_bad"] >= 0.5)


def test_what_is_fitted_is_bounded():
    few, many = np.arange(10), np.arange(0, 200_000, 2)
    assert quality._bounded(few).tolist() == few.tolist()
    kept = quality._bounded(many)
    assert len(kept) == quality.FITTED and (np.diff(kept) > 0).all()
    other = quality._bounded(np.arange(200_000))  # shared slots that stay in the larger set stay in the smaller
    assert set(other.tolist()) & set(many.tolist()) <= set(kept.tolist())


def test_strengths_by_moments(spark):
    """Groups that differ as chance would have it are shrunk all the way, others little."""
    frame = lambda rows: spark.createDataFrame(rows, "n long, bad double")
    rows = [(100, 90.0), (100, 10.0), (50, 5.0)]
    n, level = 250, 105 / 250
    ss, nn = sum(m * (b / m - level) ** 2 for m, b in rows), sum(m * m for m, _ in rows)
    between = (ss - 2 * level * (1 - level)) / (n - nn / n)
    assert abs(quality._strength(frame(rows), level) - max(2.0, level * (1 - level) / between - 1)) < 1e-9
    assert quality._strength(frame([(100, 42.0), (50, 21.0)]), level) == 1e6
    assert quality._strength(frame([(10, 1.0)]), 0.1) == quality._strength(frame([]), 0.1) == 1e6


def test_two_labels_for_one_document(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 20, "s", "en") for i in range(40)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, 0, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    first, second = (sorted(map(tuple, classify(docs.repartition(n), labels).collect())) for n in (1, 3))
    assert len(first) == 40 and [r[0] for r in first] == list(range(40)) and [r[5] for r in first] == [r[5] for r in second]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None), (1, "", "s", "en"), (None, "x " * 50_000, "s", "en")], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = classify(docs, none).collect()
    assert len(rows) == 3 and not any(r["rejected"] for r in rows)
    some = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    rows = classify(docs, some).collect()
    assert len(rows) == 3 and not any(r["rejected"] for r in rows)
    assert classify(docs.where("false"), some).count() == 0
