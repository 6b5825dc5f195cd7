"""Stages of the corpus pipeline on rows whose doc_id is null, repeated or shared."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from nearfield.llm import mixing

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(["the", "on", "er", "an", "ti", "re"], k=3)) for _ in range(n)).capitalize() + "."


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], KIND).repartition(5)


def ran(stage, spark, docs, folder):
    got = stage(spark, docs, str(folder))
    assert got.columns == list(corpus_pipeline.COLUMNS)
    return Counter((r["doc_id"], r["text"]) for r in got.collect())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    items = [(1, prose("item one", 20)), (2, prose("item two", 20)), (2, prose("item two", 20)), (None, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    labels = [(i, int(i % 2), 0) for i in range(200)] + [(None, 1, 1), (3, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_one_row_of_each_class_stays(spark, folder):
    a, b, c = prose("a"), prose("b"), prose("c")
    rows = [(5, a)] * 3 + [(7, a + " More."), (None, a)] + [(None, b)] * 3 + [(8, c), (8, prose("d"))] + [(9, "")] * 2 + [(9, "!"), (10, None), (10, None), (None, None)]
    got = ran(corpus_pipeline.one_of_each, spark, frame(spark, [(i, t, "s") for i, t in rows]), folder)
    assert got == Counter([(5, a), (None, b), (8, c), (8, prose("d")), (9, ""), (9, "!"), (10, None), (None, None)])


def test_only_contaminated_rows_go(spark, folder):
    bad, fine = f"Before {prose('item one', 20)}", prose("fine")
    rows = [(None, bad), (None, fine), (3, bad), (3, fine), (4, fine), (4, fine), (5, None), (6, bad), (6, bad)]
    got = ran(corpus_pipeline.clear_of_benchmark, spark, frame(spark, [(i, t, "s") for i, t in rows]), folder)
    assert got == Counter([(None, fine), (3, fine), (4, fine), (4, fine), (5, None)])


def test_only_rejected_rows_go(spark, folder):
    text = lambda i: prose(i) if i % 2 else prose(i).upper().replace(" ", "!! ")
    rows = [(i, text(i)) for i in range(200)] + [(None, text(1001)), (None, text(1002)), (500, text(1003)), (500, text(1004)), (501, text(1005)), (501, text(1005))]
    docs = frame(spark, [(i, t, "s") for i, t in rows])
    got = ran(corpus_pipeline.keep_quality, spark, docs, folder)
    assert got == Counter((i, t) for i, t in rows if not t.isupper() and "!!" not in t)


def test_mix_takes_each_row_by_itself(spark, folder):
    rows = [(1, prose("hot", 7), "a")] * 40 + [(None, prose(i, 5 + i % 9), "abc"[i % 3]) for i in range(120)] + [(2, prose(f"s{i}", 11), "b") for i in range(20)] + [(i, prose(-i, 30), "c") for i in range(10, 20)]
    docs = frame(spark, rows)
    got = ran(corpus_pipeline.mixed, spark, docs, folder)
    held = Counter((i, t) for i, t, _ in rows)
    assert all(n <= 3 * held[x] for x, n in got.items()) and any(i is None for i, _ in got)
    source = {t: s for _, t, s in rows}
    words = Counter()
    for (_, t), n in got.items():
        words[source[t]] += n * len(t.split())
    numbered = spark.createDataFrame([(i, t, s) for i, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    want = {r["source"]: r["taken"] for r in mixing.mix(numbered).groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "taken").collect()}
    assert dict(words) == want
    assert ran(corpus_pipeline.mixed, spark, docs.repartition(3, "text"), folder) == got


def test_stages_against_brute_force(spark, folder):
    """All stages in turn, with further columns that clash with the stages' own."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from nearfield.llm import queries
    from nearfield.llm.words import words_of

    items = [words_of(prose("item one", 20)), words_of(prose("item two", 20))]
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    base = [(i, prose(i, 20 + i % 7), "ab"[i % 2]) for i in range(200)]
    more = [(i, t + " Tail.", s) for i, t, s in base[1:60:6]] + [(None, t, s) for _, t, s in base[1:40:4]] + base[51:70:2]
    tainted = [(None, f"{prose(900)} {prose('item one', 20)}", "a"), (7, f"{prose(901)} {prose('item two', 20)}", "b")]
    rows = [(i, t.upper().replace(" ", "!! ") if i is not None and i % 2 == 0 else t, s) for i, t, s in base + more] + tainted + [(None, "", "a"), (300, None, None)]
    docs = frame(spark, rows).selectExpr("*", "1 as _row", "'x' as class_id", "2 as rejected", "3 as repeats", "4 as row", "5 as hits")
    stages = dict(corpus_pipeline.STAGES)

    docs1 = stages["quality classifier"](spark, docs, str(folder))
    judged = [(r["doc_id"], r["text"], r["source"]) for r in docs1.collect()]
    wordy = [r for r in rows if words_of(r[1])]
    assert Counter(r for r in judged if words_of(r[1])) == Counter(r for r in wordy if "!!" not in r[1])

    sets = [grams(words_of(t), 5) for _, t, _ in judged]
    root = list(range(len(judged)))
    for i in range(len(judged)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    first = {}
    for i, (d, _, _) in enumerate(judged):
        first[root[i]] = min(first.get(root[i], (True, 0)), (d is None, d or 0))
    docs2 = stages["n-gram Jaccard join"](spark, docs1, str(folder))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs2.collect()) == sorted(first.values())

    single = [(r["doc_id"], r["text"], r["source"]) for r in docs2.collect()]
    docs3 = stages["benchmark decontamination"](spark, docs2, str(folder))
    clean = Counter(r for r in single if not any(grams(words_of(r[1]), 8) & grams(w, 8) for w in items))
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in docs3.collect()) == clean and sum(clean.values()) == len(single) - 2

    docs4 = stages["mixing sources to target weights"](spark, docs3, str(folder))
    taken = Counter((r["doc_id"], r["text"], r["source"]) for r in docs4.collect())
    assert taken.keys() <= clean.keys() and all(n <= 3 * clean[r] for r, n in taken.items()) and taken

    tokenizer = Tokenizer.from_str(queries.tokenizer_json())
    crc = lambda t: zlib.crc32(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes())
    files = stages["token-ID / binary output"](spark, spark.createDataFrame([(i, t, "en", s, 0) for (i, t, s), n in taken.items() for _ in range(n)], KIND), str(folder))
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in files.collect()) == Counter({(k, c): n for (k, c), n in sum((Counter({(i, crc(t)): n}) for (i, t, _), n in taken.items()), Counter()).items()})


def test_results_that_are_not_written_stay_readable(spark, folder, tmp_path):
    """Keyed copies go only when a stage's result has been written and is read from there."""
    rows = [(i, prose(i), "s") for i in range(6)]
    frame(spark, rows).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    each = [stage(spark, docs, str(folder)) for _, stage in corpus_pipeline.STAGES[1:4]]
    assert [x.count() for x in each][:2] == [6, 6] and each[2].count() > 0
    held = list(corpus_pipeline._left[spark.sparkContext.applicationId])
    each[0].write.parquet(f"{tmp_path}/one")
    again = corpus_pipeline.clear_of_benchmark(spark, spark.read.parquet(f"{tmp_path}/one"), str(folder))
    assert again.count() == 6
    assert len(held) >= 3 and not set(map(id, held)) & set(map(id, corpus_pipeline._left[spark.sparkContext.applicationId]))


def test_stages_of_nothing(spark, folder):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], KIND), str(folder)).count() == 0, name
