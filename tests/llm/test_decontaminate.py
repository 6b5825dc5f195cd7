from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from nearfield.llm import decontaminate as module
from nearfield.llm.decontaminate import decontaminate, selected

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        b = words(item)
        n = min(8, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(names) >= 2


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["Ab", "cd", "É1", "x", "yy", "zzz"]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(n)) for i, n in enumerate([30, 12, 8, 7, 3, 1, 20, 20, 9])] + [(50, ""), (51, None), (52, "...")]
    items += [(60, items[0][1]), (1, items[1][1])]
    docs = [None, "", "!!", "x", *(some(rng.randrange(60)) for _ in range(80))]
    docs += [some(20) + ", " + items[0][1].upper().replace("É", "É") + "\n" + some(5) for _ in range(10)]
    docs += [docs[-1]] * 3 + [some(3000)]
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words int")
    d = spark.createDataFrame([(i, t, "x", 2) for i, t in enumerate(docs)], "doc_id long, text string, items string, uid int")
    got = {r["doc_id"]: r for r in decontaminate(d, b).collect()}
    assert len(got) == len(docs)
    for i, text in enumerate(docs):
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute(text, items), (i, text)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c"), (None, None), (1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate(d, b).collect()
    assert len(rows) == 3 and not any(r["n_hit"] or r["contaminated"] for r in rows)
    assert decontaminate(d.where("false"), b).count() == 0


def test_winnowing_meets_every_window():
    """Each window of eight words holds a selected run, the same one wherever it stands."""
    rng = random.Random(4)
    for _ in range(50):
        text = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(8, 60))]
        kept = set(selected(text)[0].tolist())
        for i in range(len(text) - 7):
            (least,) = {p for p in selected(text[i : i + 8])[0].tolist()}
            assert i + least in kept
    assert len(selected([b"w%d" % i for i in range(4000)])[0]) < 2000  # fewer fingerprints than windows
    assert not len(selected([b"a"] * 7)[0])


def test_one_passage_in_all_items_and_a_long_text(spark):
    line = " ".join(f"w{i}" for i in range(9))
    b = spark.createDataFrame([(i, f"x{i} y{i} {line} z{i}") for i in range(30)], "item_id long, text string")
    texts = [line, f"q {line}", " ".join(line.split()[:8]), " ".join(line.split()[:7]), f"y3 {line} z3", "far " * 40_000 + line]
    got = {r["doc_id"]: r for r in decontaminate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), b).collect()}
    assert [(got[i]["n_hit"], got[i]["n_items"]) for i in range(6)] == [(9, 30), (9, 30), (8, 30), (0, 0), (11, 30), (9, 30)]


def scanned(texts, spans, every):
    """What the scan yields; every: a bitmap that holds all."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    return list(module._scan(spans, every, every)(iter([batch])))


def test_scan_is_bounded_whatever_repeats():
    """Each place of a frequent word or passage was an object of its own in the worker: 1.5 GB for 18 MB of text."""
    every = SimpleNamespace(value=np.full(1 << 10, 2**64 - 1, np.uint64))
    line = " ".join(f"w{i}" for i in range(20))
    tracemalloc.start()
    (batch,) = scanned(["the " * 60_000, f"{line} " * 3_000], [1, 8], every)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6
    the, repeated = batch.column(3).to_pylist()
    assert sorted(p["at"] for p in the if p["n"] == 1) == [list(range(60_000))]
    assert sum(len(p["at"]) for p in repeated if p["n"] == 1) == 60_000 and len(repeated) < 60


def test_scan_passes_on_its_rows_piece_by_piece(monkeypatch):
    every = SimpleNamespace(value=np.full(1 << 10, 2**64 - 1, np.uint64))
    rng = random.Random(6)
    texts = [None, "", "x", *(" ".join(rng.choice("abcde") for _ in range(rng.randrange(40))) for _ in range(30)), "a b " * 100, None]
    places = lambda batches: [sorted((p["context"], at) for p in row for at in p["at"]) for b in batches for row in b.column(3).to_pylist()]
    whole = scanned(texts, [2, 8], every)
    assert len(whole) == 1
    monkeypatch.setattr(module, "PRINTS", 16)
    pieces = scanned(texts, [2, 8], every)
    assert len(pieces) > 10 and places(pieces) == places(whole)
    for column in range(3):
        assert [x for b in pieces for x in b.column(column).to_pylist()] == whole[0].column(column).to_pylist()


def test_frequent_words_and_repeated_passages(spark):
    line = " ".join(f"w{i}" for i in range(12))
    items = [(1, "the"), (2, "of the"), (3, f"the {line} of"), (4, f"a {line} b"), (5, line)]
    docs = ["the of " * 300, f"{line} " * 40, f"the {line} the {line} of the", " ".join(f"q{i} {line}" for i in range(30)), "none"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for r in decontaminate(d, spark.createDataFrame(items, "item_id long, text string")).collect():
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute(docs[r["doc_id"]], items), r
