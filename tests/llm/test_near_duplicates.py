from __future__ import annotations

import random
import re

import pandas as pd

from nearfield.llm import near_duplicates as nd

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    kinds = {}
    for i, s in enumerate(sets):
        kinds.setdefault(s or ("none", i), []).append(i)
    keys = [k for k in kinds if isinstance(k, frozenset)]
    root = {k: k for k in kinds}

    def top(k):
        while root[k] is not k:
            k = root[k]
        return k

    links = dict.fromkeys(kinds, 0)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(a & b)
            if common >= 0.8 * (len(a) + len(b) - common):
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    least = {}
    for k, members in kinds.items():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        if ids:
            least[id(top(k))] = min([least.get(id(top(k)), min(ids)), *ids])
    out = []
    for k, members in kinds.items():
        for i in members:
            alone = not isinstance(k, frozenset)
            out.append((rows[i][0], rows[i][0] if alone else least.get(id(top(k))), 0 if alone else links[k], 0 if alone else len(members) - 1))
    return sorted(out, key=str)


def corpus(rng, n):
    some = lambda k: [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40)) for _ in range(k)]
    line = some(25)
    rows = []
    for _ in range(n):
        base = some(rng.randrange(1, 120))
        if rng.random() < 0.4:
            base = line + base
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 0, 1, 4])):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(some(1))
            rows.append(rng.choice([" ", ", ", "\n"]).join(w))
    group = some(100)
    for i in range(60):  # a chain of near copies
        group[i] = f"new{i}"
        rows.append(" ".join(group))
    return rows + ["Exact copy of one text"] * 50 + [None, "", "--", "x", "x", "X y", "x y z"]


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 4)
    texts = corpus(random.Random(6), 60)
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3]), (None, None)]
    docs = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, n int, class_id string")
    got = sorted(map(tuple, nd.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)
    assert nd.near_duplicates(docs.where("false")).count() == 0


def test_depth_reaches_recall():
    for s in (0.5, 0.8, 0.95):
        d = nd.depth_for(s, 0.999)
        assert 1 - (1 - s**d) ** nd.TREES >= 0.999 or d == 1
        assert d == nd.DEPTH or 1 - (1 - s ** (d + 1)) ** nd.TREES < 0.999


def test_prefixes_are_shortened_as_the_links_ask():
    found = lambda s, d: 1 - (1 - s**d) ** nd.TREES
    assert nd.shortened({}, 12, 8, 0.9995) == 12
    assert nd.shortened({99: 50, 95: 7}, 12, 8, 0.9995) == 12  # close copies meet at any depth
    assert nd.shortened({99: 10**9, 80: 1}, 12, 8, 0.9995) == 8  # a band counts by itself
    assert nd.shortened({80: 1}, 12, 10, 0.9995) == 10
    depth = nd.shortened({85: 1}, 12, 8, 0.9995)
    assert found(0.85, depth) >= 0.9995 > found(0.85, depth + 1)


def test_leaves_are_prefixes():
    """Texts share a tree's node of depth d as often as its first d minima agree."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    other = list(base)
    for _ in range(4):
        other[rng.randrange(150)] = "new"
    a, b = (nd.shingles([w.encode() for w in t], 5) for t in (base, other))
    s = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    (n1, l1), (n2, l2) = nd.signature(a, 2, 4), nd.signature(b, 2, 4)
    share = [(n1 == n2).mean(), *[((n1 == n2) & (l1 >> k == l2 >> k)).mean() for k in (48, 32, 16, 0)]]
    assert share == sorted(share, reverse=True)
    assert all(abs(x - s**d) < 0.25 for d, x in zip(range(2, 7), share, strict=True))


def test_extremes(spark):
    """Very long texts, ids at both ends of a long, repeated rows, classes without any doc_id."""
    long = " ".join(f"w{i}" for i in range(30_000))
    top, low = (1 << 63) - 1, -(1 << 63)
    rows = [(top, long), (low, long + " end"), (5, long[: len(long) // 2]), (None, "a b c d e f g h"), (None, "a b c d e f g h"), (0, "p q"), (0, "p q"), (0, "r s"), (-3, "P; q")]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(top, low, 1, 0), (low, low, 1, 0), (5, 5, 0, 0), (None, None, 0, 1), (None, None, 0, 1), (0, -3, 0, 2), (0, -3, 0, 2), (0, 0, 0, 0), (-3, -3, 0, 2)], key=str
    )


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)]
    frame = nd.components(spark.createDataFrame(links, "a long, b long")).toPandas()
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    want = pd.DataFrame([(x, top(x)) for x in root if any(x in e and e[0] != e[1] for e in links)], columns=["node", "root"])
    assert sorted(map(tuple, frame.to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))
