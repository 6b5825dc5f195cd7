from __future__ import annotations

import numpy as np

from nearfield.llm import vectors
from nearfield.llm.vectors import nearest, scan


def brute(rows, k, every):
    good = {}
    for i, v in sorted(((i, v) for i, v in rows if i is not None and v is not None), key=lambda r: r[0]):
        if len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = min(good.get(i, v), v)
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids], np.float64)
    out = {}
    for i in ids[ids % every == 0]:
        d = np.sqrt(((x - np.array(good[i], np.float64)) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(v) for v in np.float32(centres[i % 12] + 0.3 * rng.normal(size=8))]) for i in range(1500)]
    rows += [(2000 + i, rows[5][1]) for i in range(300)]  # copies
    rows += [(5000, [0.0] * 8), (5100, None), (5200, [1.0] * 7 + [None]), (5300, [float("nan")] * 8), (5400, [float("inf")] * 8), (5500, [1.0] * 3), (None, rows[0][1])]
    rows += [rows[10], (10, [9.0] * 8), (5, rows[5][1])]
    table = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string")
    got = {}
    for r in sorted(nearest(table, every=20, sample=8).collect()):
        assert r["rank"] == len(got.setdefault(r["query_id"], [])) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute(rows, 10, 20)
    assert set(got) == set(want) and all(len(got[q]) == 10 for q in want)
    for q, found in got.items():
        true = dict(want[q])
        for i, d in found:
            v = dict(rows)[i] if i != 10 else min(rows[10][1], [9.0] * 8)
            assert abs(d - float(np.sqrt(((np.array(v) - np.array(dict(rows)[q])) ** 2).sum()))) < 1e-12
        assert found == sorted(found, key=lambda f: (f[1], f[0])) and len(true) == 10
    hits = sum(len(dict(want[q]).keys() & dict(got[q]).keys()) for q in want)
    assert hits >= 0.9 * 10 * len(want)


def test_few_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    assert nearest(spark.createDataFrame([], kind)).count() == 0
    assert nearest(spark.createDataFrame([(0, [0.0, 0.0]), (1, None)], kind)).count() == 0
    rows = nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], kind)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in sorted(rows)] == [(0, 1, 2, 0.0), (0, 2, 3, 0.0), (0, 3, 1, 1.414214)]


def test_recall_of_the_scan_alone(spark, monkeypatch):
    """The sample, whose rows must come from their lists like any, is a small share of the table."""
    monkeypatch.setattr(vectors, "LEAST", 100)
    monkeypatch.setattr(vectors, "PART", 40)
    monkeypatch.setattr(vectors, "QUERIES", 7)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 32))
    x = np.float32(centres[rng.integers(0, 40, 4000)] + 0.5 * rng.normal(size=(4000, 32)))
    got = {}
    for r in nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), every=40, sample=4).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert len(got) == 100
    hits = 0
    for q, found in got.items():
        d = ((np.float64(x) - np.float64(x[q])) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(found & set(np.argsort(d)[:10].tolist()))
    assert hits >= 950, hits
    monkeypatch.setattr(vectors, "_scanned", lambda held, k: lambda key, rows, asked: rows.iloc[:0].assign(query_id=0, score=0.0)[["query_id", "vec_id", "score"]])
    assert nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:50])], "vec_id long, embedding array<float>")).count() == 0


def test_bounds_are_drawn_in():
    rng = np.random.default_rng(2)
    x, z, r = rng.normal(size=(2000, 24)), rng.normal(size=(9, 24)), np.linalg.qr(rng.normal(size=(24, 24)))[0]
    q, c, d = vectors.search(np.arange(2000), x, np.arange(9), z, np.full(9, np.inf), 10, r)
    true = np.sqrt(((z[:, None] - x[None]) ** 2).sum(axis=2))
    true[np.arange(9), np.arange(9)] = np.inf
    found = {(i, j) for i, j in zip(q.tolist(), c.tolist(), strict=True)}
    want = {(i, j) for i in range(9) for j in np.argsort(true[i])[:10].tolist()}
    assert len(found) == 90 and len(found & want) >= 85 and np.allclose(d, true[q, c])


def test_scan_drops_far_ones_only():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(3000, 64)), rng.normal(size=(20, 64))
    d = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    bounds = np.sort(d, axis=1)[:, 9]
    a, b = scan([x[:, i : i + 16] for i in range(0, 64, 16)], q, bounds)
    true = d <= bounds[:, None] * (1 + 1e-9)
    assert len(a) <= true.sum() and sum(true[i, j] for i, j in zip(a, b, strict=True)) >= 0.97 * true.sum()


def test_scan_keeps_copies():
    rng = np.random.default_rng(5)
    kept = of = 0
    for scale in (1.0, 1e4):
        for _ in range(100):
            q = scale * rng.normal(size=(5, 64))
            x = np.concatenate([np.repeat(q, 40, axis=0), scale * rng.normal(size=(100, 64))])
            a, b = scan([x[:, i : i + 16] for i in range(0, 64, 16)], q, np.zeros(5))
            kept += sum(j < 200 and j // 40 == i for i, j in zip(a, b, strict=True))
            of += 200
            assert (b < 200).all()
    assert kept == of, f"{kept} of {of} copies"


def test_copies_outside_the_sample(spark):
    rng = np.random.default_rng(6)
    ids = rng.permutation(3000)
    x = np.float32(rng.normal(size=(3000, 64)))
    x[:1000] = np.repeat(x[:8], 125, axis=0)
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)]
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=10, sample=1).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    right = of = 0
    for group in ids[:1000].reshape(8, 125):
        for i in group[group % 10 == 0].tolist():
            right += sum(got[i][at + 1] == (j, 0.0) for at, j in enumerate([j for j in sorted(group.tolist()) if j != i][:10]))
            of += 10
    assert right == of > 0, f"{right} of {of}"
