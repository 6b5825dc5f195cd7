from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from nearfield.llm import rans
from nearfield.llm.common import scratch
from nearfield.llm.queries import tokenizer_json
from nearfield.llm.tokens import Encoder, read_tokens, stretches, write_tokens

TEXTS = [
    None, "", " ", "a", "Thston's  thhawhble\n\n st,\tx!", "<|endoftext|> b<|endoftext|>", "漢字 ñandú ²³ Ⅷ\x1f\x85 é́ x", "don't WE'LL 12345 __a__ ñ_1",
    "  lead and trail  \n ", "– “quoted” … 5€", "word " * 3000, "z" * 3000,
]


def test_encoder_equals_library():
    spec = tokenizer_json()
    tokenizer, encoder = Tokenizer.from_str(spec), Encoder(spec)
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choices(["a", "Bc", " ", "  ", "\n", ".", ",", "7", "'s", "é", " x", "\t"], k=12)) for _ in range(3000)]
    for text in texts:
        ids = np.frombuffer(encoder.encode(text), encoder.kind).tolist()
        assert ids == tokenizer.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000, 70_000])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49_999).astype(np.uint32)
    counts = np.bincount(ids, minlength=50_000)
    freq = rans.scale(counts)
    assert not n or freq.sum() == 1 << rans.BITS and ((freq > 0) == (counts > 0)).all()
    table = rans.Table(freq)
    others = [ids[: n // 3], ids[5:], ids[:1]]
    blocks = rans.encode([ids, *others], table)
    for got, want in zip(rans.decode(blocks, table), [ids, *others], strict=True):
        assert (got == want).all()
    block = blocks[0]
    size = rans.CHECKPOINT * block["lanes"]
    for s in range(-(-n // size)):
        assert (rans.decode_segment(block, s, table) == ids[s * size : (s + 1) * size]).all()
    if block["words"]:
        with pytest.raises(ValueError):
            rans.decode([block | {"words": block["words"][:-1] + bytes([block["words"][-1] ^ 1])}], table)


def test_scale_of_many_rare():
    counts = np.ones(60_000, np.int64)
    counts[0] = 10**15
    freq = rans.scale(counts)
    assert freq.sum() == 1 << rans.BITS and freq.min() == 1


def test_files(spark):
    spec = tokenizer_json()
    tokenizer = Tokenizer.from_str(spec)
    rows = [(i * 7 % 101, t) for i, t in enumerate(TEXTS)] + [(3, "twice"), (3, "twice"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, start int, ids string")
    path = scratch(spark, "test")
    write_tokens(docs, path, spec)
    got = sorted(read_tokens(spark, path, ids=True).collect(), key=lambda r: r["start"])
    want = sorted((-1 if d is None else d, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in rows)
    assert [-1 if r["doc_id"] is None else r["doc_id"] for r in got] == [d for d, _ in want]
    start = 0
    by = {}
    for d, ids in want:
        by.setdefault(d, []).append(ids)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert r["start"] == start and r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(r["ids"])
        by[-1 if r["doc_id"] is None else r["doc_id"]].remove(ids.tolist())
        start += len(ids)
    assert not any(by.values())


def test_stretches():
    ids = np.array([-(1 << 63), 0, 4, 5, 5, 5, 5, 6, 7, 8, 9, 1 << 60])
    turn = np.arange(len(ids))
    got = stretches([2.0, 5.0, 5.0, 5.0, 8.0], ids, turn)
    assert got.tolist() == [0, 0, 1, 2, 3, 4, 2, 5, 5, 6, 6, 6]
    order = np.argsort(ids, kind="stable")
    for a, b in zip(order[:-1], order[1:], strict=True):
        assert ids[a] == ids[b] or got[a] <= got[b]
    assert len({*got[3:7].tolist()}) == 3 and not {*got[3:7].tolist()} & {*got[:3].tolist(), *got[7:].tolist()}
    assert stretches([], ids, turn).tolist() == [0] * len(ids)
    assert stretches([-(2.0**63)] * 3, ids, turn)[0] == 1 and len({*stretches([-(2.0**63)] * 3, ids[:1].repeat(9), np.arange(9)).tolist()}) == 3


@pytest.mark.parametrize("hot", [5, None])
def test_files_of_a_hot_id(spark, hot):
    spec = tokenizer_json()
    tokenizer = Tokenizer.from_str(spec)
    rows = [(i, f"text {i}") for i in range(100)] + [(hot, "same text")] * 60 + [(hot, f"other {i % 7}") for i in range(60)]
    path = scratch(spark, "test")
    write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, spec)
    got = sorted(read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)
    sizes = [(-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got]
    code = lambda t: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4")
    want = [(-1 if d is None else d, len(x), zlib.crc32(x.tobytes())) for d, t in rows for x in [code(t)]]
    assert sorted(sizes) == sorted(want)
    assert [r["start"] for r in got] == np.cumsum([0, *[n for _, n, _ in sizes]])[:-1].tolist()


def test_empty(spark):
    path = scratch(spark, "test")
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, tokenizer_json())
    assert read_tokens(spark, path).count() == 0
