from __future__ import annotations

import random

from nearfield.llm.queries import tokenizer_json
from nearfield.llm.wordpiece import Automaton, byte_vocabulary, count_tokens


def greedy(word, first, later):
    at = n = 0
    while at < len(word):
        pieces = later if at else first
        for end in range(len(word), at, -1):
            if word[at:end] in pieces:
                at, n = end, n + 1
                break
        else:
            return 0
    return n


def test_automaton_against_greedy():
    rng = random.Random(1)
    for _ in range(200):
        some = lambda: {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(8))}
        first, later = some(), some()
        automaton = Automaton(first, later)
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12)))
            assert automaton.count(word) == greedy(word, first, later), (word, first, later)


def test_table(spark):
    spec = tokenizer_json()
    first, later = map(set, byte_vocabulary(spec))
    texts = [None, "", " \n", "Hello  worlds, naïve 漢字", "x" * 5000, "The internationalisation"]
    docs = spark.createDataFrame([*enumerate(texts), (5, texts[5])], "doc_id long, text string")
    got = sorted(map(tuple, count_tokens(docs, spec).collect()))
    want = []
    for i, t in [*enumerate(texts), (5, texts[5])]:
        each = [greedy(w, first, later) for w in (t or "").encode().split()]
        want.append((i, sum(each) + each.count(0), len(each), each.count(0)))
    assert got == sorted(want)
    assert count_tokens(docs.where("false"), spec).count() == 0
