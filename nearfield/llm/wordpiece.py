"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie of bytes. A node's failure link leads to the node at which matching
goes on once the longest piece, or pieces, are popped, and beside it stands how many pieces
that pops. A word's tokens are so counted in one pass over its bytes, without any piece
being built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Words whose count a worker remembers, in each of two generations.
MEMO = 200_000


class Automaton:
    """`first`: pieces that can begin a word; `later`: those that can go on with it."""

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]  # 0 begins a word, 1 goes on with it
        final = {}
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                if piece:
                    node = root
                    for c in piece:
                        node = self.next[node].setdefault(c, len(self.next))
                        if node == len(self.next):
                            self.next.append({})
                    final[node] = True
        self.fail = [-1] * len(self.next)
        self.pops = [0] * len(self.next)
        queue = deque((0, 1))
        while queue:
            parent = queue.popleft()
            for c, node in self.next[parent].items():
                queue.append(node)
                if node in final:
                    self.fail[node], self.pops[node] = 1, 1
                    continue
                at, n = self.fail[parent], self.pops[parent]
                while at >= 0 and c not in self.next[at]:
                    n += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.pops[node] = self.next[at][c], n

    def count(self, word: bytes) -> int:
        """Pieces of a word; 0 if the vocabulary can't spell it."""
        following, fail, pops = self.next, self.fail, self.pops
        node = n = 0
        for c in word:
            while (to := following[node].get(c)) is None:
                if fail[node] < 0:
                    return 0
                n += pops[node]
                node = fail[node]
            node = to
        while node != 1:
            if fail[node] < 0:
                return 0
            n += pops[node]
            node = fail[node]
        return n


def byte_vocabulary(spec: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a byte-level tokenizer's JSON: those behind a space begin words, the others go on."""
    import json

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    first, later = [], []
    for piece in json.loads(spec)["model"]["vocab"]:
        if all(c in byte for c in piece):
            raw = bytes(byte[c] for c in piece)
            (first if raw[:1] == b" " else later).append(raw.removeprefix(b" "))
    return first, later


class _Counts(dict):
    def __init__(self, spec: str):
        super().__init__()
        self.automaton = Automaton(*byte_vocabulary(spec))
        self.older: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        n = self.older.get(word)
        if n is None:
            n = self.automaton.count(word)
        if len(self) >= MEMO:
            self.older = dict(self)
            self.clear()
        self[word] = n
        return n


_held: dict[int, _Counts] = {}


def _counted(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(spec.value)
        if key not in _held:
            _held.clear()
            _held[key] = _Counts(spec.value)
        counts = _held[key]
        for batch in batches:
            out = []
            for text in batch.column(1):
                each = list(map(counts.__getitem__, (text.as_py() or "").encode("utf-8", "replace").split()))
                unknown = each.count(0)
                out.append((sum(each) + unknown, len(each), unknown))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(x), pa.int64()) for x in (zip(*out, strict=True) if out else ([], [], [])))],
                ["doc_id", "n_tokens", "n_words", "n_unknown"],
            )

    return run


def count_tokens(docs: DataFrame, spec: str) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_words, n_unknown.

    Words are parted by ASCII white space. A word that the vocabulary of `spec`, the
    tokenizer's JSON, can't spell counts as one unknown token. Null and empty texts count 0.
    Repeated rows keep a row each; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(_counted(docs.sparkSession.sparkContext.broadcast(spec)), "doc_id long, n_tokens long, n_words long, n_unknown long")
