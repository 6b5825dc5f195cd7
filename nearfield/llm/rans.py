"""Static range asymmetric numeral system over token ids, in numpy.

A block interleaves `lanes` coders: token i belongs to lane i % lanes. All blocks share one
frequency table, scaled to 2**BITS. States are 64-bit, renormalised by 32-bit words, and
every CHECKPOINT steps the decoder's states and its place among the words are kept, so that
a block's segments can be decoded side by side or alone.
"""

from __future__ import annotations

import zlib

import numpy as np

BITS = 20
CHECKPOINT = 128
LANES = 256
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


def scale(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits and are at least 1 wherever a count is."""
    counts = np.asarray(counts, np.int64)
    seen = int((counts > 0).sum())
    if not seen:
        return np.zeros(len(counts), np.int64)
    if seen > 1 << bits:
        raise ValueError(f"{seen} symbols need more than {bits} bits")
    out = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) / counts.sum() * (1 << bits)).astype(np.int64), 0)
    order = np.argsort(-out, kind="stable")[:seen]
    spare = (1 << bits) - int(out.sum())
    if spare > 0:
        out[order[0]] += spare
    while spare < 0:  # take from the commonest, never below 1
        room = out[order] // 2
        take = np.minimum(room, np.maximum(0, -spare - (np.cumsum(room) - room)))
        out[order] -= take
        spare += int(take.sum())
    return out


class Table:
    """Frequencies with what coding needs beside them."""

    def __init__(self, freq: np.ndarray, bits: int = BITS):
        self.bits = bits
        self.freq = freq.astype(np.uint64)
        self.below = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode(many: list[np.ndarray], table: Table) -> list[dict]:
    """A block for each array of ids: lanes, n, words (bytes), states and places of its checkpoints, crc32.

    Blocks of as many lanes are coded side by side. What pads them has the whole range as its
    frequency, which leaves a state as it is.
    """
    lanes = [max(1, min(LANES, len(ids) // CHECKPOINT)) for ids in many]
    out: list = [None] * len(many)
    for k in set(lanes):
        at = [i for i, m in enumerate(lanes) if m == k]
        for i, block in zip(at, _side_by_side([many[i] for i in at], table, k), strict=True):
            out[i] = block
    return out


def _side_by_side(many: list[np.ndarray], table: Table, lanes: int) -> list[dict]:
    bits, top = np.uint64(table.bits), np.uint64(63 - table.bits)
    steps = max(-(-len(ids) // lanes) for ids in many)
    shape = (len(many), steps * lanes)
    freq, below = np.full(shape, 1 << table.bits, np.uint64), np.zeros(shape, np.uint64)
    for i, ids in enumerate(many):
        freq[i, : len(ids)], below[i, : len(ids)] = table.freq[ids], table.below[ids]
        if len(ids) and not freq[i].all():
            raise ValueError("a token has no frequency")
    by_step = lambda x: np.ascontiguousarray(x.reshape(len(many), steps, lanes).transpose(1, 0, 2))
    freq, below = by_step(freq), by_step(below)
    x = np.full((len(many), lanes), _LOW, np.uint64)
    words, full = np.empty(freq.shape, np.uint32), np.empty(freq.shape, bool)
    kept = {}
    for step in reversed(range(steps)):
        f = freq[step]
        np.greater_equal(x, f << top, out=full[step])
        words[step] = x  # the low 32 bits
        x >>= full[step] * _WORD
        q = x // f
        x = (q << bits) + (x - q * f) + below[step]
        if step % CHECKPOINT == 0:
            kept[step] = x.copy()
    out = []
    for i, ids in enumerate(many):
        payload = words[:, i][full[:, i]].astype("<u4").tobytes()
        marks = range(0, -(-len(ids) // lanes), CHECKPOINT)
        upto = np.concatenate([[0], np.cumsum(full[:, i].sum(axis=1))])
        states = b"".join(kept[m][i].astype("<u8").tobytes() for m in marks)
        places = upto[list(marks)].astype("<u8").tobytes()
        out.append({"lanes": lanes, "n": len(ids), "words": payload, "states": states, "places": places, "crc32": _sum(payload, states, places)})
    return out


def _sum(*parts: bytes) -> int:
    crc = 0
    for x in parts:
        crc = zlib.crc32(x, crc)
    return crc


def decode(many: list[dict], table: Table) -> list[np.ndarray]:
    """The ids of each block; all segments of blocks of as many lanes are decoded side by side."""
    out: list = [np.empty(0, np.uint32)] * len(many)
    for k in {b["lanes"] for b in many}:
        at = [i for i, b in enumerate(many) if b["lanes"] == k]
        for i, ids in zip(at, _segments([(many[i], None) for i in at], table), strict=True):
            out[i] = ids
    return out


def decode_segment(block: dict, segment: int, table: Table) -> np.ndarray:
    """One stretch of CHECKPOINT * lanes ids, without what comes before it."""
    return _segments([(block, segment)], table)[0]


def _segments(many: list[tuple[dict, int | None]], table: Table) -> list[np.ndarray]:
    lanes = many[0][0]["lanes"]
    size = CHECKPOINT * lanes
    words, states, places, left, owner, base = [], [], [], [], [], 0
    for i, (block, segment) in enumerate(many):
        if _sum(block["words"], block["states"], block["places"]) != block["crc32"]:
            raise ValueError("a block is damaged: its checksum differs")
        own = np.frombuffer(block["words"], "<u4")
        place = np.frombuffer(block["places"], "<u8").astype(np.int64)
        which = np.arange(len(place)) if segment is None else np.array([segment])
        words.append(own)
        states.append(np.frombuffer(block["states"], "<u8").reshape(-1, lanes)[which])
        places.append(place[which] + base)
        left.append(np.minimum(size, block["n"] - which * size))
        owner += [i] * len(which)
        base += len(own)
    if not owner:
        return [np.empty(0, np.uint32) for _ in many]
    stream = np.concatenate([*words, [0]]).astype(np.uint64)
    x, place, left = np.concatenate(states).astype(np.uint64), np.concatenate(places), np.concatenate(left)
    out = np.empty((len(x), CHECKPOINT, lanes), np.uint32)
    bits, slots = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    lane = np.arange(lanes)
    short = bool((left < size).any())
    for t in range(int(-(-left.max() // lanes))):
        slot = x & slots
        s = table.symbol[slot.astype(np.int64)]
        out[:, t] = s
        y = table.freq[s] * (x >> bits) + slot - table.below[s]
        if short:  # beyond a block's end states stay as they are
            y = np.where(t * lanes + lane < left[:, None], y, x)
        low = y < _LOW
        order = np.cumsum(low, axis=1)
        fresh = stream[np.minimum(place[:, None] + order - 1, base)]
        x = np.where(low, (y << _WORD) | fresh, y)
        place = place + order[:, -1]
    done = [[] for _ in many]
    for i, row, n in zip(owner, out.reshape(len(x), -1), left, strict=True):
        done[i].append(row[:n])
    return [np.concatenate(d) if d else np.empty(0, np.uint32) for d in done]
