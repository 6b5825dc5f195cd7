from __future__ import annotations

from nearfield.llm.preferences import format_preferences, swapped_replies

ROWS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "hello é"), (0, 2, "user", "more"), (0, 3, "assistant", "A"),
    (1, 0, "user", "hi"), (1, 1, "assistant", "B"),
    (2, 1, "assistant", "late"), (2, 0, "user", None),
    (4, 0, "user", "open"), (5, 0, "user", "q"), (5, 1, "assistant", "r"),
    (6, 0, None, "x"), (6, 0, None, "x"), (None, 0, "user", "lost"),
]


def shown(turns):
    return "".join(f"<|turn:{r}|>{t}<|end|>\n" for r, t in turns)


def mask(turns):
    out, at = [], 0
    for r, t in turns:
        end = at + len(shown([(r, t)]))
        if r == "assistant":
            out.append(f"{at + len(f'<|turn:{r}|>')}:{end}")
        at = end
    return ",".join(out)


def test_swapped(spark):
    table = spark.createDataFrame([(*r, "p", 1) for r in ROWS], "conv_id long, turn long, role string, text string, prompt string, n_prompt int")
    got = {r["pair_id"]: r for r in format_preferences(swapped_replies(table)).collect()}
    by = {}
    for c, _, r, t in sorted(ROWS, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        by.setdefault(c, []).append((r or "", t or ""))
    assert set(got) == set(by)
    last = {c: [t for t in turns if t[0] == "assistant"][-1:] for c, turns in by.items()}
    for c, turns in by.items():
        other = list(turns)
        if turns[-1][0] == "assistant":
            other = turns[:-1] + (last.get(c ^ 1, []) if c is not None else [])
        n = next((i for i, (x, y) in enumerate(zip(turns, other, strict=False)) if x != y), min(len(turns), len(other)))
        r = got[c]
        assert tuple(r) == (c, n, shown(turns[:n]), shown(turns[n:]), mask(turns[n:]), shown(other[n:]), mask(other[n:]))
    assert format_preferences(swapped_replies(table.where("false"))).count() == 0


def test_null_and_equal_sides(spark):
    kind = "pair_id long, chosen array<struct<turn:long,role:string,text:string>>, rejected array<struct<turn:long,role:string,text:string>>"
    t = [(0, "user", "a"), (1, "assistant", "b")]
    rows = format_preferences(spark.createDataFrame([(1, t, t), (1, t, t), (2, None, t), (3, [], None)], kind)).collect()
    assert [(r["pair_id"], r["n_prompt"], bool(r["chosen"]), bool(r["rejected"])) for r in sorted(rows)] == [(1, 2, False, False), (1, 2, False, False), (2, 0, False, True), (3, 0, False, False)]


def test_a_long_conversation(spark):
    kind = "pair_id long, chosen array<struct<turn:long,role:string,text:string>>, rejected array<struct<turn:long,role:string,text:string>>"
    turns = [(i, ("user", "assistant")[i % 2], "é" * (i % 7)) for i in range(1500)]
    row = format_preferences(spark.createDataFrame([(1, turns, turns[:1])], kind)).first()
    rest = [(r, t) for _, r, t in turns[1:]]
    assert (row["n_prompt"], row["chosen"], row["chosen_mask"], row["rejected_mask"]) == (1, shown(rest), mask(rest), "")
