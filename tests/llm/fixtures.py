"""A table of awkward documents: nulls, blanks, repeats, copies, a very long text, extra columns with clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, seg string, score string, size string, h int, `_shard` int, class string, copies int"


def texts() -> list[tuple[int | None, str | None, str | None]]:
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ab", "th", "ing", "o", "ré", "st", "un", "ka"]) for _ in range(rng.randint(1, 4)))
    body = lambda n: " ".join(word() for _ in range(n))
    base, passage, long_ = body(120), body(60), body(6000)
    near = base.split(" ")
    near[60] = "changed"
    rows: list[tuple[int | None, str | None, str | None]] = [(i, body(rng.randint(5, 90)), f"s{i % 3}") for i in range(20)]
    rows += [
        (30, base, "s0"), (31, " ".join(near), "s0"), (32, base, "s1"), (33, body(30) + " " + passage + " " + body(20), "s2"), (34, passage + body(10), None),
        (35, None, "s0"), (36, "", None), (37, " \n\t ", "s1"), (38, "one two", "s1"), (39, "one two", "s2"), (None, base + " tail", None), (None, None, "s0"),
        (40, long_, "s0"), (41, "日本語 ▁ 🙂 x" * 30, "s1"), (42, "x" * 3000, "s0"), (20_000, body(3), "s9"), (38, "one two", "s1"),
    ]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, "x", "y", "z", 3, 4, "c", 5) for i, t, s in rows], SCHEMA)
