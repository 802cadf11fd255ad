"""Fill-in-middle, harmonic packing and vector codes against brute force, on awkward rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import documents, texts
from pyspark.sql import functions as F

from loomgraph.llm import fill_middle, packing, token_ids, vector_codes


@pytest.mark.parametrize("text", ["", "a", "é", "日本語 🙂" * 300, "x" * 512, "x" * 511 + "é", "é" * 256 + "🙂"])
def test_rank_and_select_of_code_points(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    index = fill_middle.CodePoints(raw)
    starts = [i for i, b in enumerate(raw) if b & 0xC0 != 0x80]
    assert index.rank(np.arange(len(raw) + 1)).tolist() == [sum(s < i for s in starts) for i in range(len(raw) + 1)]
    assert index.select(np.arange(len(starts) + 1)).tolist() == [*starts, len(raw)]


def _filled(i, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    form, out = ("spm", f"<S>{suffix}<P>{prefix}<M>{middle}") if h4 % 100 < 20 else ("psm", f"<P>{prefix}<S>{suffix}<M>{middle}")
    return n, form, a, b - a, out, text


def test_fill_middle(spark, monkeypatch):
    from loomgraph.llm import common

    monkeypatch.setattr(common, "CHUNK_BYTES", 5000)
    rows = [*texts(), (50, "a <P> b", None), (51, "x<M>", None), (52, "<S>", None), (53, "<", None), (54, "<<P" * 9, None), *[(i, "ab🙂é<" * (i % 9), None) for i in range(60, 160)]]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((i, *w[:4], sha(w[4]), sha(w[5])) for i, t, _ in rows for w in [_filled(i, t)])
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert Counter(map(tuple, fill_middle.digests(documents(spark, rows)).collect())) == want
    assert Counter(r.output for r in fill_middle.transform(documents(spark, rows)).collect()) == Counter(_filled(i, t)[4] for i, t, _ in rows)
    assert fill_middle.digests(documents(spark, [])).collect() == []


@pytest.mark.parametrize("capacity, waste", [(4096, 32), (4096, 0), (100, 3), (7, 1), (1, 0)])
def test_cuts_lie_in_classes(capacity, waste):
    table = packing.cut_table(capacity, waste)
    doc, start, n = packing.cut(np.arange(1, 3 * capacity + 2), table)
    assert (capacity - capacity // n * n <= waste).all()
    held = defaultdict(list)
    for d, s, k in zip(doc.tolist(), start.tolist(), n.tolist()):
        assert s == sum(held[d])
        held[d].append(k)
    assert all(sum(held[d]) == d + 1 for d in range(3 * capacity + 1))


@pytest.mark.parametrize("file_bytes, rows", [(16_000_000, None), (3000, None), (3000, [(i, "word " * (i % 61), None) for i in range(400)])])
def test_harmonic_packing(spark, monkeypatch, file_bytes, rows):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_ids, "FILE_BYTES", file_bytes)
    rows = texts() if rows is None else rows
    path = token_ids.public_tokenizer()
    whole = Tokenizer.from_file(path)
    want = Counter((i, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 2])) for i, t, _ in rows)
    packed = packing.pack(documents(spark, rows).repartition(5), path, columns=("ids", "ids_crc32")).cache()
    out = packed.collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in out)
    # pieces of equal doc_ids are told apart by what they would make: each document's pieces follow each other from 0 to doc_tokens
    left = Counter((r.doc_id, r.start, r.length, r.doc_tokens, tuple(r.ids)) for r in out)
    chains = Counter()
    for doc_id, ids in want.elements():
        at = 0
        while at < len(ids):
            hit = next(p for p in left if left[p] and p[0] == doc_id and p[1] == at and p[3] == len(ids) and p[4] == ids[at : at + p[2]])
            left[hit] -= 1
            at += hit[2]
        chains[(doc_id, ids)] += 1
    assert chains == want and not +left
    in_sequence = defaultdict(list)
    for r in out:
        in_sequence[r.sequence_id].append((r.offset, r.length, r.ids))
    padding = 0
    for parts in in_sequence.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
        assert at & (at - 1) == 0 or 4096 - at <= packing.WASTE
    assert padding <= packing.WASTE / 4096 * sum(len(i) for _, i in want.elements())
    made = {r.sequence_id: list(r.ids) for r in packing.sequences(packed).collect()}
    assert made == {s: [x for p in sorted(parts) for x in p[2]] for s, parts in in_sequence.items()}
    assert packing.pack(documents(spark, []), path).collect() == []


def _coded(rows, width, parts=8, entries=16, rounds=6):
    """Codes by plain loops over Python integers."""
    kept = [(i, [int(np.floor(4096 * float(np.float32(x)))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [(p * width // parts, (p + 1) * width // parts) for p in range(parts)]
    books = [[v[a:b] for _, v, _ in kept[:entries]] for a, b in cut]

    def assign(v):
        return [min((sum((x - y) ** 2 for x, y in zip(v[a:b], c)), e) for e, c in enumerate(books[p])) for p, (a, b) in enumerate(cut)]

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for p, (_, e) in enumerate(assign(v)):
                groups[p, e].append(v[cut[p][0] : cut[p][1]])
        for (p, e), members in groups.items():
            books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    found = [(i, "".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a), label) for i, v, label in kept for a in [assign(v)]]
    per = Counter()
    for f in found:
        per[f[3]] += f[2]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return Counter((i, code, error, per[label], digest) for i, code, error, label in found)


@pytest.mark.parametrize("width, n", [(16, 300), (11, 60), (5, 9)])
@pytest.mark.parametrize("few", [10_000, 1])
def test_vector_codes(spark, monkeypatch, width, n, few):
    monkeypatch.setattr(vector_codes, "FEW_LABELS", few)
    monkeypatch.setattr(vector_codes, "ROWS", 50)
    rng = np.random.default_rng(width)
    rows = [(int(i), rng.normal(size=width).astype(np.float32).tolist(), int(rng.integers(3)) if i % 5 else None) for i in rng.permutation(n)]
    rows += [(n, None, 1), (n + 1, [None, *rows[0][1][1:]], 1), (n + 2, [float("nan"), *rows[0][1][1:]], 0), (-5, [float("inf"), *rows[0][1][1:]], 0)]
    rows += [rows[0], rows[1], (3, [0.0] * width, None), (None, rows[2][1], 2), (n + 7, [-1e-5] * width, 2)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, codes int, error string").repartition(3)
    assert Counter(map(tuple, vector_codes.compressed(df).collect())) == _coded(rows, width)


def test_vector_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compressed(spark.createDataFrame([], schema)).collect() == []
    assert vector_codes.compressed(spark.createDataFrame([(1, None, 1)], schema)).collect() == []
    other = spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 7, 1), (3, [], 1), (4, [1e30] * 8, 1)], schema)
    out = {r.vec_id: r for r in vector_codes.compressed(other).collect()}
    assert set(out) == {1, 4} and out[1].error == 0 and out[4].error == 0
    assert [r.code for r in vector_codes.compressed(spark.createDataFrame([(1, [], 1), (2, [], 1)], schema)).collect()] == ["00" * 8] * 2
    books = vector_codes.fit(other)
    back = vector_codes.encode(other, books).select("vec_id", vector_codes.decode(F.col("codes"), books).alias("v")).collect()
    assert {r.vec_id: r.v for r in back}[1] == [4096] * 8
