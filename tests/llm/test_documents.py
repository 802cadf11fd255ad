"""Operators over documents against brute force, on awkward rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from fixtures import documents, texts

from loomgraph.llm import chosen_path, fingerprints, lpf_dedup, mixing, pieces, sentencepieces, token_counts, token_ids


def shingles(t: str | None) -> frozenset:
    w = [x for x in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_fingerprints(spark):
    rows = sorted(texts(), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = fingerprints.edited_pairs(documents(spark)).collect()
    assert len(out) == len(rows)
    of = defaultdict(list)
    for r in out:
        of[r.doc_id].append(r)
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for (i, t, _), (_, u, _) in zip(rows, [*rows[1:], rows[0]]):
        t, u = t or "", u or ""
        edited = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        hit = [r for r in of[i] if r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()]
        assert hit, i
        assert abs(hit[0].near_edited - jaccard(shingles(t), shingles(edited))) < 0.16
        assert (hit[0].fingerprint == "") == (not shingles(t))
    same = {r.fingerprint for r in out if r.doc_id in (30, 32)}
    assert len(same) == 1
    assert fingerprints.edited_pairs(documents(spark, [])).collect() == []


def test_fingerprint_column(spark):
    d = documents(spark)
    assert fingerprints.fingerprint(d).columns == [*d.columns, "fingerprint"]


def test_mixing(spark):
    rows = texts()
    size = lambda t: len([x for x in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if x])
    out = mixing.mix(documents(spark), shard_words=1000).collect()
    assert len(out) == len(rows)
    own, taken, target = defaultdict(int), defaultdict(int), {}
    for _, t, s in rows:
        own[s] += size(t)
    for r in out:
        assert r.taken <= 3 * r.size and r.source_size == own[r.source]
        assert r.taken == sum(x.words for x in r.draws)
        taken[r.source] += r.taken
        target[r.source] = r.target
    # water filling by repeated sharing
    order = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    want, free, left = {}, set(order), float(sum(own.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * own[s]}
        for s in over or free:
            want[s] = 3.0 * own[s] if over else share[s]
        if not over:
            break
        left -= sum(want[s] for s in over)
        free -= over
    for s in order:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 1
    again = mixing.mix(documents(spark), shard_words=1000).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mixing.mix(documents(spark, [])).collect() == []
    d = documents(spark)
    mixed = mixing.mixed_documents(d)
    assert mixed.columns[: len(d.columns)] == d.columns
    words = sum(size(r.text) for r in mixed.select("text").collect())
    assert words == sum(r.taken for r in out)


def test_mixing_fills_every_shard_with_all_sources(spark, monkeypatch):
    """Many more shards than the least number of blocks: each shard holds the sources in about their shares."""
    monkeypatch.setattr(mixing, "BLOCKS", 16)
    rows = [(i, f"w{i} a b c", f"s{i % 3}") for i in range(12_000)]
    out = mixing.mix(documents(spark, rows), shard_words=800).collect()
    words, shard = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in out:
        for x in r.draws:
            words[r.source] += x.words
            shard[x.shard][r.source] += x.words
    target = {r.source: r.target for r in out}
    assert len(shard) == 64 and all(abs(words[s] - target[s]) <= 1 for s in target)
    for own in shard.values():
        total = sum(own.values())
        assert all(abs(own[s] / total - target[s] / sum(target.values())) < 0.2 for s in target)


def test_splitting_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([([100, 300, 0, 7],)], "quotas array<bigint>")
    leaves = mixing.splitting_tree(quotas, 2).collect()
    assert [sum(c) for c in zip(*[r.quotas for r in leaves])] == [100, 300, 0, 7]
    upto = [0, 0, 0, 0]
    for r in sorted(leaves, key=lambda r: r.shard):
        assert r.starts == upto
        upto = [a + b for a, b in zip(upto, r.quotas)]
    assert {sum(r.quotas) for r in leaves} <= {101, 102} and all(q >= 0 for r in leaves for q in r.quotas)


@pytest.mark.parametrize("bucket,whole,block", [(512, 50_000, 1_000_000), (2, 4, 200), (2, 1000, 200)])
def test_jaccard_classes(spark, monkeypatch, bucket, whole, block):
    monkeypatch.setattr(chosen_path, "BUCKET", bucket)
    monkeypatch.setattr(chosen_path, "WHOLE", whole)
    monkeypatch.setattr(chosen_path, "BLOCK_TOKENS", block)
    rows = texts()
    sets = [shingles(t) for _, t, _ in rows]
    link = [{j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8} for i in range(len(rows))]
    least = list(range(len(rows)))
    key = lambda i: (rows[i][0] is not None, rows[i][0] or 0)  # noqa: E731  a null id counts as the least
    for _ in rows:
        least = [min([least[i], *(least[j] for j in link[i])], key=key) for i in range(len(rows))]
    want = sorted((str(rows[i][0]), str(rows[least[i]][0]), len(link[i])) for i in range(len(rows)))
    out = chosen_path.similarity_classes(documents(spark)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in out) == want


@pytest.mark.parametrize("cells", [10**6, 700, 7])
def test_near_pairs_against_sets(monkeypatch, cells):
    monkeypatch.setattr(chosen_path, "TILE_CELLS", cells)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    some = [np.unique(np.concatenate([base[rng.random(40) < 0.97], rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64)])) for _ in range(70)]
    some += [base[:1], base[:2], base[39:]]
    want = [[len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y)) for y in some[30:]] for x in some]
    assert chosen_path.near_pairs(some, some[30:], 0.8).tolist() == want and 0 < np.sum(want) < np.size(want)


def test_blocks_of_short_near_copies_stay_small():
    """A full block of short sets is compared in little memory, whatever the number of sets."""
    import tracemalloc

    base = np.arange(15, dtype=np.uint64)
    block = [np.append(base, np.uint64(100 + k)) for k in range(chosen_path.BLOCK_SETS)]
    tracemalloc.start()
    near = chosen_path.near_pairs(block, block, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert near.all() and peak < 100e6


def test_many_short_near_copies(spark, monkeypatch):
    """A class of more sets than a block holds, each different from the others in its last word."""
    monkeypatch.setattr(chosen_path, "BLOCK_SETS", 700)
    head = " ".join(f"w{k}" for k in range(19))
    out = chosen_path.similarity_classes(documents(spark, [(k, f"{head} x{k}", "s") for k in range(3000)])).collect()
    assert {(r.class_id, r.n_links) for r in out} == {(0, 2999)} and len(out) == 3000


def test_without_near_copies(spark):
    d = documents(spark)
    kept = chosen_path.without_near_copies(d)
    assert kept.columns == d.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(38) == 1 and 31 not in ids and 32 not in ids and 36 in ids and 35 in ids
    assert chosen_path.without_near_copies(documents(spark, [])).collect() == []


@pytest.mark.parametrize("hot", [2048, 1])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(lpf_dedup, "HOT", hot)
    rows = texts()
    raw = [(t or "").encode() for _, t, _ in rows]
    at = defaultdict(list)
    for k, b in enumerate(raw):
        for i in range(len(b) - 199):
            at[b[i : i + 200]].append((k, i))
    runs = defaultdict(list)
    for v in at.values():
        if len(v) > 1:
            for k, i in v:
                runs[k].append({"from": i, "to": i + 200})
    want = []
    for k, b in enumerate(raw):
        m = lpf_dedup.merged(runs[k])
        want.append((str(rows[k][0]), len(b), sum(e - a for a, e in m), len(m), hashlib.sha256(lpf_dedup._cut(b, m)).hexdigest()))
    out = lpf_dedup.removal_report(documents(spark)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == sorted(want)


def test_later_copies_go(spark):
    d = documents(spark)
    out = lpf_dedup.without_later_copies(d)
    assert out.columns == d.columns and out.count() == d.count()
    by = {r.doc_id: r for r in out.collect()}
    full = {i: t for i, t, _ in texts()}
    # the null id comes before all others, so its copy of the shared text is the first
    assert len(by[30].text) < len(full[30]) and by[32].text == "" and by[0].text == full[0]
    assert all(r.n_chars == len(r.text) for r in by.values())
    assert lpf_dedup.without_later_copies(documents(spark, [])).collect() == []


def test_factors_against_brute_force():
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 99, (60, 6)).astype(np.uint8)
    previous, following = lpf_dedup.longest_previous_factors(rows, np.arange(60))
    common = lambda a, b: next((i for i in range(6) if a[i] != b[i]), 6)
    for i in range(60):
        assert previous[i] == max([common(rows[i], rows[j]) for j in range(i)], default=0)
        assert following[i] == max([common(rows[i], rows[j]) for j in range(i + 1, 60)], default=0)


def test_token_ids(spark):
    from tokenizers import Tokenizer

    path = token_ids.public_tokenizer()
    whole = Tokenizer.from_file(path)
    rows = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for i, t, _ in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((str(i), start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    out = token_ids.round_trip(documents(spark), path).collect()
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in out) == sorted(want)
    assert token_ids.round_trip(documents(spark, []), path).collect() == []


def test_token_files_of_a_range(spark, monkeypatch):
    """Several files a range, several blocks a file, and random access to documents."""
    monkeypatch.setattr(token_ids, "FILE_BYTES", 3000)
    monkeypatch.setattr(token_ids, "RANGES", 2)
    path = token_ids.public_tokenizer()
    rows = [(i, f"one two {i} three " * (40 if i != 5 else 6000), "s") for i in range(60)]
    files = token_ids.write_ids(documents(spark, rows), path)
    made = sorted(files.collect())
    assert max(r.part for r in made) > 3 and len({r.range for r in made}) == 2
    assert [r.start for r in made] == [sum(x.n_ids for x in made[:k]) for k in range(len(made))]
    encode = token_ids.WordEncoder(path)
    text, seen, blocks = {i: t for i, t, _ in rows}, [], 0
    for r in made:
        with token_ids.TokenFile(r.uri) as f:
            blocks = max(blocks, len(f._at) - 1)
            for k in reversed(range(len(f.doc_ids))):
                want = np.frombuffer(encode([text[int(f.doc_ids[k])]])[0], "<u4")
                assert (f.document(k) == np.append(want, 2)).all()
            seen += f.doc_ids.tolist()
    assert seen == list(range(60)) and blocks > 5
    assert sorted(r.doc_id for r in token_ids.read_ids(files).collect()) == seen


def test_one_encoder_a_worker():
    """Tasks of a worker share an encoder and its words; its cuts are the library's, of ASCII and other texts."""
    path = token_ids.public_tokenizer()
    encode = token_ids.word_encoder(path)
    assert token_ids.word_encoder(path) is encode
    texts = ["It's we'LL they'Re I'm x'd 'tis 12a3'S don''t !?'s\n a'", "ÉCOLE's ñandú'll ½x²'t «ça»'ve ÿ\xa0é Þ'm", "", "~'`' #1's"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [encode.whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 32])
def test_packing(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 777).astype(np.uint32)
    assert (token_ids.unpack(token_ids.pack(x, bits), bits, 777) == x).all()


def test_token_counts(spark):
    model = pieces.public_model()
    names, _, kinds = pieces.vocabulary(model)
    vocabulary = {n.encode() for n, k in zip(names, kinds) if k == "normal"}
    most = max(map(len, vocabulary))

    def greedy(word: bytes) -> int:
        s, i, n = "▁".encode() + word, 0, 0
        while i < len(s):
            i += next((k for k in range(min(most, len(s) - i), 1, -1) if s[i : i + k] in vocabulary), 1)
            n += 1
        return n

    rows = texts()
    out = token_counts.token_counts(documents(spark, rows), model).collect()
    want = sorted((str(i), sum(greedy(w) for w in (t or "").encode().split())) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == want
    assert token_counts.token_counts(documents(spark, []), model).collect() == []


def test_sentencepiece_nbest():
    e = sentencepieces.Encoder(pieces.public_model())

    def every(u: str) -> list[float]:
        out = []

        def go(i: int, s: float) -> None:
            if i == len(u):
                out.append(s)
            for j in range(i + 1, min(len(u), i + e.most) + 1):
                k = e.ids.get(u[i:j])
                if k is not None:
                    go(j, s + float(e.scores[k]))
                elif j == i + 1:
                    go(j, s + len(u[i:j].encode()) * e.unknown)

        go(0, 0.0)
        return sorted(out, reverse=True)

    for text in ["to be or not", "thé añ 🙂x", "a  b", "x\ny z"]:
        want = every("▁" + text.replace(" ", "▁"))[: sentencepieces.NBEST]
        assert np.allclose(e([text])[0][1], want)


def test_sentencepiece_round_trip(spark):
    out = sentencepieces.encode(documents(spark), pieces.public_model()).collect()
    assert len(out) == len(texts()) and all(r.round_trip for r in out)
    assert all(r.nbest_scores == sorted(r.nbest_scores, reverse=True) and r.nbest_pieces[0] == r.n_pieces == len(r.ids) for r in out)
    assert sentencepieces.encode(documents(spark, []), pieces.public_model()).collect() == []


def test_sentencepiece_every_rank_decodes(spark):
    e = sentencepieces.Encoder(pieces.public_model())
    made = {i: k for k, i in e.byte.items()}
    score = lambda ids: sum(e.unknown if i in made else float(e.scores[i]) for i in ids)
    rows = [*texts(), (50, "thé añ 🙂x", "s0"), (51, "a  b ▁a b", "s0"), (52, "to be or not", "s0")]
    out = sentencepieces.encode(documents(spark, rows), pieces.public_model()).withColumn("all", sentencepieces.nbest_ids()).collect()
    assert len(out) == len(rows) and max(len(r.all) for r in out) == sentencepieces.NBEST
    text = defaultdict(set)
    for i, t, _ in rows:
        text[i].add(t or "")
    for r in out:
        assert r.all[0] == r.ids and len({tuple(x) for x in r.all}) == len(r.all) == len(r.nbest_scores)
        assert [len(x) for x in r.all] == r.nbest_pieces
        assert len({e.decode(x) for x in r.all}) == 1 and e.decode(r.all[0]) in text[r.doc_id]
        assert np.allclose([score(x) for x in r.all], r.nbest_scores)


def test_missed_pairs_at_any_depth():
    """Pairs that agree on 51 of 64 values, followed by the code itself over many splits."""
    rng = np.random.default_rng(7)
    bins, runs, levels = chosen_path.BINS, 4000, 12
    a = rng.integers(0, 1 << 16, bins).astype("<u4")
    b = a.copy()
    b[rng.permutation(bins)[51:]] ^= 1
    paths = np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)
    run = np.arange(runs)
    lost = 0.0
    for _ in range(levels):
        (i, p), (j, q) = (chosen_path._children(paths, np.tile(x, (len(paths), 1)), chosen_path.SPREAD) for x in (a, b))
        both = np.isin(p, q)
        paths, run = p[both][:20_000], run[i[both]][:20_000]
        lost = (1 - chosen_path.SPREAD / bins * (1 - lost)) ** 51
        if len(paths) == 20_000:
            break
    share = 1 - len(np.unique(run)) / runs
    assert len(paths) == 20_000 or abs(share - lost) < 0.04
    assert chosen_path.missed(chosen_path.runs_for(chosen_path.RECALL)) < 1 - chosen_path.RECALL


def _varied(rng, words: list[str], changes: int) -> str:
    out = list(words)
    for k in rng.permutation(len(words))[:changes]:
        out[k] = f"z{rng.integers(1 << 40)}"
    return " ".join(out)


def test_recall_of_pairs_near_the_threshold(spark):
    """Two thousand pairs of 0.8 and above, of texts of all lengths, and none of those below it."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(2000):
        n = int(rng.choice([12, 30, 60, 200, 500]))
        words = [f"w{rng.integers(1 << 40)}" for _ in range(n)]
        own = list(words)
        for _ in range(n // 60 + 1):  # at the end a change touches few shingles
            at = n - 1 - int(rng.integers(max(1, n // 25)))
            own[at] = f"y{rng.integers(1 << 40)}"
        rows += [(2 * k, " ".join(words), "s"), (2 * k + 1, " ".join(own), "s")]
    sets = [shingles(t) for _, t, _ in rows]
    near = {k for k in range(0, len(rows), 2) if len(sets[k] & sets[k + 1]) >= 0.8 * len(sets[k] | sets[k + 1])}
    assert len(near) > 1000
    out = {r.doc_id: r for r in chosen_path.similarity_classes(documents(spark, rows)).collect()}
    found = {k for k in range(0, len(rows), 2) if out[k + 1].class_id == k and out[k].n_links == 1}
    assert found <= near and len(found) >= 0.996 * len(near)


def _best_scores(e, text: str, count: int) -> list[float]:
    """The best scores of a whole text by lists at every node, without units."""
    s = "\u2581" + text.replace("\u2581", "\ufdd0").replace(" ", "\u2581") if text else ""
    best = [[0.0]]
    for j in range(1, len(s) + 1):
        found = []
        for i in range(max(0, j - e.most), j):
            k = e.ids.get(s[i:j])
            if k is not None:
                found += [x + float(e.scores[k]) for x in best[i]]
            elif i == j - 1:
                found += [x + (3 if s[i] == "\ufdd0" else len(s[i].encode())) * e.unknown for x in best[i]]
        best.append(sorted(found, reverse=True)[:count])
    return best[-1]


def test_sentencepiece_nbest_of_whole_texts():
    e = sentencepieces.Encoder(pieces.public_model())
    rng = np.random.default_rng(9)
    odd = ["x" * 300, "ab" * 200, "日本語の文章" * 40, "".join(rng.choice(list("etaoin"), 400)), "a▁b" * 60, "▁" * 90, "\n".join("word" for _ in range(50)), "🙂" * 70 + "abc"]
    for text in [t or "" for i, t, _ in texts() if i != 40] + odd:
        got = e([text])[0]
        assert np.allclose(got[1], _best_scores(e, text, sentencepieces.NBEST)), text[:40]
        assert e.decode(np.frombuffer(got[0], "<i4").tolist()) == text


def test_sentencepiece_work_grows_with_the_length():
    import time

    e = sentencepieces.Encoder(pieces.public_model())
    rng = np.random.default_rng(9)
    for text in ["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 100_000))), "x" * 100_000, "".join(rng.choice(list("etaoinshr"), 100_000))]:
        began = time.process_time()
        got = e([text])[0]
        assert time.process_time() - began < 15
        assert e.decode(np.frombuffer(got[0], "<i4").tolist()) == text and len(got[1]) in (1, sentencepieces.NBEST)


def test_sentencepiece_repeated_words_are_looked_up_and_searched_once():
    class Counted(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

        def __getitem__(self, k):
            self.asked += 1
            return super().__getitem__(k)

    e = sentencepieces.Encoder(pieces.public_model())
    e.units, searched, real = Counted(), [], e.nbest
    e.nbest = lambda *a: searched.append(a) or real(*a)
    text = "to be or not to be, that is the question\n" * 500
    first = e([text])
    assert e.units.asked < 100  # of 6,000 words
    n = len(searched)
    assert e([text, text]) == first * 2 and len(searched) == n
    assert np.allclose(first[0][1], _best_scores(e, text, sentencepieces.NBEST))


def test_sentencepiece_units():
    e = sentencepieces.Encoder(pieces.public_model())
    stops = "".join(c for c in ".,;:!?*#$%&" if e.kind[ord(c)] == sentencepieces.STOP)
    assert stops
    rule = re.compile(f"\u2581+[^\\W_]++(?=[{re.escape(stops)}])|\u2581+[^\u2581\n]*|\n|[^\u2581\n]+")
    rng = np.random.default_rng(5)
    rows = ["\u2581" + "".join(rng.choice(list("\u2581\u2581\nab7\u00e9\u0663\u65e5_-.,;:!?*#$%&'\u0301"), 60)) for _ in range(500)]
    points = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
    starts = e._starts(points, np.arange(len(rows)) * 61)
    assert ["".join(rows)[a:b] for a, b in zip(starts, [*starts[1:], len(points)])] == [u for r in rows for u in rule.findall(r)]


def test_sentencepiece_equal_hashes(monkeypatch):
    e = sentencepieces.Encoder(pieces.public_model())
    rows = [t or "" for _, t, _ in texts()] + ["a b ab ba a\ufdd0", "\u2581\ufdd0 \ufdd0 a", "ba aa"]
    want = e(rows)
    monkeypatch.setattr(sentencepieces, "WEIGHTS", sentencepieces.WEIGHTS * np.uint64(0))
    monkeypatch.setattr(sentencepieces, "CHUNK", 50)
    assert sentencepieces.Encoder(pieces.public_model())(rows) == want == [x for r in rows for x in e([r])]
    ids, at = np.frombuffer(b"".join(w[0] for w in want), "<i4"), np.cumsum([0, *[len(w[0]) // 4 for w in want]])
    assert e._gives(ids, at, rows).all()
    for wrong in (rows[-1][::-1], rows[-1] + "s"):
        assert e._gives(ids, at, [*rows[:-1], wrong]).tolist() == [True] * (len(rows) - 1) + [False]


def test_sentencepiece_decode(spark):
    made = sentencepieces.encode(documents(spark), pieces.public_model())
    back = sentencepieces.decode(made, pieces.public_model()).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t, _ in texts())


@pytest.mark.parametrize("whole", [50_000, 700])
def test_one_large_class_of_near_copies(spark, monkeypatch, whole):
    """A class of three thousand different near copies, and half as many texts that share a passage with it but are not near."""
    monkeypatch.setattr(chosen_path, "WHOLE", whole)
    rng = np.random.default_rng(6)
    words, passage = [f"w{k}" for k in range(100)], [f"p{k}" for k in range(30)]
    rows = [(k, _varied(rng, words + passage, 1), "s") for k in range(3000)]
    rows += [(3000 + k, _varied(rng, [f"v{k}x{j}" for j in range(40)] + passage, 0), "s") for k in range(1500)]
    seen = []
    real = chosen_path.components
    monkeypatch.setattr(chosen_path, "components", lambda edges: seen.append(edges.count()) or real(edges))
    out = chosen_path.similarity_classes(documents(spark, rows)).collect()
    assert {r.class_id for r in out if r.doc_id < 3000} == {0}
    assert all(r.class_id == r.doc_id and r.n_links == 0 for r in out if r.doc_id >= 3000)
    assert max(seen[:-1]) < 8 * 3000  # a few stars, not pairs
    links = {r.doc_id: r.n_links for r in out}
    sets = [shingles(t) for _, t, _ in rows[:3000]]
    for k in range(0, 3000, 300):
        assert links[k] == sum(1 for j in range(3000) if j != k and len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j]))


def test_components_of_long_chains(spark, monkeypatch):
    from loomgraph.llm import components as c

    for part in (c.PART_EDGES, 50):
        monkeypatch.setattr(c, "PART_EDGES", part)
        edges = [(k + 1, k) for k in range(400) if k % 100] + [(1000, 500 + k) for k in range(60)]
        out = {r.node: r.component for r in c.components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert all(out[k] == k // 100 * 100 + 1 for k in range(1, 400) if k % 100) and all(out[500 + k] == 500 for k in range(60))
