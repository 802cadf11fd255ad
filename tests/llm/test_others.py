"""WARC, embeddings, toxicity, the pipeline and its guard."""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
from fixtures import documents, texts
from pyspark.sql import functions as F

from loomgraph.llm import common, metric_join, queries, toxicity, warc

SF = "/root/testdata/sf0.001"


def _digest(b: bytes) -> str:
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_warc_round_trip(spark):
    rows = [(1, "u", "a"), (2, "v\r\nWARC/1.1 \\n", "a"), (3, None, None), (None, "z", ""), (5, "q", "bb\r\nWARC/1.1\r\n\r\n"), (6, "r", "a"), (7, "s", "é" * 5000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    out = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(out) == len(rows)
    for i, _, html in rows:
        b = (html or "").encode()
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(b), _digest(b))
    assert [(out[i].record_type, out[i].refers_to) for i in (1, 2, 6, 3, None)] == [("response", None), ("revisit", 1), ("revisit", 1), ("response", None), ("revisit", 3)]


def test_warc_pushdown_and_order(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}\\n\n", "x" * i) for i in range(20)], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/w", least_bytes=10**6)
    df = warc.read(spark, f"file://{tmp_path}/w").where("page_id = 7")
    assert [(r.target_uri, bytes(r.payload)) for r in df.collect()] == [("http://h/7\\n\n", b"x" * 7)]
    assert warc.read(spark, f"file://{tmp_path}/w", ["page_id", "payload_bytes"]).agg(F.sum("payload_bytes")).first()[0] == 190
    assert warc.read(spark, f"file://{tmp_path}/none").collect() == []


def test_warc_of_another_writer(spark, tmp_path):
    import gzip

    block = b"HTTP/1.1 200 OK\r\n\r\nhi"
    one = lambda kind, uri: b"WARC/1.0\r\nwarc-type:" + kind + b"\r\nWARC-TARGET-URI: " + uri + b"\r\nX-Odd: \xff\xfe\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, [one(b"warcinfo", b"f"), one(b"response", b"http://h/a\\n"), one(b"response", b"http://h/b")])))
    rows = warc.read(spark, f"file://{tmp_path}").where("record_type = 'response'").collect()
    assert [(r.target_uri, r.payload_bytes, bytes(r.payload), r.page_id) for r in rows] == [("http://h/a\\n", len(block), block, None), ("http://h/b", len(block), block, None)]


def test_warc_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_metric_join(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "BLOCK", 30)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 8))
    x = [(base[rng.integers(30)] + rng.normal(size=8) * rng.choice([0, 0.05, 0.2, 0.5])).astype(np.float32).tolist() for _ in range(200)]
    odd = [(500, None), (501, [0.0] * 8), (502, [1.0, None, *[0.0] * 6]), (503, [float("nan")] * 8), (504, [1.0, 2.0]), (505, [2.0, 4.0]), (None, x[0]), (506, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in [*enumerate(x), *odd]], "vec_id long, embedding array<float>, cell int, copies int")
    out = {r.vec_id: r for r in metric_join.near_duplicates(df, 0.95, 40).collect()}
    a = np.array(x, np.float64)
    a /= np.linalg.norm(a, axis=1)[:, None]
    link = a @ a.T >= 0.95
    np.fill_diagonal(link, False)
    comp = np.arange(200)
    for _ in range(200):
        comp = np.array([min(comp[i], comp[link[i]].min(initial=999)) for i in range(200)])
    for i in range(200):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (link[i].sum(), comp[i], comp[i] == i)
    assert all((out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True) for i in (500, 501, 502, 503, 506))
    assert (out[505].n_links, out[505].component_id) == (1, 504) and out[None].n_links == 0
    assert metric_join.near_duplicates(df.where("vec_id < 0")).collect() == []


def test_gradients():
    net = toxicity.Network.new(np.zeros(0, np.uint64), np.zeros(0), np.random.default_rng(0).normal(size=toxicity.GRAMS), 0.0).index()
    w = toxicity.words_of(["abc def ghi you are low", "x"])
    ids = net.ids(w.hashes)
    _, first, length = toxicity.windows_of(w.at)
    label = np.array([1.0, 0.0], np.float32)
    g = net.gradients(w, ids, first, length, label, np.ones(2, np.float32))

    def loss() -> float:
        z = net.score(net.inputs(w, ids), first, length).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(z)) - label * z))

    for name in ("rec", "att", "out", "in_c", "in_b", "bias", "gram"):
        k = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old = net.p[name][k]
        net.p[name][k] = old + 1e-2
        up = loss()
        net.p[name][k] = old - 1e-2
        slope = (up - loss()) / 2e-2
        net.p[name][k] = old
        assert abs(slope - g[name][k]) < 2e-3


def test_toxicity_held_out(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    labels = common.table(spark, "/root/testdata/sf0.01", "labels")
    net = toxicity.fit(docs, labels)
    scored = toxicity.scores(docs, net)
    rows = scored.join(labels, "doc_id").select("doc_id", toxicity.held_out().alias("h"), "toxic", "predicted", "score").collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.h]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.9
    scores = {r.toxic: np.mean([x.score for x in held if x.toxic == r.toxic]) for r in held}
    assert scores[1] > scores[0] + 0.3
    odd = toxicity.scores(documents(spark), net).collect()
    assert len(odd) == len(texts()) and all(0 <= r.score <= 1 for r in odd)
    d = documents(spark)
    assert toxicity.without_toxic(d, net).columns == d.columns


def test_toxicity_without_labels(spark):
    net = toxicity.fit(documents(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.scores(documents(spark), net).collect()} == {0}


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "suffix_array", "mixing", "sentencepiece"]
    docs, names = common.table(spark, SF, "documents"), common.table(spark, SF, "documents").columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF), name)
        counts.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == names
    assert counts[0] >= counts[1] >= counts[2] == counts[3] and counts[5] == counts[4] > 0
    assert docs.where("NOT round_trip").count() == 0


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Nulls, empty and very long texts, ties and repeats, clashing extra columns; then no rows at all; reruns agree."""
    import corpus_pipeline

    spark.createDataFrame([(i, 0) for i in range(30)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (None, []):
        docs = documents(spark, rows)
        names, runs = docs.columns, []
        for _ in range(2):
            now = docs
            for name, stage in corpus_pipeline.STAGES:
                now = common.written(stage(spark, now, str(tmp_path)), name)
                if name != "sentencepiece":
                    assert now.columns == names
            runs.append(sorted(map(str, now.select("doc_id", "ids").collect())))
        assert runs[0] == runs[1] and bool(runs[0]) == (rows is None)


def test_every_operator_is_registered():
    found = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 14))


def test_toxicity_learns_from_long_texts_alone(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 400_000)
    bad, good = "you vile idiot " * 20, "a calm walk by the river " * 20
    rows = [(i, (bad if i % 2 else good) * 40) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    sample = toxicity.sample_of(docs, labels, 50).collect()
    whole = dict(rows)
    assert all(r.text == whole[r.doc_id] for r in sample) and 380_000 < sum(len(r.text) for r in sample) <= 400_000
    assert toxicity.sample_of(docs.unionByName(docs), labels, 50).count() == len(sample)
    assert toxicity.sample_of(docs, labels, 7).count() == 7
    out = toxicity.scores(docs, toxicity.fit(docs, labels)).collect()
    assert all(r.predicted == r.doc_id % 2 for r in out)


def test_scores_of_empty_documents(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.scores(docs, toxicity.fit(docs, labels)).collect() == []


def test_sample_at_its_full_bound_trains_in_bounded_memory(monkeypatch):
    """Arrays for each character of the sample stay below what the bound promises; a tenth of it is measured."""
    import tracemalloc

    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    rng = np.random.default_rng(3)
    words = np.array([f"w{k}" for k in range(5000)])
    n = toxicity.SAMPLE_CHARS // 10 // 60_000
    sample = [" ".join(rng.choice(words, 10_300)) for _ in range(n)]
    size = sum(map(len, sample))
    tracemalloc.start()
    toxicity.train(sample, np.arange(n) % 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 + 9 * size  # what does not grow with the sample, and its arrays


def test_forward_pass_against_a_plain_loop():
    rng = np.random.default_rng(4)
    texts = ["alpha beta beta gamma", "delta", "", " ".join(f"w{i % 7}" for i in range(150))]
    known = np.unique(toxicity.words_of(texts).hashes)[:5]
    net = toxicity.Network.new(known, rng.normal(size=len(known)), rng.normal(size=toxicity.GRAMS), 0.1).index()
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h = toxicity.HIDDEN
    for text, got in zip(texts, net.texts(texts)):
        w = toxicity.words_of([text])
        where = {int(x): i for i, x in enumerate(known)}
        ends = [*w.starts[1:], len(w.grams)]
        x = []
        for k in range(len(w.hashes)):
            word = net.p["word"][where.get(int(w.hashes[k]), len(known))]
            gram = sum((net.p["gram"][g] for g in w.grams[w.starts[k] : ends[k]]), np.zeros(toxicity.CHAR_DIM))
            x.append([word @ net.p["in_w"][d] + gram @ net.p["in_c"][d] + net.p["in_b"][d, 0] for d in (0, 1)])
        best = -np.inf
        for at in range(0, max(1, len(x)), toxicity.STRIDE):
            part = x[at : at + toxicity.WINDOW]
            states = []
            for d in (0, 1):
                s, own = np.zeros(h), []
                for step in part if d == 0 else part[::-1]:
                    a, u = step[d], s @ net.p["rec"][d]
                    z, r = sigmoid(a[:h] + u[:h]), sigmoid(a[h : 2 * h] + u[h : 2 * h])
                    s = z * s + (1 - z) * np.tanh(a[2 * h :] + r * u[2 * h :])
                    own.append(s)
                states.append(own if d == 0 else own[::-1])
            e = np.array([f @ net.p["att"][0] + b @ net.p["att"][1] for f, b in zip(*states)])
            v = np.array([f @ net.p["out"][0] + b @ net.p["out"][1] for f, b in zip(*states)])
            pooled = (np.exp(e - e.max()) / np.exp(e - e.max()).sum()) @ v if len(e) else 0.0
            best = max(best, pooled + net.p["bias"][0])
            if at + toxicity.WINDOW >= len(x):
                break
        assert abs(best - got) < 1e-3


def test_gradients_of_words():
    texts = ["abc def ghi you are low", "abc x"]
    w = toxicity.words_of(texts)
    known = np.unique(w.hashes)
    rng = np.random.default_rng(2)
    net = toxicity.Network.new(known, rng.normal(size=len(known)), rng.normal(size=toxicity.GRAMS), 0.0).index()
    ids = net.ids(w.hashes)
    _, first, length = toxicity.windows_of(w.at)
    label = np.array([1.0, 0.0], np.float32)
    g = net.gradients(w, ids, first, length, label, np.ones(2, np.float32))

    def loss() -> float:
        z = net.score(net.inputs(w, ids), first, length).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(z)) - label * z))

    for name in ("word", "in_w"):
        k = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old = net.p[name][k]
        net.p[name][k] = old + 1e-2
        up = loss()
        net.p[name][k] = old - 1e-2
        slope = (up - loss()) / 2e-2
        net.p[name][k] = old
        assert abs(slope - g[name][k]) < 2e-3


def test_scratch_tables_go(spark):
    from pathlib import Path

    with common.scratch(spark):
        gone = common.written(spark.range(3), "gone").inputFiles()[0]
        stays = common.kept(spark.range(3), "stays")
    assert stays.count() == 3 and not Path(gone.removeprefix("file://")).exists()
