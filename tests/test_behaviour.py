"""Behaviours stated by hand on small fixtures."""

from __future__ import annotations

import json
import math
import time

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import markup as M
from loomgraph.functions import parse as P
from loomgraph.functions import richtext as T
from loomgraph.functions import text as X
from loomgraph.operators import evaluate as V
from loomgraph.operators import graph as G
from loomgraph.operators import quality as Q
from loomgraph.operators import retrieve as R
from loomgraph.sources import hooks as H
from loomgraph.sources import replay, sinks
from loomgraph.streaming import fold as Z


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw,want", [("5+", (5, None)), ("20-40", (20, 40)), ("20–40", (20, 40)), ("1", (1, 1)), ("10", (10, 10)), ("", (1, None)), ("any", (1, None))])
def test_unit_size(spark, raw, want):
    assert tuple(one(spark, X.unit_size, raw)) == want


@pytest.mark.parametrize("raw,want", [("30 x 60 mm", (30, 60)), ("25x25mm", (25, 25)), ("20 X 20", (20, 20)), ("50×50mm", (50, 50)), ("", (None, None)), (None, (None, None))])
def test_base_size(spark, raw, want):
    assert tuple(one(spark, X.base_size, raw)) == want


def test_scalars(spark):
    assert one(spark, X.lucene_escape, "a+b: [x]/~2 \\ 'ok'!") == r"a\+b\: \[x\]\/\~2 \\ 'ok'\!"
    assert one(spark, X.strip, "  a b  ") == "a b"
    assert [one(spark, X.stem, w) for w in ("furies", "charged", "moving", "boxes", "rules", "is", "red")] == ["fury", "charg", "mov", "box", "rul", "is", "red"]
    assert one(spark, X.camel_to_snake, "SpecialRule") == "special_rule" and one(spark, X.camel_to_snake, "FAQ") == "f_a_q"
    assert one(spark, X.canonical_url, "HTTP://Ex.Com/A/b/?q=1#top") == "http://ex.com/A/b?q=1" and one(spark, X.canonical_url, "http://ex.com") == "http://ex.com/"
    assert [one(spark, X.stat_value, v) for v in ("7", "-", "(+1)", "x", None)] == [7, None, None, None, None]
    assert tuple(one(spark, X.points_cost, "( +5 points per model )")) == (5, "per_model") and tuple(one(spark, X.points_cost, "(+1 point)")) == (1, "flat")
    assert tuple(one(spark, X.points_cost, "+1 point")) == (None, None)
    assert tuple(one(spark, X.document_version, "Rules FAQ – Version 1.2")) == ("Rules FAQ", "1.2")
    assert one(spark, X.yaml_scalar, 'a: "b"') == '"a: \\"b\\""' and one(spark, X.yaml_scalar, "plain") == "plain"


def test_rrf(spark):
    ranked = lambda ids: spark.createDataFrame([(1, i, n + 1) for n, i in enumerate(ids)], "query_id int, id string, rank int")
    got = {r.id: r.score for r in R.rrf([ranked("ab"), ranked("bc")]).collect()}
    assert got["b"] == pytest.approx(1 / 62 + 1 / 61) and got["a"] == pytest.approx(1 / 61)
    assert max(got, key=got.get) == "b"


def test_words_of_any_script(spark):
    assert one(spark, X.words, "Über L'Été_2, señor! 日本語 नमस्ते cafe\u0301") == ["über", "l", "été_2", "señor", "日本語", "नमस्ते", "cafe\u0301"]
    names = spark.createDataFrame([(1, "cole"), (2, "été"), (3, "日本")], "name_id int, name string")
    texts = spark.createDataFrame([(1, "l'école cole"), (2, "l'école"), (3, "Un ÉTÉ, 日本!"), (4, "日本語 étés")], "text_id int, text string")
    assert {tuple(r) for r in R.dictionary_join(names, texts).collect()} == {(1, 1), (2, 3), (3, 3)}
    docs = spark.createDataFrame([(1, "café noir"), (2, "caf noir"), (3, "日本 noir")], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "CAFÉ"), (2, "日本")], "query_id int, text string")
    assert {(r.query_id, r.id) for r in R.bm25(docs, "doc_id", F.col("text"), queries, 8).collect()} == {(1, 1), (2, 3)}


def test_text_contains_join_takes_whole_passages(spark, tmp_path):
    from loomgraph.plans import workload

    make = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    make("benchmark", [(1, "the old red rod."), (2, "the old"), (3, "old")], "item_id long, text string")
    make("labels", [(3,)], "doc_id long")
    make("conversations", [(1, 0, "See the Old red rod, now"), (1, 1, "the old red rod"), (2, 0, "the older rod"), (3, 0, "the old house"), (4, 0, "the")], "conv_id long, turn long, text string")
    assert {tuple(r) for r in workload.text_contains_join(spark, str(tmp_path)).collect()} == {(1, 1), (2, 2)}


def kept(spark, center, rows):
    df = spark.createDataFrame([(center, *r) for r in rows], "center string, src string, dst string, relation string")
    return {(r.src, r.dst, r.relation) for r in G.capped_bfs(df).collect()}


def test_capped_bfs(spark):
    """Caps: CONTAINS 3, SUPPLIED_BY 5, PLACED_BY 20, others 4; tiers: IN_NATION 1, SUPPLIED_BY 2, CONTAINS 3."""
    star = [("m", f"p{i}", "CONTAINS") for i in range(6)]
    assert kept(spark, "m", star) == set(star[:3])
    # a better tier claims the neighbour, whatever the name of its relation
    both = [("m", "a", "CONTAINS"), ("m", "a", "IN_NATION")]
    assert kept(spark, "m", both) == set(both)
    tiers = [("m", f"p{i}", "CONTAINS") for i in range(3)] + [("m", f"p{i}", "SUPPLIED_BY") for i in range(2)]
    assert kept(spark, "m", tiers) == set(tiers)
    # a level is walked in sorted order, not in order of discovery: b comes before z though z is found first by tier
    levels = [("m", "z", "IN_NATION"), ("m", "b", "CONTAINS"), ("z", "t", "CONTAINS"), ("b", "t", "CONTAINS")]
    assert kept(spark, "m", levels) == set(levels)
    crowd = [("m", "b", "X"), ("m", "z", "X")] + [("b", f"t{i}", "X") for i in range(4)] + [("z", f"t{i}", "X") for i in range(4)]
    # pass one: b claims t0..t3; then z has room for 3 more edges of X beside the one to m, each t for three more
    assert kept(spark, "m", crowd) == set(crowd[:2]) | {("b", f"t{i}", "X") for i in range(4)} | {("z", f"t{i}", "X") for i in range(3)}
    # what a claimed edge uses up counts at the child too
    child = [("m", "c", "CONTAINS"), ("c", "d", "CONTAINS"), ("c", "e", "CONTAINS"), ("d", "e", "CONTAINS"), ("m", "d", "SUPPLIED_BY"), ("m", "e", "SUPPLIED_BY")]
    assert kept(spark, "m", child) == set(child)
    loop = [("m", "m", "X"), ("m", "a", "X"), ("q", "r", "X")]
    assert kept(spark, "m", loop) == set(loop[:2])


def test_shortest_route_names_the_nodes(spark):
    e = spark.createDataFrame([("a", "b", "R"), ("b", "c", "R"), ("a", "x", "R"), ("x", "c", "R"), ("c", "d", "R")], "src string, dst string, relation string")
    pairs = spark.createDataFrame([("a", "d"), ("a", "a"), ("a", "zz"), ("d", "a")], "a string, b string")
    assert {(r.a, r.b): (r.hops, r.route) for r in G.shortest_route(e, pairs).collect()} == {("a", "d"): (3, "a>b>c>d"), ("a", "a"): (0, "a"), ("a", "zz"): (None, None), ("d", "a"): (3, "d>c>b>a")}


def test_long_names_are_matched_whole(spark):
    names = spark.createDataFrame([(1, "the very long name of five"), (2, "very long name"), (3, "long furies charging home now (x)"), (4, "furies")], "id int, name string")
    queries = spark.createDataFrame([(1, "Is THE very long name of five here?"), (2, "the very long name of four"), (3, "long fury charged home now?")], "query_id int, text string")
    assert {(r.query_id, r.id) for r in R.lexical_matches(names, queries).collect()} == {(1, 1), (1, 2), (2, 2), (3, 3)}


def test_traversal(spark):
    e = spark.createDataFrame([("king", "fear", "HAS_RULE"), ("fear", "terror", "REFERENCES")], "src string, dst string, relation string")
    at = lambda c, depth: {r.id for r in G.hops(e, spark.createDataFrame([(c,)], "center string"), depth).collect()}
    assert at("fear", 2) == {"king", "fear", "terror"} and at("terror", 1) == {"terror", "fear"}


def test_merges_are_idempotent_and_ignore_partitioning(spark):
    rows = spark.createDataFrame([(i % 7, i % 2, i, f"v{i}") for i in range(100)], "a int, b int, seq int, v string")
    want = sorted(G.last_wins(rows, ["a", "b"], "seq").collect())
    assert want == sorted(G.last_wins(rows.repartition(5, "v"), ["a", "b"], "seq").collect())
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "old")], "id int, name string, text string")
    new = spark.createDataFrame([(2, None, "t"), (3, "c", None)], "id int, name string, text string")
    some = spark.createDataFrame([(2, "first", 1), (2, "last", 2)], "id int, name string, seq int")
    assert {tuple(r) for r in G.merge_rows(old, some, "id", ["name", "text"], "seq").collect()} == {(1, "a", "x"), (2, "last", "old")}
    assert {tuple(r) for r in G.fill_rows(old, new, "id", ["name", "text"]).collect()} == {(1, "a", "x"), (2, "b", "t")}
    once = G.merge_rows(old, new, "id", ["name", "text"])
    assert sorted(map(str, once.collect())) == sorted(map(str, G.merge_rows(once, new, "id", ["name", "text"]).collect()))
    assert {tuple(r) for r in once.collect()} == {(1, "a", "x"), (2, None, "t"), (3, "c", None)}


def metric(spark, found, expected, k=8):
    df = spark.createDataFrame([(1, found, expected)], "query_id int, found array<string>, expected array<string>")
    return V.metrics(df, k).first()


def test_metrics(spark):
    assert metric(spark, ["a", "b", "c"], ["a"]).precision == pytest.approx(1 / 3)
    assert metric(spark, ["x", "y", "a"], ["a"]).mrr == pytest.approx(1 / 3) and metric(spark, ["x"], ["a"]).mrr == 0.0
    assert metric(spark, ["a", "b", "c"], ["a", "b"]).ndcg == pytest.approx(1.0)
    assert metric(spark, ["a", "c"], ["a", "b"]).f1 == pytest.approx(0.5) and metric(spark, ["x"], ["a"]).f1 == 0.0
    assert metric(spark, ["a"], []).recall is None
    assert metric(spark, [], ["a"]).ndcg is None and metric(spark, [], ["a"]).precision is None and metric(spark, [], ["a"]).mrr == 0.0
    assert metric(spark, ["x", "a"], ["a"], 1).recall == 0.0


def test_wilcoxon():
    assert V.wilcoxon_p(0, 8) < 0.05 and V.wilcoxon_p(0, 0) == 1.0
    assert V.wilcoxon_p(120, 30) == pytest.approx(0.01966, abs=5e-6)  # exact, where the normal gives 0.02067
    assert V.wilcoxon_p(120, 30, ties=6.0) == pytest.approx(math.erfc(112.5 / math.sqrt((30 * 31 * 61 - 3) / 24) / math.sqrt(2)))
    assert V.wilcoxon_p(0, 8) == pytest.approx(2 / 2**8) and math.isclose(V.wilcoxon_p(18, 8), 1.0, abs_tol=0.1)


def test_rich_text(spark):
    text = lambda t: {"nodeType": "text", "value": t}
    link = {"nodeType": "entry-hyperlink", "data": {"target": {"fields": {"slug": "fear"}, "sys": {"contentType": {"sys": {"id": "rule"}}}}}, "content": [text("Fear")]}
    block = {"nodeType": "embedded-entry-block", "data": {"target": {"fields": {"bodyIndex": "inner"}, "sys": {"contentType": {"sys": {"id": "table"}}}}}, "content": []}
    item = lambda *c: {"nodeType": "list-item", "content": list(c)}
    nested = {"nodeType": "unordered-list", "content": [item({"nodeType": "paragraph", "content": [text("Spear")]})]}
    tree = {"nodeType": "document", "content": [{"nodeType": "paragraph", "content": [text("One of: "), link]}, {"nodeType": "unordered-list", "content": [item({"nodeType": "paragraph", "content": [text("Lance")]}, nested)]}, block]}
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, None), (3, "{broken")], "k int, t string")
    assert {r.k: r.p for r in df.select("k", T.text_of(F.col("t")).alias("p")).collect()} == {1: "One of: FearLanceSpearinner", 2: "", 3: ""}
    assert [(r.slug, r.content_type) for r in T.links(df, "k", "t").collect()] == [("fear", "rule")]
    assert [r.h for r in df.select(T.has_block(F.col("t"), "table").alias("h")).collect()] == [True, False, False]
    o = df.where("k = 1").select(F.explode(T.options(F.col("t"))).alias("o")).select("o.*").collect()
    assert [(r.list_no, r.header, r.text) for r in o] == [(1, "One of: Fear", "Lance"), (2, "Lance", "Spear")]


def test_markdown():
    html = "<html><head><title>t</title></head><body><nav><a href='/x'>x</a></nav><h1>Head <i>in</i></h1><p>Some <b>bold</b> <a href='/u/a#f'>link</a></p><ul><li>one</li><li>two</li></ul><script>no</script></body></html>"
    md = M.to_markdown(html, {"/u/a": "u/a.md"}, "v/b.md")
    assert md.startswith("# Head *in*") and "Some **bold** [link](../u/a.md#f)" in md and "- one\n- two" in md and "no" not in md.split("two")[1]
    assert M.heading(html) == "Head" and M.to_markdown(None) == ""


def test_stream_fold(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (2, 0, "assistant", "d")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns.coalesce(1).write.parquet(f"{tmp_path}/turns")
    batch = [tuple(r) for r in Z.message_events(turns).orderBy("conv_id", "seq").collect()]
    assert batch[:4] == [(1, 1, "reasoning-start", None), (1, 2, "reasoning-delta", "a"), (1, 3, "reasoning-delta", "b"), (1, 4, "reasoning-end", None)]
    s = spark.readStream.schema(turns.schema).parquet(f"{tmp_path}/turns")
    q = Z.streamed_events(s).writeStream.format("memory").queryName("fold").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    last = {c: max(x[1] for x in batch if x[0] == c) for c in (1, 2)}
    want = [x for x in batch if x[1] != last[x[0]]]  # the last runs stay open until they have been idle
    until = time.monotonic() + 60
    while spark.sql("SELECT count(*) FROM fold").first()[0] < len(want) and time.monotonic() < until:  # with a timeout set, batches never end
        time.sleep(0.5)
    q.stop()
    assert [tuple(r) for r in spark.sql("SELECT * FROM fold ORDER BY conv_id, seq").collect()] == want


def test_idle_conversations_end():
    class State:
        hasTimedOut, exists, get, gone = True, True, ("user", 4), False

        def remove(self):
            self.gone = True

    s = State()
    assert [tuple(r) for f in Z.fold_state((1,), iter(()), s) for r in f.itertuples(index=False)] == [(1, 5, "reasoning-end", None)] and s.gone


def test_stream_deduplicates_and_windows(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, id % 3 AS k, 'a' AS event_type, 1.0D AS value FROM range(9)").coalesce(1).write.parquet(f"{tmp_path}/e")
    e = spark.readStream.schema("ts timestamp, k long, event_type string, value double").parquet(f"{tmp_path}/e")
    q = Z.deduplicated(e, ["k"]).writeStream.format("memory").queryName("dedup").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*) FROM dedup").first()[0] == 3


def test_sinks_and_replay(spark, tmp_path):
    pages = spark.createDataFrame([("http://a", "unit", "a.html", "2024-01-01"), ("http://b", "rule", "b.html", None)], "url string, page_type string, html_path string, fetched_at string")
    sinks.write_manifest(pages, f"{tmp_path}/m")
    assert sorted(sinks.read_manifest(spark, f"{tmp_path}/m").collect()) == sorted(pages.collect())
    nodes = spark.createDataFrame([("1", "A", "x"), ("2", "B", "y")], "id string, label string, name string")
    sinks.write_by_label(nodes, f"{tmp_path}/n")
    assert spark.read.parquet(f"{tmp_path}/n").where("label = 'A'").count() == 1
    at = f"{tmp_path}/u"
    sinks.upsert(nodes, at, "id", ["label", "name"])
    assert sorted(sinks.upsert(nodes, at, "id", ["label", "name"]).collect()) == sorted(nodes.collect())
    sinks.upsert(spark.createDataFrame([("2", "second")], "id string, name string"), at, "id", ["label", "name"])
    sinks.upsert(spark.createDataFrame([("3", "C", "z")], "id string, label string, name string"), at, "id", ["label", "name"])
    assert {tuple(r) for r in sinks.current(spark, at).collect()} == {("1", "A", "x"), ("2", "B", "second"), ("3", "C", "z")}
    sinks.wipe(spark, at)
    assert sinks.current(spark, at) is None
    files = spark.createDataFrame([("u/a.md", "héllo"), ("b.md", None)], "path string, content string")
    assert {r.path: r.bytes for r in sinks.write_texts(files, f"file://{tmp_path}/md").collect()} == {"u/a.md": 6, "b.md": 0}
    assert (tmp_path / "md/u/a.md").read_text() == "héllo"
    assert "| n/a | 0.500 |" in sinks.markdown_report([{"a": None, "b": 0.5}], "t")
    found = replay.frontier(spark.createDataFrame([("a",)], "url string"), spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "from_url string, to_url string"), 2)
    assert {r.url: r.round for r in found.collect()} == {"a": 0, "b": 1, "c": 2}


def test_graph_files_and_caches(spark, tmp_path):
    nodes = spark.createDataFrame([("1", "A", "x"), ("2", "B", None)], "id string, label string, name string")
    sinks.write_graph(nodes, spark.createDataFrame([("1", "2", "R")], "src string, dst string, relation string"), f"{tmp_path}/g")
    assert {tuple(r) for r in sinks.read_graph(spark, f"{tmp_path}/g", ["A", "Missing"], "id string, name string").collect()} == {("1", "x", "A")}
    vectors = spark.createDataFrame([("1", "A", [3.0, 4.0]), ("2", "A", None)], "id string, label string, embedding array<float>")
    sinks.vector_table(vectors, f"{tmp_path}/v", 2)
    assert [round(x, 4) for x in spark.read.parquet(f"{tmp_path}/v").first()["embedding"]] == [0.6, 0.8]
    with pytest.raises(Exception, match="wrong size"):
        sinks.vector_table(vectors, f"{tmp_path}/w", 3)
    (tmp_path / "html").mkdir()
    (tmp_path / "html/a.html").write_text("<p>a</p>")
    manifest = spark.createDataFrame([("u1", "html/a.html"), ("u2", "html/gone.html")], "url string, html_path string")
    there, missing = sinks.pages_of(spark, manifest, f"{tmp_path}/html")
    assert [(r.url, r.html) for r in there.collect()] == [("u1", "<p>a</p>")] and [r.url for r in missing.collect()] == ["u2"]
    results = spark.createDataFrame([(1, "x"), (2, "y")], "query_id long, answer string")
    sinks.append_results(results.where("query_id = 1"), f"{tmp_path}/r")
    assert sinks.append_results(results, f"{tmp_path}/r").count() == 2 == sinks.append_results(results, f"{tmp_path}/r").count()
    assert sinks.read_cache(spark, f"{tmp_path}/c").count() == 0
    sinks.write_cache(spark.createDataFrame([("a", "b")], "source string, target string"), f"{tmp_path}/c")
    with open(next((tmp_path / "c").glob("part-*.json")), "a") as f:
        f.write("{broken\n")
    for crc in (tmp_path / "c").glob(".*.crc"):
        crc.unlink()
    assert [tuple(r) for r in sinks.read_cache(spark, f"{tmp_path}/c").collect()] == [("a", "b")]


def test_hooks(spark):
    tried = {}

    def fetch(url: str) -> str:
        tried[url] = tried.get(url, 0) + 1
        if url == "flaky" and tried[url] < 3 or url == "down":
            raise H.Retryable("503")
        if url == "gone":
            raise ValueError("404")
        return f"<{url}>"

    urls = spark.createDataFrame([("ok",), ("flaky",), ("down",), ("gone",)], "url string").coalesce(1)
    out = {r.url: (r.html, r.error, r.tries) for r in H.fetched(urls, fetch, sleep=lambda s: None).collect()}
    assert out == {"ok": ("<ok>", None, 1), "flaky": ("<flaky>", None, 3), "down": (None, "503", 3), "gone": (None, "404", 1)}
    golden = lambda v: H.golden(spark.createDataFrame([(v,)], "value string")).collect()
    assert [r.id for r in golden('[{"id":"a","query":"q"},{"id":"b"}]')] == ["a", "b"]
    with pytest.raises(Exception, match="JSON array"):
        golden('{"id":"a"}')
    with pytest.raises(Exception, match="unknown mode"):
        spark.range(1).select(P.mode_config(F.lit("other"))).collect()
    with pytest.raises(Exception, match="options: A, B"):
        spark.range(1).select(P.allowed(F.lit("C"), ["A", "B"])).collect()
    with pytest.raises(ValueError, match="checks failed: b"):
        Q.raise_if_failed(Q.report({"a": spark.createDataFrame([(True,)], "ok boolean"), "b": spark.createDataFrame([(True,)], "low boolean")}))
    same = H.embedded(spark.createDataFrame([(1, "a b"), (2, "b  A"), (3, " "), (4, None)], "k int, t string"), "k", "t").collect()
    assert len(same) == 2 and same[0].embedding == same[1].embedding


def test_significance(spark):
    rows = [("vector", q, 0.1) for q in range(8)] + [("hybrid", q, 0.5) for q in range(8)] + [("same", q, 0.1) for q in range(8)] + [("hybrid", 99, 1.0), ("graph", 0, None)]
    out = {r["mode"]: r for r in V.significance(spark.createDataFrame(rows, "mode string, query_id int, recall double"), "recall").collect()}
    assert out["hybrid"].n == 8 and out["hybrid"].significant and out["hybrid"].p == pytest.approx(2 / 2**8)
    assert out["same"].p == 1.0 and not out["same"].significant and "graph" not in out


def test_stream_of_tries(spark, tmp_path):
    spark.createDataFrame([(1, False), (1, True), (2, False), (2, False), (2, False), (3, False)], "item long, ok boolean").coalesce(1).write.parquet(f"{tmp_path}/t")
    s = spark.readStream.schema("item long, ok boolean").parquet(f"{tmp_path}/t")
    q = Z.retried(s).writeStream.format("memory").queryName("tries").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("SELECT * FROM tries").collect()} == {(1, "done"), (2, "exhausted")}


def test_markdown_keeps_every_word(spark):
    """Words of the Markdown of all pages against those left when tags are cut out by patterns."""
    import html as H_
    import re

    from test_oracles import QUERIES, SF

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    letters = lambda t: re.sub(r"[^\w]+", "", t)
    checked = 0
    for r in QUERIES["html_to_markdown"](spark, SF).collect():
        raw = re.sub(r"(?s)<!--.*?-->|<(script|style|nav|footer|noscript|iframe|title)\b.*?</\1>", " ", pages[r.page_id] or "")
        raw = re.sub(r'(?s)<div class="(ad|breadcrumb|menu)">.*?</div>', " ", raw)
        if re.search(r"(?s)<(\w+)[^>]*class=\"(ad|breadcrumb|menu)", raw):
            continue
        links = re.sub(r"\]\([^)]*\)", "]", r.markdown)
        assert letters(links) == letters(H_.unescape(re.sub(r"(?s)<[^>]*>", " ", raw))), r.page_id
        checked += 1
    assert checked > 5


def test_frontiers_go_on_until_empty(spark, tmp_path):
    from loomgraph.plans import graph

    chain = [(f"n{i}", f"n{i + 1}") for i in range(5)] + [("n5", "n0"), ("n5", None)]
    found = replay.frontier(spark.createDataFrame([("n0",)], "url string"), spark.createDataFrame(chain, "from_url string, to_url string"))
    assert {r.url: r.round for r in found.collect()} == {f"n{i}": i for i in range(6)}
    words = ["a", "b", "c", "d", "e"]
    page = lambda i: (i, f"https://h{i}/x", "".join(f'<a href="/{w}">' for w in words[max(0, i - 1) : i + 1]))
    spark.createDataFrame([*map(page, range(5)), (9, "https://z/", '<a href="/far">')], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {tuple(r) for r in graph.crawl_frontier(spark, str(tmp_path)).collect()} == {(f"h{i}", i) for i in range(5)}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_training_operators(tmp_path):
    """The entry module and the library work when those operators are absent."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[1]
    shutil.copytree(repo / "loomgraph", tmp_path / "loomgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op1_') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and out.stdout.split()[1] == "False", out.stderr


def test_a_page_is_parsed_once_for_all_its_fields(spark, monkeypatch):
    from loomgraph.functions import markup as M

    parsed = []
    tree = M._Tree
    monkeypatch.setattr(M, "_Tree", lambda h: parsed.append(h) or tree(h))
    pages = ['<div class="spell"><table><tr><td>Type</td><td><a href="/magic/hex">Hex</a></td></tr></table></div>', "", None]
    got = M.page_fields.func(__import__("pandas").Series(pages))
    assert len(parsed) == 3 and list(got["spell"]) == ["Hex", None, None] and got["weapon"][0]["special_rules"] == [] and got["crumbs"][2]["path"] == []
