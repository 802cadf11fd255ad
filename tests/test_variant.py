"""Messages and nodes read from a VARIANT against the same read from JSON text."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import parse as P
from loomgraph.functions import variant as V

CONTENTS = [
    '"just text"', '{"type":"text","text":"a"}', '{"type":"tool_use","text":"a"}', "[]", None, '[{"type":"thinking","thinking":"hm"},{"type":"text","text":"b"},{"type":"text_delta","delta":"c"},"d"]',
    '[{"type":"text","text":"x","citations":[{"type":"search_result_location","search_result_index":4},{"type":"other","search_result_index":1},{"type":"search_result_location","search_result_index":0},{"type":"search_result_location","search_result_index":4}]}]',
    '[{"type":"reasoning","reasoning":"r1"},{"type":"reasoning","thinking":"r2"}]',
]


def test_contents(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(CONTENTS)], "i int, c string")
    plain = lambda r: (r.i, r.m["text"] or "", r.m["reasoning"] or "", list(r.m["cited"] or []))
    want = sorted(plain(r) for r in rows.select("i", P.content(F.col("c")).alias("m")).collect())
    assert sorted(plain(r) for r in rows.select("i", V.content(V.parsed(F.col("c"))).alias("m")).collect()) == want


def test_nodes(spark):
    raw = ['{"id":"a","name":null,"page":3}', '{"id":"b","page":"three","name":"B","score":"x"}', "nonsense", '{"id":"c","extra":{"x":1},"score":1.5}', None]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(raw)], "i int, c string")
    out = {r.i: r.n for r in rows.select("i", V.node(V.parsed(F.col("c"))).alias("n")).collect()}
    assert [tuple(out[i]) if out[i] else None for i in range(5)] == [("a", None, None, 3, None), ("b", "B", None, None, None), None, ("c", None, None, None, 1.5), None]
