"""Queries against their SQL on rows that the given tables do not have."""

import duckdb

from loomgraph.plans import catalog


def _same(spark, d, name, *tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    df = catalog.queries()[name](spark, str(d))
    cur = c.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    want = sorted((tuple(r[names.index(n)] for n in df.columns) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == want
    return want


def test_titles_with_references_that_have_no_semicolon(spark, tmp_path):
    rows = [(1, "u", "<h1>a &amp;&amp;&amp</h1>"), (2, "u", "<h1>x &lt y &GT; z&quot</h1>"), (3, "u", "<h1>&amp;lt;b&amp;gt</h1>"), (4, "u", "<p>none</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = _same(spark, tmp_path, "html_title", "pages")
    assert got == [(1, "a &&&"), (2, 'x < y > z"'), (3, "&lt;b&gt"), (4, "")]


def test_batches_whose_new_keys_are_taken(spark, tmp_path):
    rows = [(k, f"part {k}", float(k % 100)) for k in (1, 3, 5, 7, 10, 14, 35, 70, 1_000_005, 1_000_010, 1_000_011, 1_000_035, 1_000_070)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = _same(spark, tmp_path, "keyed_batches", "part")
    assert len({r[0] for r in got}) == len(got) and (1_000_005, "part 5", None) in got
