"""Shortest routes put together half way, against all routes of random graphs."""

from __future__ import annotations

import random
from itertools import product

import pytest

from loomgraph.operators import graph as G
from loomgraph.plans import catalog
from loomgraph.sources.tables import edge_ends, edges


def _least(links, a, b, most):
    """The shortest route, of several the least from ``b`` back, by trying all of them."""
    if a is None or b is None:
        return None
    ways = [[b]]
    for _ in range(most + 1):
        done = [w for w in ways if w[-1] == a]
        if done:
            return ">".join(reversed(min(done)))
        ways = [[*w, n] for w in ways for n in links.get(w[-1], ())]
    return None


@pytest.mark.parametrize("most", [1, 3, 4, 5])
def test_routes_against_all_routes(spark, most):
    rng = random.Random(most)
    rows = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(36)]
    links: dict = {}
    for x, y in rows:
        links.setdefault(x, set()).add(y)
        links.setdefault(y, set()).add(x)
    e = spark.createDataFrame([*rows, *rows[:9], (None, "n1"), ("n2", None)], "src string, dst string")  # copies and edges without an end
    names = [f"n{k}" for k in range(30)] + ["away", None]
    pairs = [p for p in product(names, names) if rng.random() < 0.4] + [("n1", "n2")] * 2
    got = sorted((tuple(r) for r in G.shortest_route(e, spark.createDataFrame(pairs, "a string, b string"), most).collect()), key=repr)
    want = [(a, b, _least(links, a, b, most)) for a, b in pairs]
    assert got == sorted(((a, b, None if w is None else w.count(">"), w) for a, b, w in want), key=repr)


def test_the_query_groups_no_lines(spark):
    d, wrote = "/root/testdata/sf0.01", spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: wrote.executorList(False).apply(0).totalShuffleWrite()
    at = shuffled()
    assert len(catalog.queries()["shortest_routes"](spark, d).collect()) == 5
    assert shuffled() - at < 500_000  # 60,000 lines would be more


def test_ends_are_those_of_the_edges(spark):
    d = "/root/testdata/sf0.001"
    assert {tuple(r) for r in edge_ends(spark, d).collect()} == {tuple(r) for r in edges(spark, d).select("src", "dst").collect()}
