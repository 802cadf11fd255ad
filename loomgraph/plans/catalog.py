"""Every registered query with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans import catalogue, checks, graph, indexed, parsing, retrieval, texts, workload

FAMILIES = (graph, retrieval, indexed, texts, checks, workload, parsing, catalogue)

#: Queries by stage: the module that registers them.
STAGES = {m.__name__.rpartition(".")[2]: m.QUERIES for m in FAMILIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in FAMILIES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in FAMILIES for k, sql in m.ORACLES.items()}
