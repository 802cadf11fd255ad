"""Texts composed of nodes and what surrounds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X


def _lines(items: str) -> Column:
    """Collected (place, line) structs as lines in order."""
    return F.array_join(F.transform(F.sort_array(items), lambda x: x["line"]), "\n")


def context(hits: DataFrame, near: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, context, n_seeds, n_neighbours: sources first, then related lines, in rank order."""
    seeds = hits.join(nodes, F.col("seed_id") == F.col("id")).select("query_id", "rank", F.concat(F.lit("["), "seed_id", F.lit("] "), "name", F.lit(": "), "text").alias("line"))
    a = seeds.groupBy("query_id").agg(F.collect_list(F.struct("rank", "line")).alias("_a"), F.count(F.lit(1)).alias("n_seeds"))
    around = hits.select("query_id", "seed_id", "rank").join(near, "seed_id").join(nodes.select("id", "name"), "id")
    line = F.concat("seed_id", F.lit(" -"), "rel_type", F.lit("- "), "id", F.lit(" ("), "name", F.lit(")"))
    b = around.select("query_id", "rank", "place", line.alias("line")).groupBy("query_id").agg(F.collect_list(F.struct("rank", "place", "line")).alias("_b"), F.count(F.lit(1)).alias("n"))
    text = F.concat(F.lit("Retrieved sources\n"), _lines("_a"), F.coalesce(F.concat(F.lit("\n\nRelated context\n"), _lines("_b")), F.lit("")))
    return a.join(b, "query_id", "left").select("query_id", text.alias("context"), "n_seeds", F.coalesce("n", F.lit(0)).alias("n_neighbours"))


def blocks(hits: DataFrame, near: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, seed_id, block, source: a text block a seed, empty texts left out."""
    known = near.join(nodes.select("id"), "id")
    related = known.groupBy("seed_id").agg(F.collect_list(F.struct("place", F.concat("rel_type", F.lit(" -> "), "id").alias("line"))).alias("_r"))
    rows = hits.join(nodes, F.col("seed_id") == F.col("id")).where("text <> ''").join(related, "seed_id", "left")
    block = F.concat("text", F.coalesce(F.concat(F.lit("\nGraph relationships:\n"), _lines("_r")), F.lit("")))
    return rows.select("query_id", "seed_id", block.alias("block"), F.col("rank").cast("bigint").alias("source"))


# -- context as it is cited ------------------------------------------------------


def node_text(text: Column, name: Column, extra: Column) -> Column:
    """A node's text, else its name, with what else is known of it."""
    body = F.coalesce(F.nullif(text, F.lit("")), F.nullif(name, F.lit("")), F.lit(""))
    return F.when(F.coalesce(extra, F.lit("")) != "", X.strip(F.concat_ws(" ", body, extra))).otherwise(body)


def readable(props: Column) -> Column:
    """The few properties of an edge that are shown, as JSON; nothing where it has none."""
    kept = F.map_filter(props, lambda k, v: k.isin("budget", "alliance_type", "via_upgrade") & v.isNotNull())
    return F.when(F.size(kept) > 0, F.to_json(kept)).otherwise("")


def seeds_context(seeds: DataFrame) -> DataFrame:
    """query_id, context of seeds alone: ``seeds(query_id, place, id, name, label, text, extra)``."""
    head = F.concat(F.lit("- ["), "id", F.lit("] "), F.coalesce("name", F.lit("Unnamed")), F.lit(" ("), F.coalesce("label", F.lit("Node")), F.lit("): "), node_text(F.col("text"), F.col("name"), F.col("extra")))
    rows = seeds.groupBy("query_id").agg(F.collect_list(F.struct("place", head.alias("line"))).alias("_s"))
    return rows.select("query_id", F.concat(F.lit("## Retrieved sources\n"), _lines("_s")).alias("context"))


def cited_context(seeds: DataFrame, links: DataFrame, related: DataFrame) -> DataFrame:
    """Sources, the direct links among them (or that there are none) and what is related, as one text a query.

    ``links(query_id, place, source, target, rel_type, props)``; ``related(query_id,
    place, seed_id, rel_type, id, name, text, extra)``.
    """
    shown = readable(F.col("props"))
    link = F.concat(F.lit("- ["), "source", F.lit("] --"), "rel_type", F.lit("--"), F.when(shown != "", F.concat(F.lit(" "), shown)).otherwise(""), F.lit("→ ["), "target", F.lit("]"))
    direct = links.groupBy("query_id").agg(F.collect_list(F.struct("place", link.alias("line"))).alias("_l"), F.count(F.lit(1)).alias("_n"))
    near = F.concat(F.lit("- ["), "seed_id", F.lit("] --"), "rel_type", F.lit("→ ["), "id", F.lit("] "), F.coalesce("name", F.lit("")), F.lit(": "), node_text(F.col("text"), F.col("name"), F.col("extra")))
    around = related.groupBy("query_id").agg(F.collect_list(F.struct("place", near.alias("line"))).alias("_r"))
    rows = seeds_context(seeds).join(direct, "query_id", "left").join(around, "query_id", "left")
    some = F.concat(F.lit("("), F.col("_n").cast("string"), F.lit(" direct edge(s) among the retrieved sources)\n"), _lines("_l"))
    between = F.concat(F.lit("\n\n## Direct links among sources\n"), F.coalesce(some, F.lit("(No direct edge was found among the retrieved sources.)")))
    return rows.select("query_id", F.concat("context", between, F.coalesce(F.concat(F.lit("\n\n## Related context\n"), _lines("_r")), F.lit(""))).alias("context"))


def citable(seeds: DataFrame, related: DataFrame, most: int = 60) -> DataFrame:
    """Nodes that can be cited, each once: seeds before what is related to them, in order, the first ``most`` of a query (a cap of the feature)."""
    both = seeds.select("query_id", "id", "name", "label", "text", "extra", F.lit(0).alias("_k"), "place")
    both = both.unionByName(related.select("query_id", "id", "name", F.lit(None).cast("string").alias("label"), "text", "extra", F.lit(1).alias("_k"), "place"))
    first = both.where("id IS NOT NULL AND id <> ''").groupBy("query_id", "id").agg(F.min_by(F.struct("name", "label", "text", "extra", "_k", "place"), F.struct("_k", "place")).alias("n"))
    order = Window.partitionBy("query_id").orderBy("n._k", "n.place", "id")
    return first.withColumn("source", F.row_number().over(order)).where(F.col("source") <= most).select("query_id", "source", "id", "n.name", "n.label", "n.text", "n.extra")


def tool_result(seeds: DataFrame, context: DataFrame) -> DataFrame:
    """query_id and the result of a tool as one JSON object: the context and the sources in order."""
    source = F.struct("id", "label", "name", "text")
    rows = seeds.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", source.alias("s")))).alias("_s"))
    rows = context.join(rows, "query_id", "left")
    sources = F.transform(F.coalesce("_s", F.array().cast("array<struct<place:int,s:struct<id:string,label:string,name:string,text:string>>>")), lambda x: x["s"])
    return rows.select("query_id", F.to_json(F.struct("context", sources.alias("sources")), {"ignoreNullFields": "false"}).alias("result"))


def blocks_or_context(blocks: DataFrame, context: DataFrame) -> DataFrame:
    """Blocks of each query, or its context as the only one where nothing can be cited."""
    none = context.join(blocks.select("query_id").distinct(), "query_id", "left_anti")
    return blocks.select("query_id", "source", "block").unionByName(none.select("query_id", F.lit(0).cast("bigint").alias("source"), F.col("context").alias("block")))
