"""A crawl replayed from stored pages: a streaming source with a retry queue, as there is no network here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.tables import written

PAGE = "page_id long, url string, html string"


def stream(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Stored pages as a file stream; only new files are read, the checkpoint remembers them."""
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def frontier(seeds: DataFrame, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """Breadth-first crawl order over ``links(from_url, to_url)``: url and the round in which it is met first.

    Goes on until a round meets nothing new, or for ``rounds`` where they are given; each round is written, so none is computed again.
    """
    links = written(links.select("from_url", "to_url").where("to_url IS NOT NULL"), "links")
    front = written(seeds.select("url", F.lit(0).alias("round")), "frontier")
    seen, k = front, 0
    while (rounds is None or k < rounds) and not front.isEmpty():
        k += 1
        step = front.join(links, F.col("url") == F.col("from_url")).select(F.col("to_url").alias("url")).distinct()
        front = written(step.join(seen.select("url"), "url", "left_anti").withColumn("round", F.lit(k)), "frontier")
        seen = seen.unionByName(front)
    return seen
