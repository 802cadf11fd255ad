"""Table functions for SQL: an ordered walk over a unit's option lines, and the lookups of a chat's tools."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType


class OptionWalk:
    """Lines of a unit in order: a line that ends in a colon opens a group, those indented below it are its alternatives.

    The table argument has unit, n and line; the engine partitions it by unit and
    orders it by n, as ``analyze`` asks, so one call sees a unit's lines and keeps a
    few numbers.  A row tells the option's place, its group if it has one, and
    whether the group is one of mounts.  Null lines are passed over.
    """

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        names = {f.name for f in lines.dataType.fields} if lines.isTable else set()
        if not {"unit", "n", "line"} <= names:
            raise ValueError("option_walk takes a table of unit, n and line")
        kind = lines.dataType["unit"].dataType
        shape = StructType().add("unit", kind).add("place", IntegerType()).add("line", StringType()).add("group_id", IntegerType()).add("header", StringType()).add("mounts", BooleanType()).add("n", LongType())
        return AnalyzeResult(schema=shape, partitionBy=[PartitioningColumn("unit")], orderBy=[OrderingColumn("n")])

    def __init__(self) -> None:
        self.place, self.groups, self.header = 0, 0, None

    def eval(self, row: Row) -> Iterator[tuple]:
        line = row["line"]
        if line is None or not line.strip():
            return
        inside = line[:1] in (" ", "\t")
        line = line.strip()
        if not inside:
            self.header = None
            if line.endswith(":"):
                self.header = line[:-1]
                self.groups += 1
                return
        yield row["unit"], self.place, line, self.groups if self.header else None, self.header, "mounted" in (self.header or ""), row["n"]
        self.place += 1


def register(spark: SparkSession) -> None:
    """Make ``option_walk(TABLE(...))`` known to the session's SQL."""
    spark.udtf.register("option_walk", udtf(OptionWalk))


def army_roster(spark: SparkSession, units: DataFrame) -> None:
    """``army_roster(army, category, most)`` over units(unit, army, name, category): those whose category, in any case, holds the text (all for null), by category and name, nulls last."""
    units.select("unit", "army", "name", "category").createOrReplaceTempView("loomgraph_roster")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION army_roster(army_id STRING, wanted STRING, most INT) RETURNS TABLE (unit STRING, name STRING, category STRING, place INT)
        RETURN SELECT unit, name, category, place FROM (SELECT unit, name, category, row_number() OVER (PARTITION BY army ORDER BY category NULLS LAST, name, unit) AS place FROM loomgraph_roster
            WHERE army = army_roster.army_id AND (army_roster.wanted IS NULL OR contains(lower(category), lower(army_roster.wanted)))) WHERE place <= army_roster.most""")


def archive_query(spark: SparkSession, nodes: DataFrame) -> None:
    """``archive_query(text, most)`` over nodes(id, label, name, text): the nodes that are called so first, then those whose name or text holds it, by label and id."""
    nodes.select("id", "label", "name", "text").createOrReplaceTempView("loomgraph_archive")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION archive_query(q STRING, most INT) RETURNS TABLE (id STRING, label STRING, name STRING, exact BOOLEAN, place INT)
        RETURN SELECT id, label, name, exact, place FROM (SELECT id, label, name, exact, row_number() OVER (ORDER BY exact DESC, label, id) AS place FROM (
            SELECT id, label, name, coalesce(lower(name) = lower(archive_query.q), false) AS exact FROM loomgraph_archive
            WHERE contains(lower(name), lower(archive_query.q)) OR contains(lower(text), lower(archive_query.q)))) WHERE place <= archive_query.most""")
