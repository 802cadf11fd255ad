"""Semi-structured values parsed once: messages and nodes read from a VARIANT, path by path without another parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NONE = "array<variant>"


def parsed(c: Column) -> Column:
    """A text as a VARIANT; null where it is no JSON."""
    return F.try_parse_json(c)


def field(v: Column, path: str, kind: str = "string") -> Column:
    """The value at a path in a type; null where it is missing or of another type that does not cast."""
    return F.try_variant_get(v, path, kind)


def _of(x: Column, kinds: tuple[str, ...], names: tuple[str, ...]) -> Column:
    """Of a block of one of the kinds the first field that is not empty."""
    values = [F.nullif(field(x, f"$.{n}"), F.lit("")) for n in names]
    return F.when(field(x, "$.type").isin(*kinds), F.coalesce(*values, F.lit(""))).otherwise("")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def content(v: Column) -> Column:
    """Text, reasoning and cited places of a message content: a plain string, a block, or a list of blocks and strings."""
    kind = _kind(v)
    none = F.array().cast(_NONE)
    items = F.when(kind.startswith("ARRAY"), F.coalesce(field(v, "$", _NONE), none)).when(kind.startswith("OBJECT"), F.array(v)).otherwise(none)
    one = lambda x: F.when(_kind(x).startswith("OBJECT"), _of(x, ("text", "text_delta"), ("text", "delta"))).when(_kind(x) == "STRING", field(x, "$")).otherwise("")
    plain = F.when(~kind.startswith("ARRAY") & ~kind.startswith("OBJECT") & (kind != "VOID"), field(v, "$"))
    text = F.coalesce(plain, F.array_join(F.transform(items, one), ""))
    reasoning = F.array_join(F.transform(items, lambda x: _of(x, ("thinking", "reasoning"), ("thinking", "reasoning"))), "")
    cited = F.flatten(F.transform(F.filter(items, lambda x: field(x, "$.type") == "text"), lambda x: F.coalesce(field(x, "$.citations", _NONE), none)))
    places = F.transform(F.filter(cited, lambda x: field(x, "$.type") == "search_result_location"), lambda x: field(x, "$.search_result_index", "int"))
    return F.struct(text.alias("text"), reasoning.alias("reasoning"), F.array_sort(F.array_distinct(F.filter(places, lambda i: i.isNotNull()))).alias("cited"))


def node(v: Column) -> Column:
    """A node as a client reads it: a field of a wrong type is null."""
    kinds = {"id": "string", "name": "string", "label": "string", "page": "int", "score": "double"}
    return F.when(_kind(v).startswith("OBJECT"), F.struct(*[field(v, f"$.{n}", t).alias(n) for n, t in kinds.items()]))


def blocks(rows: DataFrame, column: str, kept: list[str], path: str = "$") -> DataFrame:
    """A row for each element of the array at ``path``, with its place and value."""
    spark = rows.sparkSession
    own = rows.select(*kept, F.try_variant_get(F.col(column), path, "variant").alias("_v"))
    return own.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select(*kept, F.col("pos").cast("bigint").alias("place"), F.col("value"))
