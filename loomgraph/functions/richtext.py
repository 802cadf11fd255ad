"""Recursive rich text: {nodeType, value, data.target, content: [...]} flattened in one Arrow pass.

Spark has no recursive type, so a tree stays a JSON string; what is flat comes
out as an array of structs that native functions take from there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

NODE = StructType().add("seq", IntegerType()).add("depth", IntegerType()).add("node_type", StringType()).add("text", StringType()).add("slug", StringType()).add("content_type", StringType())
OPTION = StructType().add("pos", IntegerType()).add("list_no", IntegerType()).add("header", StringType()).add("text", StringType()).add("links", ArrayType(StringType()))


def _load(tree: str | None) -> Any:
    try:
        return json.loads(tree) if tree else None
    except ValueError:
        return None


def _target(node: dict) -> dict:
    return ((node.get("data") or {}).get("target") or {}) if isinstance(node.get("data"), dict) else {}


def _walk(node: Any, depth: int = 0) -> Iterator[tuple[int, str, str | None, str | None, str | None]]:
    if not isinstance(node, dict):
        return
    target = _target(node)
    fields = target.get("fields") or {}
    kind = (((target.get("sys") or {}).get("contentType") or {}).get("sys") or {}).get("id")
    yield depth, str(node.get("nodeType") or ""), node.get("value"), fields.get("slug"), kind
    for child in node.get("content") or ():
        yield from _walk(child, depth + 1)


def plain(node: Any) -> str:
    """Text of a tree; an embedded block gives its own text in place of children."""
    if not isinstance(node, dict):
        return ""
    if node.get("nodeType") == "text":
        return node.get("value") or ""
    if str(node.get("nodeType") or "").startswith("embedded"):
        fields = _target(node).get("fields") or {}
        if fields.get("bodyIndex"):
            return str(fields["bodyIndex"])
        return plain(fields.get("richText") or fields.get("body"))
    return "".join(plain(c) for c in node.get("content") or ())


@F.pandas_udf(StringType())
def text_of(trees: pd.Series) -> pd.Series:
    return trees.map(lambda t: plain(_load(t)))


@F.pandas_udf(ArrayType(NODE))
def flat(trees: pd.Series) -> pd.Series:
    return trees.map(lambda t: [{"seq": i, "depth": d, "node_type": k, "text": v, "slug": s, "content_type": c} for i, (d, k, v, s, c) in enumerate(_walk(_load(t)))])


def nodes(rows: DataFrame, key: str, tree: str) -> DataFrame:
    """A row per node of each tree, in document order."""
    return rows.select(key, F.explode(flat(F.col(tree))).alias("n")).select(key, "n.*")


def links(rows: DataFrame, key: str, tree: str) -> DataFrame:
    return nodes(rows, key, tree).where("slug IS NOT NULL").select(key, "seq", "slug", "content_type")


def has_block(tree: Column, kind: str) -> Column:
    """Whether an entry of a content type is embedded anywhere."""
    return F.exists(flat(tree), lambda n: (n["content_type"] == kind) & n["node_type"].startswith("embedded"))


def _options(node: Any) -> list[dict]:
    """Items of all lists, nested ones after their parent; a paragraph above a list is the list's header and children keep it."""
    out: list[dict] = []
    count = 0

    def items(parent: dict, header: str) -> None:
        nonlocal count
        count += 1
        mine = count
        for item in parent.get("content") or ():
            if not isinstance(item, dict):
                continue
            parts = [c for c in item.get("content") or () if isinstance(c, dict)]
            own = [c for c in parts if "list" not in str(c.get("nodeType"))]
            body = "".join(plain(c) for c in own).strip()
            slugs = [s for c in own for _, _, _, s, _ in _walk(c) if s]
            out.append({"pos": len(out), "list_no": mine, "header": header, "text": body, "links": slugs})
            for c in parts:
                if "list" in str(c.get("nodeType")):
                    items(c, body or header)

    header = ""
    for child in (node or {}).get("content") or ():
        if not isinstance(child, dict):
            continue
        if "list" in str(child.get("nodeType")):
            items(child, header)
        else:
            header = plain(child).strip()
    return out


@F.pandas_udf(ArrayType(OPTION))
def options(trees: pd.Series) -> pd.Series:
    return trees.map(lambda t: _options(_load(t) if isinstance(_load(t), dict) else {}))


def paragraphs(lines: Column) -> Column:
    """A tree of one paragraph a line, natively."""
    text = lambda x: F.struct(F.lit("text").alias("nodeType"), x.alias("value"))
    return F.to_json(F.struct(F.lit("document").alias("nodeType"), F.transform(lines, lambda x: F.struct(F.lit("paragraph").alias("nodeType"), F.array(text(x)).alias("content"))).alias("content")))


ITEM = (
    StructType().add("pos", IntegerType()).add("group_no", IntegerType()).add("header", StringType()).add("text", StringType())
    .add("links", ArrayType(StructType().add("slug", StringType()).add("kind", StringType())))
)


def _children(node: Any, *kinds: str) -> list[dict]:
    return [c for c in (node.get("content") or () if isinstance(node, dict) else ()) if isinstance(c, dict) and c.get("nodeType") in kinds]


def _option_items(node: Any) -> list[dict]:
    """Items of the first bullet list; one with a nested list heads a group and gives its nested items, each with the group's header."""
    out: list[dict] = []

    def add(item: dict, group: int, header: str | None) -> None:
        text = next((plain(c) for c in _children(item, "paragraph")), "")
        links = [{"slug": s, "kind": c or ""} for _, k, _, s, c in _walk(item) if s and k in ("entry-hyperlink", "embedded-entry-inline")]
        out.append({"pos": len(out), "group_no": group, "header": header, "text": text, "links": links})

    for top in _children(node, "unordered-list")[:1]:
        for group, item in enumerate(_children(top, "list-item")):
            nested = _children(item, "unordered-list")
            if nested:
                header = next((plain(c) for c in _children(item, "paragraph")), "").strip().rstrip(":").strip()
                for child in _children(nested[0], "list-item"):
                    add(child, group, header)
            else:
                add(item, group, None)
    return out


@F.pandas_udf(ArrayType(ITEM))
def option_items(trees: pd.Series) -> pd.Series:
    return trees.map(lambda t: _option_items(_load(t)))


def _leaves(item: dict) -> list[dict]:
    nested = _children(item, "unordered-list", "ordered-list")
    deeper = [x for c in (_children(nested[0], "list-item") if nested else ()) for x in _leaves(c)]
    return deeper or [item]


@F.pandas_udf(ArrayType(StringType()))
def leaf_texts(trees: pd.Series) -> pd.Series:
    """First paragraph of each leaf of all lists, however deep, in order."""
    texts = lambda node: [next((plain(c) for c in _children(leaf, "paragraph")), "") for top in _children(node, "unordered-list", "ordered-list") for item in _children(top, "list-item") for leaf in _leaves(item)]
    return trees.map(lambda t: texts(_load(t)))
