"""Pluggable work: fetchers, parsers, embedders, translators and judges as functions that run in Arrow batches on the executors."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that an embedder gets at once, nodes that a writer takes, translated strings between two saves.
EMBED_BATCH, WRITE_BATCH, TRANSLATE_BATCH = 64, 500, 200


class Retryable(Exception):
    """A failure that may pass: a server error or the network."""


def fetched(urls: DataFrame, fetch: Callable[[str], str], tries: int = 3, delay: float = 1.0, first: float = 2.0, most: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """url, html, error and tries used; only what is ``Retryable`` is tried again, after 2, 4, ... at most 10 seconds, and requests of a task keep ``delay`` seconds apart."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for f in frames:
            rows = []
            for url in f["url"]:
                wait, html, error, n = first, None, None, 0
                while n < tries:
                    n += 1
                    sleep(max(0.0, last + delay - time.monotonic()))
                    last = time.monotonic()
                    try:
                        html, error = fetch(url), None
                        break
                    except Retryable as e:
                        error = str(e)
                        if n < tries:
                            sleep(wait)
                            wait = min(most, 2 * wait)
                    except Exception as e:  # told, not tried again
                        error = str(e)
                        break
                rows.append((url, html, error, n))
            yield pd.DataFrame(rows, columns=["url", "html", "error", "tries"])

    return urls.select("url").mapInPandas(run, "url string, html string, error string, tries int")


def with_fallback(seeds: DataFrame, found: DataFrame, fallback: list[str], prefix: str) -> DataFrame:
    """Seeds and found links; where no link has the prefix, the fallback links too."""
    all_ = seeds.select("url").unionByName(found.select("url")).distinct()
    none = found.where(F.contains("url", F.lit(prefix))).agg((F.count(F.lit(1)) == 0).alias("_none"))  # one row
    spare = seeds.sparkSession.createDataFrame([(u,) for u in fallback], "url string").crossJoin(F.broadcast(none)).where("_none").select("url")
    return all_.unionByName(spare).distinct()


def parsed(pages: DataFrame, registry: dict[str, Callable[[str, str, str], list[tuple[str, str, str]]]]) -> DataFrame:
    """Nodes (id, label, name, url) of pages(page_type, html, url, fetched_at) by the parser of their type; pages of other types give none, a parser's failure gives a row of label ``error``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for kind, html, url, at in zip(f["page_type"], f["html"], f["url"], f["fetched_at"]):
                try:
                    rows += [(*n, url) for n in (registry[kind](html, url, at) if kind in registry else [])]
                except Exception as e:  # one page does not stop the others
                    rows.append((url, "error", str(e), url))
            yield pd.DataFrame(rows, columns=["id", "label", "name", "url"])

    return pages.select("page_type", "html", "url", "fetched_at").mapInPandas(run, "id string, label string, name string, url string")


def hashed(texts: list[str], size: int = 64) -> np.ndarray:
    """A stand-in embedder: word hashes summed with signs, so equal texts have equal vectors."""
    out = np.zeros((len(texts), size), np.float32)
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode("utf-8"), digest_size=8).digest(), "little")
            out[i, h % size] += 1 if h >> 63 else -1
    return out


def embedded(rows: DataFrame, key: str, text: str, encode: Callable[[list[str]], np.ndarray] = hashed) -> DataFrame:
    """key, text and embedding of the rows that have a text; the embedder gets ``EMBED_BATCH`` texts at once."""
    some = rows.where(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", "") != "").select(key, text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for s in range(0, len(f), EMBED_BATCH):
                part = f.iloc[s : s + EMBED_BATCH]
                yield pd.DataFrame({key: part[key], text: part[text], "embedding": list(np.asarray(encode(part[text].tolist()), np.float32))})

    return some.mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, {text} string, embedding array<float>")


def judged(answers: DataFrame, judge: Callable[[str, str], tuple[int, int, int]]) -> DataFrame:
    """Answers(query_id, question, answer) with a verdict's axes, 0 to 2 each; a null answer, or one that the judge fails on, has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple] = []
            for q, asked, said in zip(f["query_id"], f["question"], f["answer"]):
                try:
                    axes = tuple(min(2, max(0, int(x))) for x in judge(asked, said)) if said is not None else (None, None, None)
                except Exception:  # no verdict
                    axes = (None, None, None)
                rows.append((q, *axes))
            yield pd.DataFrame(rows, columns=["query_id", "correctness", "groundedness", "citation"]).astype("object")

    return answers.select("query_id", "question", "answer").mapInPandas(run, "query_id long, correctness int, groundedness int, citation int")


def golden(rows: DataFrame) -> DataFrame:
    """Golden queries of ``rows(value)``, one JSON text each: an array of queries; anything else is an error."""
    item = "array<struct<id:string,query:string,category:string,expected_rules:array<string>,expected_army:string>>"
    items = F.from_json("value", item)
    is_array = F.col("value").rlike(r"^\s*\[")
    checked = F.when(is_array & items.isNotNull(), items).otherwise(F.raise_error(F.lit("golden queries must be a JSON array")).cast(item))
    return rows.select(F.explode(checked).alias("q")).select("q.*")
