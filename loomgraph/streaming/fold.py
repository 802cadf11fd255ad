"""Folds of message and event streams, in batch and as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from loomgraph.functions import parse as P

OUT = "conv_id long, seq long, event string, body string"


def brackets(turns: DataFrame) -> DataFrame:
    """Runs of turns of one role within a conversation: first, last and length of each run."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    new = (~F.col("role").eqNullSafe(F.lag("role").over(order)) | F.lag("turn").over(order).isNull()).cast("int")
    rows = turns.withColumn("run", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("conv_id", "run", "role").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n"))


def message_events(turns: DataFrame) -> DataFrame:
    """Each run of a role becomes start, deltas and end events, numbered in order, by windows alone."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    before, after = F.lag("role").over(order), F.lead("role").over(order)
    kind = F.when(F.col("role") == "user", "reasoning").otherwise("text")
    rows = turns.withColumns({"_starts": ~F.col("role").eqNullSafe(before), "_ends": ~F.col("role").eqNullSafe(after), "_kind": kind})
    some = lambda on, part, event: F.when(on, F.array(F.struct(F.lit(part).alias("part"), F.concat("_kind", F.lit(event)).alias("event")))).otherwise(F.array().cast("array<struct<part:int,event:string>>"))
    rows = rows.select("conv_id", "turn", "text", F.explode(F.concat(some(F.col("_starts"), 0, "-start"), some(F.lit(True), 1, "-delta"), some(F.col("_ends"), 2, "-end"))).alias("e"))
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "e.part"))
    return rows.select("conv_id", seq.cast("bigint").alias("seq"), F.col("e.event").alias("event"), F.when(F.col("e.part") == 1, F.col("text")).alias("body"))


def answer_events(messages: DataFrame) -> DataFrame:
    """Message chunks and tool results of an answer as ordered protocol events, by windows alone.

    ``messages(conv_id, turn, kind, content, sources, native)``: kind is ai, tool or
    error; content is JSON as models give it; sources are the ids that a tool
    result brings, ``native`` whether the model cites them by place.  Reasoning is
    opened, continued and ended before the text of the chunk that ends it; ids of
    known sources in brackets go out of the text.  At the end come what is still
    open, the cited sources if a tool was called, and the finish; an error ends the
    answer without them.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ai, tool, error = (F.col("kind") == k for k in ("ai", "tool", "error"))
    rows = messages.withColumn("_failed", F.coalesce(F.max(error).over(before), F.lit(False))).where("NOT _failed").withColumn("_c", P.content(F.col("content")))
    known = F.array_distinct(F.flatten(F.collect_list(F.when(tool, F.col("sources"))).over(before)))
    rows = rows.withColumns({"_known": known, "_reasoning": F.when(ai, F.col("_c.reasoning")).otherwise(""), "_raw": F.when(ai, F.col("_c.text")).otherwise("")})
    named = F.array_intersect(F.regexp_extract_all("_raw", F.lit(r"\[([a-z0-9][a-z0-9-]*)\]"), 1), F.col("_known"))
    stripped = F.aggregate("_known", F.col("_raw"), lambda t, k: F.replace(t, F.concat(F.lit("["), k, F.lit("]")), F.lit("")))
    rows = rows.withColumns({"_named": named, "_text": stripped, "_open": F.col("_reasoning") != ""})
    was = F.coalesce(F.lag("_open").over(order), F.lit(False))
    started = F.coalesce(F.max(F.col("_text") != "").over(before), F.lit(False))
    rows = rows.withColumns({"_was": was, "_started": started})
    event = lambda on, part, name, body=F.lit(None).cast("string"): F.when(on, F.struct(F.lit(part).alias("part"), F.lit(name).alias("event"), body.alias("body")))
    some = lambda *e: F.filter(F.array(*e), lambda x: x.isNotNull())
    said = F.col("_text") != ""
    each = rows.select("conv_id", "turn", F.explode(some(
        event(F.col("_open") & ~F.col("_was"), 0, "reasoning-start"), event(F.col("_open"), 1, "reasoning-delta", F.col("_reasoning")), event(F.col("_was") & ~F.col("_open") & ~error, 2, "reasoning-end"),
        event(said & ~F.col("_started"), 3, "text-start"), event(said, 4, "text-delta", F.col("_text")), event(error, 5, "error", F.col("content")),
    )).alias("e"))
    placed = lambda on, *cols: F.sort_array(F.collect_list(F.when(on, F.struct("turn", *cols))))
    ends = rows.groupBy("conv_id").agg(
        F.max("turn").alias("turn"), F.max_by("_open", "turn").alias("open"), F.max(said).alias("said"), F.max(tool).alias("tools"), F.max(error).alias("failed"),
        F.flatten(F.transform(placed(tool & F.col("native"), "sources"), lambda x: x["sources"])).alias("results"), F.array_distinct(F.flatten(F.collect_list(F.when(tool & ~F.col("native"), F.col("sources"))))).alias("candidates"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(ai, F.col("_c.cited")))))).alias("cited"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_named")))).alias("named"),
        F.array_join(F.transform(placed(ai, "_text"), lambda x: x["_text"]), "").alias("text"),
    )
    by_place = F.transform(F.filter("cited", lambda i: (i >= 0) & (i < F.size("results"))), lambda i: F.element_at("results", i + 1))
    native = F.array_union(by_place, F.filter("named", lambda x: F.array_contains("results", x)))
    plain = F.regexp_replace("text", r"\[.*?\]", " ")
    legacy = F.array_sort(F.filter("candidates", lambda x: F.array_contains("named", x) | F.regexp_like(plain, F.concat(F.lit(r"(?i)\b\Q"), x, F.lit(r"\E\b")))))
    shown = F.when(F.size("results") > 0, native).otherwise(legacy)
    last = ends.where("NOT failed").select("conv_id", (F.col("turn") + 1).alias("turn"), F.explode(some(
        event(F.col("open"), 0, "reasoning-end"), event(F.col("said"), 1, "text-end"), event(F.col("tools"), 2, "data-sources", F.array_join(shown, ",")), event(F.lit(True), 3, "finish-step"),
    )).alias("e"))
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "e.part"))
    return each.unionByName(last).select("conv_id", seq.cast("bigint").alias("seq"), "e.event", "e.body")


#: A conversation without news for so long has its last run ended and its state dropped.
IDLE_MS = 600_000


def fold_state(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The same events from a stream of turns in the order in which they come; the open role and the next number are the state."""
    role, seq = state.get if state.exists else (None, 0)
    out = []
    if state.hasTimedOut:
        state.remove()
        end = ("reasoning" if role == "user" else "text") + "-end"
        yield pd.DataFrame([(key[0], seq + 1, end, None)], columns=["conv_id", "seq", "event", "body"])
        return
    for frame in frames:
        for r in frame.sort_values("turn").itertuples():
            kind = "reasoning" if r.role == "user" else "text"
            if r.role != role:
                if role is not None:
                    seq += 1
                    out.append((key[0], seq, ("reasoning" if role == "user" else "text") + "-end", None))
                seq += 1
                out.append((key[0], seq, kind + "-start", None))
            role = r.role
            seq += 1
            out.append((key[0], seq, kind + "-delta", r.text))
    state.update((role, seq))
    state.setTimeoutDuration(IDLE_MS)
    yield pd.DataFrame(out, columns=["conv_id", "seq", "event", "body"])


def streamed_events(turns: DataFrame) -> DataFrame:
    """``message_events`` over a streaming DataFrame; the last run of a conversation is ended once it has been idle for ``IDLE_MS``."""
    return turns.groupBy("conv_id").applyInPandasWithState(fold_state, OUT, "role string, seq long", "append", "ProcessingTimeTimeout")


def new_only(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not handled yet."""
    return rows.join(done.select(F.col(key).alias("_d")), F.col(key) == F.col("_d"), "left_anti")


def memoised(rows: DataFrame, text: str, memory: DataFrame, work: Column, out: str) -> DataFrame:
    """``work`` for distinct texts that ``memory(source, target)`` lacks, joined back with what it has."""
    known = rows.select(F.col(text).alias("source")).where("source IS NOT NULL").distinct().join(memory, "source", "left")
    full = known.select(F.col("source").alias("_source"), F.coalesce("target", work).alias(out))
    return rows.join(full, F.col(text) == F.col("_source"), "left").drop("_source")


def retry_queue(tries: DataFrame, most: int = 3) -> DataFrame:
    """Per item the tries used and its end: done, or exhausted after ``most``, or waiting."""
    rows = tries.groupBy("item").agg(F.count_if(~F.col("ok")).alias("failed"), F.min(F.when(F.col("ok"), F.col("n"))).alias("done_at"))
    return rows.withColumn("state", F.when(F.col("done_at").isNotNull() & (F.col("done_at") <= most), "done").when(F.col("failed") >= most, "exhausted").otherwise("waiting"))


def tumbling(events: DataFrame, length: str = "1 hour") -> DataFrame:
    w = F.window("ts", length)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sliding(events: DataFrame, length: str = "2 hours", step: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", length, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """First event of each key within the watermark; for a stream."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def retried(items: DataFrame, most: int = 3) -> DataFrame:
    """``retry_queue`` over a stream of tries(item, ok): item and its end, told once; the number of failures is the state."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failed = state.get[0] if state.exists else 0
        out = []
        for frame in frames:
            for ok in frame["ok"]:
                if failed < 0:  # told already
                    break
                failed = -1 if ok else failed + 1
                if ok or failed >= most:
                    out.append((key[0], "done" if ok else "exhausted"))
                    failed = -1
        state.update((failed,))
        yield pd.DataFrame(out, columns=["item", "state"])

    return items.groupBy("item").applyInPandasWithState(run, "item long, state string", "failed int", "append", "NoTimeout")


def isolated(rows: DataFrame, key: str, column: str, work: Callable[[str], str], out: str) -> DataFrame:
    """``work`` item by item: a failure leaves null and its message in ``error``, the others go on."""
    schema = f"{key} {dict(rows.dtypes)[key]}, {out} string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made: list[tuple] = []
            for k, v in zip(f[key], f[column]):
                try:
                    made.append((k, work(v), None))
                except Exception as e:  # whatever an item does, the others go on
                    made.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(made, columns=[key, out, "error"])

    return rows.select(key, column).mapInPandas(run, schema)
