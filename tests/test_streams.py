"""Streams with state against their batch forms."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from loomgraph.plans import catalogue
from loomgraph.streaming import answers, fold

SF = "/root/testdata/sf0.001"
MESSAGE = "conv_id long, turn long, kind string, content string, sources array<string>, native boolean, last boolean"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    answers.with_state_store(spark)
    yield
    spark.conf.set(key, old)


def _run(spark, batches, tmp_path, name, expected):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    # timers make the engine start batches without data for ever, so the query is stopped once it has read all files
    q = answers.streamed_answers(src).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
    end = time.time() + 90
    while time.time() < end and q.exception() is None and spark.table(name).count() < expected:
        time.sleep(0.5)
    q.stop()
    assert q.exception() is None
    return sorted((r.conv_id, r.seq, r.event, r.body) for r in spark.table(name).collect())


def test_answers_in_any_order(spark, tmp_path, rocks):
    rows = catalogue._messages(spark, SF).where("conv_id < 24").collect()
    last = {}
    for r in rows:
        last[r.conv_id] = max(r.turn, last.get(r.conv_id, 0))
    first = min(r.turn for r in rows)
    sent = [(r.conv_id, r.turn - first, r.kind, r.content, r.sources, r.native, r.turn == last[r.conv_id]) for r in rows]
    rng = random.Random(3)
    rng.shuffle(sent)
    sent += rng.sample(sent, 5)  # sent twice
    want = fold.answer_events(catalogue._messages(spark, SF).where("conv_id < 24")).collect()
    got = _run(spark, [sent[i::4] for i in range(4)], tmp_path, "shuffled", len(want))
    assert got == sorted((r.conv_id, r.seq, r.event, r.body) for r in want) and len(got) > 50


def test_a_missing_turn_waits_for_its_timer(spark, tmp_path, rocks, monkeypatch):
    monkeypatch.setattr(answers, "IDLE_MS", 600_000)
    got = _run(spark, [[(1, 2, "ai", '"b"', None, False, True)], [(1, 0, "ai", '"a"', None, False, False)]], tmp_path, "gap", 2)
    assert got == [(1, 1, "text-start", None), (1, 2, "text-delta", "a")]  # turn 1 may still come


class _Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class _Map(dict):
    containsKey = dict.__contains__  # noqa: N815
    getValue = dict.__getitem__  # noqa: N815

    def updateValue(self, k, v):  # noqa: N802
        self[k] = v

    def removeKey(self, k):  # noqa: N802
        del self[k]


class _List(list):
    def get(self):
        return iter(list(self))

    def appendValue(self, v):  # noqa: N802
        self.append(v)


def test_a_timer_passes_over_what_is_missing():
    p = answers.Answers()
    p.fold, p.held, p.brought, p.spoken, p.marks = _Value(), _Map(), _List(), _List(), _Map()
    p.fold.update((1, 2, False, True, False, False, None))
    p.held[(3,)] = ("ai", "late", "", [], None, [], False, False)
    out = [tuple(r) for f in p.handleExpiredTimer((7,), None, None) for r in f.itertuples(index=False)]
    assert out == [(7, 3, "text-delta", "late"), (7, 4, "text-end", None), (7, 5, "finish-step", None)]
    assert not p.fold.exists() and not p.held and not p.spoken
