"""The keyed table: batches, replays, crashes between steps, and writers that meet."""

from __future__ import annotations

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import keyed, sinks, versions
from loomgraph.sources.keyed import KeyedTable

SCHEMA = "id long, name string, size int"


def rows_of(t, number=None):
    return {r.id: (r.name, r.size) for r in t.read(number=number).collect()}


def test_batches_against_a_dict(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, ["id"], buckets=5)
    want: dict = {}
    import random

    rng = random.Random(4)
    for step in range(9):
        rows = [(rng.randint(0, 20), rng.choice(["a", "b", None]), rng.choice([1, 2, None]), i) for i in range(rng.randint(0, 12))]
        if step % 3 == 2:
            gone = {r[0] for r in rows}
            t.delete(spark.createDataFrame([(g,) for g in gone], "id long"))
            want = {k: v for k, v in want.items() if k not in gone}
        elif step % 3 == 1:  # sizes alone; a null clears
            t.upsert(spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "id long, size int, n int"), "n")
            for i, _, size, _ in rows:
                want[i] = (want.get(i, (None, None))[0], size)
        else:
            t.upsert(spark.createDataFrame(rows, "id long, name string, size int, n int"), "n")
            want |= {i: (name, size) for i, name, size, _ in rows}
        assert rows_of(t) == want, step
    t.compact()
    assert rows_of(t) == want
    assert rows_of(KeyedTable(spark, f"{tmp_path}/t")) == want
    assert {tuple(r) for r in t.read([(3,), (4,), (99,)]).collect()} == {(i, *want[i]) for i in (3, 4) if i in want}
    before = rows_of(t, 3)
    assert t.vacuum(keep=50) == [] and rows_of(t, 3) == before and rows_of(t) == want


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, ["id"], buckets=16)
    t.upsert(spark.range(500).select("id", F.lit("x").alias("name"), F.lit(1).alias("size")))
    t.compact()
    old = versions.latest(spark, t.path)["parts"]
    for k in range(keyed.MOST_DELTAS + 1):
        t.upsert(spark.createDataFrame([(7, f"n{k}", k)], SCHEMA))
    new = versions.latest(spark, t.path)["parts"]
    changed = {b for b in new if new[b] != old[b]}
    assert len(changed) == 1 and len(new[changed.pop()]) <= keyed.MOST_DELTAS
    assert rows_of(t)[7] == (f"n{keyed.MOST_DELTAS}", keyed.MOST_DELTAS) and len(rows_of(t)) == 500
    files = t.read([(7,)]).inputFiles()
    assert files and all(f"_bucket={files[0].split('_bucket=')[1].split('/')[0]}/" in f for f in files)


def test_a_crash_between_steps_leaves_the_table(spark, tmp_path, monkeypatch):
    t = KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, ["id"], buckets=3)
    t.upsert(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], SCHEMA), batch=("s", 0))
    real = versions.publish

    def dies(*_):
        raise OSError("stopped before it could publish")

    for step in (lambda: t.upsert(spark.createDataFrame([(1, "z", 9)], SCHEMA), batch=("s", 1)), lambda: t.compact()):
        monkeypatch.setattr(versions, "publish", dies)
        with pytest.raises(OSError):
            step()
        assert rows_of(t) == {1: ("a", 1), 2: ("b", 2)}
        monkeypatch.setattr(versions, "publish", real)
    t.upsert(spark.createDataFrame([(1, "z", 9)], SCHEMA), batch=("s", 1))
    assert rows_of(t) == {1: ("z", 9), 2: ("b", 2)}
    assert t.vacuum() and rows_of(t) == {1: ("z", 9), 2: ("b", 2)}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, ["id"], buckets=3)
    put = t.sink("stream")
    put(spark.createDataFrame([(1, "a", 1)], SCHEMA), 0)
    put(spark.createDataFrame([(1, "b", 2)], SCHEMA), 1)
    number = versions.latest(spark, t.path)["version"]
    for k in (0, 1):  # a restarted stream sends them again
        put(spark.createDataFrame([(1, "again", 7)], SCHEMA), k)
    assert versions.latest(spark, t.path)["version"] == number and rows_of(t) == {1: ("b", 2)}


def test_a_stream_fills_the_table_once(spark, tmp_path):
    spark.range(20).select((F.col("id") % 6).alias("id"), F.lit("x").alias("name"), F.col("id").cast("int").alias("size")).repartition(4).write.parquet(f"{tmp_path}/in")
    t = KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, ["id"], buckets=3)
    for _ in range(2):  # the second query starts from the first one's checkpoint
        q = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.foreachBatch(t.sink("in", "size")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    assert set(rows_of(t)) == set(range(6))
    # a lost checkpoint repeats every batch under its old number
    before, number = rows_of(t), versions.latest(spark, t.path)["version"]
    q = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.foreachBatch(t.sink("in", "size")).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows_of(t) == before and versions.latest(spark, t.path)["version"] == number


def test_writers_that_meet_both_count(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, ["id"], buckets=3)
    faults = []

    def write(k):
        try:
            for j in range(3):
                KeyedTable(spark, t.path).upsert(spark.createDataFrame([(k * 10 + j, "x", k), (99, f"w{k}", j)], SCHEMA))
        except Exception as e:  # shown by the assertion below
            faults.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not faults and set(rows_of(t)) == {99, *(k * 10 + j for k in range(3) for j in range(3))}
    assert versions.latest(spark, t.path)["sequence"] == 9


def test_a_number_is_taken_once(spark, tmp_path):
    assert versions.latest(spark, f"{tmp_path}/v") is None
    assert versions.publish(spark, f"{tmp_path}/v", {"a": 1}, 0) and not versions.publish(spark, f"{tmp_path}/v", {"a": 2}, 0)
    assert versions.latest(spark, f"{tmp_path}/v") == {"a": 1, "version": 0}
    assert [p for p in Path(f"{tmp_path}/v/_versions").iterdir() if p.suffix == ".tmp"] == []


def test_null_keys_and_empty_batches(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/t", "a string, b long, v double", ["a", "b"], buckets=2)
    assert t.read().collect() == []
    t.upsert(spark.createDataFrame([], "a string, b long, v double"))
    t.upsert(spark.createDataFrame([("x", 1, 2.0), (None, 1, 3.0), ("x", None, 4.0), ("x", 1, 1.0)], "a string, b long, v double"))
    assert [tuple(r) for r in t.read().collect()] == [("x", 1, 2.0)]
    assert versions.latest(spark, t.path)["null_keys"] == 2
    t.delete(spark.createDataFrame([("x", 1), ("y", 1)], "a string, b long"))
    assert t.read().collect() == []
    t.compact()
    assert t.read().collect() == []


def test_pages_meet_files_by_their_whole_path(spark, tmp_path):
    for kind in ("unit", "weapon"):
        (tmp_path / f"html/{kind}").mkdir(parents=True)
        (tmp_path / f"html/{kind}/x.html").write_text(kind)
    (tmp_path / "html/a b+c%.html").write_text("odd")
    paths = ["html/unit/x.html", "weapon/x.html", f"{tmp_path}/html/unit/x.html", "html\\weapon\\x.html", "html/faq/x.html", "x.html", "html/a b+c%.html", "./html/unit/x.html"]
    manifest = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "n int, html_path string")
    there, missing = sinks.pages_of(spark, manifest, f"{tmp_path}/html")
    assert sorted((r.n, r.html) for r in there.collect()) == [(0, "unit"), (1, "weapon"), (2, "unit"), (3, "weapon"), (6, "odd"), (7, "unit")]
    assert sorted(r.n for r in missing.collect()) == [4, 5]
