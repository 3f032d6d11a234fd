"""The current table: compactions, replays, and writers that die between any two steps."""

import os
import random

import pytest
from pyspark.sql import DataFrameWriter

from ashlar.plans.loops import new_folder
from ashlar.sources.upsert import CurrentTable

SCHEMA = "k STRING, v INT, ts INT"


def table(spark, every, buckets=4, root=None):
    t = CurrentTable(spark, root or new_folder(spark), ["k"], ["ts"], buckets, every)
    t.start(spark.createDataFrame([], SCHEMA).schema)
    return t


def batches(seed, n=7):
    rng = random.Random(seed)
    return [[(rng.choice(["a", "b", "c", "d", "e", None]), rng.randrange(100), rng.randrange(5)) for _ in range(6)] for _ in range(n)]


def want(rows):
    """Equal order: the later batch; the batches here hold one row for each key and order."""
    found = {}
    for batch in rows:
        for k, v, ts in batch:
            if k not in found or ts >= found[k][1]:
                found[k] = (v, ts)
    return found


def distinct(batch):
    return list({(k, ts): (k, v, ts) for k, v, ts in batch}.values())


def state(t):
    rows = t.read().collect()
    assert len({r["k"] for r in rows}) == len(rows)
    return {r["k"]: (r["v"], r["ts"]) for r in rows}


@pytest.mark.parametrize("every", [1, 3])
def test_rows_are_the_same_after_each_batch_and_its_replay(spark, every):
    t, rows = table(spark, every), [distinct(b) for b in batches(every, 5)]
    assert state(t) == {}
    for n, batch in enumerate(rows):
        for _ in range(2):
            t.write(spark.createDataFrame(batch, SCHEMA), n)
        assert state(t) == want(rows[: n + 1])
    assert t.generation().number == len(rows) // every


def test_a_reader_opens_one_generation(spark):
    t, rows = table(spark, 2), [distinct(b) for b in batches(5, 9)]
    for n, batch in enumerate(rows):
        t.write(spark.createDataFrame(batch, SCHEMA), n)
    now = t.generation()
    files = t.read().inputFiles()
    assert now.number == 4 and not [f for f in files if "/rows/" in f and "/rows/g-4/" not in f]
    assert len([f for f in files if "/base/" in f]) <= 4
    left = [f for f in os.listdir(f"{t.root}/rows/g-0") if f.startswith("upsert_batch")]
    assert left == [] and state(t) == want(rows)


def test_only_touched_buckets_are_written_again(spark):
    t = table(spark, 1, buckets=64)
    t.write(spark.createDataFrame([(f"k{i}", i, 0) for i in range(300)], SCHEMA), 0)
    t.write(spark.createDataFrame([("k7", -1, 1)], SCHEMA), 1)
    assert sorted(t.generation().buckets.values()).count(2) == 1
    assert state(t) == {f"k{i}": (i, 0) if i != 7 else (-1, 1) for i in range(300)}


class Died(Exception):
    pass


@pytest.mark.parametrize("step", range(1, 7))
def test_a_writer_dies_at_any_write_and_starts_again(spark, monkeypatch, step):
    t, rows = table(spark, 1), [distinct(b) for b in batches(11, 4)]
    for n in range(3):
        t.write(spark.createDataFrame(rows[n], SCHEMA), n)
    write, seen = DataFrameWriter.parquet, [0]

    def dies(self, path, *args, **kw):
        seen[0] += 1
        if seen[0] == step:
            raise Died
        write(self, path, *args, **kw)

    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrameWriter.parquet", dies)
    try:
        t.write(spark.createDataFrame(rows[3], SCHEMA), 3)
        assert seen[0] < step
    except Died:
        pass
    monkeypatch.undo()
    assert state(t) in (want(rows[:3]), want(rows))  # what a reader sees before the next start
    t = table(spark, 1, root=t.root)
    t.write(spark.createDataFrame(rows[3], SCHEMA), 3)
    assert state(t) == want(rows) and t.generation().last == 3


def test_other_columns_are_refused(spark):
    t = table(spark, 1)
    with pytest.raises(ValueError):
        t.start(spark.createDataFrame([], "k STRING, other INT").schema)
    with pytest.raises(ValueError):
        t.start(spark.createDataFrame([], "upsert_batch INT").schema)
