"""Sagas share their state by slot: many keys cost few state rows, and re-reading a slot loses nothing."""

import random

from pyspark.sql import functions as F

from ashlar.operators.graph import saga_reconcile
from ashlar.plans.loops import new_folder
from ashlar.sources.streams import event_stream, run_batches
from ashlar.streaming import operators as ops
from ashlar.streaming import processors
from test_streams import minute, same, shuffled_files

SCHEMA = "key BIGINT, ts TIMESTAMP, command BOOLEAN"


def test_state_rows_grow_with_the_slots_and_not_with_the_keys(spark):
    folder, root, out = new_folder(spark), new_folder(spark), []
    keys = spark.range(4000).withColumnRenamed("id", "key")
    for at, command in ((0, True), (5, False), (5000, True)):
        keys.select("key", F.lit(minute(at)).cast("timestamp").alias("ts"), F.lit(command).alias("command")).coalesce(1).write.mode("append").parquet(folder)
    live = event_stream(spark, folder, SCHEMA, files_per_batch=1)
    stream = ops.saga_stream(live.filter("command"), live.filter("NOT command"), 900.0, 600.0)
    query = run_batches(stream, lambda df, n: out.append(df.groupBy("state").count().collect()), root)
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert 0 < max(held) < 2000
    assert sum(r["count"] for rows in out for r in rows if r["state"] == "complete") == 4000


def test_rows_are_the_same_if_slots_are_read_again_each_time(spark, monkeypatch):
    monkeypatch.setattr(processors, "LOG_ROWS", 1)
    monkeypatch.setattr(ops, "SAGA_SLOTS", 3)
    rnd = random.Random(4)
    rows = [(key, minute(rnd.randrange(0, 3000)), rnd.random() < 0.4) for key in range(90) for _ in range(rnd.randint(1, 4))]
    rows += [(500, minute(1000 + i % 90), i % 3 == 0) for i in range(600)] + [(None, minute(100), True)]
    folder, out = shuffled_files(spark, rows, SCHEMA, 4), []
    live = event_stream(spark, folder, SCHEMA, files_per_batch=1)
    stream = ops.saga_stream(live.filter("command"), live.filter("NOT command"), 900.0, 4000 * 60.0)
    # Nothing is closed before the last row: a far row of another key then closes all but itself.
    spark.createDataFrame([(-1, minute(9000), True), (-1, minute(9000), False)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    run_batches(stream, lambda df, n: out.extend(df.collect()), new_folder(spark))
    whole = spark.createDataFrame([r for r in rows if r[0] is not None], SCHEMA)
    want = saga_reconcile(whole.filter("command"), whole.filter("NOT command"), 900.0)
    assert len(out) > 100 and same(spark.createDataFrame(out, want.select("key", "sent", "done", "state").schema), want)
