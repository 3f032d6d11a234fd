"""Streams fed in several micro-batches against their batch forms; replays, late rows, restarts."""

import pytest
from pyspark.sql import functions as F

from ashlar.operators import routing, signal
from ashlar.plans.loops import new_folder
from ashlar.sources.artifacts import read_artifacts, write_artifacts
from ashlar.sources.streams import event_stream, late_rows, run_available, run_batches
from ashlar.sources.upsert import latest_by, upsert_stream
from ashlar.streaming import operators as ops

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def parts(spark):
    """The events in four files in time order, so that a stream takes four micro-batches."""
    folder = new_folder(spark)
    events = spark.read.parquet(EVENTS)
    n = events.count()
    for i in range(4):
        events.filter(F.floor(F.col("event_id") * 4 / n) == i).coalesce(1).write.mode("append").parquet(folder)
    return folder


@pytest.fixture(scope="module")
def batch(spark):
    return spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


def live(spark, parts, **options):
    return event_stream(spark, parts, spark.read.parquet(EVENTS).schema, files_per_batch=1, **options)


def closed(batch, hours=1):
    return batch.agg(F.max("ts") - F.expr(f"INTERVAL {hours} HOURS")).first()[0]


def same(a, b):
    b = b.select(a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_peak_meter(spark, parts, batch):
    def samples(df):
        return df.select(F.col("user_id").alias("track"), "ts", (F.col("value") / 500).alias("x"))

    got = run_available(ops.peak_meter_stream(samples(live(spark, parts)), ["track"], "1 hour"))
    want = signal.peak_meter(samples(batch), ["track"], "1 hour").filter(F.col("end") <= F.lit(closed(batch)))
    assert got.count() > 0 and same(got, want)


def test_sessions(spark, parts, batch):
    def log(df):
        return df.select(F.col("user_id").alias("agent"), "ts")

    got = run_available(ops.session_stream(log(live(spark, parts)), ["agent"], "12 hours"))
    want = routing.activity_sessions(log(batch), ["agent"], 12 * 3600)
    want = want.filter(F.col("last") + F.expr("INTERVAL 12 HOURS") <= F.lit(closed(batch)))
    assert got.count() > 0 and same(got, want)


def test_regions_survive_batch_borders(spark, parts, batch):
    kind = F.col("event_type")

    def control(df):
        event = F.when(kind == "signup", "CAPTURE").otherwise("STOP")
        return df.filter(kind.isin("signup", "error")).select(F.col("user_id").alias("track"), "ts", F.col("event_id").alias("seq"), event.alias("event"))

    got = run_available(ops.region_stream(control(live(spark, parts))))
    whole = signal.control_regions(control(batch)).filter("event = 'CAPTURE' AND until IS NOT NULL")
    assert got.count() > 0 and same(got, whole.select("track", F.col("at").alias("started"), F.col("until").alias("stopped")))


def test_holder_watch_against_a_plain_loop(spark, parts, batch):
    def log(df):
        return df.select((F.col("user_id") % 5).alias("worktree"), F.col("user_id").alias("agent"), "ts")

    root = new_folder(spark)
    buckets = run_available(ops.bucket_stream(log(live(spark, parts)), ["worktree", "agent"], "10 minutes"), root)
    schema = "worktree BIGINT, agent BIGINT, bucket TIMESTAMP, value BIGINT"
    activity = event_stream(spark, f"{root}/rows", schema, time="bucket").withColumnRenamed("bucket", "ts")
    got = sorted((r["worktree"], r["ts"], r["holder"], r["intruder"]) for r in run_available(ops.overlap_stream(activity, 7200)).collect())
    want, holders = [], {}
    for r in sorted(buckets.collect(), key=lambda r: (r["bucket"], r["agent"])):
        agent, seen = holders.get(r["worktree"], (None, None))
        if agent is None or (r["bucket"] - seen).total_seconds() >= 7200 or agent == r["agent"]:
            holders[r["worktree"]] = (r["agent"], r["bucket"])
        else:
            want.append((r["worktree"], r["bucket"], agent, r["agent"]))
    assert want and got == sorted(want)


def test_consume_once(spark, parts, batch):
    hour = F.date_trunc("hour", "ts")
    keys = ["user_id", "event_type", "hour"]
    got = run_available(ops.consume_once(live(spark, parts).withColumn("hour", hour), keys).select(*keys))
    assert same(got, batch.select("user_id", "event_type", hour.alias("hour")).distinct())


def test_reroutes_between_batches(spark, parts):
    targets = {"view": "a", "click": "b", "purchase": "c", "signup": "d"}
    seen = live(spark, parts).select(F.col("user_id").alias("task"), "ts", F.col("event_type").alias("shape"))
    got = run_available(ops.reroute_stream(seen, targets, "ask"))
    assert got.count() > 0 and got.filter("old_target = new_target").isEmpty()


def test_days_are_computed_once_over_restarts(spark, batch):
    folder, root = new_folder(spark), new_folder(spark)
    events = spark.read.parquet(EVENTS)
    cut = events.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]

    def run():
        rows = event_stream(spark, folder, events.schema)
        runs = rows.select((F.col("user_id") % 4).alias("repo"), "ts", (F.col("event_type") == "error").alias("failed"), F.col("value").cast("decimal(18,2)").alias("amount"))
        return run_available(ops.daily_stream(runs), root, ("day",))

    events.filter(F.col("event_id") <= cut).write.mode("append").parquet(folder)
    first = run().count()
    events.filter(F.col("event_id") > cut).write.mode("append").parquet(folder)
    second = run()
    assert 0 < first < second.count()
    assert second.groupBy("repo", "day").count().filter("count > 1").isEmpty()
    want = batch.filter(F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY") <= F.lit(closed(batch))).count()
    assert second.agg(F.sum("runs")).first()[0] == want


def test_upsert_is_idempotent(spark, parts):
    root, key, order = new_folder(spark), ["user_id"], ["ts", "event_id"]
    got = upsert_stream(live(spark, parts), key, order, root)
    want = latest_by(spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp")), key, order)
    assert same(got, want)


def test_late_rows_are_counted(spark):
    folder, root = new_folder(spark), new_folder(spark)
    for hour in [1, 9, 10, 2]:  # the watermark that drops rows lags one batch behind
        rows = spark.createDataFrame([(1, hour)], "track INT, h INT").select("track", F.timestamp_seconds(F.col("h") * 3600).alias("ts"), F.lit(0.5).alias("x"))
        rows.coalesce(1).write.mode("append").parquet(folder)
    rows = event_stream(spark, folder, "track INT, ts TIMESTAMP, x DOUBLE", files_per_batch=1)
    meter = ops.peak_meter_stream(rows, ["track"], "1 hour")
    query = run_batches(meter, lambda df, n: df.write.format("noop").mode("overwrite").save(), root)
    assert late_rows(query) == 1


def test_artifacts(spark):
    root = new_folder(spark)
    rows = spark.createDataFrame([(1, "decision", "a"), (2, "ledger", "b"), (3, "story", "c")], "id INT, kind STRING, text STRING")
    write_artifacts(rows, root)
    write_artifacts(rows.filter("kind <> 'story'"), root)
    counts = {r["kind"]: r["count"] for r in read_artifacts(spark, root).groupBy("kind").count().collect()}
    assert counts == {"decision": 1, "ledger": 2, "story": 1}


def shuffled_files(spark, rows, schema, seed, n=5):
    """The rows in files that overlap in time by up to 40 minutes, each in no order."""
    import random

    rnd = random.Random(seed)
    folder = new_folder(spark)
    late = sorted(rows, key=lambda r: r[1].timestamp() + rnd.uniform(0, 2400))
    for i in range(n):
        part = late[i * len(late) // n : (i + 1) * len(late) // n]
        rnd.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def minute(m):
    import datetime

    return datetime.datetime(2024, 3, 1) + datetime.timedelta(minutes=m)


def test_late_controls_are_ordered_across_batches(spark):
    import random

    rnd = random.Random(2)
    control = [(rnd.randrange(4), minute(rnd.randrange(0, 3000, 3)), i, rnd.choice(["CAPTURE", "STOP"])) for i in range(600)]
    schema = "track BIGINT, ts TIMESTAMP, seq BIGINT, event STRING"
    folder = shuffled_files(spark, control, schema, 4)
    got = run_available(ops.region_stream(event_stream(spark, folder, schema, files_per_batch=1)))
    whole = signal.control_regions(spark.createDataFrame(control, schema)).filter("event = 'CAPTURE'")
    end = max(r[1] for r in control) - minute(60) + minute(0)
    want = whole.filter(F.col("until") <= F.lit(end)).select("track", F.col("at").alias("started"), F.col("until").alias("stopped"))
    assert got.count() > 50 and same(got, want)


def test_saga_rows_equal_the_batch_rows(spark):
    import random

    from ashlar.operators.graph import saga_reconcile

    rnd = random.Random(9)
    rows = []
    for key in range(120):
        start = rnd.randrange(0, 4000)
        rows += [(key, minute(start + rnd.randrange(0, 100)), rnd.random() < 0.4) for _ in range(rnd.randint(1, 5))]
    rows += [(500, minute(1000 + i % 90), i % 3 == 0) for i in range(900)]  # a busy key
    schema = "key BIGINT, ts TIMESTAMP, command BOOLEAN"
    folder = shuffled_files(spark, rows, schema, 7)
    live_rows = event_stream(spark, folder, schema, files_per_batch=1)
    got = run_available(ops.saga_stream(live_rows.filter("command"), live_rows.filter("NOT command"), 900.0, 6 * 3600.0))
    whole = spark.createDataFrame(rows, schema)
    batch = saga_reconcile(whole.filter("command"), whole.filter("NOT command"), 900.0)
    ends = [max(r[1] for r in rows if r[2] == kind) for kind in (True, False)]
    opened = whole.groupBy("key").agg(F.min("ts").alias("_opened"))
    end = min(ends) - minute(60) + minute(0)
    want = batch.join(opened, "key").filter(F.col("_opened") + F.expr("INTERVAL 6 HOURS") <= F.lit(end)).drop("_opened")
    states = {r["state"] for r in got.collect()}
    assert states == {"complete", "missing step", "late step", "orphan step"} and same(got, want)


def test_idle_tasks_leave_the_state(spark):
    folder, root = new_folder(spark), new_folder(spark)
    schema = "task BIGINT, ts TIMESTAMP, shape STRING"
    files = [[(k, minute(k), "view") for k in range(50)], [(1, minute(200), "click")], [(1, minute(1000), "view")], [(1, minute(2000), "view")],
             [(2, minute(2100), "click"), (2, minute(2101), "view")]]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    out = []
    stream = ops.reroute_stream(event_stream(spark, folder, schema, files_per_batch=1), {"view": "a", "click": "b"}, "ask", idle_s=300 * 60.0)
    query = run_batches(stream, lambda df, n: out.extend(df.collect()), root)
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(held) >= 50 and held[-1] < 10
    # Task 1 moves while it is held; after 800 idle minutes it starts anew, and so does task 2.
    assert [(r["task"], r["old_target"], r["new_target"]) for r in out] == [(1, "a", "b"), (2, "b", "a")]
