from pyspark.sql import functions as F

from ashlar.operators import routing, signal
from ashlar.sources.artifacts import read_artifacts, write_artifacts
from ashlar.sources.records import read_records, write_records
from ashlar.plans.loops import new_folder
from ashlar.sources.streams import event_stream, run_available
from ashlar.sources.upsert import upsert_stream
from ashlar.streaming import operators as ops
import bindings.signal  # noqa: F401  its SQL is reused below
from bindings.registry import SQL, query
from bindings.routing import SHAPE_CASE, SHAPES
from bindings.records import FIRES, REVISIT_SQL, TRIGGERS, revisit_triggers

CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


def closed(*kinds):
    """The watermark of a stream of these events only: the filter acts before it."""
    return CLOSED.replace("events", f"events WHERE event_type IN {kinds}")


def live(t):
    return event_stream(t.spark, t.sf_dir, t.events.schema, glob="events.parquet")


def ntz(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query(
    "i1_read_records",
    """
SELECT 'adr' AS series, s_suppkey + 1 AS num, 'use-supplier-' || s_suppkey AS slug,
  '# ADR-' || (s_suppkey + 1) || ': Use ' || s_name || chr(10) || chr(10) || '- Status: accepted' || chr(10) AS text FROM supplier""",
)
def i1(t):
    num = F.col("s_suppkey") + 1
    text = F.concat(F.lit("# ADR-"), num, F.lit(": Use "), F.col("s_name"), F.lit("\n\n- Status: accepted"))
    records = t.supplier.select(num.alias("num"), F.concat(F.lit("use-supplier-"), F.col("s_suppkey")).alias("slug"), text.alias("text"))
    folder = f"{new_folder(t.spark)}/adr"
    write_records(records, folder)
    return read_records(t.spark, folder)


@query(
    "i2_write_artifacts",
    """
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'decision' WHEN 'O' THEN 'story' ELSE 'ledger' END AS kind, o_orderpriority AS text FROM orders""",
)
def i2(t):
    kind = F.expr("CASE o_orderstatus WHEN 'F' THEN 'decision' WHEN 'O' THEN 'story' ELSE 'ledger' END")
    root = new_folder(t.spark)
    write_artifacts(t.orders.select(F.col("o_orderkey").alias("id"), kind.alias("kind"), F.col("o_orderpriority").alias("text")), root)
    return read_artifacts(t.spark, root)


@query("i3_event_stream", "SELECT * FROM events")
def i3(t):
    return ntz(run_available(live(t)), "ts")


@query(
    "i4_upsert_stream",
    "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def i4(t):
    return ntz(upsert_stream(live(t), ["user_id"], ["ts", "event_id"], every=1), "ts")


@query(
    "h3_peak_meter_stream",
    f"""
WITH w AS (SELECT user_id AS track, time_bucket(INTERVAL 1 HOUR, ts) AS "start", max(abs(value / 500)) AS peak FROM events GROUP BY ALL)
SELECT track, "start", "start" + INTERVAL 1 HOUR AS "end", CASE WHEN peak > 0 THEN round(20 * log10(peak), 4) END AS peak_db FROM w WHERE "start" + INTERVAL 1 HOUR <= {CLOSED}""",
)
def h3_stream(t):
    samples = live(t).select(F.col("user_id").alias("track"), "ts", (F.col("value") / 500).alias("x"))
    closed = run_available(ops.peak_meter_stream(samples, ["track"], "1 hour"))
    return ntz(closed, "start", "end").withColumn("peak_db", F.round("peak_db", 4))


@query(
    "h1_region_stream",
    f"""
WITH c AS (
  SELECT user_id AS track, ts, event_id, CASE event_type WHEN 'signup' THEN 'CAPTURE' ELSE 'STOP' END AS event FROM events WHERE event_type IN ('signup', 'error')),
p AS (SELECT *, lag(event) OVER (PARTITION BY track ORDER BY ts, event_id) AS prev FROM c),
k AS (SELECT *, lead(ts) OVER (PARTITION BY track ORDER BY ts, event_id) AS stopped FROM p WHERE event IS DISTINCT FROM prev)
SELECT track, ts AS started, stopped FROM k WHERE event = 'CAPTURE' AND stopped <= {closed('signup', 'error')}""",
)
def h1_stream(t):
    kind = F.col("event_type")
    control = live(t).filter(kind.isin("signup", "error")).select(
        F.col("user_id").alias("track"), "ts", F.col("event_id").alias("seq"), F.when(kind == "signup", "CAPTURE").otherwise("STOP").alias("event")
    )
    return ntz(run_available(ops.region_stream(control)), "started", "stopped")


@query(
    "f3_reroute_stream",
    f"""
WITH s AS (
  SELECT user_id AS task, max(ts) AS ts, arg_min(event_type, (ts, event_id)) AS first, arg_max(event_type, (ts, event_id)) AS shape FROM events GROUP BY 1),
n AS (SELECT task, ts, {SHAPE_CASE.format('first')} AS old_target, {SHAPE_CASE.format('shape')} AS new_target FROM s)
SELECT * FROM n WHERE old_target <> new_target""",
)
def f3_stream(t):
    seen = live(t).select(F.col("user_id").alias("task"), "ts", F.col("event_type").alias("shape"))
    return ntz(run_available(ops.reroute_stream(seen, SHAPES, routing.ASK)), "ts")


@query(
    "f7_overlap_watch",
    f"""
WITH RECURSIVE b AS (SELECT DISTINCT user_id % 5 AS worktree, user_id AS agent, time_bucket(INTERVAL 10 MINUTE, ts) AS ts FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY worktree ORDER BY ts, agent) AS rn FROM b WHERE ts + INTERVAL 10 MINUTE <= {CLOSED}),
w(worktree, rn, ts, agent, holder, seen, hit) AS (
  SELECT worktree, rn, ts, agent, agent, ts, NULL::BIGINT FROM o WHERE rn = 1
  UNION ALL
  SELECT o.worktree, o.rn, o.ts, o.agent,
    CASE WHEN o.ts >= seen + INTERVAL 2 HOUR OR o.agent = holder THEN o.agent ELSE holder END,
    CASE WHEN o.ts >= seen + INTERVAL 2 HOUR OR o.agent = holder THEN o.ts ELSE seen END,
    CASE WHEN o.ts < seen + INTERVAL 2 HOUR AND o.agent <> holder THEN holder END
  FROM w JOIN o ON o.worktree = w.worktree AND o.rn = w.rn + 1)
SELECT worktree, ts, hit AS holder, agent AS intruder FROM w WHERE hit IS NOT NULL""",
)
def f7(t):
    log = live(t).select((F.col("user_id") % 5).alias("worktree"), F.col("user_id").alias("agent"), "ts")
    root = new_folder(t.spark)
    run_available(ops.bucket_stream(log, ["worktree", "agent"], "10 minutes"), root)
    schema = "worktree BIGINT, agent BIGINT, bucket TIMESTAMP, value BIGINT"
    activity = event_stream(t.spark, f"{root}/rows", schema, time="bucket").withColumnRenamed("bucket", "ts")
    return ntz(run_available(ops.overlap_stream(activity, 7200)), "ts")


@query(
    "f9_session_stream",
    f"""
WITH g AS (
  SELECT user_id AS agent, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 12 HOUR, true)::INTEGER AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY agent ORDER BY ts) AS no FROM g)
SELECT agent, min(ts) AS "start", max(ts) AS last, count(*) AS events FROM n GROUP BY agent, no HAVING max(ts) + INTERVAL 12 HOUR <= {CLOSED}""",
)
def f9_stream(t):
    log = live(t).select(F.col("user_id").alias("agent"), "ts")
    return ntz(run_available(ops.session_stream(log, ["agent"], "12 hours")), "start", "last")


@query(
    "f8_nightly_stream",
    f"""
WITH d AS (
  SELECT user_id % 40 AS repo, ts::DATE AS day, count(*) AS runs, count_if(event_type = 'error') AS failures, sum(value::DECIMAL(18,2)) AS amount FROM events
  WHERE ts::DATE + INTERVAL 1 DAY <= {CLOSED} GROUP BY ALL)
SELECT repo, day, sum(runs)::BIGINT AS runs, sum(failures)::BIGINT AS failures, sum(amount)::DOUBLE AS amount FROM d GROUP BY ROLLUP (repo, day)""",
)
def f8_stream(t):
    runs = live(t).select(
        (F.col("user_id") % 40).alias("repo"), "ts", (F.col("event_type") == "error").alias("failed"), F.col("value").cast("decimal(18,2)").alias("amount")
    )
    daily = run_available(ops.daily_stream(runs), partition_by=("day",))
    totals = daily.rollup("repo", "day").agg(*[F.sum(c).alias(c) for c in ["runs", "failures", "amount"]])
    return totals.withColumn("amount", F.col("amount").cast("double"))


@query(
    "b9_trigger_stream",
    f"""
WITH triggers AS (SELECT * FROM ({TRIGGERS}) v(metric, threshold, sustain)),
b AS (
  SELECT * FROM (SELECT event_type AS metric, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS value FROM events GROUP BY ALL)
  WHERE bucket + INTERVAL 1 HOUR <= {CLOSED}),
r AS (
  SELECT b.*, threshold, sustain, bucket - INTERVAL 1 HOUR * (row_number() OVER (PARTITION BY b.metric, threshold, sustain ORDER BY bucket)) AS run
  FROM b JOIN triggers t ON b.metric = t.metric AND value > threshold)
SELECT metric, threshold, sustain, min(bucket) AS first_bucket, min(bucket) + INTERVAL 1 HOUR * (any_value(sustain) - 1) AS fired_bucket, any_value(sustain)::BIGINT AS buckets
FROM r GROUP BY metric, threshold, sustain, run HAVING count(*) >= sustain""",
)
def b9_stream(t):
    root = new_folder(t.spark)
    run_available(ops.bucket_stream(live(t).withColumnRenamed("event_type", "metric"), ["metric"], "1 hour"), root)
    buckets = event_stream(t.spark, f"{root}/rows", "metric STRING, bucket TIMESTAMP, value BIGINT", time="bucket")
    triggers = t.spark.sql(f"SELECT * FROM {TRIGGERS} AS v(metric, threshold, sustain)")
    return ntz(run_available(ops.trigger_stream(buckets, triggers, 3600)), "first_bucket", "fired_bucket")


@query(
    "b9_revisit_stream",
    f"""
WITH {REVISIT_SQL},
b AS (
  SELECT * FROM (SELECT event_type AS metric, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS value FROM events GROUP BY ALL)
  WHERE bucket + INTERVAL 1 HOUR <= {CLOSED}),
r AS (
  SELECT g.*, bucket,
    bucket - INTERVAL 1 HOUR * (row_number() OVER (PARTITION BY record, g.metric, op, threshold, factor, sustain ORDER BY bucket)) AS run
  FROM b JOIN g ON b.metric = g.metric AND {FIRES})
SELECT record, metric, op, threshold, factor, sustain, min(bucket) AS first_bucket,
  min(bucket) + INTERVAL 1 HOUR * (any_value(sustain) - 1) AS fired_bucket, any_value(sustain)::BIGINT AS buckets
FROM r GROUP BY record, metric, op, threshold, factor, sustain, run HAVING count(*) >= sustain""",
)
def b9_revisit_stream(t):
    root = new_folder(t.spark)
    run_available(ops.bucket_stream(live(t).withColumnRenamed("event_type", "metric"), ["metric"], "1 hour"), root)
    buckets = event_stream(t.spark, f"{root}/rows", "metric STRING, bucket TIMESTAMP, value BIGINT", time="bucket")
    return ntz(run_available(ops.trigger_stream(buckets, revisit_triggers(t), 3600)), "first_bucket", "fired_bucket")


@query("c17_consume_once_stream", "SELECT DISTINCT user_id, event_type, date_trunc('hour', ts)::TIMESTAMP AS hour FROM events")
def c17_stream(t):
    hour = F.date_trunc("hour", "ts")
    once = ops.consume_once(live(t).withColumn("hour", hour), ["user_id", "event_type", "hour"])
    # Copies of a key lie within its hour, hence within the delay: the keys do not depend on the batches.
    return ntz(run_available(once.select("user_id", "event_type", "hour")), "hour")


@query(
    "d15_saga_stream",
    f"""
WITH e AS (SELECT user_id * 1000 + dayofyear(ts) AS key, ts, event_type FROM events WHERE event_type IN ('click', 'purchase')),
c AS (SELECT key, min(ts) AS sent FROM e WHERE event_type = 'click' GROUP BY 1),
s AS (SELECT key, ts FROM e WHERE event_type = 'purchase'),
d AS (SELECT s.key, min(ts) AS done FROM s JOIN c ON c.key = s.key AND ts >= sent GROUP BY 1),
r AS (
  SELECT c.key, sent, done, CASE WHEN done IS NULL THEN 'missing step' WHEN done > sent + INTERVAL 1 HOUR THEN 'late step' ELSE 'complete' END AS state
  FROM c LEFT JOIN d ON c.key = d.key
  UNION ALL SELECT s.key, NULL, min(ts), 'orphan step' FROM s LEFT JOIN c ON c.key = s.key WHERE sent IS NULL OR ts < sent GROUP BY 1)
SELECT r.* FROM r JOIN (SELECT key, min(ts) AS opened FROM e GROUP BY 1) o ON o.key = r.key WHERE opened + INTERVAL 1 DAY <= {closed('click', 'purchase')}""",
)
def d15_stream(t):
    """A saga is a user's day: the first click asks, purchases answer."""
    rows = live(t).withColumn("key", F.col("user_id") * 1000 + F.dayofyear("ts"))
    commands, steps = (rows.filter(F.col("event_type") == kind).select("key", "ts") for kind in ("click", "purchase"))
    return ntz(run_available(ops.saga_stream(commands, steps, 3600.0, 86400.0)), "sent", "done")


@query("h9_pass_progress_stream", SQL["h9_pass_progress"])
def h9_stream(t):
    log = live(t).select(
        F.col("user_id").alias("job"),
        F.expr("CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END").alias("pass"),
        F.when(F.col("value") < 25, "Waiting").when(F.col("value") < 50, "Processing").otherwise("Done").alias("state"),
        "ts",
    )
    current = upsert_stream(ops.pass_state_stream(log), ["job", "pass"], ["ts"], mode="update")
    return signal.job_progress(current, 4).withColumn("remaining_s", F.round("remaining_s", 3))
