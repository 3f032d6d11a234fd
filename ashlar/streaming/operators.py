"""Stream forms of the operators. Inputs carry event time ``ts`` with a watermark (see ``event_stream``)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ashlar.operators.records import fires
from ashlar.operators.signal import peak_meter
from ashlar.streaming import processors as p

#: Groups of keys that share a state in ``saga_stream``; fixed, as the state of a running stream is.
SAGA_SLOTS = 256

# State processors travel with their code: the worker that prepares a query sees no files sent to executors.
cloudpickle.register_pickle_by_value(p)


def peak_meter_stream(samples: DataFrame, keys: Sequence[str], size: str, slide: str | None = None) -> DataFrame:
    """Closed windows of the peak meter, in append mode."""
    return peak_meter(samples, keys, size, slide)


def bucket_stream(events: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Rows per key and closed tumbling window: (keys…, bucket, value)."""
    counts = events.groupBy(*keys, F.window("ts", size).alias("_w")).agg(F.count(F.lit(1)).alias("value"))
    return counts.select(*keys, F.col("_w.start").alias("bucket"), "value")


def trigger_stream(buckets: DataFrame, triggers: DataFrame, bucket_s: int) -> DataFrame:
    """buckets(metric, bucket, value) as a stream, triggers(metric, threshold, sustain, and more) → runs as they reach sustain.

    Ratio triggers get their level from ``records.trigger_bounds`` first.
    """
    names = ["metric", *[c for c in triggers.columns if c != "metric"]]
    above = buckets.join(triggers, "metric").filter(fires(triggers))
    # Triggers may have null columns, which a key of the state may not: the whole trigger travels as one text.
    keyed = above.select(F.to_json(F.struct(*names)).alias("trigger"), "sustain", "bucket").groupBy("trigger")
    runs = keyed.transformWithStateInPandas(p.SustainedRuns(bucket_s), p.RUNS, "append", "none")
    trigger = F.from_json("trigger", StructType([above.schema[c] for c in names]))
    return runs.withColumn("_t", trigger).select("_t.*", "first_bucket", "fired_bucket", "buckets")


def consume_once(events: DataFrame, key: Sequence[str]) -> DataFrame:
    """At-least-once delivery → one row per key within the watermark's delay."""
    return events.dropDuplicatesWithinWatermark(list(key))


def saga_stream(commands: DataFrame, steps: DataFrame, limit_s: float, patience_s: float) -> DataFrame:
    """commands(key, ts), steps(key, ts) → the rows of ``saga_reconcile``: complete, late, missing and orphan steps.

    A key is closed once the watermark shows that ``patience_s`` have passed since its first command or step; a row of it
    that comes later opens it anew. The two sides meet as one keyed stream, so a key with many commands and steps costs
    its rows and not its pairs. The state is kept in SAGA_SLOTS slots of keys (see ``Sagas``). Rows without key or time
    take no part.
    """
    both = commands.select("key", "ts", F.lit(True).alias("command")).unionByName(steps.select("key", "ts", F.lit(False).alias("command")))
    slots = both.na.drop(subset=["key", "ts"]).withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(SAGA_SLOTS))).groupBy("slot")
    return slots.transformWithStateInPandas(p.Sagas(limit_s, patience_s), p.SAGAS, "append", "eventTime")


def region_stream(control: DataFrame) -> DataFrame:
    """control(track, ts, seq, event) → closed capture regions, in event order. Samples never enter the state.

    A region comes out once the watermark has passed its STOP; controls may come in any order within the delay.
    """
    return control.groupBy("track").transformWithStateInPandas(p.CaptureRegions(), p.REGIONS, "append", "eventTime")


def reroute_stream(observations: DataFrame, targets: Mapping[str, str], default: str, idle_s: float = 7 * 86400.0) -> DataFrame:
    """observations(task, ts, shape) → tasks that should move to another target; a task is over after ``idle_s`` of silence."""
    keyed = observations.groupBy("task")
    return keyed.transformWithStateInPandas(p.Reroutes(dict(targets), default, idle_s), p.REROUTES, "append", "eventTime")


def overlap_stream(activity: DataFrame, hold_s: int) -> DataFrame:
    """activity(worktree, agent, ts), one row per agent and bucket → edits into a held worktree."""
    keyed = activity.groupBy("worktree")
    return keyed.transformWithStateInPandas(p.WorktreeHolder(hold_s), p.CONFLICTS, "append", "eventTime")


def session_stream(log: DataFrame, keys: Sequence[str], gap: str) -> DataFrame:
    """log(keys…, ts) → closed sessions (keys…, start, last, events)."""
    counts = log.groupBy(*keys, F.session_window("ts", gap).alias("_w")).agg(
        F.max("ts").alias("last"), F.count(F.lit(1)).alias("events")
    )
    return counts.select(*keys, F.col("_w.start").alias("start"), "last", "events")


def daily_stream(runs: DataFrame) -> DataFrame:
    """runs(repo, ts, failed, amount) → one row per repo and closed day. Run again from the same root, only
    new days are computed."""
    daily = runs.groupBy("repo", F.window("ts", "1 day").alias("_w")).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("failed").alias("failures"), F.sum("amount").alias("amount")
    )
    return daily.select("repo", F.to_date("_w.start").alias("day"), "runs", "failures", "amount")


def pass_state_stream(status_log: DataFrame) -> DataFrame:
    """status_log(job, pass, state, ts) → latest state per job and pass, for update mode."""
    ts, state = F.col("ts"), F.col("state")
    return status_log.groupBy("job", "pass").agg(
        F.max_by("state", "ts").alias("state"),
        F.max("ts").alias("ts"),
        F.min(F.when(state == "Processing", ts)).alias("started"),
        F.max(F.when(state == "Done", ts)).alias("finished"),
    )
