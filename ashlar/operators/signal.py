"""Sampled signals as rows: samples(track, ts, x), control(track, ts, event), cleaning passes on rows."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.functions.levels import decibel, loudness, seconds_between
from ashlar.functions.lint import broken_rules
from ashlar.plans.scans import last, scan
from ashlar.plans.sizes import dealt_by_rows

# The delivery spec and the gates of the published loudness measure.
SAMPLE_RATE = 44100
BIT_DEPTH = 24
CHANNELS = 2
LOUDNESS_TARGET = -14.0
PEAK_CEILING = -1.0
ABSOLUTE_GATE = -70.0
RELATIVE_GATE = -10.0
#: Rows (one per track and step) that one task spreads over blocks.
TASK_STEPS = 200_000


def control_regions(control: DataFrame, unit: str = "day") -> DataFrame:
    """control(track, ts, seq, event) → effective CAPTURE rows (track, started, stopped).

    Repeated controls inside or outside a region are dropped; an open region has stopped = null.
    """
    chunk = F.date_trunc(unit, F.col("ts").cast("timestamp"))
    order = ["ts", "seq"]
    before = scan(control, ["track"], order, chunk, {"_prev": last(F.col("event"), inclusive=False)}, measured=True)
    changes = before.filter(~F.col("event").eqNullSafe(F.col("_prev"))).drop("_prev")
    after = scan(changes, ["track"], order, chunk, {"_next": last(F.col("ts"), inclusive=False)}, reverse=True)
    return after.select("track", F.col("ts").alias("at"), "seq", "event", F.col("_next").alias("until"))


def capture_regions(samples: DataFrame, control: DataFrame, unit: str = "day") -> DataFrame:
    """Samples between a CAPTURE and the next STOP of their track, with the region's start and open mark.

    samples(track, ts, seq, x). A second CAPTURE inside a region is ignored.
    """
    marks = control_regions(control, unit).select(
        "track", F.col("at").alias("ts"), "seq", F.lit(0).alias("_side"), F.struct("event", "at", "until").alias("_mark")
    )
    rows = samples.select("track", "ts", "seq", F.lit(1).alias("_side"), "x").unionByName(marks, allowMissingColumns=True)
    chunk = F.date_trunc(unit, F.col("ts").cast("timestamp"))
    held = scan(rows, ["track"], ["ts", "seq", "_side"], chunk, {"_in": last(F.col("_mark"))}, measured=True)
    inside = held.filter((F.col("_side") == 1) & (F.col("_in.event") == "CAPTURE"))
    return inside.select("track", "ts", "seq", "x", F.col("_in.at").alias("region"), F.col("_in.until").isNull().alias("open"))


def envelope(samples: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    """Waveform overview per bucket: lowest, highest, rms."""
    return (
        samples.groupBy(*keys, F.window("ts", bucket).alias("_w"))
        .agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
        .select(*keys, F.col("_w.start").alias("bucket"), "low", "high", "rms")
    )


def peak_meter(samples: DataFrame, keys: Sequence[str], size: str, slide: str | None = None) -> DataFrame:
    """Sample peak in dBFS per tumbling or sliding window, null at silence; works on streams too."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        samples.groupBy(*keys, window.alias("_w"))
        .agg(F.max(F.abs("x")).alias("_peak"))
        .select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), decibel(F.col("_peak")).alias("peak_db"))
    )


def loudness_blocks(energy: DataFrame, step: str, steps: int = 4) -> DataFrame:
    """energy(track, ts, e) → mean square per complete block of ``steps`` steps, a new block each step.

    A block is complete if it lies between the track's first and last step; a step without samples is silence. Samples are
    reduced to one row per step first; only those rows, dealt by track into tasks of about TASK_STEPS, are spread over the
    blocks. Wholly silent blocks have no row.
    """
    length = F.expr(f"INTERVAL {step}")
    per_step = energy.filter(F.col("track").isNotNull()).groupBy("track", F.window("ts", step).start.alias("_step")).agg(F.avg("e").alias("_e"))
    per_step = dealt_by_rows(per_step, "track", TASK_STEPS)
    track = Window.partitionBy("track")
    spans = per_step.withColumns({"_first": F.min("_step").over(track), "_last": F.max("_step").over(track)})
    starts = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.col("_step") - k * length)
    complete = (F.col("block") >= F.col("_first")) & (F.col("block") + (steps - 1) * length <= F.col("_last"))
    return (
        spans.select("track", F.explode(starts).alias("block"), "_e", "_first", "_last")
        .filter(complete)
        .groupBy("track", "block")
        .agg((F.sum("_e") / steps).alias("ms"))
    )


def integrated_loudness(energy: DataFrame, step: str, steps: int = 4) -> DataFrame:
    """Gated loudness per track. Input is already frequency-weighted energy.

    Blocks below the absolute gate are dropped, then those below the mean of the rest less 10. The blocks stay where their
    track's steps were dealt; a window over a track holds one row per step.
    """
    blocks = loudness_blocks(energy, step, steps).filter(loudness(F.col("ms")) > ABSOLUTE_GATE)
    gated = blocks.withColumn("_gate", loudness(F.avg("ms").over(Window.partitionBy("track"))) + RELATIVE_GATE)
    kept = gated.filter(loudness(F.col("ms")) > F.col("_gate"))
    return kept.groupBy("track").agg(loudness(F.avg("ms")).alias("lufs"), F.count(F.lit(1)).alias("blocks"))


def track_levels(samples: DataFrame, step: str) -> DataFrame:
    """Loudness and sample peak per track."""
    loud = integrated_loudness(samples.select("track", "ts", (F.col("x") * F.col("x")).alias("e")), step)
    peaks = samples.groupBy("track").agg(decibel(F.max(F.abs("x"))).alias("peak_db"))
    return peaks.join(loud, "track", "left").select("track", "lufs", "peak_db")


def track_gain(levels: DataFrame, target: float = LOUDNESS_TARGET, ceiling: float = PEAK_CEILING) -> DataFrame:
    """Gain to the loudness target, capped so that the sample peak stays at or below the ceiling."""
    wanted, room = F.lit(target) - F.col("lufs"), F.lit(ceiling) - F.col("peak_db")
    return levels.withColumns({"gain_db": F.least(wanted, room), "capped": room < wanted})


def normalise_gain(samples: DataFrame, levels: DataFrame, target: float = LOUDNESS_TARGET, ceiling: float = PEAK_CEILING) -> DataFrame:
    """Samples scaled by their track's gain; a track without loudness stays as it is."""
    gains = track_gain(levels, target, ceiling).select("track", "gain_db", "capped")
    scaled = F.col("x") * F.pow(F.lit(10.0), F.coalesce("gain_db", F.lit(0.0)) / 20)
    return samples.join(gains, "track").withColumn("y", scaled)


def output_conformance(files: DataFrame, tolerance: float) -> DataFrame:
    """files(file, rate, depth, channels, lufs, peak_db) → one row per broken delivery rule."""
    return broken_rules(
        files,
        ["file"],
        {
            "sample rate": ~F.col("rate").eqNullSafe(F.lit(SAMPLE_RATE)),
            "bit depth": ~F.col("depth").eqNullSafe(F.lit(BIT_DEPTH)),
            "channels": ~F.col("channels").eqNullSafe(F.lit(CHANNELS)),
            "loudness": F.col("lufs").isNull() | (F.abs(F.col("lufs") - LOUDNESS_TARGET) > tolerance),
            "peak": F.col("peak_db") > PEAK_CEILING,
        },
    )


def mark_duplicates(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``rows`` plus ``duplicate``: the same whole text occurs under a smaller key.

    Only digests are grouped, with map-side combine; the kept keys then join back on the unique
    key, so even a text copied into a third of all rows makes no hot join key. Pass a narrow table
    (key, digest or text, pass conditions): its columns are what the join moves.
    """
    digests = rows.select(key, F.sha2(text, 256).alias("_d"))
    keepers = digests.groupBy("_d").agg(F.min(key).alias(key)).select(key, F.lit(False).alias("_dup"))
    return rows.join(keepers, key, "left").withColumn("duplicate", F.coalesce("_dup", F.lit(True))).drop("_dup")


def pass_chain(rows: DataFrame, passes: Mapping[str, Column], enabled: Collection[str]) -> DataFrame:
    """``rows`` plus ``removed_by``: the first enabled pass, in order, whose condition holds (null = kept)."""
    active = [F.when(cond, F.lit(name)) for name, cond in passes.items() if name in enabled]
    return rows.withColumn("removed_by", F.coalesce(*active, F.lit(None).cast("string")))


def pass_summary(chained: DataFrame, passes: Sequence[str]) -> DataFrame:
    """Per pass in order: rows in, removed, out; all from one aggregate."""
    counts = chained.agg(
        F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col("removed_by") == p).alias(f"_r{i}") for i, p in enumerate(passes)]
    )
    rows, before = [], F.col("_all")
    for i, name in enumerate(passes):
        removed = F.col(f"_r{i}")
        rows.append(
            F.struct(
                F.lit(i + 1).alias("ord"), F.lit(name).alias("name"), before.alias("rows_in"),
                removed.alias("removed"), (before - removed).alias("rows_out"),
            )
        )
        before = before - removed
    return counts.select(F.inline(F.array(*rows)))


def ab_compare(chain_a: DataFrame, chain_b: DataFrame, key: str) -> DataFrame:
    """Rows (key, kept_in) of two chains: both, A only, B only, neither."""
    a = chain_a.select(key, F.col("removed_by").isNull().alias("_a"))
    b = chain_b.select(key, F.col("removed_by").isNull().alias("_b"))
    in_a, in_b = F.coalesce("_a", F.lit(False)), F.coalesce("_b", F.lit(False))
    kept = F.when(in_a & in_b, "both").when(in_a, "A only").when(in_b, "B only").otherwise("neither")
    return a.join(b, key, "full_outer").select(key, kept.alias("kept_in"))


def pass_states(status_log: DataFrame) -> DataFrame:
    """status_log(job, pass, state, ts, seq) → latest state, start and end per job and pass."""
    state, ts = F.col("state"), F.col("ts")
    return status_log.groupBy("job", "pass").agg(
        F.max_by("state", F.struct("ts", "seq")).alias("state"),
        F.min(F.when(state == "Processing", ts)).alias("started"),
        F.max(F.when(state == "Done", ts)).alias("finished"),
    )


def job_progress(states: DataFrame, passes: int) -> DataFrame:
    """Per job: running pass n of N, its state, remaining seconds.

    The estimate is the mean duration of finished passes times the passes left.
    """
    done = F.col("state") == "Done"
    took = F.when(done & (F.col("finished") > F.col("started")), seconds_between(F.col("started"), F.col("finished")))
    begun = F.when(F.col("state") != "Waiting", F.col("pass"))
    per_job = states.groupBy("job").agg(
        F.max(begun).alias("pass"),
        F.max_by("state", begun).alias("state"),
        F.count_if(done).alias("finished"),
        F.avg(took).alias("_mean"),
    )
    left = F.lit(passes) - F.col("finished")
    return per_job.select("job", "pass", F.lit(passes).alias("passes"), "state", "finished", (F.col("_mean") * left).alias("remaining_s"))


def pass_progress(status_log: DataFrame, passes: int) -> DataFrame:
    return job_progress(pass_states(status_log), passes)


def separation_quality(reference: DataFrame, estimate: DataFrame) -> DataFrame:
    """reference(track, i, s), estimate(track, i, e) → signal-to-distortion ratio in dB; null without distortion."""
    pairs = reference.join(estimate, ["track", "i"])
    error = F.col("s") - F.col("e")
    sums = pairs.groupBy("track").agg(F.sum(F.col("s") * F.col("s")).alias("_s"), F.sum(error * error).alias("_d"))
    return sums.select("track", F.when((F.col("_d") > 0) & (F.col("_s") > 0), 10 * F.log10(F.col("_s") / F.col("_d"))).alias("sdr_db"))


def quantise(samples: DataFrame, bits: int = BIT_DEPTH) -> DataFrame:
    """Full-scale real x → signed integer q of the given depth, clipped, with a clip mark."""
    full = 2 ** (bits - 1)
    raw = F.round(F.col("x") * full).cast("bigint")
    return samples.withColumns({"q": F.greatest(F.lit(-full), F.least(F.lit(full - 1), raw)), "clipped": (raw > full - 1) | (raw < -full)})


def quantise_stats(samples: DataFrame, bits: int = BIT_DEPTH) -> DataFrame:
    """Per track: samples, clips, largest and rms error."""
    error = F.col("q") / F.lit(float(2 ** (bits - 1))) - F.col("x")
    return quantise(samples, bits).groupBy("track").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if("clipped").alias("clips"),
        F.max(F.abs(error)).alias("max_error"),
        F.sqrt(F.avg(error * error)).alias("rms_error"),
    )
