"""Candidate comparison and quality attributes measured on logs and tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.functions.levels import micros, seconds_between
from ashlar.functions.lint import blank
from ashlar.functions.text import (
    DATA_CLASS_HINTS,
    DATA_CLASS_PATTERNS,
    SECRET_HINTS,
    SECRET_PATTERN,
    count_matches,
    may_match,
)
from ashlar.plans.quantiles import exact_percentiles
from ashlar.plans.loops import Workspace
from ashlar.plans.scans import Chunked, Whole, in_two, last, scan

# Data classes, lowest rank first, and the patterns that vote for each.
DATA_CLASSES = {
    "pii": ["mail", "phone", "national_id"],
    "payment": ["card", "payment_term"],
    "health": ["health_term"],
}


# -- candidates --------------------------------------------------------------------------------


def stable_core(elements: DataFrame) -> DataFrame:
    """elements(decision, candidate, element): adopt what all candidates share, decide on the rest."""
    distinct = elements.select("decision", "candidate", "element").distinct()
    total = elements.groupBy("decision").agg(F.count_distinct("candidate").alias("_total"))
    held = distinct.groupBy("decision", "element").agg(
        F.count(F.lit(1)).alias("held_by"), F.array_sort(F.collect_list("candidate")).alias("candidates")
    )
    verdict = F.when(F.col("held_by") == F.col("_total"), "adopt").otherwise("decide")
    return held.join(total, "decision").withColumn("verdict", verdict).drop("_total")


def independence_check(candidates: DataFrame) -> DataFrame:
    """candidates(decision, candidate, principle) that share their principle within a decision."""
    shared = (
        candidates.groupBy("decision", "principle")
        .agg(F.count_distinct("candidate").alias("sharers"))
        .filter(F.col("sharers") > 1)
    )
    return candidates.join(shared, ["decision", "principle"]).select("decision", "candidate", "principle", "sharers")


def attribute_coverage(candidates: DataFrame, attributes: Sequence[str], recorded: DataFrame) -> DataFrame:
    """Candidate × attribute pairs with neither a target nor "not a driver".

    recorded(candidate, attribute, target, not_a_driver). The checklist is a literal array, so the
    full product is never built: each candidate expands only what it lacks.
    """
    said = F.col("target").isNotNull() | F.coalesce("not_a_driver", F.lit(False))
    answered = (
        recorded.filter(said & F.col("attribute").isin(list(attributes)))
        .groupBy("candidate")
        .agg(F.collect_set("attribute").alias("_said"))
    )
    checklist = F.array(*[F.lit(a) for a in attributes])
    none = F.array().cast("array<string>")
    return candidates.join(answered, "candidate", "left").select(
        "candidate", F.explode(F.array_except(checklist, F.coalesce("_said", none))).alias("attribute")
    )


def verdict_matrix(measured: DataFrame, targets: DataFrame) -> DataFrame:
    """measured(candidate, attribute, value) against targets(attribute, op, target, margin).

    meets inside the target, risks beyond it by at most the share ``margin``, fails further out.
    """
    miss = F.when(F.col("op") == "<=", F.col("value") - F.col("target")).otherwise(F.col("target") - F.col("value"))
    verdict = (
        F.when(miss <= 0, "meets").when(miss <= F.abs("target") * F.col("margin"), "risks").otherwise("fails")
    )
    return measured.join(targets, "attribute").select("candidate", "attribute", "value", verdict.alias("verdict"))


def justified(verdicts: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows of :func:`verdict_matrix` with a one-line justification: the value, the target, by how much it is missed.

    Numbers have two decimals; a missing value (its verdict is fails) is said to be one. targets may name in ``source`` the ledger entry they come from; it stands in brackets.
    """

    def number(col: Column) -> Column:
        return col.cast("decimal(28,2)").cast("string")

    value, target = F.col("value"), F.col("target")
    source = F.col("source") if "source" in targets.columns else F.lit(None).cast("string")
    share = F.concat(F.round(F.col("margin") * 100).cast("bigint").cast("string"), F.lit(" %"))
    bound = F.concat("op", F.lit(" "), number(target))
    missed = F.concat(F.lit(" misses "), bound, F.lit(" by "), number(F.abs(value - target)))
    said = (
        F.when(F.col("verdict") == "meets", F.concat(F.lit(" meets "), bound))
        .when(F.col("verdict") == "risks", F.concat(missed, F.lit(", within "), share))
        .otherwise(F.concat(missed, F.lit(", beyond "), share))
    )
    cited = F.when(~blank(source), F.concat(F.lit(" ("), source, F.lit(")"))).otherwise("")
    told = F.coalesce(F.concat(F.lit(" "), number(value), said), F.lit(" is not measured"))
    line = F.concat("attribute", told, cited).alias("justification")
    return verdicts.join(targets, "attribute").select("candidate", "attribute", "value", "verdict", line)


def verdict_grid(verdicts: DataFrame, attributes: Sequence[str]) -> DataFrame:
    return verdicts.groupBy("candidate").pivot("attribute", list(attributes)).agg(F.min("verdict"))


def prune_candidates(verdicts: DataFrame, drivers: Sequence[str], reason: str = "attribute") -> DataFrame:
    """Per candidate: kept, and the hard drivers it fails (at most one reason per driver).

    ``reason`` is the column told as the reason: the driver's name, or the ``justification`` of :func:`justified`.
    """
    told = F.when(F.col("attribute").isin(list(drivers)) & (F.col("verdict") == "fails"), F.coalesce(F.col(reason), F.col("attribute")))
    out = verdicts.groupBy("candidate").agg(F.array_sort(F.collect_set(told)).alias("reasons"))
    return out.withColumn("kept", F.size("reasons") == 0)


# -- load and latency --------------------------------------------------------------------------


def bucket_counts(events: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    """events(keys…, ts) → (keys…, bucket, value): rows per tumbling bucket."""
    return (
        events.groupBy(*keys, F.window("ts", bucket).alias("_w"))
        .agg(F.count(F.lit(1)).alias("value"))
        .select(*keys, F.col("_w.start").alias("bucket"), "value")
    )


def request_rates(events: DataFrame, bucket: str, seconds: int) -> DataFrame:
    """events(key, ts) → peak, sustained (mean), p50, p95 per bucket and the peak at ten times the load.

    Buckets without events between the first and the last bucket of the table count as zero; they
    enter as one weighted row per key instead of being generated.
    """
    counts = bucket_counts(events, ["key"], bucket)
    index = F.floor(F.unix_seconds(F.col("bucket").cast("timestamp")) / seconds)
    span = counts.select((F.max(index) - F.min(index) + 1).alias("_span")).scalar()
    totals = counts.groupBy("key").agg(
        F.max("value").alias("peak"), F.sum("value").alias("requests"), F.count(F.lit(1)).alias("_used")
    )
    empty = totals.select("key", F.lit(0).cast("bigint").alias("value"), (span - F.col("_used")).alias("_times"))
    weighted = counts.select("key", "value", F.lit(1).cast("bigint").alias("_times")).unionByName(empty)
    spread = exact_percentiles(weighted, ["key"], "value", {"p50": 0.5, "p95": 0.95}, weight=F.col("_times"))
    return totals.join(spread, "key").select(
        "key",
        "requests",
        "peak",
        (F.col("requests") / F.col("n")).alias("sustained"),
        "p50",
        "p95",
        (F.col("peak") * 10).alias("peak_10x"),
    )


def path_latency(hops: DataFrame) -> DataFrame:
    """hops(path, request, latency) → p50 and p99 per path over whole requests, never per hop."""
    requests = hops.groupBy("path", "request").agg(F.sum("latency").alias("latency"))
    return exact_percentiles(requests, ["path"], "latency", {"p50": 0.5, "p99": 0.99})


def workload_split(hops: DataFrame, dims: Sequence[str]) -> DataFrame:
    """The same percentiles per ``dims`` with subtotals and the grand total; ``level`` counts rolled-up dims."""
    requests = hops.groupBy(*dims, "request").agg(F.sum("latency").alias("latency"))
    types = {f.name: f.dataType for f in requests.schema.fields}
    sets = [
        F.struct(
            F.lit(len(dims) - kept).alias("level"),
            *[(F.col(d) if i < kept else F.lit(None).cast(types[d])).alias(d) for i, d in enumerate(dims)],
        )
        for kept in range(len(dims), -1, -1)
    ]
    rolled = requests.select(F.explode(F.array(*sets)).alias("_g"), "latency").select("_g.*", "latency")
    return exact_percentiles(rolled, ["level", *dims], "latency", {"p50": 0.5, "p99": 0.99})


def workload_split_approx(hops: DataFrame, dims: Sequence[str], accuracy: int = 10000) -> DataFrame:
    """Scale variant of :func:`workload_split`: mergeable sketches under Spark's own rollup."""
    requests = hops.groupBy(*dims, "request").agg(F.sum("latency").alias("latency"))
    return requests.rollup(*dims).agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("latency", 0.5, accuracy).alias("p50"),
        F.percentile_approx("latency", 0.99, accuracy).alias("p99"),
    )


def volume_growth(rows: DataFrame, unit: str, retention: str) -> DataFrame:
    """rows(key, ts) → per key and period: rows, growth, running total and rows past retention."""
    cutoff = rows.select((F.max("ts") - F.expr(f"INTERVAL {retention}")).alias("_cut")).scalar()
    period = F.date_trunc(unit, F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    volume = rows.groupBy("key", period.alias("period")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("ts") < cutoff).alias("past_retention")
    )
    w = Window.partitionBy("key").orderBy("period")
    return volume.withColumns(
        {
            "growth": F.col("rows") - F.lag("rows").over(w),
            "total": F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )


def read_write_profile(events: DataFrame, reads: Sequence[str], writes: Sequence[str], factor: float = 10.0) -> DataFrame:
    """events(key, kind) → reads, writes, ratio and the flag for separate read and write models."""
    kind = F.col("kind")
    counts = events.groupBy("key").agg(
        F.count_if(kind.isin(list(reads))).alias("reads"), F.count_if(kind.isin(list(writes))).alias("writes")
    )
    ratio = F.when(F.col("writes") > 0, F.col("reads") / F.col("writes"))
    apart = (F.col("reads") >= factor * F.col("writes")) | (F.col("writes") >= factor * F.col("reads"))
    return counts.withColumns({"ratio": ratio, "split": apart & (F.col("reads") + F.col("writes") > 0)})


def hot_spots(events: DataFrame, k: int) -> DataFrame:
    """events(grp, key): top ``k`` keys of each group with their share of the group; ties by key.

    The rank filter lets Spark cut each map task to k rows per group before the shuffle.
    """
    counts = events.groupBy("grp", "key").agg(F.count(F.lit(1)).alias("hits"))
    totals = events.groupBy("grp").agg(F.count(F.lit(1)).alias("_all"))
    w = Window.partitionBy("grp").orderBy(F.col("hits").desc(), F.col("key").asc())
    top = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.join(totals, "grp").select("grp", "key", "rank", "hits", (F.col("hits") / F.col("_all")).alias("share"))


def heavy_keys_approx(events: DataFrame, k: int = 20, max_items: int = 100_000) -> DataFrame:
    """Scale variant of :func:`hot_spots`: distinct and frequent keys per group from sketches of fixed size."""
    out = events.groupBy("grp").agg(
        F.approx_count_distinct("key", 0.01).alias("distinct_keys"),
        F.expr(f"approx_top_k(key, {k}, {max_items})").alias("_top"),
    )
    return out.select("grp", "distinct_keys", F.explode_outer("_top").alias("_t")).select(
        "grp", "distinct_keys", F.col("_t.item").alias("key"), F.col("_t.count").alias("hits")
    )


def heavy_keys(events: DataFrame, k: int, buckets: int = 1 << 14) -> DataFrame:
    """events(grp, key): every key that makes more than one in ``k`` of its group's rows, with exact hits and share.

    The first pass adds rows up by hash bucket of the key, a sketch that merges on the map side and holds ``buckets``
    counts per group whatever the number of keys. A key cannot be heavier than its bucket, so only fewer than ``k`` buckets
    of a group can hold a heavy one. The second pass counts the keys of those buckets exactly. Null is a key, and a group.
    """
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets))
    sketch = events.groupBy("grp", bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    sketch = Workspace(events.sparkSession).keep(sketch)
    totals = sketch.groupBy(F.col("grp").alias("_of")).agg(F.sum("_n").alias("_all"))
    mine = F.col("grp").eqNullSafe(F.col("_of"))
    heavy = sketch.join(totals, mine).filter(F.col("_n") * k > F.col("_all")).select("_of", "_bucket", "_all")
    named = events.withColumn("_at", bucket).join(heavy, mine & (F.col("_at") == F.col("_bucket")))
    hits = named.groupBy("grp", "key").agg(F.count(F.lit(1)).alias("hits"), F.max("_all").alias("_all"))
    return hits.filter(F.col("hits") * k > F.col("_all")).select("grp", "key", "hits", (F.col("hits") / F.col("_all")).alias("share"))


def spikes(buckets: DataFrame, seconds: int, n: int, ratio: float) -> DataFrame:
    """buckets(key, bucket, value) far above the mean of the n earlier buckets (absent ones are zero).

    One row per (key, bucket) meets in the window, so its size is bounded by time.
    """
    index = F.floor(F.unix_seconds(F.col("bucket").cast("timestamp")) / seconds)
    w = Window.partitionBy("key").orderBy("_i").rangeBetween(-n, -1)
    trail = buckets.withColumn("_i", index).withColumn("trailing_mean", F.coalesce(F.sum("value").over(w), F.lit(0)) / n)
    return trail.filter(F.col("value") > ratio * F.col("trailing_mean")).drop("_i")


def peak_to_mean(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("key").agg(
        F.max("value").alias("peak"), (F.max("value") * F.count(F.lit(1)) / F.sum("value")).alias("peak_to_mean")
    )


# -- reliability -------------------------------------------------------------------------------


def availability(events: DataFrame, unit: str, target: float) -> DataFrame:
    """events(component, ts, failed) → success ratio per period, nines (null without failure), met."""
    period = F.date_trunc(unit, F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    counts = events.groupBy("component", period.alias("period")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("failed").alias("failures")
    )
    down = F.col("failures") / F.col("calls")
    return counts.withColumns(
        {
            "ratio": 1 - down,
            "nines": F.when(F.col("failures") > 0, -F.log10(down)),
            "met": 1 - down >= target,
        }
    )


def outages(events: DataFrame, unit: str = "day") -> DataFrame:
    """events(store, ts, seq, good, failed) → (store, started, recovered, last_good): one row per good point
    to come. started is the first failure before it (null if none), last_good the good point before it."""
    marks = events.filter(F.col("good") | F.col("failed"))
    chunk = F.date_trunc(unit, F.col("ts").cast("timestamp"))
    following = scan(
        marks,
        ["store"],
        ["ts", "seq"],
        chunk,
        {"recovered": last(F.when(F.col("good"), F.col("ts")), inclusive=False)},
        reverse=True,
        measured=True,
    )
    return following.groupBy("store", "recovered").agg(
        F.min(F.when(F.col("failed"), F.col("ts"))).alias("started"),
        F.max(F.when(F.col("good"), F.col("ts"))).alias("last_good"),
    )


def recovery_times(events: DataFrame, rto: float, rpo: float, unit: str = "day") -> DataFrame:
    """Per store: outages, still open ones, longest recovery and longest gap between good points (seconds)."""
    spans = outages(events, unit)
    down = F.col("started").isNotNull()
    return (
        spans.groupBy("store")
        .agg(
            F.count_if(down).alias("outages"),
            F.count_if(down & F.col("recovered").isNull()).alias("open"),
            F.max(F.when(down, seconds_between(F.col("started"), F.col("recovered")))).alias("rto_s"),
            F.max(seconds_between(F.col("last_good"), F.col("recovered"))).alias("rpo_s"),
        )
        .withColumns({"rto_met": F.col("rto_s") <= rto, "rpo_met": F.col("rpo_s") <= rpo})
    )


def degraded_share(events: DataFrame, unit: str = "day") -> DataFrame:
    """events(store, ts, seq, type, good, failed): traffic per type inside and outside outages.

    An outage runs from a failure to the next good point, so the latest mark of an event's store
    says which side it is on; no interval join is needed.
    """
    chunk = F.date_trunc(unit, F.col("ts").cast("timestamp"))
    mark = F.when(F.col("failed"), True).when(F.col("good"), False)
    known = scan(events, ["store"], ["ts", "seq"], chunk, {"_down": last(mark)}, measured=True)
    down = F.coalesce("_down", F.lit(False))
    return (
        known.groupBy("type")
        .agg(F.count_if(down).alias("inside"), F.count_if(~down).alias("outside"))
        .withColumn("share", F.col("inside") / (F.col("inside") + F.col("outside")))
    )


def duplicate_writes(rows: DataFrame, key: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Repeated keys: replay when all payloads are equal, conflict otherwise."""

    def run(part: DataFrame, by: Whole | Chunked) -> DataFrame:
        # Whole payloads first: equal copies of a large key combine on the map side, so one key copied a billion times is cheap.
        # Small keys lie in tasks of their own, since hardly any of them combines there.
        variants = part.groupBy(*key, *payload).agg(F.count(F.lit(1)).alias("_n"))
        return variants.groupBy(*key).agg(F.sum("_n").alias("copies"), F.count(F.lit(1)).alias("payloads"))

    found = in_two(rows.select(*dict.fromkeys([*key, *payload])), key, run)
    kind = F.when(F.col("payloads") > 1, "conflict").otherwise("replay")
    return found.filter(F.col("copies") > 1).withColumn("kind", kind)


def idempotent_consume(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first delivery per key by ``order`` (a total order)."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*key, "_row.*")


def retry_outcomes(attempts: DataFrame) -> DataFrame:
    """attempts(key, ts, seq, outcome, retryable): outcome is ok or error."""
    failed = F.col("outcome") == "error"
    at = F.struct("ts", "seq")
    return attempts.groupBy("key").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.max_by("outcome", at).alias("final"),
        F.count_if(failed & F.col("retryable")).alias("retryable_errors"),
        F.count_if(failed & ~F.col("retryable")).alias("terminal_errors"),
        (F.min_by("outcome", at) == "ok").alias("first_try"),
    )


# -- data --------------------------------------------------------------------------------------


def truth_owners(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """entities(entity), claims(entity, role, staleness_bound): role truth or derived.

    Rows: no truth / several truths / copy without bound, with the number of claims concerned.
    """
    per = claims.groupBy("entity").agg(
        F.count_if(F.col("role") == "truth").alias("_truths"),
        F.count_if((F.col("role") == "derived") & F.col("staleness_bound").isNull()).alias("_loose"),
    )
    truths, loose = F.coalesce("_truths", F.lit(0)), F.coalesce("_loose", F.lit(0))

    def problem(name: str, n: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("problem"), n.cast("bigint").alias("claims")))

    found = F.array(
        problem("no truth", truths, truths == 0),
        problem("several truths", truths, truths > 1),
        problem("copy without bound", loose, loose > 0),
    )
    return entities.join(per, "entity", "left").select("entity", F.explode(F.array_compact(found)).alias("_p")).select("entity", "_p.*")


def staleness_audit(reads: DataFrame, refreshes: DataFrame, writes: DataFrame, bound_s: float, unit: str = "day") -> DataFrame:
    """reads(key, ts, id), refreshes(key, ts), writes(key, ts): age of the copy each read saw.

    stale when never refreshed, written since the refresh, or older than the bound. One pass
    carries both the last refresh and the last write.
    """
    rows = (
        writes.select("key", "ts", F.lit(0).alias("_side"), F.lit(None).cast("bigint").alias("id"))
        .unionByName(refreshes.select("key", "ts", F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("id")))
        .unionByName(reads.select("key", "ts", F.lit(2).alias("_side"), F.col("id").cast("bigint").alias("id")))
    )
    ts, side = F.col("ts"), F.col("_side")
    seen = scan(
        rows,
        ["key"],
        ["ts", "_side", "id"],
        F.date_trunc(unit, ts.cast("timestamp")),
        {"refreshed": last(F.when(side == 1, ts)), "written": last(F.when(side == 0, ts))},
        measured=True,
    )
    age = seconds_between(F.col("refreshed"), ts)
    newer = F.coalesce(F.col("written") > F.col("refreshed"), F.lit(False))
    stale = F.col("refreshed").isNull() | newer | (age > bound_s)
    return seen.filter(side == 2).select("key", "id", "ts", age.alias("age_s"), stale.alias("stale"))


def classify_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Hits per data class over the whole text; the highest class with a hit wins."""

    def hits(pattern: str) -> Column:
        return count_matches(F.col(text), DATA_CLASS_PATTERNS[pattern], DATA_CLASS_HINTS.get(pattern, ()))

    counts = {name: reduce(Column.__add__, map(hits, votes)) for name, votes in DATA_CLASSES.items()}
    winner = F.coalesce(*[F.when(F.col(name) > 0, F.lit(name)) for name in reversed(DATA_CLASSES)], F.lit("none"))
    return docs.withColumns(counts).withColumn("class", winner)


def placement_check(classified: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows of classified(…, class, store) whose (class, store) is not in allowed(class, store)."""
    return classified.filter(F.col("class") != "none").join(allowed, ["class", "store"], "left_anti")


def secret_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with credential-shaped strings: hits, digest of each in order, redacted text."""
    found = F.regexp_extract_all(text, F.lit(SECRET_PATTERN), F.lit(0))
    return (
        docs.filter(may_match(F.col(text), SECRET_HINTS))
        .withColumn("_found", found)
        .filter(F.size("_found") > 0)
        .withColumns(
            {
                "hits": F.size("_found").cast("bigint"),
                "digests": F.transform("_found", lambda secret: F.sha2(secret, 256)),
                text: F.regexp_replace(text, SECRET_PATTERN, "[REDACTED]"),
            }
        )
        .drop("_found")
    )


def audit_gaps(writes: DataFrame, audit: DataFrame) -> DataFrame:
    """writes(key) without an audit row and audit(key) rows without a write; duplicates combine before the shuffle."""
    both = writes.select("key", F.lit(True).alias("_w")).unionByName(audit.select("key", F.lit(False).alias("_w")))
    sides = both.groupBy("key").agg(F.bool_or("_w").alias("_any_w"), F.bool_and("_w").alias("_all_w"))
    gap = F.when(F.col("_all_w"), "no audit").when(~F.col("_any_w"), "no write")
    return sides.select("key", gap.alias("gap")).filter("gap IS NOT NULL")


# -- cost and teams ----------------------------------------------------------------------------


def cost_cliffs(levels: DataFrame, factor: float) -> DataFrame:
    """levels(system, level, load, build, run): cost growth over load growth between successive levels."""
    w = Window.partitionBy("system").orderBy("level")
    total = levels.withColumn("cost", F.col("build") + F.col("run"))
    growth = (F.col("cost") / F.lag("cost").over(w)) / (F.col("load") / F.lag("load").over(w))
    return total.withColumn("growth", growth).withColumn("cliff", F.coalesce(F.col("growth") >= factor, F.lit(False)))


def shared_components(owns: DataFrame) -> DataFrame:
    """owns(component, team): components of several teams; component and team boundaries differ there."""
    return owns.groupBy("component").agg(F.count_distinct("team").alias("teams")).filter(F.col("teams") > 1)


def main_team(owns: DataFrame) -> DataFrame:
    """The team with most rows per component, ties by team."""
    counts = owns.groupBy("component", "team").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy("component").agg(F.min_by("team", F.struct(-F.col("_n"), F.col("team"))).alias("team"))


def crossing_edges(edges: DataFrame, teams: DataFrame) -> DataFrame:
    """edges(src, dst) whose ends belong to different teams of teams(component, team)."""
    src = teams.select(F.col("component").alias("src"), F.col("team").alias("src_team"))
    dst = teams.select(F.col("component").alias("dst"), F.col("team").alias("dst_team"))
    return edges.join(src, "src").join(dst, "dst").filter(F.col("src_team") != F.col("dst_team"))


def skill_gaps(required: DataFrame, present: DataFrame) -> DataFrame:
    """required(team, skill) minus present(team, skill)."""
    there = present.select("team", "skill").distinct()
    return required.select("team", "skill").distinct().join(there, ["team", "skill"], "left_anti")
