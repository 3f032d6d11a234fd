"""Decision records: parsing, supersession, numbering, lint, trade-offs and revisit triggers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.functions.lint import blank, broken_rules
from ashlar.plans.loops import Workspace
from ashlar.plans.scans import last, scan

# Record format and domains.
TITLE_LINE = r"(?m)^# ADR-([0-9]+): (.*)$"
HEADER_FIELDS = {"status": "Status", "date": "Date", "deciders": "Deciders", "tags": "Tags"}
SUPERSEDED_BY = r"^superseded by ADR-([0-9]+)$"
STATUSES = ["proposed", "accepted", "superseded", "deprecated"]
RISK_CLASSES = ["mitigated", "mitigable", "accepted"]
#: The phases a record of each shape must show.
PHASES = {"mini": [2, 4], "full": [1, 2, 3, 4, 5, 6]}


def record_headers(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) → num, title, status, superseded_by, date, deciders, tags."""
    text = F.col("text")
    head = F.split_part(text, F.lit("\n## "), F.lit(1))
    fields = {
        name: F.trim(F.regexp_extract(head, rf"(?m)^- {label}: (.*)$", 1)) for name, label in HEADER_FIELDS.items()
    }
    successor = F.regexp_extract("status", SUPERSEDED_BY, 1)

    def listed(name: str) -> Column:
        return F.filter(F.split(name, r"\s*,\s*"), lambda x: x != "")

    return (
        docs.select(
            "doc_id",
            F.expr(f"try_cast(regexp_extract(text, r'{TITLE_LINE}', 1) AS BIGINT)").alias("num"),
            F.trim(F.regexp_extract(text, TITLE_LINE, 2)).alias("title"),
            *[c.alias(n) for n, c in fields.items()],
        )
        .withColumn("superseded_by", F.when(successor != "", successor.cast("bigint")))
        .withColumns(
            {
                "status": F.when(successor != "", "superseded").otherwise(F.col("status")),
                "date": F.expr("try_cast(date AS DATE)"),
                "deciders": listed("deciders"),
                "tags": listed("tags"),
            }
        )
    )


def record_lines(docs: DataFrame) -> DataFrame:
    """One row per (document, section, non-blank line). Sections come from splitting the text at
    its headings, so no row leaves its partition."""
    sections = docs.select("doc_id", F.posexplode(F.split("text", "\n## ")).alias("section_no", "body"))
    lines = sections.filter(F.col("section_no") > 0).select(
        "doc_id",
        "section_no",
        F.trim(F.split_part("body", F.lit("\n"), F.lit(1))).alias("section"),
        F.posexplode(F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")).alias("line_no", "line"),
    )
    return lines.filter(F.col("line_no") > 0)


def resolve_supersession(records: DataFrame) -> DataFrame:
    """records(num, superseded_by) → num, final, hops, state.

    Pointer jumping: each round every record adopts its pointer's pointer, so a chain of n
    takes log2(n) rounds. state: resolved, dangling (ends at a number with no record) or loop
    (final and hops null).
    """
    successor = F.col("superseded_by")
    nodes = records.select(
        "num",
        F.coalesce(successor, F.col("num")).alias("ptr"),
        F.when(successor.isNotNull(), 1).otherwise(0).cast("bigint").alias("hops"),
        successor.isNull().alias("done"),
    )
    space = Workspace(records.sparkSession)
    state, total = space.state(nodes, "state")
    rounds, open_ = 0, total
    while open_ and 2**rounds <= 2 * total:
        step = state.select(
            F.col("num").alias("_n"), F.col("ptr").alias("_p"), F.col("hops").alias("_h"), F.col("done").alias("_d")
        )
        moved = state.join(step, F.col("ptr") == F.col("_n"), "left")
        # A pointer without a record of its own ends there; a finished pointer finishes this row.
        state, open_ = space.state(
            moved.select(
                "num",
                F.coalesce("_p", "ptr").alias("ptr"),
                F.when(F.col("done"), F.col("hops")).otherwise(F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"),
                (F.col("done") | F.col("_n").isNull() | F.col("_d")).alias("done"),
            ),
            "state",
            ~F.col("done"),
        )
        rounds += 1
    known = records.select(F.col("num").alias("_n"), F.lit(True).alias("_known"))
    return state.join(known, F.col("ptr") == F.col("_n"), "left").select(
        "num",
        F.when(F.col("done"), F.col("ptr")).alias("final"),
        F.when(F.col("done"), F.col("hops")).alias("hops"),
        F.when(~F.col("done"), "loop").when(F.col("_known"), "resolved").otherwise("dangling").alias("state"),
    )


def link_symmetry(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """forward(old, new) must equal backward(old, new); rows present on one side only."""
    f = forward.select("old", "new", F.lit(True).alias("_f"))
    b = backward.select("old", "new", F.lit(True).alias("_b"))
    missing = F.when(F.col("_b").isNull(), "backward").when(F.col("_f").isNull(), "forward")
    return f.join(b, ["old", "new"], "full_outer").select("old", "new", missing.alias("missing")).filter("missing IS NOT NULL")


def number_gaps(records: DataFrame, first: int = 1, width: int = 1_000_000) -> DataFrame:
    """records(series, n) → missing ranges and duplicate numbers: (series, kind, from_n, to_n, copies)."""
    used = records.groupBy("series", "n").agg(F.count(F.lit(1)).alias("copies"))
    previous = {"_prev": last(F.col("n").cast("bigint"), inclusive=False)}
    seen = scan(used, ["series"], ["n"], F.floor(F.col("n") / width), previous)
    n = F.col("n").cast("bigint")
    start = F.coalesce("_prev", F.lit(first - 1).cast("bigint"))
    found = F.array(
        F.when(n - start > 1, F.struct(F.lit("gap").alias("kind"), (start + 1).alias("from_n"), (n - 1).alias("to_n"), F.lit(0).cast("bigint").alias("copies"))),
        F.when(F.col("copies") > 1, F.struct(F.lit("duplicate").alias("kind"), n.alias("from_n"), n.alias("to_n"), F.col("copies").alias("copies"))),
    )
    return seen.select("series", F.explode(F.array_compact(found)).alias("_f")).select("series", "_f.*")


def record_lint(
    records: DataFrame, options: DataFrame, scores: DataFrame, drivers: DataFrame, risks: DataFrame
) -> DataFrame:
    """One row (num, rule) per broken rule.

    records(num, title, status, change_triggers), options(num, option, chosen, reason),
    scores(num, driver), drivers(num, driver), risks(num, class).
    """
    per_option = options.groupBy("num").agg(
        F.count(F.lit(1)).alias("_options"), F.count_if(~F.col("chosen") & blank(F.col("reason"))).alias("_silent")
    )
    named = drivers.select("num", "driver").distinct()
    per_score = scores.join(named, ["num", "driver"], "left_anti").groupBy("num").agg(F.count(F.lit(1)).alias("_loose"))
    bad_class = F.col("class").isNull() | ~F.col("class").isin(RISK_CLASSES)
    per_risk = risks.groupBy("num").agg(F.count_if(bad_class).alias("_risks"))
    joined = records.join(per_option, "num", "left").join(per_score, "num", "left").join(per_risk, "num", "left")
    n_options = F.coalesce("_options", F.lit(0))
    return broken_rules(
        joined,
        ["num"],
        {
            "status outside domain": F.col("status").isNull() | ~F.col("status").isin(STATUSES),
            "no change triggers": blank(F.col("change_triggers")),
            "two decisions in title": F.col("title").rlike(r"(?i)\band\b"),
            "options outside 2-3": (n_options < 2) | (n_options > 3),
            "trade-off row names no driver": F.col("_loose") > 0,
            "rejected option without reason": F.col("_silent") > 0,
            "risk class outside domain": F.col("_risks") > 0,
        },
    )


def record_shape_lint(records: DataFrame, phases: DataFrame, principles: DataFrame, low: int = 3, high: int = 5) -> DataFrame:
    """One row (num, rule) per broken rule of a record's shape.

    records(num, shape, stakes) with the stakes of :func:`gate_by_stakes`, phases(num, phase) that the record has parts of,
    principles(num, ...). A mini record has phases 2 and 4 alone and serves lightweight changes only; null stakes break nothing.
    """
    has = phases.groupBy("num").agg(F.collect_set(F.col("phase").cast("int")).alias("_has"))  # a handful of numbers
    said = principles.groupBy("num").agg(F.count(F.lit(1)).alias("_said"))
    joined = records.join(has, "num", "left").join(said, "num", "left")
    none = F.array().cast("array<int>")
    present, said_n = F.coalesce("_has", none), F.coalesce("_said", F.lit(0))
    mini, full = (F.array(*[F.lit(n) for n in PHASES[shape]]) for shape in ("mini", "full"))
    needed = F.when(F.col("shape") == "mini", mini).when(F.col("shape") == "full", full).otherwise(none)
    return broken_rules(
        joined,
        ["num"],
        {
            "shape outside domain": F.col("shape").isNull() | ~F.col("shape").isin(list(PHASES)),
            "mini record of a full change": (F.col("shape") == "mini") & (F.col("stakes") == "full"),
            "record of a trivial change": F.col("stakes") == "none",
            "phase missing": F.size(F.array_except(needed, present)) > 0,
            "phase beyond a mini record": (F.col("shape") == "mini") & (F.size(F.array_except(present, mini)) > 0),
            "principles outside 3-5": (said_n < low) | (said_n > high),
        },
    )


def tradeoff_matrix(scores: DataFrame, options: Sequence, by: Sequence[str] = ("driver",)) -> DataFrame:
    """scores(driver, option, score) → one row per driver, one column per option, absent cells null."""
    return scores.groupBy(*by).pivot("option", list(options)).agg(F.avg("score"))


def rejected_options(options: DataFrame, chosen: DataFrame, reasons: DataFrame) -> DataFrame:
    """Considered options (record, option) minus the chosen ones, each with its reason (null = missing)."""
    key = ["record", "option"]
    return options.join(chosen.select(*key).distinct(), key, "left_anti").join(reasons, key, "left").select(*key, "reason")


def gate_by_stakes(changes: DataFrame) -> DataFrame:
    """full / lightweight / none by the first group that holds any set flag."""
    full = ["new_system", "new_service", "new_dependency", "data_model_change", "hard_to_reverse"]
    light = ["library_choice", "internal_structure", "reversible"]

    def any_of(flags: Sequence[str]) -> Column:
        return F.greatest(*[F.coalesce(F.col(f), F.lit(False)) for f in flags])

    return changes.withColumn(
        "stakes", F.when(any_of(full), "full").when(any_of(light), "lightweight").otherwise("none")
    )


def trigger_bounds(triggers: DataFrame, baseline: DataFrame) -> DataFrame:
    """triggers(record, metric, op, threshold, factor, sustain), baseline(metric, base) → triggers with a level to compare with.

    A trigger without a threshold is a ratio: factor × the metric's base, its value when the decision was taken. Without
    either, or without a base, it stays null and never fires. One base for each metric.
    """
    level = F.coalesce(F.col("threshold").cast("double"), F.col("factor") * F.col("base"))
    return triggers.join(baseline.select("metric", "base"), "metric", "left").withColumn("threshold", level).drop("base")


def fires(triggers: DataFrame) -> Column:
    """Whether ``value`` meets a trigger: op is >, >=, < or <=; without that column, >. Other operators never fire."""
    value, level = F.col("value"), F.col("threshold")
    if "op" not in triggers.columns:
        return value > level
    op = F.coalesce("op", F.lit(">"))
    return F.when(op == ">", value > level).when(op == ">=", value >= level).when(op == "<", value < level).when(op == "<=", value <= level)


def trigger_monitor(buckets: DataFrame, triggers: DataFrame, seconds: int) -> DataFrame:
    """buckets(metric, bucket, value), triggers(metric, threshold, sustain, and more) → runs of consecutive
    buckets that meet a trigger and last at least ``sustain`` buckets, for each trigger (all its columns) by itself.

    Works on one row per (trigger, bucket), so a window over a trigger is bounded by time, not by rows. ``peak`` is the
    greatest value, or the least one where the trigger waits for small values.
    """
    above = buckets.join(triggers, "metric").filter(fires(triggers))
    index = F.floor(F.unix_seconds(F.col("bucket").cast("timestamp")) / seconds)
    trigger = ["metric", *[c for c in triggers.columns if c != "metric"]]
    falling = F.col("op").isin("<", "<=") if "op" in trigger else F.lit(False)
    w = Window.partitionBy(*trigger).orderBy("bucket")
    runs = above.withColumn("_run", index - F.row_number().over(w)).groupBy(*trigger, "_run")
    return (
        runs.agg(
            F.min("bucket").alias("first_bucket"),
            F.max("bucket").alias("last_bucket"),
            F.count(F.lit(1)).alias("buckets"),
            F.when(F.any_value(falling), F.min("value")).otherwise(F.max("value")).alias("peak"),
        )
        .filter(F.col("buckets") >= F.col("sustain"))
        .drop("_run")
    )


def growth_trigger(series: DataFrame, factor: float, base: str = "first") -> DataFrame:
    """series(key, period, value) → periods whose value exceeds factor × the first or the previous one."""
    w = Window.partitionBy("key").orderBy("period")
    value = F.first_value("value").over(w) if base == "first" else F.lag("value").over(w)
    return series.withColumn("base", value).filter(F.col("value") > F.lit(factor) * F.col("base"))


def verbatim_carry(records: DataFrame, principles: DataFrame, batch: int = 1000) -> DataFrame:
    """Principles that do not reappear verbatim in their record's context.

    records(decision, context), principles(decision, ord, text). Principles travel in batches, so
    a long context is repeated per batch and not per principle, and no group is gathered whole.
    """
    batches = principles.groupBy("decision", F.floor(F.col("ord") / batch).alias("_batch")).agg(
        F.collect_list(F.struct("ord", "text")).alias("_p")
    )
    joined = batches.join(records, "decision", "left")
    absent = F.filter("_p", lambda p: ~F.coalesce(F.contains(F.col("context"), p["text"]), F.lit(False)))
    return joined.select("decision", F.explode(absent).alias("_m")).select("decision", "_m.ord", "_m.text")


def principle_count(principles: DataFrame, low: int = 3, high: int = 5) -> DataFrame:
    """Decisions whose number of principles is outside low..high."""
    n = principles.groupBy("decision").agg(F.count(F.lit(1)).alias("principles"))
    return n.filter(~F.col("principles").between(low, high))


def analogue_lint(analogues: DataFrame) -> DataFrame:
    """analogues(decision, system, similarity, transfers, not_transfers): rows with a missing part,
    and decisions with fewer than two or more than three systems (system null)."""
    per_row = broken_rules(
        analogues,
        ["decision", "system"],
        {f"no {part}": blank(F.col(part)) for part in ["similarity", "transfers", "not_transfers"]},
    )
    n = analogues.groupBy("decision").agg(F.count(F.lit(1)).alias("_n")).filter(~F.col("_n").between(2, 3))
    system = analogues.schema["system"].dataType
    return per_row.unionByName(
        n.select("decision", F.lit(None).cast(system).alias("system"), F.lit("systems outside 2-3").alias("rule"))
    )
