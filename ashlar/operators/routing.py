"""Task routing, handoffs and working sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.functions.levels import micros, trunc
from ashlar.functions.lint import blank, broken_rules, names_where
from ashlar.plans.scans import Chunked, Whole, in_two, last, running_max, running_sum

# The ordered rules (feature, target); no match means ask.
RULES = [
    ("autonomous_edits", "autonomous coder"),
    ("approve_each_diff", "supervised editor"),
    ("debugger_central", "terminal debugger"),
    ("plans_or_schedules", "orchestrator"),
]
ASK = "ask"
PROMPT_FIELDS = ["goal", "context", "constraints", "do_not", "validation", "return_format"]


def _set(feature: str) -> Column:
    return F.coalesce(F.col(feature), F.lit(False))


def route_first_match(tasks: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """tasks(task, one boolean per feature) → target and number of the first rule that holds."""
    target, number = F.lit(ASK), F.lit(len(rules) + 1)
    for i, (feature, name) in reversed(list(enumerate(rules, 1))):
        target = F.when(_set(feature), name).otherwise(target)
        number = F.when(_set(feature), i).otherwise(number)
    return tasks.withColumns({"target": target, "rule": number})


def route_by_table(tasks: DataFrame, features: Sequence[str], rules: DataFrame) -> DataFrame:
    """The same with rules(priority, feature, target) as data: task, target, rule (null with ask)."""
    held = names_where({f: _set(f) for f in features})
    hits = tasks.select("task", F.explode_outer(held).alias("feature")).join(rules, "feature", "left")
    # min skips null structs, so features without a rule take no part.
    rule = F.when(F.col("priority").isNotNull(), F.struct("priority", "target"))
    best = hits.groupBy("task").agg(F.min(rule).alias("_b"))
    return best.select("task", F.coalesce("_b.target", F.lit(ASK)).alias("target"), F.col("_b.priority").alias("rule"))


def route_ambiguity(tasks: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Tasks that match several rules or none, with the matched targets."""
    matched = names_where({target: _set(feature) for feature, target in rules})
    return tasks.select("task", matched.alias("matched")).filter(F.size("matched") != 1)


def reroute(tasks: DataFrame, observations: DataFrame, shapes: dict[str, str]) -> DataFrame:
    """tasks(task, target), observations(task, ts, seq, shape): tasks whose latest shape routes elsewhere."""
    latest = observations.groupBy("task").agg(F.max_by("shape", F.struct("ts", "seq")).alias("shape"))
    target = F.lit(ASK)
    for shape, name in shapes.items():
        target = F.when(F.col("shape") == shape, name).otherwise(target)
    moved = tasks.join(latest, "task").withColumn("new_target", target)
    return moved.filter(F.col("new_target") != F.col("target"))


def misroute_audit(assigned: DataFrame) -> DataFrame:
    """assigned(task, assigned, recommended) → confusion counts with margins (null = all) and misroutes."""
    wrong = (F.col("assigned") != F.col("recommended")).cast("int")
    return (
        assigned.withColumn("_wrong", wrong)
        .cube("assigned", "recommended")
        .agg(F.count(F.lit(1)).alias("tasks"), F.sum("_wrong").alias("misroutes"), F.grouping_id().alias("margin"))
        .withColumn("misroute_share", F.col("misroutes") / F.col("tasks"))
    )


def misroute_matrix(assigned: DataFrame, targets: Sequence[str]) -> DataFrame:
    return assigned.groupBy("assigned").pivot("recommended", list(targets)).count().na.fill(0)


def routing_smells(tasks: DataFrame) -> DataFrame:
    """tasks(task, assigned, unattended, code_edits, repetitive, by_name, shared_worktree) → (task, rule)."""
    to = F.col("assigned")
    return broken_rules(
        tasks,
        ["task"],
        {
            "supervised editor unattended": (to == "supervised editor") & _set("unattended"),
            "orchestrator as editor": (to == "orchestrator") & _set("code_edits"),
            "autonomous coder for batches": (to == "autonomous coder") & _set("repetitive"),
            "routed by name": _set("by_name"),
            "shared worktree": _set("shared_worktree"),
        },
    )


def handoff_lint(handoffs: DataFrame) -> DataFrame:
    """handoffs(handoff, dirty, branch, done, left, risks, has_tests, tests_run, prompt fields…) → (handoff, rule)."""
    rules = {
        "dirty tree": _set("dirty"),
        "no branch": blank(F.col("branch")),
        "summary lacks goal": blank(F.col("goal")),
        "summary lacks done": blank(F.col("done")),
        "summary lacks left": blank(F.col("left")),
        "summary lacks risks": blank(F.col("risks")),
        "tests not run": _set("has_tests") & ~_set("tests_run"),
    }
    rules |= {f"prompt lacks {f}": blank(F.col(f)) for f in PROMPT_FIELDS}
    return broken_rules(handoffs, ["handoff"], rules)


# -- sessions ----------------------------------------------------------------------------------


def _held(sessions: DataFrame) -> DataFrame:
    return sessions.select("worktree", "agent", "start", "end").filter(F.col("start") < F.col("end"))


def _merged(sessions: DataFrame) -> DataFrame:
    """Equal sessions as one row with their number."""
    return sessions.groupBy("worktree", "agent", "start", "end").agg(F.count(F.lit(1)).alias("n"))


def _marks(sessions: DataFrame) -> DataFrame:
    """One row per session end (side 0) and start (side 1). Ends sort first, so touching sessions do not overlap."""
    ends = F.array(
        F.struct(F.col("end").alias("at"), F.lit(0).alias("side")),
        F.struct(F.col("start").alias("at"), F.lit(1).alias("side")),
    )
    return sessions.select("*", F.inline(ends))


_KEYS, _ORDER = ["worktree"], ["at", "side"]  # a sum of one side does not depend on the order within the other


def _started() -> Column:
    return F.when(F.col("side") == 1, F.col("n")).otherwise(0)


def _ended() -> Column:
    return F.when(F.col("side") == 0, F.col("n")).otherwise(0)


def _overlaps() -> Column:
    """Starts before my end minus ends up to my start, over the worktree less over my own sessions."""
    at_end = F.max(F.when(F.col("side") == 0, F.col("_s") - F.col("_os")))
    return at_end - F.max(F.when(F.col("side") == 1, F.col("_e") - F.col("_oe")))


def worktree_overlaps(sessions: DataFrame, unit: str = "month") -> DataFrame:
    """sessions(agent, worktree, start, end) in which another agent holds the same worktree.

    overlaps = number of overlapping sessions of other agents, counted exactly but never listed:
    starts before my end minus ends up to my start, over the worktree less over my own sessions.
    Each overlapping pair counts once at either session, so sum(n · overlaps) / 2 is the number of
    pairs. Cost and output grow with the sessions, not with the pairs.
    """

    def run(rows: DataFrame, by: Whole | Chunked) -> DataFrame:
        marks = by.cut(_marks(_merged(rows)), _KEYS, _ORDER, F.date_trunc(unit, F.col("at").cast("timestamp")))
        own = by.keep(by.scan(marks, ["worktree", "agent"], _ORDER, {"_os": running_sum(_started()), "_oe": running_sum(_ended())}))
        everyone = by.scan(own, _KEYS, _ORDER, {"_s": running_sum(_started()), "_e": running_sum(_ended())})
        counted = everyone.groupBy("worktree", "agent", "start", "end", "n").agg(_overlaps().alias("overlaps"))
        return counted.filter(F.col("overlaps") > 0)

    return in_two(_held(sessions), _KEYS, run)


def overlap_partners(sessions: DataFrame, unit: str = "month") -> DataFrame:
    """One other agent's session that each overlapping session meets: (worktree, agent, start, end, n, partner_…).

    In the order (start, end, agent) it is the one before it that ends last, if it is still open then, else the next one
    after it, if that starts in time. A sweep carries the session that ended last so far, and the one that did so among
    agents other than its agent: a session that takes the lead from another agent leaves the old leader as second, one that
    doesn't is a second itself if its agent is not the leader's. No pair is listed; a session without overlap gives no row.
    """
    order, agent = ["start", "end", "agent"], F.col("agent")
    me, place = F.struct("end", "agent", "start"), F.struct("start", "end", "agent")
    before = F.when(F.col("_lead.agent") != agent, F.col("_lead")).otherwise(F.col("_second"))

    def run(rows: DataFrame, by: Whole | Chunked) -> DataFrame:
        merged = by.cut(_merged(rows), _KEYS, order, F.date_trunc(unit, F.col("start").cast("timestamp")))
        led = by.scan(merged, _KEYS, order, {"_lead": running_max(me, inclusive=False)})
        led = by.keep(led.withColumn("_loses", F.when(F.col("_lead.agent") != agent, F.least(me, F.col("_lead")))))
        ahead = by.keep(by.scan(led, _KEYS, order, {"_second": running_max(F.col("_loses"), inclusive=False)}))
        follows = by.scan(ahead, _KEYS, order, {"_next": last(place, inclusive=False)}, reverse=True)
        follows = by.keep(follows.withColumn("_change", F.when(F.col("_next.agent") != agent, F.col("_next"))))
        swept = by.scan(follows, _KEYS, order, {"_after": last(F.col("_change"))}, reverse=True)
        open_then = swept.withColumn("_before", before).withColumns({
            "_before": F.when(F.col("_before.end") > F.col("start"), F.struct("_before.start", "_before.end", "_before.agent")),
            "_after": F.when(F.col("_after.start") < F.col("end"), F.struct("_after.start", "_after.end", "_after.agent")),
        })
        found = open_then.withColumn("_p", F.coalesce("_before", "_after")).filter(F.col("_p").isNotNull())
        return found.select("worktree", "agent", "start", "end", "n", F.col("_p.agent").alias("partner_agent"),
                            F.col("_p.start").alias("partner_start"), F.col("_p.end").alias("partner_end"))

    return in_two(_held(sessions), _KEYS, run)


def overlap_groups(sessions: DataFrame, unit: str = "month") -> DataFrame:
    """Sessions connected by overlaps of different agents: (worktree, since, first_start, last_end, sessions, agents, links).

    A worktree is contended while two agents or more are in it; whoever is in it then belongs to one group. Two contended
    spans belong to one group if a session reaches from one into the next. So a sweep over starts and ends finds the groups:
    agents present, spans, and the last end of what started before a span was over. ``since`` is the first contended
    moment, ``links`` the number of overlapping pairs, counted from both sides (see ``worktree_overlaps``) and never listed.
    """
    at, side, own = F.col("at"), F.col("side"), F.col("_os") - F.col("_oe")
    enters, leaves = (side == 1) & (own == F.col("n")), (side == 0) & (own == 0)
    begins = (F.col("_step") == 1) & (F.col("_crowd") == 2)
    over = (F.col("_step") == -1) & (F.col("_crowd") == 1)
    apart = begins & ~F.coalesce(F.col("_reached") > at, F.lit(False))

    def run(rows: DataFrame, by: Whole | Chunked) -> DataFrame:
        marks = by.cut(_marks(_merged(rows)), _KEYS, _ORDER, F.date_trunc(unit, at.cast("timestamp")))
        steps = by.scan(marks, ["worktree", "agent"], _ORDER, {"_os": running_sum(_started()), "_oe": running_sum(_ended())})
        steps = by.keep(steps.withColumn("_step", F.when(enters, 1).when(leaves, -1).otherwise(0)))
        crowd = by.keep(by.scan(steps, _KEYS, _ORDER, {
            "_s": running_sum(_started()), "_e": running_sum(_ended()),
            "_crowd": running_sum(F.col("_step")), "_reach": running_max(F.when(side == 1, F.col("end")))}))
        reached = by.keep(by.scan(crowd, _KEYS, _ORDER, {"_reached": last(F.when(over, F.col("_reach")), inclusive=False)}))
        named = by.keep(by.scan(reached, _KEYS, _ORDER, {"_since": last(F.when(apart, at))}))
        placed = by.scan(named, _KEYS, _ORDER, {"_group": last(F.when(over, F.col("_since")), inclusive=False)}, reverse=True)
        counted = placed.groupBy("worktree", "agent", "start", "end", "n").agg(
            _overlaps().alias("overlaps"), F.max(F.when(side == 1, F.col("_group"))).alias("since"))
        return counted.filter(F.col("overlaps") > 0).groupBy("worktree", "since").agg(
            F.min("start").alias("first_start"), F.max("end").alias("last_end"), F.sum("n").alias("sessions"),
            F.count_distinct("agent").alias("agents"), (F.sum(F.col("n") * F.col("overlaps")) / 2).cast("bigint").alias("links"))

    return in_two(_held(sessions), _KEYS, run)


def peak_concurrency(sessions: DataFrame, unit: str = "month") -> DataFrame:
    """Highest number of sessions open at once per worktree, from ±1 events and a running sum."""

    def run(rows: DataFrame, by: Whole | Chunked) -> DataFrame:
        marks = _marks(rows).withColumn("n", F.lit(1))
        if isinstance(by, Chunked):  # all starts and ends of one instant combine before the shuffle into at most one row per side
            marks = marks.groupBy(*_KEYS, *_ORDER).agg(F.sum("n").alias("n"))
        marks = by.cut(marks, _KEYS, _ORDER, F.date_trunc(unit, F.col("at").cast("timestamp")))
        open_now = by.scan(marks, _KEYS, _ORDER, {"_open": running_sum(_started() - _ended())})
        return open_now.groupBy("worktree").agg(F.max("_open").alias("peak"))

    return in_two(_held(sessions), _KEYS, run)


def activity_sessions(log: DataFrame, keys: Sequence[str], gap_s: int, unit: str = "day") -> DataFrame:
    """log(keys…, ts) → sessions (keys…, start, last, events), closed after ``gap_s`` without an event.

    Sessions are formed per (keys, period) first and then joined up across periods; the second
    step sees only partial sessions, whose number is bounded by time / gap.
    """

    def islands(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("start")
        idle = micros(F.col("start")) - micros(F.lag("last").over(w))
        opened = rows.withColumn("_new", F.coalesce(idle >= gap_s * 1_000_000, F.lit(True)).cast("int"))
        numbered = opened.withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy(*by, "_no").agg(
            F.min("start").alias("start"), F.max("last").alias("last"), F.sum("events").alias("events")
        )

    period = F.date_trunc(unit, F.col("ts").cast("timestamp"))
    rows = log.groupBy(*keys, period.alias("_period"), "ts").agg(F.count(F.lit(1)).alias("events"))
    points = rows.select(*keys, "_period", F.col("ts").alias("start"), F.col("ts").alias("last"), "events")
    partial = islands(points, [*keys, "_period"])
    return islands(partial.drop("_period", "_no"), keys).drop("_no")


def nightly_rollup(runs: DataFrame) -> DataFrame:
    """runs(repo, ts, failed, amount) → facts per repo and day, per repo and overall (nulls = all)."""
    daily = runs.groupBy("repo", trunc("day", F.col("ts")).alias("day")).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("failed").alias("failures"), F.sum("amount").alias("amount")
    )
    return daily.rollup("repo", "day").agg(
        F.sum("runs").alias("runs"), F.sum("failures").alias("failures"), F.sum("amount").alias("amount")
    )
