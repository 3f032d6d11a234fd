"""Review findings: parsing, summaries, lint, judging changes, checklist and story coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.functions.levels import trunc
from ashlar.functions.lint import blank, broken_rules, names_where

# The verdict vocabulary and its two written forms.
VERDICTS = ["VIOLATION", "DRIFT", "GAP", "CONFORMS"]
TAG_IN_FRONT = r"\[(VIOLATION|DRIFT|GAP|CONFORMS)(?:\s*[—–-]\s*ADR-([0-9]+))?\]\s*(.*)$"
TAG_AT_END = r"^(.*?)\s*\b(VIOLATION|DRIFT|GAP|CONFORMS)(?:\s*\((?:update |new )?ADR(?:-([0-9]+))?[^)]*\))?\s*\.?$"
TAG_PLAIN = (
    r"^\s*(?:[0-9]+\.\s*)?(VIOLATION|DRIFT|GAP|CONFORMS)"
    r"(?:\s*\((?:update |new )?ADR(?:-([0-9]+))?[^)]*\)\s*[:—–-]?|\s*[:—–-])\s*(\S.*)$"
)
EVIDENCE = r"[A-Za-z0-9_/-]+\.[a-z]+(:[0-9]+)?|\b[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*"


def parse_findings(lines: DataFrame) -> DataFrame:
    """lines(…, line) → verdict (UNTAGGED if none), decision number, detail.

    The tag stands in front, in brackets or plain with a record or colon after it, or at the end.
    """

    def front(i: int) -> Column:
        bracketed, plain = (F.nullif(F.regexp_extract("line", p, i), F.lit("")) for p in (TAG_IN_FRONT, TAG_PLAIN))
        return F.when(F.regexp_extract("line", TAG_IN_FRONT, 1) != "", bracketed).otherwise(plain)

    def end(i: int) -> Column:
        return F.nullif(F.regexp_extract("line", TAG_AT_END, i), F.lit(""))

    tagged_in_front = front(1).isNotNull()
    return lines.withColumns(
        {
            "verdict": F.coalesce(front(1), end(2), F.lit("UNTAGGED")),
            "decision": F.when(tagged_in_front, front(2)).otherwise(end(3)).try_cast("bigint"),
            "detail": F.when(tagged_in_front, front(3)).when(end(2).isNotNull(), end(1)).otherwise(F.col("line")),
        }
    )


def verdict_summary(findings: DataFrame, by: Sequence[str] = ("scope", "date")) -> DataFrame:
    """Counts of the four verdicts per group; zeros are printed."""
    counts = findings.groupBy(*by).pivot("verdict", VERDICTS).agg(F.count(F.lit(1)))
    return counts.select(*by, *[F.coalesce(v, F.lit(0)).alias(v.lower()) for v in VERDICTS])


def finding_lint(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """findings(id, verdict, decision, evidence, fix) against decisions(num): one row per broken rule."""
    known = decisions.select(F.concat(F.lit("number "), "num").alias("_key")).distinct()
    needs_number = F.col("verdict").isin("VIOLATION", "DRIFT")
    number = F.col("decision")
    listed = broken_rules(
        findings,
        ["id", "decision"],
        {
            "no tag": ~F.col("verdict").isin(VERDICTS),
            "no evidence": blank(F.col("evidence")),
            "evidence names no place": ~blank(F.col("evidence")) & ~F.col("evidence").rlike(EVIDENCE),
            "no decision": needs_number & number.isNull(),
            "unknown decision": number.isNotNull(),
            "no fix": (F.col("verdict") != "CONFORMS") & blank(F.col("fix")),
        },
    )
    # Rows that ask for no number have a key of their own; by their null they would all meet in one task of the join.
    key = F.when(F.col("rule") == "unknown decision", F.concat(F.lit("number "), number))
    keyed = listed.select("id", "rule", F.coalesce(key, F.concat(F.lit("id "), F.xxhash64("id", "rule"))).alias("_key"))
    return keyed.join(known, "_key", "left_anti").drop("_key")


def drift_escalation(findings: DataFrame, n: int) -> DataFrame:
    """findings(area, ts, verdict): areas with n or more DRIFT findings, with first and last time."""
    drift = findings.filter(F.col("verdict") == "DRIFT").groupBy("area")
    return drift.agg(
        F.count(F.lit(1)).alias("drifts"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    ).filter(F.col("drifts") >= n)


def drift_running(findings: DataFrame, n: int) -> DataFrame:
    """DRIFT findings per area and day with their running count and whether it reached n.

    Days are counted before the window, so an area's window is bounded by time.
    """
    daily = (
        findings.filter(F.col("verdict") == "DRIFT")
        .groupBy("area", trunc("day", F.col("ts")).alias("day"))
        .agg(F.count(F.lit(1)).alias("drifts"))
    )
    upto = Window.partitionBy("area").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("drifts").over(upto)
    return daily.withColumn("running", total).withColumn("escalate", F.col("running") >= n)


def judge_changes(changes: DataFrame, decisions: DataFrame, holds: Column, record_outdated: Column) -> DataFrame:
    """changes(change, component, …) × each decisions(decision, component, …) on its component.

    ``holds`` is the decision's rule on the joined row; when it fails, ``record_outdated`` says
    whether the code is right and the record wrong.
    """
    judged = changes.join(decisions, "component", "left")
    verdict = (
        F.when(F.col("decision").isNull(), "GAP")
        .when(holds, "CONFORMS")
        .when(record_outdated, "DRIFT")
        .otherwise("VIOLATION")
    )
    return judged.select("change", "component", "decision", verdict.alias("verdict"))


def _answered(changes: DataFrame, items: Mapping[str, str], answers: DataFrame) -> DataFrame:
    said = (
        answers.filter(F.col("item").isin(list(items)))
        .groupBy("change")
        .agg(F.collect_set("item").alias("_said"))  # at most one entry per checklist item
    )
    return changes.join(said, "change", "left").withColumn("_said", F.coalesce("_said", F.array().cast("array<string>")))


def checklist_gaps(changes: DataFrame, items: Mapping[str, str], answers: DataFrame) -> DataFrame:
    """Checklist items (item → section) not answered per change; answers(change, item)."""
    checklist = F.array(*[F.lit(i) for i in items])
    return _answered(changes, items, answers).select(
        "change", F.explode(F.array_except(checklist, F.col("_said"))).alias("item")
    )


def checklist_coverage(changes: DataFrame, items: Mapping[str, str], answers: DataFrame) -> DataFrame:
    """Share of answered items per section, and over all sections (section null)."""
    checklist = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(i).alias("item")) for i, s in items.items()])
    cells = _answered(changes, items, answers).select("_said", F.inline(checklist))
    hit = F.array_contains("_said", F.col("item"))
    return (
        cells.select("section", hit.cast("int").alias("_hit"))
        .rollup("section")
        .agg(F.count(F.lit(1)).alias("asked"), F.sum("_hit").alias("answered"))
        .withColumn("share", F.col("answered") / F.col("asked"))
    )


def story_lint(stories: DataFrame) -> DataFrame:
    """stories(story, scope, criteria, decisions, interfaces, out_of_scope) → missing parts per story."""
    ordered = F.col("criteria").rlike(r"(?is)\bgiven\b.*\bwhen\b.*\bthen\b")
    missing = names_where(
        {
            "scope": blank(F.col("scope")),
            "criteria": ~F.coalesce(ordered, F.lit(False)),
            "decision": F.coalesce(F.size("decisions"), F.lit(0)) < 1,
            "interfaces": blank(F.col("interfaces")),
            "out of scope": blank(F.col("out_of_scope")),
        }
    )
    return stories.select("story", missing.alias("missing")).filter(F.size("missing") > 0)


def decision_coverage(decisions: DataFrame, stories: DataFrame) -> DataFrame:
    """decisions(num, status), stories(story, decisions): rows (kind, num, story) for accepted decisions
    without a story, and stories naming no decision or a superseded one."""
    named = stories.select("story", F.explode_outer("decisions").alias("num"))
    story = stories.schema["story"].dataType
    uncovered = decisions.filter(F.col("status") == "accepted").join(named.select("num").distinct(), "num", "left_anti")
    gone = decisions.filter(F.col("status") == "superseded").select("num").distinct()
    return (
        uncovered.select(F.lit("no story").alias("kind"), "num", F.lit(None).cast(story).alias("story"))
        .unionByName(named.filter("num IS NULL").select(F.lit("no decision").alias("kind"), "num", "story"))
        .unionByName(named.join(gone, "num", "left_semi").select(F.lit("superseded decision").alias("kind"), "num", "story"))
    )
