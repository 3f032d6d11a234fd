"""Desired against observed install state.

desired(label, path, entry, target): entry is link or rule; target is the link text or the rule file's content.
observed(path, kind, link, content, has_manifest, resolves): kind is link, directory or file; resolves is
false for a link whose target is gone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand_targets(
    projects: DataFrame,
    personal: Sequence[tuple[str, str]],
    target: str,
    rule_text: str,
    link_suffix: str,
    rule_suffix: str,
) -> DataFrame:
    """Each personal entry once, plus a link and a rule file per projects(project)."""

    def entry(label, path, kind: str, text: str):
        return F.struct(label.alias("label"), path.alias("path"), F.lit(kind).alias("entry"), F.lit(text).alias("target"))

    fixed = F.array(*[entry(F.lit(l), F.lit(p), "link", target) for l, p in personal])
    project = F.col("project")
    each = F.array(
        entry(F.concat(F.lit("project "), project), F.concat(project, F.lit(link_suffix)), "link", target),
        entry(F.concat(F.lit("rule "), project), F.concat(project, F.lit(rule_suffix)), "rule", rule_text),
    )
    return projects.sparkSession.range(1).select(F.inline(fixed)).unionByName(projects.select(F.inline(each)))


def _paired(desired: DataFrame, observed: DataFrame) -> DataFrame:
    return desired.join(observed, "path", "left")


def check_state(desired: DataFrame, observed: DataFrame) -> DataFrame:
    """State and passed per entry; first match wins. A dangling link counts as missing."""
    kind, dangling = F.col("kind"), (F.col("kind") == "link") & ~F.col("resolves")
    gone = kind.isNull() | dangling
    rule = F.col("entry") == "rule"
    state = (
        F.when(rule & (gone | (kind == "directory")), "missing")
        .when(rule, "present")
        .when(gone, "missing")
        .when((kind == "link") & (F.col("link") == F.col("target")), "link ok")
        .when(kind == "link", "link elsewhere")
        .when(F.coalesce("has_manifest", F.lit(False)), "directory ok")
        .otherwise("no manifest")
    )
    checked = _paired(desired, observed).withColumn("state", state)
    return checked.select("label", "path", "state", F.col("state").isin("link ok", "directory ok", "present").alias("passed"))


def plan_install(desired: DataFrame, observed: DataFrame) -> DataFrame:
    """Action per entry. Here a dangling link is a link; a non-link is skipped; rule files are always written."""
    kind = F.col("kind")
    action = (
        F.when(F.col("entry") == "rule", "write")
        .when((kind == "link") & (F.col("link") == F.col("target")), "no-op")
        .when(kind == "link", "update")
        .when(kind.isNotNull(), "skip")
        .otherwise("create")
    )
    return _paired(desired, observed).select("label", "path", "entry", "target", action.alias("action"))


def plan_removal(desired: DataFrame, observed: DataFrame) -> DataFrame:
    """remove any link, whatever it points to; leave non-links; remove a rule file that is present."""
    kind = F.col("kind")
    action = (
        F.when(kind.isNull(), "nothing")
        .when((F.col("entry") == "rule") & (kind == "file"), "remove")
        .when(F.col("entry") == "rule", "nothing")
        .when(kind == "link", "remove")
        .otherwise("leave")
    )
    return _paired(desired, observed).select("label", "path", "entry", action.alias("action"))


def apply_install(plan: DataFrame, observed: DataFrame) -> DataFrame:
    """Observed state after the plan's create, update and write actions."""
    acts = plan.select("path", "entry", "target", "action")
    both = observed.join(acts, "path", "full_outer")
    linked, written = F.col("action").isin("create", "update"), F.col("action") == "write"
    return both.select(
        "path",
        F.when(linked, "link").when(written, "file").otherwise(F.col("kind")).alias("kind"),
        F.when(linked, F.col("target")).when(written, F.lit(None)).otherwise(F.col("link")).alias("link"),
        F.when(written, F.col("target")).when(linked, F.lit(None)).otherwise(F.col("content")).alias("content"),
        F.when(linked, True).when(written, False).otherwise(F.col("has_manifest")).alias("has_manifest"),
        F.when(linked | written, True).otherwise(F.col("resolves")).alias("resolves"),
    )


def overall_status(checks: DataFrame, by: Sequence[str]) -> DataFrame:
    """checks(by…, ord, label, passed) → all passed, failing count, label of the first failing check by ord per scope."""
    bad = ~F.col("passed")
    return checks.groupBy(*by).agg(
        F.bool_and("passed").alias("all_passed"),
        F.count_if(bad).alias("failing"),
        F.min_by("label", F.when(bad, F.struct("ord", "label"))).alias("first_failing"),
    )


def replan_is_noop(desired: DataFrame, observed: DataFrame) -> DataFrame:
    """Plan, apply, plan again: entries per second action, and how many would change content (must be 0)."""
    state = apply_install(plan_install(desired, observed), observed)
    again = plan_install(desired, state).join(state.select("path", "content"), "path", "left")
    rewritten = (F.col("action") == "write") & ~F.col("content").eqNullSafe(F.col("target"))
    touched = F.col("action").isin("create", "update") | rewritten
    return again.groupBy("entry", "action").agg(F.count(F.lit(1)).alias("entries"), F.count_if(touched).alias("changed"))
