from pyspark.sql import functions as F

from ashlar.operators import reconcile as ops
from bindings.registry import query

PERSONAL = [("alpha", "/home/me/.alpha/skills/router"), ("beta", "/home/me/.beta/skills/router"), ("gamma", "/home/me/.gamma/router")]
TARGET, RULE_TEXT = "/srv/skills/router", "route by task shape"


@query(
    "g1_expand_targets",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{l}', '{p}', 'link', '{TARGET}')" for l, p in PERSONAL)
    + f""") v(label, path, entry, target)
UNION ALL SELECT 'project /repo/' || s_name, '/repo/' || s_name || '/.skills/router', 'link', '{TARGET}' FROM supplier
UNION ALL SELECT 'rule /repo/' || s_name, '/repo/' || s_name || '/.rules/00-router.md', 'rule', '{RULE_TEXT}' FROM supplier""",
)
def g1(t):
    projects = t.supplier.select(F.concat(F.lit("/repo/"), F.col("s_name")).alias("project"))
    return ops.expand_targets(projects, PERSONAL, TARGET, RULE_TEXT, "/.skills/router", "/.rules/00-router.md")


def desired(t):
    rule = F.col("p_type") == "SMALL"
    return t.part.select(
        F.concat(F.lit("part "), F.col("p_partkey")).alias("label"),
        F.col("p_partkey").alias("path"),
        F.when(rule, "rule").otherwise("link").alias("entry"),
        F.when(rule, RULE_TEXT).otherwise("Brand#1").alias("target"),
        "p_brand",
    )


def observed(t):
    k = F.col("p_size") % 6
    return t.part.filter(k != 0).select(
        F.col("p_partkey").alias("path"),
        F.when(k <= 2, "link").when(k <= 4, "directory").otherwise("file").alias("kind"),
        F.when(k <= 2, F.when(F.col("p_retailprice") < 1000, "Brand#1").otherwise(F.col("p_brand"))).alias("link"),
        F.when(k == 5, F.when(F.col("p_retailprice") < 950, RULE_TEXT).otherwise("old rule")).alias("content"),
        (k == 3).alias("has_manifest"),
        (k != 2).alias("resolves"),
    )


STATE = f"""
p AS (
  SELECT 'part ' || p_partkey AS label, p_partkey AS path, p_type = 'SMALL' AS is_rule, p_size % 6 AS k, p_brand,
    CASE WHEN p_retailprice < 1000 THEN 'Brand#1' ELSE p_brand END AS link, p_retailprice < 950 AS fresh FROM part),
c AS (
  SELECT *, CASE WHEN is_rule THEN CASE WHEN k IN (1, 5) THEN 'present' ELSE 'missing' END
    WHEN k IN (0, 2) THEN 'missing' WHEN k = 1 AND link = 'Brand#1' THEN 'link ok' WHEN k = 1 THEN 'link elsewhere'
    WHEN k = 3 THEN 'directory ok' ELSE 'no manifest' END AS state FROM p),
v AS (SELECT *, state IN ('link ok', 'directory ok', 'present') AS passed FROM c)"""


@query("g2_check_state", f"WITH {STATE} SELECT label, path, state, passed FROM v")
def g2(t):
    return ops.check_state(desired(t), observed(t))


@query(
    "g3_plan_install",
    f"""WITH {STATE}
SELECT label, path, CASE WHEN is_rule THEN 'rule' ELSE 'link' END AS entry, CASE WHEN is_rule THEN '{RULE_TEXT}' ELSE 'Brand#1' END AS target,
  CASE WHEN is_rule THEN 'write' WHEN k = 0 THEN 'create' WHEN k IN (1, 2) AND link = 'Brand#1' THEN 'no-op' WHEN k IN (1, 2) THEN 'update' ELSE 'skip' END AS action FROM v""",
)
def g3(t):
    return ops.plan_install(desired(t), observed(t))


@query(
    "g4_plan_removal",
    f"""WITH {STATE}
SELECT label, path, CASE WHEN is_rule THEN 'rule' ELSE 'link' END AS entry, CASE WHEN k = 0 THEN 'nothing'
  WHEN is_rule THEN CASE WHEN k = 5 THEN 'remove' ELSE 'nothing' END WHEN k IN (1, 2) THEN 'remove' ELSE 'leave' END AS action FROM v""",
)
def g4(t):
    return ops.plan_removal(desired(t), observed(t))


@query(
    "g5_overall_status",
    f"""WITH {STATE}
SELECT p_brand AS scope, bool_and(passed) AS all_passed, count_if(NOT passed)::BIGINT AS failing, arg_min(label, path) FILTER (NOT passed) AS first_failing
FROM v GROUP BY p_brand""",
)
def g5(t):
    checks = ops.check_state(desired(t), observed(t)).join(desired(t).select("path", F.col("p_brand").alias("scope")), "path")
    return ops.overall_status(checks.withColumn("ord", F.col("path")), ["scope"])


@query(
    "g6_replan_is_noop",
    f"""WITH {STATE},
a AS (SELECT CASE WHEN is_rule THEN 'rule' ELSE 'link' END AS entry, CASE WHEN is_rule THEN 'write' WHEN k IN (0, 1, 2) THEN 'no-op' ELSE 'skip' END AS action FROM v)
SELECT entry, action, count(*) AS entries, 0::BIGINT AS changed FROM a GROUP BY ALL""",
)
def g6(t):
    return ops.replan_is_noop(desired(t).drop("p_brand"), observed(t))
