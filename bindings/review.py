from pyspark.sql import functions as F

from ashlar.operators import review as ops
from bindings.registry import query


def finding_lines(t, *others):
    kind, user, place = F.col("event_type"), F.col("user_id"), F.concat(F.lit("src/u"), F.col("user_id"), F.lit(".py:"), F.col("event_id"))
    line = (
        F.when((kind == "error") & (F.col("value") < 50), F.concat(F.lit("1. [VIOLATION — ADR-"), user, F.lit("] "), place))
        .when((kind == "error") & (F.col("value") >= 300), F.concat(F.lit("VIOLATION (ADR-"), user, F.lit("): "), place))
        .when(kind == "error", F.concat(place, F.lit(" VIOLATION (ADR-"), user, F.lit(")")))
        .when((kind == "signup") & (F.col("value") < 50), F.concat(F.lit("[DRIFT — ADR-"), user, F.lit("] "), place))
        .when((kind == "signup") & (F.col("value") >= 300), F.concat(F.lit("DRIFT (update ADR-"), user, F.lit(") - "), place))
        .when(kind == "signup", F.concat(place, F.lit(" DRIFT (update ADR-"), user, F.lit(")")))
        .when((kind == "click") & (F.col("value") < 50), F.concat(F.lit("[GAP] "), place))
        .when((kind == "click") & (F.col("value") >= 300), F.concat(F.lit("GAP: "), place))
        .when(kind == "click", F.concat(place, F.lit(" GAP (new ADR needed)")))
        .when(kind == "purchase", F.concat(place, F.lit(" CONFORMS")))
        .otherwise(F.concat(F.lit("I would not do this at "), place))
    )
    return t.events.select(F.col("event_id").alias("id"), user.alias("scope"), "ts", *others, line.alias("line"))


PLACE = "'src/u' || user_id || '.py:' || event_id"
FINDINGS = f"""
f AS (
  SELECT event_id AS id, user_id AS scope, ts,
    CASE event_type WHEN 'error' THEN 'VIOLATION' WHEN 'signup' THEN 'DRIFT' WHEN 'click' THEN 'GAP' WHEN 'purchase' THEN 'CONFORMS' ELSE 'UNTAGGED' END AS verdict,
    CASE WHEN event_type IN ('error', 'signup') THEN user_id END AS decision,
    CASE WHEN event_type = 'view' THEN 'I would not do this at ' || {PLACE} ELSE {PLACE} END AS detail, value FROM events)"""


def findings(t, *others):
    return ops.parse_findings(finding_lines(t, *others)).drop("line")


@query("e1_parse_findings", f"WITH {FINDINGS} SELECT * EXCLUDE (value) FROM f")
def e1(t):
    return findings(t)


@query(
    "e2_verdict_summary",
    f"""WITH {FINDINGS}
SELECT scope, ts::DATE AS date, count_if(verdict = 'VIOLATION')::BIGINT AS violation, count_if(verdict = 'DRIFT')::BIGINT AS drift,
  count_if(verdict = 'GAP')::BIGINT AS gap, count_if(verdict = 'CONFORMS')::BIGINT AS conforms FROM f GROUP BY ALL""",
)
def e2(t):
    return ops.verdict_summary(findings(t).withColumn("date", F.to_date("ts")))


@query(
    "e3_finding_lint",
    f"""WITH {FINDINGS},
k AS (SELECT DISTINCT o_custkey AS num FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT id, 'no tag' AS rule FROM f WHERE verdict = 'UNTAGGED'
UNION ALL SELECT id, 'no evidence' FROM f WHERE value < 5
UNION ALL SELECT id, 'evidence names no place' FROM f WHERE value >= 5 AND value < 10
UNION ALL SELECT id, 'unknown decision' FROM f WHERE decision IS NOT NULL AND decision NOT IN (SELECT num FROM k)
UNION ALL SELECT id, 'no fix' FROM f WHERE verdict <> 'CONFORMS' AND value > 100""",
)
def e3(t):
    value = F.col("value")
    rows = findings(t, "value").withColumns(
        {
            "evidence": F.when(value >= 10, F.col("detail")).when(value >= 5, "somewhere in there"),
            "fix": F.when(value <= 100, "publish an event"),
        }
    )
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("num"))
    return ops.finding_lint(rows, urgent)


@query(
    "e4_drift_escalation",
    f"WITH {FINDINGS} SELECT scope AS area, count(*) AS drifts, min(ts) AS first_ts, max(ts) AS last_ts FROM f WHERE verdict = 'DRIFT' GROUP BY 1 HAVING count(*) >= 10",
)
def e4(t):
    return ops.drift_escalation(findings(t).withColumnRenamed("scope", "area"), 10)


@query(
    "e4_drift_running",
    f"""WITH {FINDINGS},
d AS (SELECT scope AS area, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS drifts FROM f WHERE verdict = 'DRIFT' GROUP BY ALL),
r AS (SELECT *, (sum(drifts) OVER (PARTITION BY area ORDER BY day))::BIGINT AS running FROM d)
SELECT *, running >= 10 AS escalate FROM r""",
)
def e4_running(t):
    return ops.drift_running(findings(t).withColumnRenamed("scope", "area"), 10)


@query(
    "e5_judge_changes",
    """
SELECT l_orderkey AS change, l_partkey AS component, p_partkey AS decision, CASE WHEN p_partkey IS NULL THEN 'GAP'
  WHEN l_extendedprice <= 40 * p_retailprice THEN 'CONFORMS' WHEN p_type = 'PROMO' THEN 'DRIFT' ELSE 'VIOLATION' END AS verdict
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 40) ON p_partkey = l_partkey""",
)
def e5(t):
    changes = t.lineitem.select(F.col("l_orderkey").alias("change"), F.col("l_partkey").alias("component"), "l_extendedprice")
    decisions = t.part.filter(F.col("p_size") <= 40).select(
        F.col("p_partkey").alias("decision"), F.col("p_partkey").alias("component"), "p_retailprice", "p_type"
    )
    holds = F.col("l_extendedprice") <= 40 * F.col("p_retailprice")
    return ops.judge_changes(changes, decisions, holds, F.col("p_type") == "PROMO")


ITEMS = {
    "direction": "boundaries", "tables": "boundaries", "timeouts": "contracts", "idempotency": "contracts",
    "one job": "coupling", "one truth": "data", "blast radius": "operations",
}
NAMES = list(ITEMS)


def answers(t):
    names = F.array(*[F.lit(i) for i in NAMES])
    return t.lineitem.select(F.col("l_orderkey").alias("change"), F.element_at(names, F.col("l_linenumber")).alias("item"))


CELLS = f"""
i AS (SELECT unnest({NAMES!r}) AS item, unnest({list(ITEMS.values())!r}) AS section),
a AS (SELECT DISTINCT l_orderkey AS change, {NAMES!r}[l_linenumber] AS item FROM lineitem),
c AS (SELECT o_orderkey AS change, i.item, i.section, a.item IS NOT NULL AS hit FROM orders CROSS JOIN i LEFT JOIN a ON a.change = o_orderkey AND a.item = i.item)"""


@query("e6_checklist_gaps", f"WITH {CELLS} SELECT change, item FROM c WHERE NOT hit")
def e6_gaps(t):
    return ops.checklist_gaps(t.orders.select(F.col("o_orderkey").alias("change")), ITEMS, answers(t))


@query(
    "e6_checklist_coverage",
    f"""WITH {CELLS}
SELECT section, count(*) AS asked, count_if(hit)::BIGINT AS answered, round(count_if(hit) / count(*), 6) AS share FROM c GROUP BY ROLLUP (section)""",
)
def e6(t):
    cover = ops.checklist_coverage(t.orders.select(F.col("o_orderkey").alias("change")), ITEMS, answers(t))
    return cover.withColumn("share", F.round("share", 6))


@query(
    "e7_story_lint",
    """
SELECT * FROM (
  SELECT o_orderkey AS story, concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'scope' END, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'criteria' END,
    CASE WHEN o_totalprice < 100000 THEN 'decision' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'interfaces' END,
    CASE WHEN o_totalprice > 400000 THEN 'out of scope' END) AS missing FROM orders) WHERE missing <> ''""",
)
def e7(t):
    priority, price = F.col("o_orderpriority"), F.col("o_totalprice")
    stories = t.orders.select(
        F.col("o_orderkey").alias("story"),
        F.when(F.col("o_orderstatus") != "P", "ship the order").otherwise(" ").alias("scope"),
        F.when(priority == "1-URGENT", "Then shipped, given paid, when packed")
        .when(priority == "2-HIGH", F.lit(None))
        .otherwise("Given a paid order\nWhen it is packed\nThen it ships")
        .alias("criteria"),
        F.when(price >= 100000, F.array(F.col("o_custkey"))).otherwise(F.array().cast("array<bigint>")).alias("decisions"),
        F.when(priority != "5-LOW", "POST /ship").alias("interfaces"),
        F.when(price <= 400000, "returns").alias("out_of_scope"),
    )
    return ops.story_lint(stories).withColumn("missing", F.concat_ws(",", "missing"))


@query(
    "e8_decision_coverage",
    """
SELECT 'no story' AS kind, o_orderkey AS num, NULL::BIGINT AS story FROM orders
WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')
UNION ALL SELECT 'no decision', NULL, l_partkey FROM lineitem WHERE l_returnflag <> 'A'
UNION ALL SELECT 'superseded decision', l_orderkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'A' AND o_orderstatus = 'F'""",
)
def e8(t):
    status = F.col("o_orderstatus")
    decisions = t.orders.select(
        F.col("o_orderkey").alias("num"), F.when(status == "O", "accepted").when(status == "F", "superseded").otherwise("proposed").alias("status")
    )
    named = F.when(F.col("l_returnflag") == "A", F.array("l_orderkey")).otherwise(F.array().cast("array<bigint>"))
    return ops.decision_coverage(decisions, t.lineitem.select(F.col("l_partkey").alias("story"), named.alias("decisions")))
