from pyspark.sql import functions as F

from ashlar.operators import routing as ops
from bindings.registry import query

FEATURES = [f for f, _ in ops.RULES]


def tasks(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("task")).agg(F.count(F.lit(1)).alias("lines"))
    orders = t.orders.select(F.col("o_orderkey").alias("task"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    priority = F.col("o_orderpriority")
    return orders.join(lines, "task", "left").select(
        "task",
        (F.col("lines") >= 5).alias("autonomous_edits"),
        (priority == "1-URGENT").alias("approve_each_diff"),
        (F.col("o_orderstatus") == "F").alias("debugger_central"),
        (priority == "5-LOW").alias("plans_or_schedules"),
        "o_orderpriority",
        "o_totalprice",
    )


TASKS = """
k AS (
  SELECT o_orderkey AS task, coalesce(n >= 5, false) AS a, o_orderpriority = '1-URGENT' AS b, o_orderstatus = 'F' AS c, o_orderpriority = '5-LOW' AS d,
    o_orderpriority, o_totalprice FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
r AS (
  SELECT *, CASE WHEN a THEN 1 WHEN b THEN 2 WHEN c THEN 3 WHEN d THEN 4 ELSE 5 END AS rule,
    ['autonomous coder', 'supervised editor', 'terminal debugger', 'orchestrator', 'ask'][CASE WHEN a THEN 1 WHEN b THEN 2 WHEN c THEN 3 WHEN d THEN 4 ELSE 5 END] AS target FROM k)"""


@query("f1_route_first_match", f"WITH {TASKS} SELECT task, target, rule FROM r")
def f1(t):
    return ops.route_first_match(tasks(t)).select("task", "target", "rule")


@query("f1_route_by_table", f"WITH {TASKS} SELECT task, target, CASE WHEN rule < 5 THEN rule END AS rule FROM r")
def f1_table(t):
    rows = ", ".join(f"({i}, '{f}', '{target}')" for i, (f, target) in enumerate(ops.RULES, 1))
    rules = t.spark.sql(f"SELECT * FROM VALUES {rows} AS v(priority, feature, target)")
    return ops.route_by_table(tasks(t), FEATURES, rules)


@query(
    "f2_route_ambiguity",
    f"""WITH {TASKS}
SELECT task, concat_ws(',', CASE WHEN a THEN 'autonomous coder' END, CASE WHEN b THEN 'supervised editor' END, CASE WHEN c THEN 'terminal debugger' END,
  CASE WHEN d THEN 'orchestrator' END) AS matched FROM k WHERE a::INTEGER + b::INTEGER + c::INTEGER + d::INTEGER <> 1""",
)
def f2(t):
    return ops.route_ambiguity(tasks(t)).withColumn("matched", F.concat_ws(",", "matched"))


SHAPES = {"view": "supervised editor", "click": "autonomous coder", "purchase": "orchestrator", "signup": "terminal debugger"}
SHAPE_CASE = "CASE {} " + " ".join(f"WHEN '{s}' THEN '{n}'" for s, n in SHAPES.items()) + " ELSE 'ask' END"


@query(
    "f3_reroute",
    f"""
WITH s AS (SELECT user_id AS task, arg_min(event_type, (ts, event_id)) AS first, arg_max(event_type, (ts, event_id)) AS shape FROM events GROUP BY 1),
n AS (SELECT task, {SHAPE_CASE.format('first')} AS target, shape, {SHAPE_CASE.format('shape')} AS new_target FROM s)
SELECT * FROM n WHERE target <> new_target""",
)
def f3(t):
    seen = t.events.select(F.col("user_id").alias("task"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("shape"))
    first = seen.groupBy("task").agg(F.min_by("shape", F.struct("ts", "seq")).alias("first"))
    return ops.reroute(first.select("task", F.expr(SHAPE_CASE.format("first")).alias("target")), seen, SHAPES)


PRIORITY_CASE = """CASE o_orderpriority WHEN '1-URGENT' THEN 'supervised editor' WHEN '2-HIGH' THEN 'autonomous coder'
  WHEN '3-MEDIUM' THEN 'terminal debugger' WHEN '5-LOW' THEN 'orchestrator' ELSE 'ask' END"""


def assigned(t):
    return ops.route_first_match(tasks(t)).select("task", F.expr(PRIORITY_CASE).alias("assigned"), F.col("target").alias("recommended"))


@query(
    "f4_misroute_audit",
    f"""WITH {TASKS}, g AS (SELECT {PRIORITY_CASE} AS assigned, target AS recommended FROM r)
SELECT assigned, recommended, count(*) AS tasks, count_if(assigned <> recommended)::BIGINT AS misroutes,
  (grouping(assigned) * 2 + grouping(recommended))::BIGINT AS margin, round(count_if(assigned <> recommended) / count(*), 6) AS misroute_share
FROM (SELECT assigned, recommended, assigned <> recommended AS w FROM g) GROUP BY CUBE (assigned, recommended)""".replace(
        "count_if(assigned <> recommended)", "count_if(w)"
    ),
)
def f4(t):
    return ops.misroute_audit(assigned(t)).withColumn("misroute_share", F.round("misroute_share", 6))


TARGETS = [n for _, n in ops.RULES] + [ops.ASK]


@query(
    "f4_misroute_matrix",
    f"WITH {TASKS} SELECT {PRIORITY_CASE} AS assigned, "
    + ", ".join(f"count_if(target = '{n}')::BIGINT AS {n.replace(' ', '_')}" for n in TARGETS)
    + " FROM r GROUP BY 1",
)
def f4_matrix(t):
    grid = ops.misroute_matrix(assigned(t), TARGETS)
    return grid.select("assigned", *[F.col(n).alias(n.replace(" ", "_")) for n in TARGETS])


@query(
    "f4_routing_smells",
    f"""WITH {TASKS}, g AS (SELECT *, {PRIORITY_CASE} AS assigned FROM r)
SELECT task, 'supervised editor unattended' AS rule FROM g WHERE assigned = 'supervised editor' AND a
UNION ALL SELECT task, 'orchestrator as editor' FROM g WHERE assigned = 'orchestrator' AND a
UNION ALL SELECT task, 'autonomous coder for batches' FROM g WHERE assigned = 'autonomous coder' AND c
UNION ALL SELECT task, 'routed by name' FROM g WHERE o_totalprice > 450000
UNION ALL SELECT task, 'shared worktree' FROM g WHERE o_totalprice < 50000""",
)
def f4_smells(t):
    rows = tasks(t).select(
        "task",
        F.expr(PRIORITY_CASE).alias("assigned"),
        F.col("autonomous_edits").alias("unattended"),
        F.col("autonomous_edits").alias("code_edits"),
        F.col("debugger_central").alias("repetitive"),
        (F.col("o_totalprice") > 450000).alias("by_name"),
        (F.col("o_totalprice") < 50000).alias("shared_worktree"),
    )
    return ops.routing_smells(rows)


HANDOFF_RULES = {
    "dirty tree": "o_orderstatus = 'P'",
    "no branch": "o_orderpriority = '5-LOW'",
    "summary lacks goal": "p % 10 = 1",
    "summary lacks done": "p % 10 = 2",
    "summary lacks left": "p % 10 = 3",
    "summary lacks risks": "p % 10 = 4",
    "tests not run": "o_orderpriority = '1-URGENT' AND p % 2 = 0",
    "prompt lacks goal": "p % 10 = 1",
    "prompt lacks context": "p % 10 = 5",
    "prompt lacks constraints": "p % 10 = 6",
    "prompt lacks do_not": "p % 10 = 7",
    "prompt lacks validation": "p % 10 = 8",
    "prompt lacks return_format": "p % 10 = 9",
}


@query(
    "f5_handoff_lint",
    "WITH h AS (SELECT *, floor(o_totalprice)::BIGINT AS p FROM orders) "
    + " UNION ALL ".join(f"SELECT o_orderkey AS handoff, '{r}' AS rule FROM h WHERE {c}" for r, c in HANDOFF_RULES.items()),
)
def f5(t):
    p = F.floor("o_totalprice").cast("bigint")

    def text(digit):
        return F.when(p % 10 != digit, "stated").otherwise("")

    rows = t.orders.select(
        F.col("o_orderkey").alias("handoff"),
        (F.col("o_orderstatus") == "P").alias("dirty"),
        F.when(F.col("o_orderpriority") != "5-LOW", "work").alias("branch"),
        text(1).alias("goal"),
        text(2).alias("done"),
        text(3).alias("left"),
        text(4).alias("risks"),
        (F.col("o_orderpriority") == "1-URGENT").alias("has_tests"),
        (p % 2 == 1).alias("tests_run"),
        *[text(d).alias(f) for d, f in enumerate(ops.PROMPT_FIELDS[1:], 5)],
    )
    return ops.handoff_lint(rows)


def sessions(t):
    end = F.expr("l_shipdate + make_dt_interval(cast(l_quantity AS int))")
    return t.lineitem.select(
        F.col("l_suppkey").alias("agent"), F.col("l_partkey").alias("worktree"), F.col("l_shipdate").alias("start"), end.alias("end")
    )


SESSIONS = """
s AS (
  SELECT l_suppkey AS agent, l_partkey AS worktree, l_shipdate AS "start", l_shipdate + to_days(l_quantity::INTEGER) AS "end", count(*) AS n
  FROM lineitem GROUP BY ALL)"""


@query(
    "f6_worktree_overlaps",
    f"""WITH {SESSIONS}
SELECT a.worktree, a.agent, a."start", a."end", a.n, sum(b.n)::BIGINT AS overlaps FROM s a
JOIN s b ON a.worktree = b.worktree AND a.agent <> b.agent AND a."start" < b."end" AND b."start" < a."end" GROUP BY ALL""",
)
def f6(t):
    return ops.worktree_overlaps(sessions(t))


@query(
    "f6_overlap_partners",
    f"""WITH {SESSIONS},
b AS (
  SELECT a.worktree, a.agent, a."start", a."end", arg_max({{'a': b.agent, 's': b."start", 'e': b."end"}}, (b."end", b.agent, b."start")) AS p FROM s a
  JOIN s b ON a.worktree = b.worktree AND a.agent <> b.agent AND (b."start", b."end", b.agent) < (a."start", a."end", a.agent) AND b."end" > a."start" GROUP BY ALL),
f AS (
  SELECT a.worktree, a.agent, a."start", a."end", arg_min({{'a': b.agent, 's': b."start", 'e': b."end"}}, (b."start", b."end", b.agent)) AS p FROM s a
  JOIN s b ON a.worktree = b.worktree AND a.agent <> b.agent AND (b."start", b."end", b.agent) > (a."start", a."end", a.agent) AND b."start" < a."end" GROUP BY ALL),
j AS (
  SELECT s.*, coalesce(b.p, f.p) AS p FROM s LEFT JOIN b USING (worktree, agent, "start", "end") LEFT JOIN f USING (worktree, agent, "start", "end"))
SELECT worktree, agent, "start", "end", n, p.a AS partner_agent, p.s AS partner_start, p.e AS partner_end FROM j WHERE p IS NOT NULL""",
)
def f6_partners(t):
    return ops.overlap_partners(sessions(t))


@query(
    "f6_overlap_groups",
    f"""WITH RECURSIVE {SESSIONS},
i AS (SELECT *, row_number() OVER () AS id FROM s),
p AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b, a.n * b.n AS links, greatest(a."start", b."start") AS since FROM i a
  JOIN i b ON a.worktree = b.worktree AND a.agent <> b.agent AND a."start" < b."end" AND b."start" < a."end"),
g(id, label) USING KEY (id) AS (
  SELECT DISTINCT a, a FROM p
  UNION
  SELECT p.a, min(w.label) FROM p JOIN g w ON w.id = p.b JOIN recurring.g r ON r.id = p.a WHERE w.label < r.label GROUP BY p.a),
l AS (SELECT label, min(since) AS since, (sum(links) // 2)::BIGINT AS links FROM p JOIN g ON g.id = p.a GROUP BY 1)
SELECT worktree, since, min("start") AS first_start, max("end") AS last_end, sum(n)::BIGINT AS sessions, count(DISTINCT agent) AS agents, links
FROM g JOIN i USING (id) JOIN l USING (label) GROUP BY worktree, since, links, label""",
)
def f6_groups(t):
    return ops.overlap_groups(sessions(t))


@query(
    "f6_peak_concurrency",
    f"""WITH {SESSIONS},
m AS (SELECT worktree, "start" AS t, 1 AS side, n AS d FROM s UNION ALL SELECT worktree, "end", 0, -n FROM s),
r AS (SELECT worktree, sum(d) OVER (PARTITION BY worktree ORDER BY t, side ROWS UNBOUNDED PRECEDING) AS o FROM m)
SELECT worktree, max(o)::BIGINT AS peak FROM r GROUP BY 1""",
)
def f6_peak(t):
    return ops.peak_concurrency(sessions(t))


@query(
    "f8_nightly_rollup",
    """
SELECT user_id % 40 AS repo, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS runs, count_if(event_type = 'error')::BIGINT AS failures,
  sum(value::DECIMAL(18,2))::DOUBLE AS amount FROM (SELECT *, user_id % 40 AS repo FROM events) GROUP BY ROLLUP (user_id % 40, date_trunc('day', ts)::TIMESTAMP)""",
)
def f8(t):
    runs = t.events.select(
        (F.col("user_id") % 40).alias("repo"), "ts", (F.col("event_type") == "error").alias("failed"), F.col("value").cast("decimal(18,2)").alias("amount")
    )
    return ops.nightly_rollup(runs).withColumn("amount", F.col("amount").cast("double"))


@query(
    "f9_activity_sessions",
    """
WITH g AS (
  SELECT user_id % 20 AS worktree, user_id AS agent, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 12 HOUR, true)::INTEGER AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY agent ORDER BY ts) AS no FROM g)
SELECT worktree, agent, min(ts) AS "start", max(ts) AS last, count(*) AS events FROM n GROUP BY worktree, agent, no""",
)
def f9(t):
    log = t.events.select((F.col("user_id") % 20).alias("worktree"), F.col("user_id").alias("agent"), "ts")
    return ops.activity_sessions(log, ["worktree", "agent"], 12 * 3600)
