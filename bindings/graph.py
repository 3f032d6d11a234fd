from pyspark.sql import functions as F

from ashlar.operators import graph as ops
from bindings.registry import SQL, query

def edges(t):
    src, dst = F.col("l_partkey"), F.col("l_suppkey") * 20 + F.col("l_linenumber")
    mode = F.when(F.col("l_returnflag") == "A", "sync").otherwise("async")
    return t.lineitem.select(src.alias("src"), dst.alias("dst"), F.col("l_returnflag").alias("protocol"), mode.alias("mode"), "l_shipdate")


ALL_EDGES = """
e AS (SELECT DISTINCT l_partkey AS src, l_suppkey * 20 + l_linenumber AS dst FROM lineitem)"""


@query(
    "d1_lift_graph",
    """
SELECT a.p_brand AS "from", b.p_brand AS "to", string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS protocols, count(*) AS relations
FROM lineitem JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = l_suppkey * 20 + l_linenumber
WHERE a.p_brand <> b.p_brand GROUP BY ALL""",
)
def d1(t):
    elements = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("boundary"))
    return ops.lift_graph(elements, edges(t)).withColumn("protocols", F.concat_ws(",", "protocols"))


@query(
    "d2_diagram_lint",
    """
WITH el AS (
  SELECT p_brand AS diagram, p_partkey AS id, p_size % 4 AS k, p_name LIKE 'red%' AS no_name, p_type = 'PROMO' AS no_tech,
    p_retailprice > 950 AS no_resp, p_size % 3 AS level FROM part),
r AS (
  SELECT 'Brand#' || (l_suppkey % 30) AS diagram, l_partkey AS id, CASE l_returnflag WHEN 'A' THEN 'Uses' WHEN 'R' THEN 'Sends' END AS verb,
    l_discount < 0.02 AS no_protocol, l_tax = 0 AS no_mode FROM lineitem)
SELECT diagram, id AS item, 'no name' AS rule FROM el WHERE no_name
UNION ALL SELECT diagram, id, 'no technology' FROM el WHERE no_tech AND k IN (1, 2, 3)
UNION ALL SELECT diagram, id, 'no responsibility' FROM el WHERE no_resp
UNION ALL SELECT diagram, id, 'no verb' FROM r WHERE verb IS NULL
UNION ALL SELECT diagram, id, 'no protocol' FROM r WHERE no_protocol
UNION ALL SELECT diagram, id, 'uses alone' FROM r WHERE verb = 'Uses' AND no_protocol
UNION ALL SELECT diagram, id, 'sync or async not marked' FROM r WHERE no_mode
UNION ALL SELECT diagram, NULL, 'mixed levels' FROM el GROUP BY diagram HAVING count(DISTINCT level) > 1
UNION ALL SELECT p_brand, NULL, 'long legend' FROM part GROUP BY p_brand HAVING max(p_size) > 49""",
)
def d2(t):
    size, price = F.col("p_size"), F.col("p_retailprice")
    kinds = F.array(*[F.lit(k) for k in ["person", "container", "database", "queue"]])
    elements = t.part.select(
        F.col("p_brand").alias("diagram"),
        F.col("p_partkey").alias("id"),
        F.element_at(kinds, size % 4 + 1).alias("kind"),
        F.when(~F.col("p_name").startswith("red"), F.col("p_name")).otherwise(" ").alias("name"),
        F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("technology"),
        F.when(price <= 950, "keeps stock").alias("responsibility"),
        (size % 3).alias("level"),
    )
    flag = F.col("l_returnflag")
    rels = t.lineitem.select(
        F.concat(F.lit("Brand#"), F.col("l_suppkey") % 30).alias("diagram"),
        F.col("l_partkey").alias("id"),
        F.when(flag == "A", "Uses").when(flag == "R", "Sends").alias("verb"),
        F.when(F.col("l_discount") >= 0.02, "HTTPS").alias("protocol"),
        F.when(F.col("l_tax") != 0, "sync").otherwise("both").alias("mode"),
    )
    diagrams = t.part.groupBy(F.col("p_brand").alias("diagram")).agg(
        F.when(F.max("p_size") > 49, "a\nb\nc\nd").otherwise("a\nb\nc").alias("legend")
    )
    return ops.diagram_lint(diagrams, elements, rels)


@query(
    "d3_levels_needed",
    """
WITH c AS (
  SELECT l_orderkey AS design, count(DISTINCT l_suppkey) AS n, arg_max(l_suppkey, (l_extendedprice, -l_suppkey)) AS top FROM lineitem GROUP BY 1)
SELECT o_orderkey AS design, 1 AS level, NULL::BIGINT AS container FROM orders
UNION ALL SELECT design, 2, NULL FROM c JOIN orders ON design = o_orderkey WHERE n > 1
UNION ALL SELECT design, 3, top FROM c JOIN orders ON design = o_orderkey""",
)
def d3(t):
    containers = t.lineitem.select(
        F.col("l_orderkey").alias("design"), F.col("l_suppkey").alias("container"), F.col("l_extendedprice").alias("risk")
    )
    return ops.levels_needed(t.orders.select(F.col("o_orderkey").alias("design")), containers)


@query(
    "d4_cycle_members",
    f"""
WITH RECURSIVE {ALL_EDGES},
reach(a, b) AS (
  SELECT src, dst FROM e WHERE src IN (SELECT dst FROM e)
  UNION SELECT r.a, e.dst FROM reach r JOIN e ON e.src = r.b)
SELECT x.a AS node, min(x.b) AS grp FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a""",
)
def d4(t):
    return ops.cycle_members(edges(t))


query("d4_cycle_members_whole", SQL["d4_cycle_members"])(d4)


@query(
    "d5_direction_violations",
    """
SELECT DISTINCT l_partkey AS src, l_suppkey * 20 + l_linenumber AS dst, a.p_size % 4 AS src_rank, b.p_size % 4 AS dst_rank, a.p_size % 4 = 0 AS core
FROM lineitem JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = l_suppkey * 20 + l_linenumber WHERE a.p_size % 4 < b.p_size % 4""",
)
def d5(t):
    layers = t.part.select(F.col("p_partkey").alias("node"), (F.col("p_size") % 4).alias("rank"))
    return ops.direction_violations(edges(t), layers)


@query(
    "d6_foreign_table_access",
    """
WITH o AS (SELECT l_partkey AS tbl, min(l_suppkey) AS owner FROM lineitem GROUP BY 1)
SELECT l_suppkey AS service, l_partkey AS "table", count(*) AS touches, owner
FROM lineitem JOIN o ON tbl = l_partkey WHERE l_suppkey <> owner GROUP BY ALL""",
)
def d6(t):
    access = t.lineitem.select(F.col("l_suppkey").alias("service"), F.col("l_partkey").alias("table"))
    return ops.foreign_table_access(access, access.groupBy("table").agg(F.min("service").alias("owner")))


@query(
    "d6_shared_tables",
    'SELECT l_partkey AS "table", count(DISTINCT l_suppkey) AS writers FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1',
)
def d6_shared(t):
    return ops.shared_tables(t.lineitem.select(F.col("l_suppkey").alias("service"), F.col("l_partkey").alias("table")))


# Each release date is a change that touches what was released on it.
BLAST = f"""
WITH RECURSIVE {ALL_EDGES},
o AS (SELECT l_shipdate AS change, row_number() OVER (ORDER BY l_shipdate) - 1 AS ordinal FROM (SELECT DISTINCT l_shipdate FROM lineitem)),
s AS (SELECT DISTINCT ordinal, l_suppkey * 20 + l_linenumber AS node FROM lineitem JOIN o ON l_shipdate = change),
walk(ordinal, node, hops) USING KEY (ordinal, node) AS (
  SELECT ordinal, node, 0 FROM s
  UNION
  SELECT w.ordinal, e.src, min(w.hops + 1) FROM walk w JOIN e ON e.dst = w.node
  LEFT JOIN recurring.walk r ON r.ordinal = w.ordinal AND r.node = e.src WHERE r.node IS NULL GROUP BY w.ordinal, e.src)"""


def releases(t):
    graph = edges(t)
    return graph, graph.select(F.col("l_shipdate").alias("change"), F.col("dst").alias("node"))


@query(
    "d7_blast_radius",
    f"""{BLAST},
b AS (
  SELECT node, hops, ordinal // 64 AS word, bit_or(1::UBIGINT << (ordinal % 64)::UBIGINT) AS bits, count(*) AS changes
  FROM walk WHERE hops > 0 GROUP BY ALL)
SELECT node, hops::INTEGER AS hops, word, (bits::HUGEINT - CASE WHEN bits >= 9223372036854775808 THEN 18446744073709551616 ELSE 0 END)::BIGINT AS bits,
  changes::INTEGER AS changes FROM b""",
)
def d7(t):
    return ops.blast_bitmaps(*releases(t))


@query("d7_blast_radius_whole")
def d7_whole(t):
    """The same rows written out, one for each change and node."""
    return ops.blast_radius(*releases(t))


@query(
    "d7_blast_sizes",
    f"{BLAST} SELECT change, hops::INTEGER AS hops, count(*) AS nodes FROM walk JOIN o USING (ordinal) WHERE hops > 0 GROUP BY ALL",
)
def d7_sizes(t):
    return ops.blast_sizes(*releases(t))


@query(
    "d8_failure_domains",
    f"""
WITH RECURSIVE {ALL_EDGES},
u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
cc(node, domain) USING KEY (node) AS (
  SELECT DISTINCT a, a FROM u
  UNION
  SELECT u.a, min(c.domain) FROM u JOIN cc c ON c.node = u.b JOIN recurring.cc r ON r.node = u.a WHERE c.domain < r.domain GROUP BY u.a)
SELECT node, domain FROM cc""",
)
def d8(t):
    return ops.failure_domains(edges(t))


@query(
    "d9_undeclared_dependencies",
    """
WITH d AS (SELECT p_partkey AS dep, p_partkey AS num FROM part WHERE p_size <= 40),
m AS (SELECT l_partkey AS dep, min(l_orderkey) AS first_change FROM lineitem ANTI JOIN d ON d.dep = l_partkey GROUP BY 1)
SELECT (SELECT max(num) FROM d) + row_number() OVER (ORDER BY dep) AS num, dep, first_change FROM m""",
)
def d9(t):
    decisions = t.part.filter(F.col("p_size") <= 40).select(F.col("p_partkey").alias("dep"), F.col("p_partkey").alias("num"))
    deps = t.lineitem.select(F.col("l_orderkey").alias("change"), F.col("l_partkey").alias("dep"))
    return ops.undeclared_dependencies(deps, decisions)


def contract_version(t, later):
    side = F.col("p_size") > 25 if later else F.col("p_size") <= 25
    return t.part.filter(side).groupBy(F.col("p_name").alias("contract"), F.col("p_brand").alias("field")).agg(
        F.min("p_type").alias("type"), (F.max("p_retailprice") > 990).alias("required")
    )


@query(
    "d10_contract_diff",
    """
WITH v AS (
  SELECT p_size > 25 AS later, p_name AS contract, p_brand AS field, min(p_type) AS type, max(p_retailprice) > 990 AS required FROM part GROUP BY ALL),
j AS (
  SELECT coalesce(a.contract, b.contract) AS contract, coalesce(a.field, b.field) AS field, a.type AS old_type, b.type AS new_type,
    a.contract IS NULL AS is_new, b.contract IS NULL AS gone, coalesce(b.required, false) AND NOT coalesce(a.required, false) AS tight
  FROM (SELECT * FROM v WHERE NOT later) a FULL JOIN (SELECT * FROM v WHERE later) b ON a.contract = b.contract AND a.field = b.field),
k AS (
  SELECT *, CASE WHEN gone THEN 'removed' WHEN is_new THEN 'added' WHEN old_type <> new_type THEN 'type changed' WHEN tight THEN 'made required' END AS kind FROM j)
SELECT contract, field, old_type, new_type, kind, kind IN ('removed', 'type changed', 'made required') OR tight AS breaking FROM k WHERE kind IS NOT NULL""",
)
def d10(t):
    return ops.contract_diff(contract_version(t, False), contract_version(t, True))


@query(
    "d11_call_policy_gaps",
    """
SELECT * FROM (
  SELECT l_orderkey AS call, concat_ws(',', CASE WHEN l_discount = 0 THEN 'timeout' END, CASE WHEN l_tax = 0 THEN 'retry' END,
    CASE WHEN l_returnflag = 'A' THEN 'failure behaviour' END, CASE WHEN l_linenumber <> 1 THEN 'circuit breaker' END,
    CASE WHEN l_linestatus = 'F' AND l_quantity < 10 THEN 'idempotency key' END) AS missing FROM lineitem) WHERE missing <> ''""",
)
def d11(t):
    calls = t.lineitem.select(
        F.col("l_orderkey").alias("call"),
        F.when(F.col("l_discount") != 0, F.lit(200)).alias("timeout_ms"),
        F.when(F.col("l_tax") != 0, "backoff").otherwise("").alias("retry"),
        F.when(F.col("l_returnflag") != "A", "degrade").alias("on_failure"),
        (F.col("l_linenumber") == 1).alias("breaker"),
        (F.col("l_linestatus") == "F").alias("is_write"),
        F.when(F.col("l_quantity") >= 10, "key").alias("idempotency_key"),
    )
    return ops.call_policy_gaps(calls).withColumn("missing", F.concat_ws(",", "missing"))


@query(
    "d12_fan_out",
    """
WITH n AS (
  SELECT l_partkey AS node, 0 AS i, 1 AS o, (l_returnflag = 'A')::INTEGER AS s FROM lineitem
  UNION ALL SELECT l_suppkey * 20 + l_linenumber, 1, 0, 0 FROM lineitem)
SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, sum(s)::BIGINT AS sync_out, sum(s) > 12 AS high FROM n GROUP BY node""",
)
def d12(t):
    return ops.fan_out(edges(t), 12)


@query(
    "d13_shared_module_growth",
    """
WITH c AS (
  SELECT p_name AS module, year(l_shipdate)::INTEGER AS period, count(DISTINCT l_suppkey) AS importers
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE regexp_matches(p_name, '(widget|bolt)$') GROUP BY ALL),
g AS (SELECT *, importers - lag(importers) OVER (PARTITION BY module ORDER BY period) AS growth FROM c)
SELECT * FROM g WHERE growth > 0""",
)
def d13(t):
    imports = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_name").alias("module"), F.col("l_suppkey").alias("importer"), F.year("l_shipdate").alias("period")
    )
    return ops.shared_module_growth(imports, "(widget|bolt)$")


@query(
    "d14_same_change_check",
    "SELECT l_orderkey AS change FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R') AND NOT bool_or(l_returnflag = 'A')",
)
def d14(t):
    flag = F.col("l_returnflag")
    return ops.same_change_check(
        t.lineitem.select(F.col("l_orderkey").alias("change"), (flag == "R").alias("model"), (flag == "A").alias("diagram"))
    )


@query(
    "d15_saga_reconcile",
    """
WITH c AS (SELECT o_orderkey AS key, min(o_orderdate) AS sent FROM orders GROUP BY 1),
s AS (SELECT l_orderkey AS key, l_shipdate - INTERVAL 10 DAY AS ts FROM lineitem WHERE l_returnflag <> 'N'),
d AS (SELECT s.key, min(ts) AS done FROM s JOIN c ON c.key = s.key AND ts >= sent GROUP BY 1)
SELECT c.key, sent, done, CASE WHEN done IS NULL THEN 'missing step' WHEN done > sent + INTERVAL 30 DAY THEN 'late step' ELSE 'complete' END AS state
FROM c LEFT JOIN d ON c.key = d.key
UNION ALL SELECT s.key, NULL, min(ts), 'orphan step' FROM s LEFT JOIN c ON c.key = s.key WHERE sent IS NULL OR ts < sent GROUP BY 1""",
)
def d15(t):
    commands = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("ts"))
    steps = t.lineitem.filter(F.col("l_returnflag") != "N").select(F.col("l_orderkey").alias("key"), (F.col("l_shipdate") - F.expr("INTERVAL 10 DAYS")).alias("ts"))
    return ops.saga_reconcile(commands, steps, 30 * 86400.0)


def ledger_events(t):
    return t.events.select(
        F.col("user_id").alias("entity"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("status"),
        F.col("value").cast("decimal(18,2)").alias("amount"),
    )


@query(
    "d16_replay_as_of",
    """
SELECT user_id AS entity, arg_max(event_type, (ts, event_id)) AS status, count(*) AS events, sum(value::DECIMAL(18,2))::DOUBLE AS balance
FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY 1""",
)
def d16(t):
    at = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return ops.replay_as_of(ledger_events(t), at).withColumn("balance", F.col("balance").cast("double"))


@query(
    "d16_replay_running",
    """
SELECT user_id AS entity, ts, event_id AS seq, (sum(value::DECIMAL(18,2)) OVER w)::DOUBLE AS balance, count(*) OVER w AS events
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def d16_running(t):
    return ops.replay_running(ledger_events(t)).select("entity", "ts", "seq", F.col("balance").cast("double").alias("balance"), "events")


def subjects(t):
    return t.events.filter((F.col("event_type") == "error") & (F.col("value") > 200)).select("user_id")


SUBJECTS = "s AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 200)"


@query("d17_erase_subjects", f"WITH {SUBJECTS} SELECT * FROM events WHERE user_id NOT IN (SELECT user_id FROM s)")
def d17(t):
    return ops.erase_subjects(t.events, subjects(t), "user_id")


@query(
    "d17_blank_subjects",
    f"""WITH {SUBJECTS}
SELECT event_id, ts, user_id, event_type, CASE WHEN user_id NOT IN (SELECT user_id FROM s) THEN value END AS value,
  CASE WHEN user_id NOT IN (SELECT user_id FROM s) THEN props END AS props FROM events""",
)
def d17_blank(t):
    return ops.erase_subjects(t.events, subjects(t), "user_id", ["value", "props"])


@query(
    "d17_erase_proof",
    f"""WITH {SUBJECTS}
SELECT (SELECT count(*) FROM events) AS rows_before, count(*) AS rows_after, 0::BIGINT AS subject_rows_left, 0::BIGINT AS other_rows_changed
FROM events WHERE user_id NOT IN (SELECT user_id FROM s)""",
)
def d17_proof(t):
    return ops.erase_proof(t.events, ops.erase_subjects(t.events, subjects(t), "user_id"), subjects(t), "user_id")


@query(
    "d18_version_mix",
    """
SELECT event_type AS topic, date_trunc('day', ts)::TIMESTAMP AS period, (json_extract(props, '$.k')::INTEGER // 25)::INTEGER AS version,
  count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY ALL""",
)
def d18(t):
    version = F.floor(F.get_json_object("props", "$.k").cast("int") / 25).cast("int")
    return ops.version_mix(t.events.select(F.col("event_type").alias("topic"), "ts", version.alias("version")), "day")
