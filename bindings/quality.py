from pyspark.sql import functions as F

from ashlar.functions.text import DATA_CLASS_PATTERNS, SECRET_PATTERN
from ashlar.operators import quality as ops
from ashlar.plans.quantiles import exact_percentiles
from bindings.registry import query

BLOCKED = ["capacity", "latency", "volume", "ratio", "isolation", "cost", "audit"]


def event_marks(t):
    return t.events.select(
        F.col("user_id").alias("store"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("type"),
        (F.col("event_type") == "purchase").alias("good"),
        (F.col("event_type") == "error").alias("failed"),
    )


@query(
    "c1_stable_core",
    """
WITH e AS (SELECT DISTINCT l_returnflag AS decision, l_suppkey % 3 AS candidate, l_partkey AS element FROM lineitem),
t AS (SELECT decision, count(DISTINCT candidate) AS total FROM e GROUP BY decision)
SELECT decision, element, count(*) AS held_by, string_agg(candidate::VARCHAR, ',' ORDER BY candidate) AS candidates,
  CASE WHEN count(*) = any_value(total) THEN 'adopt' ELSE 'decide' END AS verdict
FROM e JOIN t USING (decision) GROUP BY decision, element""",
)
def c1(t):
    elements = t.lineitem.select(
        F.col("l_returnflag").alias("decision"),
        (F.col("l_suppkey") % 3).alias("candidate"),
        F.col("l_partkey").alias("element"),
    )
    return ops.stable_core(elements).withColumn("candidates", F.concat_ws(",", F.col("candidates").cast("array<string>")))


@query(
    "c2_independence_check",
    """
WITH c AS (SELECT l_orderkey AS decision, l_linenumber AS candidate, l_returnflag AS principle FROM lineitem),
s AS (SELECT decision, principle, count(DISTINCT candidate) AS sharers FROM c GROUP BY ALL HAVING count(DISTINCT candidate) > 1)
SELECT decision, candidate, principle, sharers FROM c JOIN s USING (decision, principle)""",
)
def c2(t):
    return ops.independence_check(
        t.lineitem.select(
            F.col("l_orderkey").alias("decision"),
            F.col("l_linenumber").alias("candidate"),
            F.col("l_returnflag").alias("principle"),
        )
    )


@query(
    "c3_attribute_coverage",
    f"""
WITH said AS (
  SELECT DISTINCT l_suppkey AS candidate, {BLOCKED!r}[l_linenumber] AS attribute FROM lineitem
  WHERE l_quantity >= 49.5 AND l_discount > 0.07 OR l_tax = 0.08 AND l_quantity > 45 AND l_discount < 0.02),
pairs AS (SELECT s_suppkey AS candidate, unnest({BLOCKED!r}) AS attribute FROM supplier)
SELECT * FROM pairs EXCEPT SELECT * FROM said""",
)
def c3(t):
    names = F.array(*[F.lit(a) for a in BLOCKED])
    recorded = t.lineitem.select(
        F.col("l_suppkey").alias("candidate"),
        F.element_at(names, F.col("l_linenumber")).alias("attribute"),
        F.when((F.col("l_quantity") >= 49.5) & (F.col("l_discount") > 0.07), F.col("l_quantity")).alias("target"),
        ((F.col("l_tax") == 0.08) & (F.col("l_quantity") > 45) & (F.col("l_discount") < 0.02)).alias("not_a_driver"),
    )
    return ops.attribute_coverage(t.supplier.select(F.col("s_suppkey").alias("candidate")), BLOCKED, recorded)


TARGETS = "VALUES ('balance', '>=', 4500.0, 0.2), ('lowest', '>=', 800.0, 0.5), ('suppliers', '<=', 4.0, 0.3)"


def measured(t):
    nation = t.supplier.groupBy(F.col("s_nationkey").alias("candidate")).agg(
        (F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("balance"),
        F.min("s_acctbal").alias("lowest"),
        F.count(F.lit(1)).cast("double").alias("suppliers"),
    )
    return nation.unpivot("candidate", ["balance", "lowest", "suppliers"], "attribute", "value")


def verdicts(t):
    types = "attribute STRING, op STRING, target DOUBLE, margin DOUBLE"
    targets = t.spark.sql(f"SELECT * FROM {TARGETS} AS v(attribute, op, target, margin)").select(
        *[F.col(c.split()[0]).cast(c.split()[1].lower()).alias(c.split()[0]) for c in types.split(", ")]
    )
    return ops.verdict_matrix(measured(t), targets)


VERDICTS = f"""
n AS (
  SELECT s_nationkey AS candidate, sum(s_acctbal::DECIMAL(18,2))::DOUBLE / count(*) AS balance,
    min(s_acctbal) AS lowest, count(*)::DOUBLE AS suppliers FROM supplier GROUP BY 1),
m AS (UNPIVOT n ON balance, lowest, suppliers INTO NAME attribute VALUE value),
v AS (
  SELECT candidate, m.attribute, value, CASE WHEN miss <= 0 THEN 'meets' WHEN miss <= target * margin THEN 'risks' ELSE 'fails' END AS verdict
  FROM (SELECT m.*, target, margin, CASE WHEN op = '<=' THEN value - target ELSE target - value END AS miss
        FROM m JOIN (SELECT attribute, op, target::DOUBLE AS target, margin::DOUBLE AS margin
          FROM ({TARGETS}) v(attribute, op, target, margin)) t ON m.attribute = t.attribute) m)"""


@query("c4_verdict_matrix", f"WITH {VERDICTS} SELECT candidate, attribute, round(value, 4) AS value, verdict FROM v")
def c4(t):
    return verdicts(t).withColumn("value", F.round("value", 4))


@query(
    "c4_verdict_grid",
    f"""WITH {VERDICTS}
SELECT candidate, max(verdict) FILTER (attribute = 'balance') AS balance, max(verdict) FILTER (attribute = 'lowest') AS lowest,
  max(verdict) FILTER (attribute = 'suppliers') AS suppliers FROM v GROUP BY candidate""",
)
def c4_grid(t):
    return ops.verdict_grid(verdicts(t), ["balance", "lowest", "suppliers"])


@query(
    "c5_prune_candidates",
    f"""WITH {VERDICTS}
SELECT candidate, coalesce(string_agg(attribute, ',' ORDER BY attribute) FILTER (verdict = 'fails' AND attribute IN ('lowest', 'suppliers')), '') AS reasons,
  count_if(verdict = 'fails' AND attribute IN ('lowest', 'suppliers')) = 0 AS kept FROM v GROUP BY candidate""",
)
def c5(t):
    return ops.prune_candidates(verdicts(t), ["lowest", "suppliers"]).withColumn("reasons", F.concat_ws(",", "reasons"))


SOURCED = f"""
s AS (
  SELECT attribute, op, target::DOUBLE AS target, margin::DOUBLE AS margin, 'ledger ' || attribute AS source
  FROM ({TARGETS}) v(attribute, op, target, margin)),
x AS (
  SELECT v.candidate, v.attribute, v.value, v.verdict, v.attribute || ' ' || v.value::DECIMAL(28,2)
    || CASE WHEN verdict = 'meets' THEN ' meets ' || op || ' ' || target::DECIMAL(28,2)
       ELSE ' misses ' || op || ' ' || target::DECIMAL(28,2) || ' by ' || abs(v.value - target)::DECIMAL(28,2)
         || CASE verdict WHEN 'risks' THEN ', within ' ELSE ', beyond ' END || round(margin * 100)::BIGINT || ' %' END
    || ' (' || source || ')' AS justification
  FROM v JOIN s ON s.attribute = v.attribute)"""


def justified(t):
    targets = t.spark.sql(f"SELECT * FROM {TARGETS} AS v(attribute, op, target, margin)").select(
        "attribute", "op", F.col("target").cast("double").alias("target"), F.col("margin").cast("double").alias("margin"),
        F.concat(F.lit("ledger "), F.col("attribute")).alias("source"),
    )
    return ops.justified(verdicts(t), targets)


@query("c4_verdict_justified", f"WITH {VERDICTS}, {SOURCED} SELECT candidate, attribute, round(value, 4) AS value, verdict, justification FROM x")
def c4_justified(t):
    return justified(t).withColumn("value", F.round("value", 4))


@query(
    "c5_prune_justified",
    f"""WITH {VERDICTS}, {SOURCED}
SELECT candidate, coalesce(string_agg(justification, '; ' ORDER BY justification) FILTER (verdict = 'fails' AND attribute IN ('lowest', 'suppliers')), '') AS reasons,
  count_if(verdict = 'fails' AND attribute IN ('lowest', 'suppliers')) = 0 AS kept FROM x GROUP BY candidate""",
)
def c5_justified(t):
    pruned = ops.prune_candidates(justified(t), ["lowest", "suppliers"], "justification")
    return pruned.withColumn("reasons", F.concat_ws("; ", "reasons"))


@query(
    "c6_request_rates",
    """
WITH c AS (SELECT event_type AS key, time_bucket(INTERVAL 1 HOUR, ts) AS b, count(*) AS n FROM events GROUP BY ALL),
g AS (SELECT unnest(generate_series(min(b), max(b), INTERVAL 1 HOUR)) AS b FROM c),
f AS (SELECT k.key, g.b, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT key FROM c) k CROSS JOIN g LEFT JOIN c ON c.key = k.key AND c.b = g.b)
SELECT key, sum(n)::BIGINT AS requests, max(n) AS peak, round(avg(n), 6) AS sustained, round(quantile_cont(n::DOUBLE, 0.5), 4) AS p50,
  round(quantile_cont(n::DOUBLE, 0.95), 4) AS p95, max(n) * 10 AS peak_10x FROM f GROUP BY key""",
)
def c6(t):
    rates = ops.request_rates(t.events.select(F.col("event_type").alias("key"), "ts"), "1 hour", 3600)
    return rates.withColumns(
        {"sustained": F.round("sustained", 6), "p50": F.round("p50", 4), "p95": F.round("p95", 4)}
    )


def hops(t):
    return t.lineitem.select("l_orderkey", "l_quantity").join(
        t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey")
    )


@query(
    "c7_path_latency",
    """
WITH r AS (
  SELECT o_orderpriority AS path, l_orderkey, sum(l_quantity) AS latency
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT path, count(*) AS n, round(quantile_cont(latency, 0.5), 4) AS p50, round(quantile_cont(latency, 0.99), 4) AS p99
FROM r GROUP BY path""",
)
def c7(t):
    rows = hops(t).select(
        F.col("o_orderpriority").alias("path"), F.col("l_orderkey").alias("request"), F.col("l_quantity").alias("latency")
    )
    return ops.path_latency(rows).withColumns({"p50": F.round("p50", 4), "p99": F.round("p99", 4)})


def split_rows(t):
    return hops(t).select(
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.col("l_orderkey").alias("request"),
        F.col("l_quantity").alias("latency"),
    )


@query(
    "c8_workload_split",
    """
WITH r AS (
  SELECT o_orderpriority AS priority, o_orderstatus AS status, l_orderkey, sum(l_quantity) AS latency
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT (grouping(priority) + grouping(status))::INTEGER AS level, priority, status, count(*) AS n,
  round(quantile_cont(latency, 0.5), 4) AS p50, round(quantile_cont(latency, 0.99), 4) AS p99
FROM r GROUP BY ROLLUP (priority, status)""",
)
def c8(t):
    split = ops.workload_split(split_rows(t), ["priority", "status"])
    return split.withColumns({"p50": F.round("p50", 4), "p99": F.round("p99", 4)})


@query("c8_workload_split_approx")
def c8_approx(t):
    return ops.workload_split_approx(split_rows(t), ["priority", "status"])


@query(
    "c9_volume_growth",
    """
WITH cut AS (SELECT max(o_orderdate) - INTERVAL 3 YEAR AS c FROM orders),
v AS (
  SELECT o_orderstatus AS key, date_trunc('month', o_orderdate)::TIMESTAMP AS period, count(*) AS rows,
    count_if(o_orderdate < (SELECT c FROM cut))::BIGINT AS past_retention FROM orders GROUP BY ALL)
SELECT *, rows - lag(rows) OVER w AS growth, (sum(rows) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS total
FROM v WINDOW w AS (PARTITION BY key ORDER BY period)""",
)
def c9(t):
    rows = t.orders.select(F.col("o_orderstatus").alias("key"), F.col("o_orderdate").alias("ts"))
    return ops.volume_growth(rows, "month", "3 YEARS")


@query(
    "c10_read_write_profile",
    """
WITH c AS (
  SELECT user_id AS key, count_if(event_type IN ('view', 'click'))::BIGINT AS reads,
    count_if(event_type IN ('purchase', 'signup'))::BIGINT AS writes FROM events GROUP BY 1)
SELECT *, CASE WHEN writes > 0 THEN round(reads / writes, 6) END AS ratio,
  (reads >= 1.5 * writes OR writes >= 1.5 * reads) AND reads + writes > 0 AS split FROM c""",
)
def c10(t):
    rows = t.events.select(F.col("user_id").alias("key"), F.col("event_type").alias("kind"))
    profile = ops.read_write_profile(rows, ["view", "click"], ["purchase", "signup"], 1.5)
    return profile.withColumn("ratio", F.round("ratio", 6))


@query(
    "c11_hot_spots",
    """
WITH c AS (SELECT l_returnflag AS grp, l_partkey AS key, count(*) AS hits FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY hits DESC, key)::INTEGER AS rank, sum(hits) OVER (PARTITION BY grp) AS t FROM c)
SELECT grp, key, rank, hits, round(hits / t, 8)::DOUBLE AS share FROM r WHERE rank <= 10""",
)
def c11(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("grp"), F.col("l_partkey").alias("key"))
    return ops.hot_spots(rows, 10).withColumn("share", F.round("share", 8))


@query(
    "c12_heavy_keys",
    """
WITH c AS (SELECT o_orderpriority AS grp, o_custkey AS key, count(*) AS hits FROM orders GROUP BY ALL),
t AS (SELECT *, sum(hits) OVER (PARTITION BY grp) AS total FROM c)
SELECT grp, key, hits, hits / total AS share FROM t WHERE hits * 1200 > total""",
)
def c12_exact(t):
    return ops.heavy_keys(t.orders.select(F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("key")), 1200)


@query("c12_heavy_keys_approx")
def c12(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("grp"), F.col("l_partkey").alias("key"))
    return ops.heavy_keys_approx(rows)


@query(
    "c13_availability",
    """
WITH c AS (
  SELECT user_id % 10 AS component, date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS calls,
    count_if(event_type = 'error')::BIGINT AS failures FROM events GROUP BY ALL)
SELECT *, round(1 - failures / calls, 6) AS ratio, CASE WHEN failures > 0 THEN round(-log10(failures / calls), 6) END AS nines,
  1 - failures / calls >= 0.8 AS met FROM c""",
)
def c13(t):
    rows = t.events.select(
        (F.col("user_id") % 10).alias("component"), "ts", (F.col("event_type") == "error").alias("failed")
    )
    return ops.availability(rows, "day", 0.8).withColumns(
        {"ratio": F.round("ratio", 6), "nines": F.round("nines", 6)}
    )


@query(
    "c14_recovery_times",
    """
WITH m AS (SELECT user_id AS store, ts, event_id, event_type = 'purchase' AS good FROM events WHERE event_type IN ('purchase', 'error')),
p AS (
  SELECT *, lag(good) OVER w AS prev_good,
    min(CASE WHEN good THEN ts END) OVER (PARTITION BY store ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_good
  FROM m WINDOW w AS (PARTITION BY store ORDER BY ts, event_id)),
s AS (
  SELECT store, count_if(NOT good AND coalesce(prev_good, true))::BIGINT AS outages,
    count_if(NOT good AND coalesce(prev_good, true) AND next_good IS NULL)::BIGINT AS open,
    max(CASE WHEN NOT good AND coalesce(prev_good, true) THEN epoch_us(next_good) - epoch_us(ts) END) / 1000000.0 AS rto_s,
    max(CASE WHEN good THEN epoch_us(next_good) - epoch_us(ts) END) / 1000000.0 AS rpo_s
  FROM p GROUP BY store)
SELECT *, rto_s <= 86400.0 AS rto_met, rpo_s <= 172800.0 AS rpo_met FROM s""",
)
def c14(t):
    return ops.recovery_times(event_marks(t), 86400.0, 172800.0)


@query(
    "c15_degraded_share",
    """
WITH k AS (
  SELECT event_type AS type, last_value(CASE event_type WHEN 'error' THEN true WHEN 'purchase' THEN false END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS down FROM events),
c AS (SELECT type, count_if(coalesce(down, false))::BIGINT AS inside, count_if(NOT coalesce(down, false))::BIGINT AS outside FROM k GROUP BY type)
SELECT *, round(inside / (inside + outside), 6) AS share FROM c""",
)
def c15(t):
    return ops.degraded_share(event_marks(t)).withColumn("share", F.round("share", 6))


@query(
    "c16_duplicate_writes",
    """
SELECT l_orderkey, l_linenumber, count(*) AS copies, count(DISTINCT (l_returnflag, l_linestatus, l_tax)) AS payloads,
  CASE WHEN count(DISTINCT (l_returnflag, l_linestatus, l_tax)) > 1 THEN 'conflict' ELSE 'replay' END AS kind
FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
)
def c16(t):
    return ops.duplicate_writes(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_returnflag", "l_linestatus", "l_tax"])


@query(
    "c17_idempotent_consume",
    """
SELECT user_id, event_type, date_trunc('hour', ts)::TIMESTAMP AS hour, event_id, ts, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type, hour ORDER BY ts, event_id) = 1""",
)
def c17(t):
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    rows = t.events.select("user_id", "event_type", hour.alias("hour"), "event_id", "ts", "value")
    return ops.idempotent_consume(rows, ["user_id", "event_type", "hour"], ["ts", "event_id"])


@query(
    "c18_retry_outcomes",
    """
WITH a AS (
  SELECT user_id AS key, date_trunc('day', ts)::TIMESTAMP AS day, ts, event_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS outcome,
    json_extract(props, '$.k')::INTEGER < 50 AS retryable FROM events)
SELECT key, day, count(*) AS attempts, arg_max(outcome, (ts, event_id)) AS final,
  count_if(outcome = 'error' AND retryable)::BIGINT AS retryable_errors, count_if(outcome = 'error' AND NOT retryable)::BIGINT AS terminal_errors,
  arg_min(outcome, (ts, event_id)) = 'ok' AS first_try FROM a GROUP BY key, day""",
)
def c18(t):
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    attempts = t.events.select(
        F.struct(F.col("user_id").alias("key"), day.alias("day")).alias("key"),
        "ts",
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("outcome"),
        (F.get_json_object("props", "$.k").cast("int") < 50).alias("retryable"),
    )
    return ops.retry_outcomes(attempts).select("key.*", "attempts", "final", "retryable_errors", "terminal_errors", "first_try")


@query(
    "c19_truth_owners",
    """
WITH c AS (
  SELECT p_partkey AS entity, count_if(l_quantity = 50) AS t, count_if(l_quantity < 50 AND l_discount = 0.1) AS d
  FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)
SELECT entity, 'no truth' AS problem, 0::BIGINT AS claims FROM c WHERE t = 0
UNION ALL SELECT entity, 'several truths', t::BIGINT FROM c WHERE t > 1
UNION ALL SELECT entity, 'copy without bound', d::BIGINT FROM c WHERE d > 0""",
)
def c19(t):
    claims = t.lineitem.select(
        F.col("l_partkey").alias("entity"),
        F.when(F.col("l_quantity") == 50, "truth").otherwise("derived").alias("role"),
        F.when(F.col("l_discount") != 0.1, F.lit(60)).alias("staleness_bound"),
    )
    return ops.truth_owners(t.part.select(F.col("p_partkey").alias("entity")), claims)


@query(
    "c20_staleness_audit",
    """
WITH s AS (
  SELECT user_id AS key, event_id AS id, ts, event_type,
    max(CASE WHEN event_type = 'click' THEN ts END) OVER w AS refreshed, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER w AS written
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT key, id, ts, (epoch_us(ts) - epoch_us(refreshed)) / 1000000.0 AS age_s,
  refreshed IS NULL OR coalesce(written > refreshed, false) OR epoch_us(ts) - epoch_us(refreshed) > 86400000000 AS stale
FROM s WHERE event_type = 'view'""",
)
def c20(t):
    def of(kind):
        return t.events.filter(F.col("event_type") == kind).select(
            F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id")
        )

    return ops.staleness_audit(of("view"), of("click"), of("purchase"), 86400.0)


def _hits(names):
    return " + ".join(f"len(regexp_extract_all(text, '{DATA_CLASS_PATTERNS[n]}'))" for n in names)


CLASSIFIED = f"""
c AS (
  SELECT doc_id, source AS store, ({_hits(ops.DATA_CLASSES['pii'])})::BIGINT AS pii, ({_hits(ops.DATA_CLASSES['payment'])})::BIGINT AS payment,
    ({_hits(ops.DATA_CLASSES['health'])})::BIGINT AS health FROM documents),
k AS (SELECT *, CASE WHEN health > 0 THEN 'health' WHEN payment > 0 THEN 'payment' WHEN pii > 0 THEN 'pii' ELSE 'none' END AS class FROM c)"""


def classified(t):
    return ops.classify_text(t.documents.select("doc_id", F.col("source").alias("store"), "text")).drop("text")


@query("c21_classify_text", f"WITH {CLASSIFIED} SELECT * FROM k")
def c21(t):
    return classified(t)


ALLOWED = "VALUES ('pii', 'src1'), ('pii', 'src2'), ('pii', 'src3'), ('payment', 'src1'), ('payment', 'src4'), ('health', 'src5')"


@query(
    "c22_placement_check",
    f"WITH {CLASSIFIED} SELECT * FROM k WHERE class <> 'none' AND (class, store) NOT IN (SELECT * FROM ({ALLOWED}) v(class, store))",
)
def c22(t):
    return ops.placement_check(classified(t), t.spark.sql(f"SELECT * FROM {ALLOWED} AS v(class, store)"))


_SECRET = SECRET_PATTERN.replace("'", "''")


@query(
    "c23_secret_scan",
    f"""
SELECT doc_id, len(regexp_extract_all(text, '{_SECRET}'))::BIGINT AS hits, array_to_string(list_transform(regexp_extract_all(text, '{_SECRET}'), lambda x: sha256(x)), ',') AS digests,
  regexp_replace(text, '{_SECRET}', '[REDACTED]', 'g') AS text FROM documents WHERE regexp_matches(text, '{_SECRET}')""",
)
def c23(t):
    return ops.secret_scan(t.documents.select("doc_id", "text")).withColumn("digests", F.concat_ws(",", "digests"))


@query(
    "c24_audit_gaps",
    """
SELECT o_orderkey AS key, 'no audit' AS gap FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT DISTINCT l_orderkey, 'no write' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
)
def c24(t):
    return ops.audit_gaps(t.orders.select(F.col("o_orderkey").alias("key")), t.lineitem.select(F.col("l_orderkey").alias("key")))


@query(
    "c25_cost_cliffs",
    """
WITH d AS (SELECT o_orderstatus AS system, quantile_cont(o_totalprice, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM orders GROUP BY 1),
r AS (SELECT system, len(list_filter(q, lambda x: x < o_totalprice)) AS level, o_totalprice, o_custkey FROM orders JOIN d ON system = o_orderstatus),
l AS (
  SELECT system, level::INTEGER AS level, count(DISTINCT o_custkey) AS load, count(*)::DOUBLE AS build, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS run
  FROM r GROUP BY ALL),
c AS (SELECT *, build + run AS cost FROM l),
g AS (SELECT *, (cost / lag(cost) OVER w) / (load / lag(load) OVER w) AS growth FROM c WINDOW w AS (PARTITION BY system ORDER BY level))
SELECT system, level, load, build, run, cost, round(growth, 6) AS growth, coalesce(growth >= 1.3, false) AS cliff FROM g""",
)
def c25(t):
    probs = {f"d{i}": i / 10 for i in range(1, 10)}
    cuts = exact_percentiles(t.orders, ["o_orderstatus"], "o_totalprice", probs)
    level = F.size(F.filter(F.array(*probs), lambda x: x < F.col("o_totalprice")))
    levels = (
        t.orders.join(cuts, "o_orderstatus")
        .groupBy(F.col("o_orderstatus").alias("system"), level.alias("level"))
        .agg(
            F.count_distinct("o_custkey").alias("load"),
            F.count(F.lit(1)).cast("double").alias("build"),
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("run"),
        )
    )
    return ops.cost_cliffs(levels, 1.3).withColumn("growth", F.round("growth", 6))


def owners(t):
    return t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_partkey").alias("component"), F.col("s_nationkey").alias("team")
    )


@query(
    "c26_shared_components",
    """
SELECT l_partkey AS component, count(DISTINCT s_nationkey) AS teams FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
GROUP BY 1 HAVING count(DISTINCT s_nationkey) > 1""",
)
def c26(t):
    return ops.shared_components(owners(t))


@query(
    "c26_crossing_edges",
    """
WITH o AS (SELECT l_partkey AS component, s_nationkey AS team, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
m AS (SELECT component, team FROM o QUALIFY row_number() OVER (PARTITION BY component ORDER BY n DESC, team) = 1),
e AS (SELECT DISTINCT l_partkey AS src, l_suppkey * 20 + l_linenumber AS dst FROM lineitem)
SELECT src, dst, a.team AS src_team, b.team AS dst_team FROM e JOIN m a ON a.component = src JOIN m b ON b.component = dst WHERE a.team <> b.team""",
)
def c26_edges(t):
    edges = t.lineitem.select(
        F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 20 + F.col("l_linenumber")).alias("dst")
    ).distinct()
    return ops.crossing_edges(edges, ops.main_team(owners(t)))


@query(
    "c27_skill_gaps",
    """
SELECT DISTINCT s_nationkey AS team, p_type AS skill FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
EXCEPT SELECT c_nationkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'LARGE' WHEN 'BUILDING' THEN 'STANDARD' WHEN 'AUTOMOBILE' THEN 'PROMO' ELSE 'SMALL' END
FROM customer WHERE c_acctbal > 9000""",
)
def c27(t):
    required = (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("s_nationkey").alias("team"), F.col("p_type").alias("skill"))
    )
    segment = F.col("c_mktsegment")
    skill = F.when(segment == "MACHINERY", "LARGE").when(segment == "BUILDING", "STANDARD").when(segment == "AUTOMOBILE", "PROMO")
    present = t.customer.filter(F.col("c_acctbal") > 9000).select(
        F.col("c_nationkey").alias("team"), skill.otherwise("SMALL").alias("skill")
    )
    return ops.skill_gaps(required, present)


HOURLY = "b AS (SELECT event_type AS key, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS value FROM events GROUP BY ALL)"


@query(
    "c28_spikes",
    f"""
WITH {HOURLY},
t AS (
  SELECT *, coalesce(sum(value) OVER (PARTITION BY key ORDER BY bucket RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING), 0) / 24 AS trailing_mean FROM b)
SELECT key, bucket, value, round(trailing_mean, 6) AS trailing_mean FROM t WHERE value > 2 * trailing_mean""",
)
def c28(t):
    buckets = ops.bucket_counts(t.events.withColumnRenamed("event_type", "key"), ["key"], "1 hour")
    return ops.spikes(buckets, 3600, 24, 2.0).withColumn("trailing_mean", F.round("trailing_mean", 6))


@query(
    "c28_peak_to_mean",
    f"WITH {HOURLY} SELECT key, max(value) AS peak, round(max(value) / avg(value), 6) AS peak_to_mean FROM b GROUP BY key",
)
def c28_mean(t):
    buckets = ops.bucket_counts(t.events.withColumnRenamed("event_type", "key"), ["key"], "1 hour")
    return ops.peak_to_mean(buckets).withColumn("peak_to_mean", F.round("peak_to_mean", 6))
