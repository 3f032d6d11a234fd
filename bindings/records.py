from pyspark.sql import functions as F

from ashlar.operators import records as ops
from ashlar.plans.scans import last, scan
from bindings.registry import query

STATUS_WORD = "CASE o_orderstatus WHEN 'O' THEN 'proposed' WHEN 'P' THEN 'deprecated' ELSE 'accepted' END"


def record_texts(t):
    num = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("superseded by ADR-"), num + 1)).otherwise(
        F.expr(STATUS_WORD)
    )
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# ADR-"), num, F.lit(": Serve customer "), F.col("o_custkey")),
        F.lit(""),
        F.concat(F.lit("- Status: "), status),
        F.concat(F.lit("- Date: "), F.date_format(F.col("o_orderdate"), "yyyy-MM-dd")),
        F.concat(F.lit("- Deciders: c"), F.col("o_custkey"), F.lit(", board")),
        F.concat(F.lit("- Tags: "), F.lower("o_orderpriority")),
        F.lit(""),
        F.lit("## Context"),
        F.lit(""),
        F.concat(F.lit("Order "), num, F.lit(" must ship.")),
        F.concat(F.lit("Priority is "), F.col("o_orderpriority"), F.lit(".")),
        F.lit(""),
        F.lit("## Decision"),
        F.lit(""),
        F.concat(F.lit("Chosen option: lane "), num % 7),
    )
    return t.orders.select(num.alias("doc_id"), text.alias("text"))


@query(
    "b1_record_headers",
    f"""
SELECT o_orderkey AS doc_id, o_orderkey AS num, 'Serve customer ' || o_custkey AS title,
  CASE WHEN o_orderstatus = 'F' THEN 'superseded' ELSE {STATUS_WORD} END AS status,
  CASE WHEN o_orderstatus = 'F' THEN o_orderkey + 1 END AS superseded_by,
  o_orderdate::DATE AS date, 'c' || o_custkey || '|board' AS deciders, lower(o_orderpriority) AS tags
FROM orders""",
)
def b1_headers(t):
    heads = ops.record_headers(record_texts(t))
    return heads.withColumns({c: F.concat_ws("|", c) for c in ["deciders", "tags"]})


@query(
    "b1_record_lines",
    """
SELECT o_orderkey AS doc_id, section_no, section, line_no, line FROM (
  SELECT o_orderkey, 1 AS section_no, 'Context' AS section, 1 AS line_no, 'Order ' || o_orderkey || ' must ship.' AS line FROM orders
  UNION ALL SELECT o_orderkey, 1, 'Context', 2, 'Priority is ' || o_orderpriority || '.' FROM orders
  UNION ALL SELECT o_orderkey, 2, 'Decision', 1, 'Chosen option: lane ' || (o_orderkey % 7) FROM orders)""",
)
def b1_lines(t):
    return ops.record_lines(record_texts(t))


def successors(t):
    following = scan(
        t.orders,
        ["o_custkey"],
        ["o_orderdate", "o_orderkey"],
        F.year("o_orderdate"),
        {"_next": last(F.col("o_orderkey"), inclusive=False)},
        reverse=True,
    )
    return following.select(
        F.col("o_orderkey").alias("num"),
        F.when(F.col("o_orderstatus") == "F", F.col("_next")).alias("superseded_by"),
        "o_orderpriority",
    )


SUCCESSORS = """
rec AS (
  SELECT o_orderkey AS num, o_orderpriority, CASE WHEN o_orderstatus = 'F'
    THEN lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS superseded_by
  FROM orders)"""


@query(
    "b2_resolve_supersession",
    f"""
WITH RECURSIVE {SUCCESSORS},
walk(num, cur, hops) AS (
  SELECT num, num, 0::BIGINT FROM rec
  UNION ALL SELECT w.num, r.superseded_by, w.hops + 1 FROM walk w JOIN rec r ON r.num = w.cur
  WHERE r.superseded_by IS NOT NULL)
SELECT num, arg_max(cur, hops) AS final, max(hops) AS hops, 'resolved' AS state FROM walk GROUP BY num""",
)
def b2(t):
    return ops.resolve_supersession(successors(t))


@query(
    "b3_link_symmetry",
    f"""
WITH {SUCCESSORS}
SELECT num AS old, superseded_by AS new, 'backward' AS missing FROM rec
WHERE superseded_by IS NOT NULL AND o_orderpriority = '1-URGENT'""",
)
def b3(t):
    forward = successors(t).filter("superseded_by IS NOT NULL").select(
        F.col("num").alias("old"), F.col("superseded_by").alias("new"), "o_orderpriority"
    )
    return ops.link_symmetry(forward, forward.filter(F.col("o_orderpriority") != "1-URGENT"))


@query(
    "b4_number_gaps",
    """
WITH used AS (SELECT l_orderkey AS series, l_linenumber::BIGINT AS n, count(*) AS copies FROM lineitem GROUP BY ALL),
seen AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY series ORDER BY n), 0) AS prev FROM used)
SELECT series, 'gap' AS kind, prev + 1 AS from_n, n - 1 AS to_n, 0::BIGINT AS copies FROM seen WHERE n - prev > 1
UNION ALL SELECT series, 'duplicate', n, n, copies FROM seen WHERE copies > 1""",
)
def b4(t):
    return ops.number_gaps(t.lineitem.select(F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("n")))


@query(
    "b5_record_lint",
    """
WITH options AS (
  SELECT l_orderkey AS num, l_suppkey AS option, min(l_linenumber) = 1 AS chosen,
    CASE WHEN max(l_discount) > 0.02 THEN 'dearer' END AS reason FROM lineitem GROUP BY ALL),
o AS (SELECT num, count(*) AS n, count_if(NOT chosen AND reason IS NULL) AS silent FROM options GROUP BY num),
s AS (
  SELECT DISTINCT l_orderkey AS num FROM lineitem WHERE (l_orderkey, l_returnflag) NOT IN
    (SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_tax > 0.01)),
r AS (SELECT DISTINCT l_orderkey AS num FROM lineitem WHERE l_quantity >= 45),
rec AS (
  SELECT o_orderkey AS num, o_orderstatus, o_orderpriority, coalesce(n, 0) AS n, coalesce(silent, 0) AS silent,
    s.num IS NOT NULL AS loose, r.num IS NOT NULL AS risky
  FROM orders LEFT JOIN o ON o.num = o_orderkey LEFT JOIN s ON s.num = o_orderkey LEFT JOIN r ON r.num = o_orderkey)
SELECT num, 'status outside domain' AS rule FROM rec WHERE o_orderstatus = 'P'
UNION ALL SELECT num, 'no change triggers' FROM rec WHERE o_orderpriority = '5-LOW'
UNION ALL SELECT num, 'two decisions in title' FROM rec WHERE o_orderpriority = '2-HIGH'
UNION ALL SELECT num, 'options outside 2-3' FROM rec WHERE n < 2 OR n > 3
UNION ALL SELECT num, 'trade-off row names no driver' FROM rec WHERE loose
UNION ALL SELECT num, 'rejected option without reason' FROM rec WHERE silent > 0
UNION ALL SELECT num, 'risk class outside domain' FROM rec WHERE risky""",
)
def b5(t):
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    records = t.orders.select(
        F.col("o_orderkey").alias("num"),
        F.when(priority == "2-HIGH", "Ship AND bill").otherwise("Ship the brandy").alias("title"),
        F.when(status == "F", "accepted").when(status == "O", "proposed").otherwise("draft").alias("status"),
        F.when(priority == "5-LOW", " ").otherwise("load > 5k rps").alias("change_triggers"),
    )
    lines = t.lineitem.withColumnRenamed("l_orderkey", "num")
    options = lines.groupBy("num", F.col("l_suppkey").alias("option")).agg(
        (F.min("l_linenumber") == 1).alias("chosen"),
        F.when(F.max("l_discount") > 0.02, "dearer").alias("reason"),
    )
    scores = lines.select("num", F.col("l_returnflag").alias("driver"))
    drivers = lines.filter(F.col("l_tax") > 0.01).select("num", F.col("l_returnflag").alias("driver"))
    risks = lines.select("num", F.when(F.col("l_quantity") >= 45, "unknown").otherwise("mitigable").alias("class"))
    return ops.record_lint(records, options, scores, drivers, risks)


@query(
    "b6_tradeoff_matrix",
    """
SELECT l_returnflag AS driver, l_linestatus AS status, """
    + ", ".join(
        f"round(avg(CASE WHEN l_linenumber = {i} THEN l_discount::DECIMAL(18,2) END)::DOUBLE, 4) AS option_{i}"
        for i in range(1, 8)
    )
    + " FROM lineitem GROUP BY ALL",
)
def b6(t):
    scores = t.lineitem.select(
        F.col("l_returnflag").alias("driver"),
        F.col("l_linestatus").alias("status"),
        F.col("l_linenumber").alias("option"),
        F.col("l_discount").cast("decimal(18,2)").alias("score"),
    )
    grid = ops.tradeoff_matrix(scores, range(1, 8), by=["driver", "status"])
    cells = [F.round(F.col(f"`{i}`").cast("double"), 4).alias(f"option_{i}") for i in range(1, 8)]
    return grid.select("driver", "status", *cells)


@query(
    "b7_rejected_options",
    """
WITH options AS (
  SELECT l_orderkey AS record, l_suppkey AS option, max(l_discount) AS d FROM lineitem GROUP BY ALL),
chosen AS (
  SELECT l_orderkey AS record, l_suppkey AS option FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_suppkey) = 1)
SELECT o.record, o.option, CASE WHEN d > 0.05 THEN 'discount ' || (round(d * 100))::BIGINT END AS reason
FROM options o ANTI JOIN chosen c ON o.record = c.record AND o.option = c.option""",
)
def b7(t):
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("record"), F.col("l_suppkey").alias("option"), "l_extendedprice", "l_discount"
    )
    options = lines.groupBy("record", "option").agg(F.max("l_discount").alias("d"))
    chosen = lines.groupBy("record").agg(F.min_by("option", F.struct("l_extendedprice", "option")).alias("option"))
    reasons = options.filter(F.col("d") > 0.05).select(
        "record", "option", F.concat(F.lit("discount "), F.round(F.col("d") * 100).cast("bigint")).alias("reason")
    )
    return ops.rejected_options(options.select("record", "option"), chosen, reasons)


@query(
    "b8_gate_by_stakes",
    """
SELECT o_orderkey AS change, CASE
    WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_totalprice > 450000 THEN 'full'
    WHEN o_orderstatus = 'P' OR o_totalprice < 50000 THEN 'lightweight' ELSE 'none' END AS stakes FROM orders""",
)
def b8(t):
    price, priority = F.col("o_totalprice"), F.col("o_orderpriority")
    never = F.lit(None).cast("boolean")
    changes = t.orders.select(
        F.col("o_orderkey").alias("change"),
        never.alias("new_system"),
        (priority == "1-URGENT").alias("new_service"),
        (priority == "2-HIGH").alias("new_dependency"),
        (price > 450000).alias("data_model_change"),
        F.lit(False).alias("hard_to_reverse"),
        (F.col("o_orderstatus") == "P").alias("library_choice"),
        (price < 50000).alias("internal_structure"),
        never.alias("reversible"),
    )
    return ops.gate_by_stakes(changes).select("change", "stakes")


TRIGGERS = "VALUES ('view', 4, 2), ('view', 6, 1), ('click', 3, 2), ('purchase', 3, 2), ('signup', 3, 2), ('error', 2, 2)"


def hourly_counts(t):
    return t.events.groupBy(
        F.col("event_type").alias("metric"), F.window("ts", "1 hour")["start"].alias("bucket")
    ).agg(F.count(F.lit(1)).alias("value"))


@query(
    "b9_trigger_monitor",
    f"""
WITH triggers AS (SELECT * FROM ({TRIGGERS}) v(metric, threshold, sustain)),
b AS (SELECT event_type AS metric, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS value FROM events GROUP BY ALL),
r AS (
  SELECT b.*, threshold, sustain, bucket - INTERVAL 1 HOUR * (row_number() OVER (PARTITION BY b.metric, threshold, sustain ORDER BY bucket)) AS run
  FROM b JOIN triggers t ON b.metric = t.metric AND value > threshold)
SELECT metric, threshold, sustain, min(bucket) AS first_bucket, max(bucket) AS last_bucket, count(*) AS buckets, max(value) AS peak
FROM r GROUP BY metric, threshold, sustain, run HAVING count(*) >= sustain""",
)
def b9(t):
    triggers = t.spark.sql(f"SELECT * FROM {TRIGGERS} AS v(metric, threshold, sustain)")
    return ops.trigger_monitor(hourly_counts(t), triggers, 3600)


REVISIT = """VALUES ('rec-1', 'view', '>', 4, NULL, 2), ('rec-1', 'view', '<=', 1, NULL, 1), ('rec-2', 'click', '>=', NULL, 2.0, 1),
  ('rec-3', 'purchase', '<', NULL, 1.0, 3), ('rec-3', 'error', NULL, 2, NULL, 1), ('rec-4', 'nothing', '>', NULL, 2.0, 1)"""
REVISIT_COLUMNS = "record, metric, op, threshold, factor, sustain"
REVISIT_SQL = f"""
f AS (SELECT event_type AS metric, arg_min(n, bucket) AS base
  FROM (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1),
g AS (
  SELECT record, t.metric, op, coalesce(threshold::DOUBLE, factor::DOUBLE * base) AS threshold, factor::DOUBLE AS factor, sustain
  FROM ({REVISIT}) t({REVISIT_COLUMNS}) LEFT JOIN f ON f.metric = t.metric)"""
FIRES = """CASE coalesce(op, '>') WHEN '>' THEN value > threshold WHEN '>=' THEN value >= threshold
    WHEN '<' THEN value < threshold WHEN '<=' THEN value <= threshold END"""


def revisit_triggers(t):
    """Levels and ratios; the base of a metric is its first hour."""
    base = hourly_counts(t).groupBy("metric").agg(F.min_by("value", "bucket").alias("base"))
    triggers = t.spark.sql(f"SELECT * FROM {REVISIT} AS v({REVISIT_COLUMNS})").withColumn("factor", F.col("factor").cast("double"))
    return ops.trigger_bounds(triggers, base)


@query(
    "b9_revisit_triggers",
    f"""
WITH {REVISIT_SQL},
b AS (SELECT event_type AS metric, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS value FROM events GROUP BY ALL),
r AS (
  SELECT g.*, bucket, value,
    bucket - INTERVAL 1 HOUR * (row_number() OVER (PARTITION BY record, g.metric, op, threshold, factor, sustain ORDER BY bucket)) AS run
  FROM b JOIN g ON b.metric = g.metric AND {FIRES})
SELECT record, metric, op, threshold, factor, sustain, min(bucket) AS first_bucket, max(bucket) AS last_bucket, count(*) AS buckets,
  CASE WHEN op IN ('<', '<=') THEN min(value) ELSE max(value) END AS peak
FROM r GROUP BY record, metric, op, threshold, factor, sustain, run HAVING count(*) >= sustain""",
)
def b9_revisit(t):
    return ops.trigger_monitor(hourly_counts(t), revisit_triggers(t), 3600)


@query(
    "b5_record_shape_lint",
    """
WITH rec AS (
  SELECT o_orderkey AS num, CASE o_orderstatus WHEN 'F' THEN 'full' WHEN 'O' THEN 'mini' END AS shape, CASE
    WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_totalprice > 450000 THEN 'full'
    WHEN o_orderstatus = 'P' OR o_totalprice < 50000 THEN 'lightweight' ELSE 'none' END AS stakes FROM orders),
l AS (
  SELECT l_orderkey AS num, count(*) AS said, count(DISTINCT l_linenumber) FILTER (l_linenumber IN (2, 4)) AS in_mini,
    count(DISTINCT l_linenumber) FILTER (l_linenumber BETWEEN 1 AND 6) AS in_full,
    count_if(l_linenumber NOT IN (2, 4)) AS beyond FROM lineitem GROUP BY 1),
j AS (SELECT rec.*, coalesce(said, 0) AS said, coalesce(in_mini, 0) AS in_mini, coalesce(in_full, 0) AS in_full, coalesce(beyond, 0) AS beyond
  FROM rec LEFT JOIN l ON l.num = rec.num)
SELECT num, 'shape outside domain' AS rule FROM j WHERE shape IS NULL
UNION ALL SELECT num, 'mini record of a full change' FROM j WHERE shape = 'mini' AND stakes = 'full'
UNION ALL SELECT num, 'record of a trivial change' FROM j WHERE stakes = 'none'
UNION ALL SELECT num, 'phase missing' FROM j WHERE shape = 'mini' AND in_mini < 2 OR shape = 'full' AND in_full < 6
UNION ALL SELECT num, 'phase beyond a mini record' FROM j WHERE shape = 'mini' AND beyond > 0
UNION ALL SELECT num, 'principles outside 3-5' FROM j WHERE said NOT BETWEEN 3 AND 5""",
)
def b5_shape(t):
    """An order is a record, its status the shape; line numbers are the phases it shows, lines its principles."""
    status = F.col("o_orderstatus")
    shape = t.orders.select(F.col("o_orderkey").alias("change"), F.when(status == "F", "full").when(status == "O", "mini").alias("shape"))
    records = b8(t).join(shape, "change").withColumnRenamed("change", "num")
    lines = t.lineitem.select(F.col("l_orderkey").alias("num"), F.col("l_linenumber").alias("phase"))
    return ops.record_shape_lint(records, lines, lines)


for _base in ["first", "previous"]:
    _value = "first_value(value)" if _base == "first" else "lag(value)"

    @query(
        f"b10_growth_trigger_{_base}",
        f"""
WITH s AS (
  SELECT o_orderpriority AS key, date_trunc('month', o_orderdate)::TIMESTAMP AS period,
    sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders GROUP BY ALL),
b AS (SELECT *, {_value} OVER (PARTITION BY key ORDER BY period) AS base FROM s)
SELECT * FROM b WHERE value > 1.1 * base""",
    )
    def b10(t, base=_base):
        series = (
            t.orders.groupBy(
                F.col("o_orderpriority").alias("key"),
                F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).cast("timestamp_ntz").alias("period"),
            ).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
        )
        return ops.growth_trigger(series, 1.1, base)


def principles_of(t):
    line = F.posexplode(F.split("text", "\n")).alias("ord", "line")
    return t.documents.select("doc_id", line).select(
        F.col("doc_id").alias("decision"),
        "ord",
        F.when(F.col("ord") % 2 == 1, F.concat("line", F.lit(" (amended)"))).otherwise(F.col("line")).alias("text"),
    )


PRINCIPLES = r"""
principles AS (
  SELECT doc_id AS decision, (i - 1)::INTEGER AS ord,
    CASE WHEN i % 2 = 0 THEN l[i] || ' (amended)' ELSE l[i] END AS text
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


@query(
    "b11_verbatim_carry",
    f"""
WITH {PRINCIPLES}
SELECT decision, ord, p.text FROM principles p JOIN documents d ON decision = doc_id WHERE NOT contains(d.text, p.text)""",
)
def b11(t):
    contexts = t.documents.select(F.col("doc_id").alias("decision"), F.col("text").alias("context"))
    return ops.verbatim_carry(contexts, principles_of(t))


@query(
    "b11_principle_count",
    f"WITH {PRINCIPLES} SELECT decision, count(*) AS principles FROM principles GROUP BY 1 HAVING count(*) NOT BETWEEN 3 AND 5",
)
def b11_count(t):
    return ops.principle_count(principles_of(t))


@query(
    "b12_analogue_lint",
    """
WITH a AS (
  SELECT l_orderkey AS decision, l_partkey AS system, l_returnflag = 'R' AS s, l_discount = 0 AS t, l_tax = 0 AS n FROM lineitem)
SELECT decision, system, 'no similarity' AS rule FROM a WHERE s
UNION ALL SELECT decision, system, 'no transfers' FROM a WHERE t
UNION ALL SELECT decision, system, 'no not_transfers' FROM a WHERE n
UNION ALL SELECT decision, NULL, 'systems outside 2-3' FROM a GROUP BY decision HAVING count(*) NOT BETWEEN 2 AND 3""",
)
def b12(t):
    return ops.analogue_lint(
        t.lineitem.select(
            F.col("l_orderkey").alias("decision"),
            F.col("l_partkey").alias("system"),
            F.when(F.col("l_returnflag") != "R", "same load").otherwise(" ").alias("similarity"),
            F.when(F.col("l_discount") != 0, "queueing").alias("transfers"),
            F.when(F.col("l_tax") != 0, "scale").alias("not_transfers"),
        )
    )
