from pyspark.sql import functions as F

from ashlar.functions.text import MEASURE, MEASURE_LEAD, tokens, words
from ashlar.operators import ledger as ops
from bindings.registry import query


def ledger_of_orders(t):
    return t.orders.select(
        F.col("o_custkey").alias("term"),
        F.col("o_totalprice").alias("definition"),
        F.when(F.col("o_orderstatus") == "P", "assumption - confirm").otherwise("user").alias("source"),
        F.col("o_orderdate").alias("recorded"),
        F.col("o_orderkey").alias("seq"),
    )


LEDGER = """
ledger AS (
  SELECT o_custkey AS term, o_totalprice AS definition,
         CASE WHEN o_orderstatus = 'P' THEN 'assumption - confirm' ELSE 'user' END AS source,
         o_orderdate AS recorded, o_orderkey AS seq
  FROM orders),
current AS (
  SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY term ORDER BY recorded DESC, seq DESC) = 1)
"""


@query("a1_ledger_current", f"WITH {LEDGER} SELECT * FROM current")
def a1(t):
    return ops.ledger_current(ledger_of_orders(t))


@query(
    "a2_ledger_open",
    f"WITH {LEDGER} SELECT *, 'unconfirmed' AS reason FROM current WHERE source LIKE 'assumption%'",
)
def a2(t):
    return ops.ledger_open(ledger_of_orders(t))


@query(
    "a3_undefined_terms",
    r"""
WITH item AS (SELECT text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}-]+'), lambda x: x <> '') AS w FROM benchmark),
vocab AS (
  SELECT DISTINCT term, array_to_string(list_filter(regexp_split_to_array(lower(term), '[^\p{L}\p{N}-]+'), lambda x: x <> ''), ' ') AS name FROM (
    SELECT unnest(w) AS term FROM item UNION ALL SELECT array_to_string(w[1:2], ' - ') FROM item UNION ALL SELECT translate(array_to_string(w[2:4], ' '), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') FROM item)),
known AS (
  SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}-]+')) AS name
  FROM conversations WHERE role = 'assistant'),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}-]+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT doc_id, unnest(w) AS name FROM d
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM d
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM d)
SELECT doc_id, term, count(*) AS hits FROM g JOIN vocab USING (name) WHERE name NOT IN (SELECT name FROM known) GROUP BY doc_id, term""",
)
def a3(t):
    """Terms of one word, of two with a dash between them, and of three in capitals."""
    w, small = words(F.col("text")), "abcdefghijklmnopqrstuvwxyz"
    vocab = t.benchmark.select(F.explode(F.concat(w, F.array(F.concat_ws(" - ", F.slice(w, 1, 2)), F.translate(F.concat_ws(" ", F.slice(w, 2, 3)), small, small.upper())))).alias("term"))
    known = t.conversations.filter(F.col("role") == "assistant").select(F.explode(tokens(F.col("text"))).alias("term"))
    return ops.undefined_terms(t.documents.select("doc_id", "text"), vocab, known)


@query(
    "a4_extract_measures",
    f"""
WITH rows AS (
  SELECT o_orderkey AS id,
    CASE WHEN o_orderstatus = 'P' THEN 'fast enough'
         WHEN o_orderpriority = '1-URGENT' THEN 'about ' || (o_orderkey % 100)::VARCHAR || 'k rps'
         WHEN o_orderpriority = '2-HIGH' THEN concat(o_orderkey % 10, 'x load (→ ', o_orderkey % 100, 'k rps) with < ', o_orderkey % 7, 'x cost, $', o_orderkey % 900, '/month, past 3 squads')
         ELSE concat('p', o_orderkey % 100, ' latency < ', floor(o_totalprice)::BIGINT, 'ms') END AS definition
  FROM orders),
pieces AS (
  SELECT id, definition, unnest(CASE WHEN len(p) = 0 THEN [NULL] ELSE range(1, len(p) + 1) END)::INTEGER AS measure,
    unnest(CASE WHEN len(p) = 0 THEN [NULL] ELSE p END) AS piece
  FROM (SELECT *, regexp_extract_all(definition, '{MEASURE}', 0) AS p FROM rows)),
parts AS (
  SELECT id, definition, measure, nullif(regexp_extract(piece, '{MEASURE}', 2), '') AS op,
    nullif(trim(regexp_replace(regexp_extract(piece, '{MEASURE}', 1), '{MEASURE_LEAD}', '')), '') AS words,
    nullif(regexp_extract(piece, '{MEASURE}', 4), '')::DOUBLE AS value, nullif(regexp_extract(piece, '{MEASURE}', 5), '') AS suffix,
    nullif(concat(regexp_extract(piece, '{MEASURE}', 3), regexp_extract(piece, '{MEASURE}', 6)), '') AS unit FROM pieces)
SELECT id, definition, measure, suffix, unit, CASE WHEN op IS NOT NULL THEN words END AS metric, op, value,
  round(value * (CASE WHEN suffix = 'k' THEN 1000.0 ELSE 1.0 END)
    * (CASE unit WHEN 'ms' THEN 0.001 WHEN '%' THEN 0.01 ELSE 1.0 END), 4)::DOUBLE AS scaled,
  value IS NULL AS wish FROM parts""",
)
def a4(t):
    number = F.floor("o_totalprice").cast("bigint")
    bucket = F.col("o_orderkey") % 100
    several = F.concat(
        F.col("o_orderkey") % 10, F.lit("x load (→ "), bucket, F.lit("k rps) with < "), F.col("o_orderkey") % 7,
        F.lit("x cost, $"), F.col("o_orderkey") % 900, F.lit("/month, past 3 squads"),
    )
    definition = (
        F.when(F.col("o_orderstatus") == "P", "fast enough")
        .when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("about "), bucket, F.lit("k rps")))
        .when(F.col("o_orderpriority") == "2-HIGH", several)
        .otherwise(F.concat(F.lit("p"), bucket, F.lit(" latency < "), number, F.lit("ms")))
    )
    rows = t.orders.select(F.col("o_orderkey").alias("id"), definition.alias("definition"))
    return ops.extract_measures(rows, "definition").withColumn("scaled", F.round("scaled", 4))


@query(
    "a5_definition_as_of",
    f"""
WITH {LEDGER},
decisions AS (
  SELECT o_custkey AS term, l_shipdate AS decided, l_orderkey, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
last_of_day AS (
  SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY term, recorded ORDER BY seq DESC) = 1)
SELECT d.term, d.decided, d.l_orderkey, d.l_linenumber, r.definition, r.source, r.recorded
FROM decisions d ASOF LEFT JOIN last_of_day r ON d.term = r.term AND d.decided >= r.recorded""",
)
def a5(t):
    decisions = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("term"), F.col("l_shipdate").alias("decided"), "l_orderkey", "l_linenumber"
    )
    return ops.definition_as_of(decisions, ledger_of_orders(t), unit="year")


@query(
    "a6_ledger_conflicts",
    """
WITH live AS (
  SELECT p_name AS term, p_brand AS source, p_type AS definition FROM part
  QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey DESC) = 1)
SELECT term, count(DISTINCT definition) AS definitions, count(*) AS sources
FROM live GROUP BY term HAVING count(DISTINCT definition) > 1 OR count(*) > 1""",
)
def a6(t):
    return ops.ledger_conflicts(
        t.part.select(
            F.col("p_name").alias("term"),
            F.col("p_type").alias("definition"),
            F.col("p_brand").alias("source"),
            F.lit(0).alias("recorded"),
            F.col("p_partkey").alias("seq"),
        )
    )


@query(
    "a7_intake_gaps",
    """
WITH gaps AS (
  SELECT o_orderkey AS request, concat_ws(',',
    CASE WHEN o_orderstatus = 'P' THEN 'purpose' END,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'quality' END,
    CASE WHEN o_totalprice < 100000 THEN 'scale' END,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'constraints' END,
    CASE WHEN o_totalprice > 400000 THEN 'evolution' END) AS questions FROM orders)
SELECT request, questions FROM gaps WHERE questions <> ''""",
)
def a7(t):
    priority, price = F.col("o_orderpriority"), F.col("o_totalprice")
    requests = t.orders.select(
        F.col("o_orderkey").alias("request"),
        F.when(F.col("o_orderstatus") != "P", "serve orders").alias("purpose"),
        F.when(priority != "5-LOW", priority).otherwise("  ").alias("quality"),
        F.when(price >= 100000, price).alias("scale"),
        F.when(priority != "4-NOT SPECIFIED", "one team").alias("constraints"),
        F.when(price <= 400000, "none known").alias("evolution"),
    )
    return ops.intake_gaps(requests).withColumn("questions", F.concat_ws(",", "questions"))
