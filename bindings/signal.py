from pyspark.sql import functions as F

from ashlar.operators import signal as ops
from bindings.registry import query


def samples(t):
    return t.events.select(F.col("user_id").alias("track"), "ts", F.col("event_id").alias("seq"), (F.col("value") / 500).alias("x"))


def round_all(df, digits=4, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(
    "h1_capture_regions",
    """
WITH c AS (
  SELECT user_id AS track, ts, event_id, CASE event_type WHEN 'signup' THEN 'CAPTURE' ELSE 'STOP' END AS event FROM events WHERE event_type IN ('signup', 'error')),
p AS (SELECT *, lag(event) OVER (PARTITION BY track ORDER BY ts, event_id) AS prev FROM c),
k AS (SELECT *, lead(ts) OVER (PARTITION BY track ORDER BY ts, event_id) AS until FROM p WHERE event IS DISTINCT FROM prev),
s AS (SELECT user_id AS track, ts, event_id AS seq, value / 500 AS x FROM events WHERE event_type NOT IN ('signup', 'error'))
SELECT s.track, s.ts, s.seq, s.x, k.ts AS region, k.until IS NULL AS open FROM s ASOF JOIN k ON s.track = k.track AND s.ts >= k.ts WHERE k.event = 'CAPTURE'""",
)
def h1(t):
    kind = F.col("event_type")
    control = t.events.filter(kind.isin("signup", "error")).select(
        F.col("user_id").alias("track"), "ts", F.col("event_id").alias("seq"), F.when(kind == "signup", "CAPTURE").otherwise("STOP").alias("event")
    )
    rows = t.events.filter(~kind.isin("signup", "error")).select(
        F.col("user_id").alias("track"), "ts", F.col("event_id").alias("seq"), (F.col("value") / 500).alias("x")
    )
    return ops.capture_regions(rows, control)


@query(
    "h2_envelope",
    """
SELECT user_id AS track, event_type = 'purchase' AS output, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, min(value / 500) AS low, max(value / 500) AS high,
  round(sqrt(avg((value / 500) * (value / 500))), 6) AS rms FROM events GROUP BY ALL""",
)
def h2(t):
    rows = t.events.select(
        F.col("user_id").alias("track"), (F.col("event_type") == "purchase").alias("output"), "ts", (F.col("value") / 500).alias("x")
    )
    return round_all(ops.envelope(rows, ["track", "output"], "1 hour"), 6, "rms")


@query(
    "h3_peak_meter",
    """
SELECT user_id AS track, time_bucket(INTERVAL 1 HOUR, ts) AS "start", time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end",
  CASE WHEN max(abs(value)) > 0 THEN round(20 * log10(max(abs(value / 500))), 4) END AS peak_db FROM events GROUP BY ALL""",
)
def h3(t):
    return round_all(ops.peak_meter(samples(t), ["track"], "1 hour"), 4, "peak_db")


@query(
    "h3_peak_meter_sliding",
    """
WITH w AS (SELECT user_id AS track, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * unnest(range(4)) AS s, value / 500 AS x FROM events)
SELECT track, s AS "start", s + INTERVAL 4 HOUR AS "end", CASE WHEN max(abs(x)) > 0 THEN round(20 * log10(max(abs(x))), 4) END AS peak_db FROM w GROUP BY ALL""",
)
def h3_sliding(t):
    return round_all(ops.peak_meter(samples(t), ["track"], "4 hours", "1 hour"), 4, "peak_db")


LOUD = """
s AS (SELECT user_id AS track, time_bucket(INTERVAL 1 HOUR, ts) AS step, avg((value / 500) * (value / 500)) AS e FROM events GROUP BY ALL),
z AS (SELECT track, min(step) AS first_step, max(step) AS last_step FROM s GROUP BY track),
w AS (SELECT track, step - INTERVAL 1 HOUR * unnest(range(4)) AS block, e FROM s),
b AS (
  SELECT track, block, sum(e) / 4 AS ms FROM w JOIN z USING (track)
  WHERE block >= first_step AND block + INTERVAL 3 HOUR <= last_step GROUP BY ALL),
a AS (SELECT * FROM b WHERE ms > 0 AND -0.691 + 10 * log10(ms) > -70),
g AS (SELECT track, -10.691 + 10 * log10(avg(ms)) AS gate FROM a GROUP BY track),
l AS (
  SELECT track, -0.691 + 10 * log10(avg(ms)) AS lufs, count(*) AS blocks FROM a JOIN g USING (track) WHERE -0.691 + 10 * log10(ms) > gate GROUP BY track)"""
LEVELS = LOUD + """,
v AS (
  SELECT track, lufs, peak_db FROM (SELECT user_id AS track, 20 * log10(max(abs(value / 500))) AS peak_db FROM events GROUP BY 1) LEFT JOIN l USING (track)),
n AS (SELECT *, least(-14 - lufs, -1 - peak_db) AS gain_db, -1 - peak_db < -14 - lufs AS capped FROM v)"""


@query("h4_integrated_loudness", f"WITH {LOUD} SELECT track, round(lufs, 4) AS lufs, blocks FROM l")
def h4(t):
    energy = samples(t).select("track", "ts", (F.col("x") * F.col("x")).alias("e"))
    return round_all(ops.integrated_loudness(energy, "1 HOUR"), 4, "lufs")


@query(
    "h5_track_gain",
    f"WITH {LEVELS} SELECT track, round(lufs, 4) AS lufs, round(peak_db, 4) AS peak_db, round(gain_db, 4) AS gain_db, capped FROM n",
)
def h5_gain(t):
    return round_all(ops.track_gain(ops.track_levels(samples(t), "1 HOUR")), 4, "lufs", "peak_db", "gain_db")


@query(
    "h5_normalise_gain",
    f"""WITH {LEVELS}
SELECT user_id AS track, ts, event_id AS seq, round(value / 500, 6) AS x, round(gain_db, 4) AS gain_db, capped, round(value / 500 * pow(10, gain_db / 20), 6) AS y
FROM events JOIN n ON n.track = user_id""",
)
def h5(t):
    scaled = ops.normalise_gain(samples(t), ops.track_levels(samples(t), "1 HOUR"))
    return round_all(round_all(scaled, 6, "x", "y"), 4, "gain_db")


@query(
    "h6_output_conformance",
    f"""WITH {LEVELS},
f AS (
  SELECT track, CASE WHEN track % 4 = 0 THEN 48000 ELSE 44100 END AS rate, CASE WHEN track % 5 = 0 THEN 16 ELSE 24 END AS depth,
    CASE WHEN track % 7 = 0 THEN 1 ELSE 2 END AS channels, lufs + gain_db AS lufs, peak_db + gain_db + CASE WHEN track % 3 = 0 THEN 0.5 ELSE -0.001 END AS peak_db FROM n)
SELECT track AS file, 'sample rate' AS rule FROM f WHERE rate <> 44100
UNION ALL SELECT track, 'bit depth' FROM f WHERE depth <> 24
UNION ALL SELECT track, 'channels' FROM f WHERE channels <> 2
UNION ALL SELECT track, 'loudness' FROM f WHERE lufs IS NULL OR abs(lufs + 14) > 1
UNION ALL SELECT track, 'peak' FROM f WHERE peak_db > -1""",
)
def h6(t):
    track = F.col("track")
    gains = ops.track_gain(ops.track_levels(samples(t), "1 HOUR"))
    files = gains.select(
        track.alias("file"),
        F.when(track % 4 == 0, 48000).otherwise(44100).alias("rate"),
        F.when(track % 5 == 0, 16).otherwise(24).alias("depth"),
        F.when(track % 7 == 0, 1).otherwise(2).alias("channels"),
        (F.col("lufs") + F.col("gain_db")).alias("lufs"),
        (F.col("peak_db") + F.col("gain_db") + F.when(track % 3 == 0, 0.5).otherwise(-0.001)).alias("peak_db"),
    )
    return ops.output_conformance(files, 1.0)


PASSES = ["short", "duplicate", "symbols", "flagged"]


def cleaned(t, enabled=tuple(PASSES)):
    # Conditions on the text are evaluated where it is read; only flags and a digest are shuffled.
    symbols = F.length(F.regexp_replace("text", r"[\p{L}\p{N} \n]", "")) > 0.1 * F.length("text")
    docs = t.documents.select(
        "doc_id", F.sha2("text", 256).alias("digest"), (F.length("text") < 200).alias("short"), symbols.alias("symbols")
    )
    flagged = t.labels.select("doc_id", (F.col("toxic") == 1).alias("flagged"))
    rows = ops.mark_duplicates(docs.join(flagged, "doc_id", "left"), "doc_id", "digest")
    return ops.pass_chain(rows, {p: F.col(p) for p in PASSES}, enabled).select("doc_id", "removed_by")


CHAIN = r"""
d AS (
  SELECT d.doc_id, length(text) < 200 AS p1, row_number() OVER (PARTITION BY text ORDER BY d.doc_id) > 1 AS p2,
    length(regexp_replace(text, '[\p{L}\p{N} \n]', '', 'g')) > 0.1 * length(text) AS p3, coalesce(toxic = 1, false) AS p4
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
a AS (SELECT doc_id, CASE WHEN p1 THEN 'short' WHEN p2 THEN 'duplicate' WHEN p3 THEN 'symbols' WHEN p4 THEN 'flagged' END AS removed_by FROM d),
b AS (SELECT doc_id, CASE WHEN p1 THEN 'short' WHEN p2 THEN 'duplicate' WHEN p4 THEN 'flagged' END AS removed_by FROM d)"""


@query("h7_pass_chain", f"WITH {CHAIN} SELECT * FROM a")
def h7(t):
    return cleaned(t)


@query(
    "h7_pass_summary",
    f"""WITH {CHAIN},
p AS (SELECT unnest([1, 2, 3, 4])::INTEGER AS ord, unnest(['short', 'duplicate', 'symbols', 'flagged']) AS name),
c AS (SELECT ord, name, (SELECT count(*) FROM a WHERE removed_by = name) AS removed FROM p)
SELECT ord, name, (SELECT count(*) FROM a) - coalesce(sum(removed) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rows_in,
  removed, (SELECT count(*) FROM a) - (sum(removed) OVER (ORDER BY ord))::BIGINT AS rows_out FROM c""",
)
def h7_summary(t):
    return ops.pass_summary(cleaned(t), PASSES)


@query(
    "h8_ab_compare",
    f"""WITH {CHAIN}
SELECT doc_id, CASE WHEN a.removed_by IS NULL AND b.removed_by IS NULL THEN 'both' WHEN a.removed_by IS NULL THEN 'A only'
  WHEN b.removed_by IS NULL THEN 'B only' ELSE 'neither' END AS kept_in FROM a JOIN b USING (doc_id)""",
)
def h8(t):
    return ops.ab_compare(cleaned(t), cleaned(t, ["short", "duplicate", "flagged"]), "doc_id")


@query(
    "h8_ab_counts",
    f"""WITH {CHAIN}
SELECT CASE WHEN a.removed_by IS NULL AND b.removed_by IS NULL THEN 'both' WHEN a.removed_by IS NULL THEN 'A only'
  WHEN b.removed_by IS NULL THEN 'B only' ELSE 'neither' END AS kept_in, count(*) AS rows FROM a JOIN b USING (doc_id) GROUP BY 1""",
)
def h8_counts(t):
    both = ops.ab_compare(cleaned(t), cleaned(t, ["short", "duplicate", "flagged"]), "doc_id")
    return both.groupBy("kept_in").agg(F.count(F.lit(1)).alias("rows"))


PASS_NO = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END"


def status_log(t):
    return t.events.select(
        F.col("user_id").alias("job"),
        F.expr(PASS_NO).alias("pass"),
        F.when(F.col("value") < 25, "Waiting").when(F.col("value") < 50, "Processing").otherwise("Done").alias("state"),
        "ts",
        F.col("event_id").alias("seq"),
    )


@query(
    "h9_pass_progress",
    f"""
WITH s AS (SELECT user_id AS job, {PASS_NO} AS pass, CASE WHEN value < 25 THEN 'Waiting' WHEN value < 50 THEN 'Processing' ELSE 'Done' END AS state, ts, event_id FROM events),
p AS (
  SELECT job, pass, arg_max(state, (ts, event_id)) AS state, min(ts) FILTER (state = 'Processing') AS started, max(ts) FILTER (state = 'Done') AS finished FROM s GROUP BY ALL),
j AS (
  SELECT job, max(pass) FILTER (state <> 'Waiting') AS pass, arg_max(state, pass) FILTER (state <> 'Waiting') AS state, count_if(state = 'Done')::BIGINT AS finished,
    avg((epoch_us(finished) - epoch_us(started)) / 1000000.0) FILTER (state = 'Done' AND finished > started) AS mean FROM p GROUP BY job)
SELECT job, pass, 4 AS passes, state, finished, round(mean * (4 - finished), 3) AS remaining_s FROM j""",
)
def h9(t):
    return round_all(ops.pass_progress(status_log(t), 4), 3, "remaining_s")


@query(
    "h10_separation_quality",
    """
WITH p AS (
  SELECT l_suppkey AS track, l_orderkey * 8 + l_linenumber AS i, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS s,
    sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(18,2)))::DOUBLE AS e FROM lineitem GROUP BY ALL)
SELECT track, round(10 * log10(sum(s * s) / sum((s - e) * (s - e))), 6) AS sdr_db FROM p GROUP BY track""",
)
def h10(t):
    price, discount = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(18,2)")
    keys = [F.col("l_suppkey").alias("track"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("i")]
    reference = t.lineitem.groupBy(*keys).agg(F.sum(price).cast("double").alias("s"))
    estimate = t.lineitem.groupBy(*keys).agg(F.sum(price * (1 - discount)).cast("double").alias("e"))
    return round_all(ops.separation_quality(reference, estimate), 6, "sdr_db")


LOUDER = "SELECT user_id AS track, event_id AS seq, value / 300 AS x, round(value / 300 * 8388608)::BIGINT AS raw FROM events"


@query("h11_quantise", f"SELECT track, seq, x, greatest(-8388608, least(8388607, raw)) AS q, raw > 8388607 OR raw < -8388608 AS clipped FROM ({LOUDER})")
def h11(t):
    rows = t.events.select(F.col("user_id").alias("track"), F.col("event_id").alias("seq"), (F.col("value") / 300).alias("x"))
    return ops.quantise(rows)


@query(
    "h11_quantise_stats",
    f"""
WITH q AS (SELECT *, greatest(-8388608, least(8388607, raw)) / 8388608.0 - x AS err FROM ({LOUDER}))
SELECT track, count(*) AS samples, count_if(raw > 8388607 OR raw < -8388608)::BIGINT AS clips, round(max(abs(err)), 9) AS max_error,
  round(sqrt(avg(err * err)), 9) AS rms_error FROM q GROUP BY track""",
)
def h11_stats(t):
    rows = t.events.select(F.col("user_id").alias("track"), (F.col("value") / 300).alias("x"))
    return round_all(ops.quantise_stats(rows), 9, "max_error", "rms_error")
