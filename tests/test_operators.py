"""Golden rows and edge cases of single operators."""

import hashlib
import datetime as dt

import pytest
from pyspark.sql import functions as F

from ashlar.functions.text import SECRET_PATTERN
from ashlar.operators import graph, ledger, quality, reconcile, records, review, routing, signal


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


# Two example definitions whose reading is given, and two more.
LEDGER = [
    ("real-time", "p99 end-to-end latency < 200ms", "user, 2026-06-10", 1, 1),
    ("scalable", "10x current load (→ 5k rps) with < 2x cost", "assumption — CONFIRM", 1, 2),
    ("secure", " ", "user", 1, 3),
    ("real-time", "fast", "user", 0, 9),
]


def ledger_df(spark):
    return spark.createDataFrame(LEDGER, "term STRING, definition STRING, source STRING, recorded INT, seq INT")


def test_ledger(spark):
    df = ledger_df(spark)
    assert [r for r in rows(ledger.ledger_current(df), "term", "seq")] == [("real-time", 1), ("scalable", 2), ("secure", 3)]
    assert rows(ledger.ledger_open(df), "term", "reason") == [("scalable", "unconfirmed"), ("secure", "undefined")]
    assert ledger.ledger_current(df.limit(0)).isEmpty()


def test_measures(spark):
    texts = ["p99 end-to-end latency < 200ms", "10x current load (→ 5k rps) with < 2x cost", "availability >= 99.9%", "up to 5k rps", "fast"]
    df = ledger.extract_measures(spark.createDataFrame([(t,) for t in texts], "d STRING"), "d")
    rows = df.collect()
    got = {r["d"]: r for r in rows if r["measure"] in (None, 1)}
    first = got[texts[0]]
    assert (first["metric"], first["op"], first["value"], first["unit"]) == ("p99 end-to-end latency", "<", 200.0, "ms")
    assert first["scaled"] == pytest.approx(0.2)
    several = sorted((r["measure"], r["metric"], r["op"], r["scaled"], r["unit"]) for r in rows if r["d"] == texts[1])
    assert several == [(1, None, None, 10.0, "x"), (2, None, None, 5000.0, "rps"), (3, "with", "<", 2.0, "x")]
    assert got[texts[2]]["scaled"] == pytest.approx(0.999)
    assert (got[texts[3]]["value"], got[texts[3]]["suffix"], got[texts[3]]["scaled"]) == (5.0, "k", 5000.0)
    assert got[texts[4]]["wish"] and got[texts[4]]["value"] is None
    units = ["team grows past 3 squads", "within 4 stages", "p99 < 5 kb", "under $900/month", "12 months"]
    df = ledger.extract_measures(spark.createDataFrame([(t,) for t in units], "d STRING"), "d")
    got = {r["d"]: (r["scaled"], r["unit"]) for r in df.collect()}
    assert got == dict(zip(units, [(3.0, "squads"), (4.0, "stages"), (5.0, "kb"), (900.0, "$/month"), (12.0, "months")], strict=True))


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_undefined_terms_by_either_join(spark, limit):
    docs = spark.createDataFrame([(1, "A scalable, SCALABLE thing; real-time!"), (2, "secure and plain"), (3, "")], "doc_id INT, text STRING")
    vocab = spark.createDataFrame([("scalable",), ("real-time",), ("secure",), ("secure",)], "term STRING")
    known = spark.createDataFrame([("secure",), ("secure",)], "term STRING")
    assert rows(ledger.undefined_terms(docs, vocab, known, limit)) == [(1, "real-time", 1), (1, "scalable", 2)]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_undefined_terms_of_several_words(spark, limit):
    docs = spark.createDataFrame(
        [(1, "Peak load and PEAK\nLoad; peak, loads. The source of truth-ish"), (2, "source of, truth of source of truth"), (3, None), (4, "a a a a")],
        "doc_id INT, text STRING")
    vocab = spark.createDataFrame([("peak load",), ("Source of Truth",), ("  ",), (None,), ("Peak",), ("a a a",), ("gone by",), ("truth of",)], "term STRING")
    known = spark.createDataFrame([("Truth  OF",), (None,)], "term STRING")
    got = rows(ledger.undefined_terms(docs, vocab, known, limit))
    assert sorted(got) == [(1, "Peak", 3), (1, "peak load", 2), (2, "Source of Truth", 2), (4, "a a a", 2)]
    assert ledger.undefined_terms(docs, vocab.filter("false"), known, limit).isEmpty()


def test_intake_of_a_vague_request(spark):
    asked = "request STRING, purpose STRING, quality STRING, scale STRING, constraints STRING, evolution STRING"
    df = spark.createDataFrame([("notifications", "notify users", None, "50k users", "small team", " "), ("full", "a", "b", "c", "d", "e")], asked)
    assert rows(ledger.intake_gaps(df)) == [("notifications", ["quality", "evolution"])]


RECORD = """# ADR-0012: Use a queue

- Status: superseded by ADR-0015
- Date: 2026-06-10
- Deciders: ann, bo
- Tags: data, messaging

## Context

Load is rising.
p99 < 200ms

## Decision

Chosen option: Queue
## What would change this decision

"""


def test_parse_record(spark):
    df = spark.createDataFrame([(1, RECORD), (2, "no header")], "doc_id INT, text STRING")
    head = {r["doc_id"]: r for r in records.record_headers(df).collect()}
    assert (head[1]["num"], head[1]["title"], head[1]["status"], head[1]["superseded_by"]) == (12, "Use a queue", "superseded", 15)
    assert head[1]["date"] == dt.date(2026, 6, 10) and head[1]["deciders"] == ["ann", "bo"] and head[1]["tags"] == ["data", "messaging"]
    assert head[2]["num"] is None and head[2]["date"] is None
    lines = rows(records.record_lines(df), "section", "line_no", "line")
    assert lines == [("Context", 1, "Load is rising."), ("Context", 2, "p99 < 200ms"), ("Decision", 1, "Chosen option: Queue")]


def test_number_gaps_across_chunks(spark):
    df = spark.createDataFrame([("s", n) for n in [2, 3, 3, 7, 25]], "series STRING, n INT")
    assert rows(records.number_gaps(df, width=5), "kind", "from_n", "to_n") == [("duplicate", 3, 3), ("gap", 1, 1), ("gap", 4, 6), ("gap", 8, 24)]


def test_trigger_needs_consecutive_buckets(spark):
    stamps = [("rps", f"2024-01-01 0{h}:00:00", v) for h, v in [(0, 9), (1, 9), (2, 1), (3, 9), (5, 9), (6, 9), (7, 9)]]
    b = spark.createDataFrame(stamps, "metric STRING, bucket STRING, value INT").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
    t = spark.createDataFrame([("rps", 5, 2)], "metric STRING, threshold INT, sustain INT")
    assert rows(records.trigger_monitor(b, t, 3600), "buckets") == [(2,), (3,)]
    two = spark.createDataFrame([("rps", 1, 3), ("rps", 5, 3)], "metric STRING, threshold INT, sustain INT")
    assert rows(records.trigger_monitor(b, two, 3600), "threshold", "buckets") == [(1, 3), (5, 3)]


def test_triggers_by_ratio_and_operator(spark):
    b = spark.createDataFrame([("price", h, v) for h, v in [(0, 10), (1, 21), (2, 20), (3, 4), (4, 5)]], "metric STRING, h INT, value INT")
    b = b.select("metric", F.timestamp_seconds(F.col("h") * 3600).alias("bucket"), "value")
    schema = "record INT, metric STRING, op STRING, threshold INT, factor DOUBLE, sustain INT"
    t = [(1, "price", ">", None, 2.0, 1), (2, "price", ">=", None, 2.0, 2), (3, "price", "<", 5, None, 1), (4, "price", "<=", None, 0.5, 2),
         (5, "price", "!=", 5, None, 1), (6, "price", ">", None, None, 1), (7, "other", ">", None, 2.0, 1), (8, "price", None, 20, None, 1)]
    bounds = records.trigger_bounds(spark.createDataFrame(t, schema), spark.createDataFrame([("price", 10)], "metric STRING, base INT"))
    assert [r["threshold"] for r in bounds.orderBy("record").collect()] == [20.0, 20.0, 5.0, 5.0, 5.0, None, None, 20.0]
    got = records.trigger_monitor(b, bounds, 3600)
    assert sorted((r["record"], r["buckets"], r["peak"]) for r in got.collect()) == [(1, 1, 21), (2, 2, 21), (3, 1, 4), (4, 2, 4), (8, 1, 21)]


def test_record_shapes(spark):
    rec = spark.createDataFrame(
        [(1, "mini", "lightweight"), (2, "mini", "full"), (3, "full", "full"), (4, "full", "none"), (5, None, None)], "num INT, shape STRING, stakes STRING"
    )
    phases = spark.createDataFrame([(1, 2), (1, 4), (1, 4), (2, 2), (2, 3), *[(3, p) for p in range(1, 8)]], "num INT, phase INT")
    said = spark.createDataFrame([(n, i) for n, k in [(1, 3), (2, 5), (3, 6), (5, 4)] for i in range(k)], "num INT, ord INT")
    got = {}
    for r in records.record_shape_lint(rec, phases, said).collect():
        got.setdefault(r["num"], set()).add(r["rule"])
    assert got == {
        2: {"mini record of a full change", "phase missing", "phase beyond a mini record"},
        3: {"principles outside 3-5"},
        4: {"record of a trivial change", "phase missing", "principles outside 3-5"},
        5: {"shape outside domain"},
    }


def test_verdicts_say_why(spark):
    measured = spark.createDataFrame([("a", "p99", 150.0), ("b", "p99", 210.0), ("c", "p99", 300.0), ("d", "p99", None)], "candidate STRING, attribute STRING, value DOUBLE")
    targets = spark.createDataFrame([("p99", "<=", 200.0, 0.1, "row 4")], "attribute STRING, op STRING, target DOUBLE, margin DOUBLE, source STRING")
    got = quality.justified(quality.verdict_matrix(measured, targets), targets)
    assert {r["candidate"]: r["justification"] for r in got.collect()} == {
        "a": "p99 150.00 meets <= 200.00 (row 4)",
        "b": "p99 210.00 misses <= 200.00 by 10.00, within 10 % (row 4)",
        "c": "p99 300.00 misses <= 200.00 by 100.00, beyond 10 % (row 4)",
        "d": "p99 is not measured (row 4)",
    }
    pruned = quality.prune_candidates(got, ["p99"], "justification")
    assert {r["candidate"]: r["reasons"] for r in pruned.collect() if not r["kept"]} == {
        "c": ["p99 300.00 misses <= 200.00 by 100.00, beyond 10 % (row 4)"],
        "d": ["p99 is not measured (row 4)"],
    }


def test_saga_steps_before_the_command_answer_nothing(spark):
    at = F.col("ts").cast("timestamp_ntz")
    sent = spark.createDataFrame([(1, "2024-01-10"), (2, "2024-01-10"), (3, "2024-01-10"), (5, "2024-01-10")], "key INT, ts STRING").withColumn("ts", at)
    done = [(1, "2024-01-01"), (1, "2024-01-11"), (2, "2024-01-01"), (3, "2024-01-20"), (4, "2024-01-10")]
    steps = spark.createDataFrame(done, "key INT, ts STRING").withColumn("ts", at)
    got = graph.saga_reconcile(sent, steps, 5 * 86400.0)
    assert sorted(rows(got, "key", "state")) == [
        (1, "complete"), (1, "orphan step"), (2, "missing step"), (2, "orphan step"), (3, "late step"), (4, "orphan step"), (5, "missing step"),
    ]


def test_rejected_plus_chosen_is_all(spark):
    options = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "record INT, option STRING")
    chosen = spark.createDataFrame([(1, "b"), (2, "a")], "record INT, option STRING")
    reasons = spark.createDataFrame([(1, "a", "too dear")], "record INT, option STRING, reason STRING")
    got = records.rejected_options(options, chosen, reasons)
    assert rows(got) == [(1, "a", "too dear"), (1, "c", None)]
    assert got.select("record", "option").union(chosen).exceptAll(options).isEmpty()


def test_verbatim_carry_in_batches(spark):
    r = spark.createDataFrame([(1, "keep it simple. data has gravity."), (2, None)], "decision INT, context STRING")
    p = spark.createDataFrame([(1, 0, "keep it simple"), (1, 1, "Data has gravity"), (2, 0, "x"), (3, 0, "y")], "decision INT, ord INT, text STRING")
    assert rows(records.verbatim_carry(r, p, batch=1)) == [(1, 1, "Data has gravity"), (2, 0, "x"), (3, 0, "y")]


def test_stable_core_partitions_the_elements(spark):
    e = spark.createDataFrame([(1, c, x) for c, xs in {"a": "pq", "b": "pr", "c": "p"}.items() for x in xs], "decision INT, candidate STRING, element STRING")
    got = {r["element"]: (r["verdict"], r["candidates"]) for r in quality.stable_core(e).collect()}
    assert got == {"p": ("adopt", ["a", "b", "c"]), "q": ("decide", ["a"]), "r": ("decide", ["b"])}


def test_request_rates_count_empty_buckets(spark):
    times = ["00:10", "00:20", "00:30", "03:00"]
    df = spark.createDataFrame([("k", f"2024-01-01 {t}:00") for t in times], "key STRING, ts STRING").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    r = quality.request_rates(df, "1 hour", 3600).first()
    assert (r["peak"], r["sustained"], r["p50"], r["peak_10x"]) == (3, 1.0, 0.5, 30)


def test_recovery(spark):
    marks = [("s", h, h, h in (0, 3, 9), h in (1, 2, 5, 10)) for h in (0, 1, 2, 3, 5, 9, 10)]
    df = spark.createDataFrame(marks, "store STRING, h INT, seq INT, good BOOLEAN, failed BOOLEAN")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("h") * 3600).cast("timestamp_ntz"))
    r = quality.recovery_times(df, 3600, 3600 * 6).first()
    assert (r["outages"], r["open"], r["rto_s"], r["rpo_s"], r["rto_met"], r["rpo_met"]) == (3, 1, 4 * 3600.0, 6 * 3600.0, False, True)


def test_text_classes_and_secrets(spark):
    texts = [("mail a.b@example.com",), ("card 4111 1111 1111 1111 of c@d.org",), ("the patient has an allergy",), ("plain",), ("x" * 50000 + " call +1 (555) 123-4567",)]
    got = [r["class"] for r in quality.classify_text(spark.createDataFrame(texts, "text STRING")).collect()]
    assert got == ["pii", "payment", "health", "none", "pii"]
    s = spark.createDataFrame([(1, 'a token = "abcdef123456" and password: hunter2hunter2 end'), (2, "token gesture")], "doc_id INT, text STRING")
    r = quality.secret_scan(s).collect()
    assert len(r) == 1 and r[0]["hits"] == 2 and r[0]["text"] == "a [REDACTED] and [REDACTED] end"
    assert r[0]["digests"] == [hashlib.sha256(x.encode()).hexdigest() for x in ('token = "abcdef123456"', "password: hunter2hunter2")]
    assert "AKIA" in SECRET_PATTERN


def c4_graphs(spark):
    elements = [
        ("context", "buyer", "person", "Buyer", None, "Buys", 1),
        ("context", "shop", "system", "Shop", None, "Takes money", 1),
        ("container", "web", "container", "Pages", "HTML", "Shows goods", 2),
        ("container", "db", "database", "Store", "SQL", "Keeps stock", 2),
        ("container", "x", "queue", "Events", " ", "events", 3),
    ]
    rels = [("context", "buyer", "Uses", "HTTPS", "sync"), ("context", "a", "Uses", None, "sync"), ("container", "b", None, "SQL", None)]
    e = spark.createDataFrame(elements, "diagram STRING, id STRING, kind STRING, name STRING, technology STRING, responsibility STRING, level INT")
    r = spark.createDataFrame(rels, "diagram STRING, id STRING, verb STRING, protocol STRING, mode STRING")
    d = spark.createDataFrame([("context", "a\nb\nc"), ("container", "a\nb\nc\nd")], "diagram STRING, legend STRING")
    return d, e, r


def test_diagram_lint(spark):
    assert rows(graph.diagram_lint(*c4_graphs(spark)), "diagram", "item", "rule") == sorted(
        [
            ("container", "x", "no technology"),
            ("container", "b", "no verb"),
            ("container", "b", "sync or async not marked"),
            ("container", None, "mixed levels"),
            ("container", None, "long legend"),
            ("context", "a", "no protocol"),
            ("context", "a", "uses alone"),
        ],
        key=repr,
    )


def test_contract_diff(spark):
    schema = "contract STRING, field STRING, type STRING, required BOOLEAN"
    v1 = spark.createDataFrame([("o", "a", "int", False), ("o", "b", "int", False), ("o", "c", "int", True), ("o", "same", "int", True)], schema)
    v2 = spark.createDataFrame([("o", "a", "string", False), ("o", "b", "int", True), ("o", "d", "int", False), ("o", "e", "int", True), ("o", "same", "int", True)], schema)
    got = {r["field"]: (r["kind"], r["breaking"]) for r in graph.contract_diff(v1, v2).collect()}
    assert got == {"a": ("type changed", True), "b": ("made required", True), "c": ("removed", True), "d": ("added", False), "e": ("added", True)}


def test_levels_and_fan_out(spark):
    c = spark.createDataFrame([(1, 7, 0.5), (1, 3, 0.5), (2, 9, 0.1)], "design INT, container INT, risk DOUBLE")
    d = spark.createDataFrame([(1,), (2,), (3,)], "design INT")
    assert rows(graph.levels_needed(d, c)) == sorted([(1, 1, None), (1, 2, None), (1, 3, 3), (2, 1, None), (2, 3, 9), (3, 1, None)], key=repr)


def test_findings_in_both_forms(spark):
    lines = [
        "Summary of four findings",
        "1. [VIOLATION — ADR-0007] the shop writes into the stock tables",
        "2. [GAP] nobody decided on the cache",
        "3. [DRIFT — ADR-0003] cache",
        "the shop writes into the stock tables: VIOLATION (ADR-0007)",
        "cache ttl DRIFT (update ADR-0003)",
        "queue GAP (new ADR needed)",
        "api layer CONFORMS",
        "VIOLATION (ADR-0007): OrderService writes into the stock tables",
        "DRIFT (update ADR-0003) - cache ttl",
        "GAP: nobody decided on the queue",
    ]
    got = [(r["verdict"], r["decision"]) for r in review.parse_findings(spark.createDataFrame([(l,) for l in lines], "line STRING")).collect()]
    assert got == [("UNTAGGED", None), ("VIOLATION", 7), ("GAP", None), ("DRIFT", 3), ("VIOLATION", 7), ("DRIFT", 3), ("GAP", None), ("CONFORMS", None), ("VIOLATION", 7), ("DRIFT", 3), ("GAP", None)]


def test_routing_examples(spark):
    """Six task shapes: refactor, crash hunt, watched tweak, nightly run, research, rename."""
    shapes = [("refactor", 0), ("segfault", 2), ("ui tweak", 1), ("nightly", 3), ("research", 3), ("rename", 2), ("unclear", None)]
    names = [f for f, _ in routing.RULES]
    tasks = spark.createDataFrame([(t, *[i == hit for i in range(4)]) for t, hit in shapes], "task STRING, " + ", ".join(f"{n} BOOLEAN" for n in names))
    got = {r["task"]: (r["target"], r["rule"]) for r in routing.route_first_match(tasks).collect()}
    assert got["refactor"] == ("autonomous coder", 1) and got["segfault"] == got["rename"] == ("terminal debugger", 3)
    assert got["ui tweak"] == ("supervised editor", 2) and got["nightly"] == got["research"] == ("orchestrator", 4)
    assert got["unclear"] == ("ask", 5)
    assert rows(routing.route_ambiguity(tasks)) == [("unclear", [])]


def test_overlaps_touching_ends_and_copies(spark):
    s = [("a", 1, 0, 10), ("b", 1, 10, 20), ("b", 1, 5, 6), ("b", 1, 5, 6), ("a", 1, 2, 8), ("c", 2, 0, 5), ("c", 2, 3, 9), ("d", 1, 4, 4)]
    df = spark.createDataFrame(s, "agent STRING, worktree INT, s INT, e INT")
    df = df.select("agent", "worktree", *[F.timestamp_seconds(F.col(c) * 86400).cast("timestamp_ntz").alias(n) for c, n in [("s", "start"), ("e", "end")]])
    got = routing.worktree_overlaps(df)
    assert rows(got, "worktree", "agent", F.day("start"), "n", "overlaps") == [(1, "a", 1, 1, 2), (1, "a", 3, 1, 2), (1, "b", 6, 2, 2)]
    pairs = got.agg(F.sum(F.col("n") * F.col("overlaps")) / 2).first()[0]
    assert pairs == 4
    assert rows(routing.peak_concurrency(df)) == [(1, 4), (2, 2)]


def test_sessions_join_up_across_periods(spark):
    times = ["2024-01-01 20:00:00", "2024-01-01 23:00:00", "2024-01-02 02:00:00", "2024-01-02 14:00:00", "2024-01-02 13:59:59"]
    df = spark.createDataFrame([("k", t) for t in times], "k STRING, ts STRING").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = routing.activity_sessions(df, ["k"], 12 * 3600)
    assert rows(got, "events") == [(5,)]
    assert rows(routing.activity_sessions(df, ["k"], 3 * 3600), "events") == [(1,), (1,), (1,), (2,)]


def install_state(spark):
    desired = [("a", "/a", "link", "/c"), ("b", "/b", "link", "/c"), ("d", "/d", "link", "/c"), ("e", "/e", "link", "/c"), ("f", "/f", "link", "/c"), ("g", "/g", "link", "/c"), ("r", "/r", "rule", "text"), ("q", "/q", "rule", "text")]
    observed = [
        ("/b", "link", "/c", None, False, True), ("/d", "link", "/other", None, False, True), ("/e", "directory", None, None, True, True),
        ("/f", "directory", None, None, False, True), ("/g", "link", "/c", None, False, False), ("/r", "file", None, "old", False, True),
    ]
    d = spark.createDataFrame(desired, "label STRING, path STRING, entry STRING, target STRING")
    o = spark.createDataFrame(observed, "path STRING, kind STRING, link STRING, content STRING, has_manifest BOOLEAN, resolves BOOLEAN")
    return d, o


def test_install_outcomes(spark):
    d, o = install_state(spark)
    assert dict(rows(reconcile.check_state(d, o), "label", "state")) == {
        "a": "missing", "b": "link ok", "d": "link elsewhere", "e": "directory ok", "f": "no manifest", "g": "missing", "r": "present", "q": "missing",
    }
    assert dict(rows(reconcile.plan_install(d, o), "label", "action")) == {
        "a": "create", "b": "no-op", "d": "update", "e": "skip", "f": "skip", "g": "no-op", "r": "write", "q": "write",
    }
    assert dict(rows(reconcile.plan_removal(d, o), "label", "action")) == {
        "a": "nothing", "b": "remove", "d": "remove", "e": "leave", "f": "leave", "g": "remove", "r": "remove", "q": "nothing",
    }
    status = reconcile.overall_status(reconcile.check_state(d, o).withColumns({"s": F.lit(1), "ord": -F.ascii("label")}), ["s"]).first()
    assert (status["all_passed"], status["failing"], status["first_failing"]) == (False, 5, "q")
    assert rows(reconcile.replan_is_noop(d, o)) == [("link", "no-op", 4, 0), ("link", "skip", 2, 0), ("rule", "write", 2, 0)]


def test_capture_ignores_repeated_controls(spark):
    control = [(1, 1, "CAPTURE"), (1, 3, "CAPTURE"), (1, 5, "STOP"), (1, 6, "STOP"), (1, 8, "CAPTURE")]
    at = F.timestamp_seconds(F.col("h") * 3600).cast("timestamp_ntz").alias("ts")
    c = spark.createDataFrame(control, "track INT, h INT, event STRING").select("track", at, F.col("h").alias("seq"), "event")
    s = spark.createDataFrame([(1, h, 0.5) for h in (0, 2, 4, 7, 9, 40)], "track INT, h INT, x DOUBLE").select("track", at, (F.col("h") + 100).alias("seq"), "x")
    got = signal.capture_regions(s, c)
    assert rows(got, F.hour("region"), F.col("seq") - 100, "open") == [(1, 2, False), (1, 4, False), (8, 40, True), (8, 9, True)]


def test_only_complete_blocks_are_gated_in(spark):
    def loud(steps):
        rows = [("a", f"2024-01-01 {h:02d}:{m:02d}:00", e) for h, e in steps for m in (0, 30)]
        df = spark.createDataFrame(rows, "track STRING, ts STRING, e DOUBLE").withColumn("ts", F.to_timestamp("ts"))
        return [(r["blocks"], round(r["lufs"], 3)) for r in signal.integrated_loudness(df, "1 HOUR").collect()]

    assert loud([(5, 1.0)]) == []
    assert loud([(h, 1.0) for h in range(4)]) == [(1, -0.691)]
    assert loud([(h, 1.0) for h in range(6)]) == [(3, -0.691)]
    assert loud([(0, 1.0), (3, 1.0)]) == [(1, -3.701)]  # two of four steps are silent


def test_gain_is_capped_and_silence_kept(spark):
    levels = spark.createDataFrame([("loud", -10.0, -3.0), ("quiet", -30.0, -20.0), ("peaky", -30.0, -2.0), ("silent", None, None)], "track STRING, lufs DOUBLE, peak_db DOUBLE")
    got = {r["track"]: (r["gain_db"], r["capped"]) for r in signal.track_gain(levels).collect()}
    assert got == {"loud": (-4.0, False), "quiet": (16.0, False), "peaky": (1.0, True), "silent": (None, None)}
    flat = spark.createDataFrame([(1, "2024-01-01 00:00:00", 0.0)], "track INT, ts STRING, x DOUBLE").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert rows(signal.peak_meter(flat, ["track"], "1 hour"), "peak_db") == [(None,)]


def test_delivery_spec(spark):
    files = [("ok", 44100, 24, 2, -14.2, -1.0), ("bad", 48000, 16, 1, -20.0, 0.0), ("unknown", None, 24, 2, None, -3.0)]
    df = spark.createDataFrame(files, "file STRING, rate INT, depth INT, channels INT, lufs DOUBLE, peak_db DOUBLE")
    got = rows(signal.output_conformance(df, 1.0))
    assert got == [("bad", "bit depth"), ("bad", "channels"), ("bad", "loudness"), ("bad", "peak"), ("bad", "sample rate"), ("unknown", "loudness"), ("unknown", "sample rate")]


def test_pass_chain_balances(spark):
    texts = [(i, "same words here" if i % 3 == 0 else f"text {i}") for i in range(60)]
    df = signal.mark_duplicates(spark.createDataFrame(texts, "id INT, text STRING"), "id", "text")
    assert df.filter("duplicate").count() == 19 and not df.filter("id = 0").first()["duplicate"]
    passes = {"odd": F.col("id") % 2 == 1, "duplicate": F.col("duplicate")}
    chained = signal.pass_chain(df, passes, passes)
    assert rows(signal.pass_summary(chained, list(passes))) == [(1, "odd", 60, 30, 30), (2, "duplicate", 30, 9, 21)]
    assert signal.pass_chain(df, passes, []).filter("removed_by IS NOT NULL").isEmpty()


def test_quantise_clips(spark):
    df = spark.createDataFrame([(1, 1.0), (1, -1.0), (1, 0.5), (1, -1.1)], "track INT, x DOUBLE")
    assert rows(signal.quantise(df, 8), "x", "q", "clipped") == [(-1.0, -128, False), (-1.1, -128, True), (0.5, 64, False), (1.0, 127, True)]


def test_separation_quality(spark):
    ref = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0), (2, 0, 3.0)], "track INT, i INT, s DOUBLE")
    est = spark.createDataFrame([(1, 0, 0.9), (1, 1, 1.1), (2, 0, 3.0)], "track INT, i INT, e DOUBLE")
    got = dict(rows(signal.separation_quality(ref, est)))
    assert got[1] == pytest.approx(20.0) and got[2] is None


@pytest.mark.parametrize("buckets", [1 << 14, 8])
def test_heavy_keys_are_exact_and_none_is_lost(spark, buckets):
    import random
    from collections import Counter

    rnd = random.Random(3)
    events = [(g, int(rnd.paretovariate(0.6)) if rnd.random() < 0.9 else None) for g in ("a", "b", None) for _ in range(4000)]
    events += [("a", -1)] * 2000 + [("c", 1)]
    counts, totals = Counter(events), Counter(g for g, _ in events)
    want = {(g, key): n for (g, key), n in counts.items() if n * 50 > totals[g]}
    got = quality.heavy_keys(spark.createDataFrame(events, "grp STRING, key BIGINT"), 50, buckets).collect()
    assert {(r["grp"], r["key"]): r["hits"] for r in got} == want and len(got) == len(want) > 10
    assert all(abs(r["share"] - r["hits"] / totals[r["grp"]]) < 1e-12 for r in got)
