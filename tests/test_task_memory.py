"""Steps whose largest task would grow with the table."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ashlar.operators.quality import duplicate_writes
from ashlar.operators.review import finding_lint
from ashlar.plans import scans


@pytest.mark.parametrize("whole", [1_000_000, 50])
def test_repeated_keys_are_judged_in_tasks_by_rows(spark, monkeypatch, whole):
    monkeypatch.setattr(scans, "WHOLE_ROWS", whole)
    monkeypatch.setattr(scans, "TASK_ROWS", 20)
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 41 > 0, F.col("id") % 200)
    rows = spark.range(400).select(key.alias("key"), (F.col("id") % 4).alias("payload"), F.lit("x").alias("other"))
    df = duplicate_writes(rows, ["key"], ["payload"])
    if whole > 50:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and df.rdd.getNumPartitions() == 400 // 20 + 1
    copies = {}
    for r in rows.collect():
        copies.setdefault(r["key"], []).append(r["payload"])
    want = {(k, len(p), len(set(p)), "conflict" if len(set(p)) > 1 else "replay") for k, p in copies.items() if len(p) > 1}
    assert {(r["key"], r["copies"], r["payloads"], r["kind"]) for r in df.collect()} == want and len(want) > 50


@pytest.fixture
def plain_joins(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_findings_without_a_number_do_not_meet_in_one_task(spark, plain_joins):
    verdict = F.when(F.col("id") % 2 == 0, "GAP").otherwise("DRIFT")
    findings = spark.range(3000).select(
        "id", verdict.alias("verdict"), F.when(F.col("id") % 10 == 1, F.col("id")).alias("decision"),
        F.lit("src/a.py:1").alias("evidence"), F.lit("do it").alias("fix"))
    known = spark.range(1000).select(F.col("id").alias("num"))
    parts = finding_lint(findings, known.unionByName(known)).rdd.glom().collect()
    want = Counter((i, "unknown decision") for i in range(3000) if i % 10 == 1 and i >= 1000)
    want += Counter((i, "no decision") for i in range(3000) if i % 2 and i % 10 != 1)
    assert Counter(tuple(r) for part in parts for r in part) == want
    assert max(len(part) for part in parts) < 2 * sum(want.values()) / 8
