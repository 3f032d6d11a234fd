"""Rows that a join would drop are dropped before its shuffle."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ashlar.llm import common, weighted_minhash


def written(spark):
    """Bytes that each stage so far has shuffled, by its number."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none, lists = sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList
    stages = sc._jsc.sc().statusStore().stageList(lists(), False, False, none, lists())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


@pytest.mark.parametrize("most", [26, 16, 10])
def test_every_key_is_marked_and_few_others(spark, monkeypatch, most):
    monkeypatch.setattr(common, "PLACE_BITS", most)
    table = spark.range(20000).select("id", F.xxhash64("id").alias("key"))
    found = table.where(common.marked(table.where("id % 10 = 0"), "key")("key"))
    assert found.where("id % 10 = 0").count() == 2000
    assert table.where("key < 0").count() and (most == 10 or found.count() < 2000 + 18000 / common.PLACES)
    assert table.where(common.marked(table.where("false"), "key")("key")).count() == 0


def test_texts_without_a_near_one_are_not_shuffled(spark, monkeypatch):
    # the counts of shingles have a fixed size, large beside so few texts
    monkeypatch.setattr(weighted_minhash, "document_frequencies", lambda docs: (np.ones(1 << weighted_minhash.BUCKET_BITS), 300))
    rng = random.Random(3)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(800)) for _ in range(300)]
    texts += [f"{t} more" for t in texts[:10]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(310, texts[5])] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more keys than are broadcast
    try:
        first = max(written(spark), default=-1)
        got = weighted_minhash.near_duplicates(table).collect()
        moved = sum(n for stage, n in written(spark).items() if stage > first)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: i - 300 if 300 <= i < 310 else 5 if i == 310 else i for i in range(311)}
    assert moved < 0.5 * sum(map(len, texts))
