"""Rows equal in id and text: all kept, parted over buckets, the same on a second run."""

import collections

import pytest
from pyspark.sql import functions as F

from ashlar.llm import sharding
from ashlar.llm.common import Stored

SCHEMA = "doc_id long, text string, tags map<string,int>, size string, _shard_x int"


@pytest.fixture(scope="module")
def hot(spark):
    rows = [(None, None, None, "x", 1)] * 700 + [(5, "word " * 40, {"a": i % 3}, "x", 1) for i in range(900)]
    rows += [(i, f"text {i} " * (i % 9), None, None, None) for i in range(600)] + [(9, "y" * 20000, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(autouse=True)
def few_copies(monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 64)


def test_hot_rows_stay_whole(hot):
    got = sharding.shard(hot, shards=4, bucket_bytes=600, task_bytes=5000).collect()
    tags = lambda t: tuple(sorted(t.items())) if t else None
    assert collections.Counter((r["doc_id"], r["text"], tags(r["tags"])) for r in got) == collections.Counter(
        (r["doc_id"], r["text"], tags(r["tags"])) for r in hot.collect())
    assert set(got[0].asDict()) == {"doc_id", "text", "tags", "size", "law", "shard", "grown_shard", "slot"}
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len((r["text"] or "").encode()) + 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    places = [r["slot"] for r in got if r["doc_id"] == 5]
    assert len({r["shard"] for r in got if r["doc_id"] == 5}) == 1 and max(places) - min(places) > 900  # among others


def test_salts_part_copies_and_stay(spark, hot):
    sized = hot.drop("size", "_shard_x").withColumn("size", sharding.text_size())

    def salts(df):
        out = sharding.salted(df, Stored(spark), 600)
        return collections.Counter((r["doc_id"], r["_shard_salt"]) for r in out.select("doc_id", "_shard_salt").collect())

    once = salts(sized)
    assert max(once.values()) == 2 and len([1 for k in once if k[0] == 5]) == 901  # id 5 has a short text as well
    assert len([1 for k in once if k[0] is None]) == 700
    assert once == salts(sized.repartition(11, F.rand(3)))
    assert sum(once.values()) == 2201


def test_few_rows_and_none(spark, hot):
    assert sharding.shard(hot.limit(0)).collect() == []
    assert [r["slot"] for r in sharding.shard(hot.where("doc_id = 9").limit(1)).collect()] == [0]
