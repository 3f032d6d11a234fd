"""Rows of one task follow a fixed number, not the number of partitions that the session has."""

from collections import Counter

from pyspark.sql import functions as F

from ashlar.operators import signal


def test_loudness_is_dealt_by_rows(spark, monkeypatch):
    hour = F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id % 50 AS int))")
    energy = spark.range(3000).select((F.col("id") % 60).alias("track"), hour.alias("ts"), ((F.col("id") * 7919 % 101) / 100).alias("e"))
    energy = energy.unionByName(energy.limit(1).withColumn("track", F.lit(None).cast("long")))

    def rows():
        found = signal.integrated_loudness(energy, "1 HOUR").select("track", F.round("lufs", 6), "blocks")
        return Counter(tuple(r) for r in found.collect())
    plain = rows()
    monkeypatch.setattr(signal, "TASK_STEPS", 20)
    steps = energy.filter("track IS NOT NULL").select("track", "ts").distinct().count()
    assert signal.loudness_blocks(energy, "1 HOUR").rdd.getNumPartitions() > steps // 20
    assert rows() == plain and len(plain) > 30
