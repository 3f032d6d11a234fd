"""Decision, story and ledger rows out, partitioned by kind."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

APPEND_ONLY = ("ledger",)


def write_artifacts(rows: DataFrame, root: str, append_only: Collection[str] = APPEND_ONLY) -> None:
    """rows(kind, …): append-only kinds are added to, every other kind present replaces its own partition."""
    grows = F.col("kind").isin(list(append_only))
    replaced = rows.filter(~grows).write.partitionBy("kind").mode("overwrite")
    replaced.option("partitionOverwriteMode", "dynamic").parquet(f"{root}/records")
    rows.filter(grows).write.partitionBy("kind").mode("append").parquet(f"{root}/log")


def read_artifacts(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/records").unionByName(spark.read.parquet(f"{root}/log"))
