"""Lineage cuts for driver loops, on storage every executor can reach.

A cut writes a table and reads it back. Unlike a cached or locally stored result it survives lost
executors, the next plan starts from files with known sizes, and nothing of the old plan is kept.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local session may fall back to a temporary folder."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ashlar-"))
    return sc.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A fresh folder on the storage all executors share."""
    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"


@contextmanager
def cells_joined_in_place(spark: SparkSession) -> Iterator[None]:
    """Within it, sides dealt alike by the first of their join keys are joined without being dealt again by all of them."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Workspace:
    """Tables of one loop. State that each round replaces alternates between two slots, so a loop
    holds at most two copies of it however long it runs."""

    def __init__(self, spark: SparkSession) -> None:
        self.root = new_folder(spark)
        self.rounds: dict[str, int] = {}
        self.kept = 0

    def _store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def state(self, df: DataFrame, name: str, where: Column | None = None) -> tuple[DataFrame, int]:
        """The next value of a loop variable, and how many of its rows meet ``where`` (default: all).

        The value before the last one is overwritten. The count is observed while writing, so a
        stop test costs no job of its own.
        """
        table, counts = self.counted(df, name, n=F.lit(True) if where is None else where)
        return table, counts["n"]

    def counted(self, df: DataFrame, name: str, **where: Column) -> tuple[DataFrame, dict[str, int]]:
        """The same with one count for each of several conditions."""
        turn = self.rounds.get(name, 0)
        self.rounds[name] = turn + 1
        seen = Observation(f"{name}-{turn}-{uuid.uuid4().hex}")
        counts = [F.count_if(condition).alias(n) for n, condition in where.items()]
        table = self._store(df.observe(seen, *counts), f"{name}-{turn % 2}")
        return table, seen.get

    def part(self, df: DataFrame, name: str, column: str, value: int) -> None:
        """Rows of one round, added to the table ``name`` under column = value; written again, they replace themselves."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/{column}={value}")

    def parts(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        """All rounds of ``name`` as one table; its plan doesn't grow with their number."""
        return spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def keep(self, df: DataFrame) -> DataFrame:
        """A table that stays."""
        self.kept += 1
        return self._store(df, f"kept-{self.kept}")
