"""Consecutive numbers over a whole table in a given order, without one task seeing all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.plans.loops import Workspace
from ashlar.plans.scans import running_sum, scan


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` plus ``name`` = 1, 2, 3 … along ``order`` (a total order).

    Rows are range-partitioned; the partition number is stored before use, so a lost executor
    cannot change it between the two passes.
    """
    ranged = Workspace(df.sparkSession).keep(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counted = scan(
        ranged.withColumn("_all", F.lit(0)), ["_all"], order, F.col("_range"), {name: running_sum(F.lit(1).cast("bigint"))}
    )
    return counted.drop("_range", "_all")
