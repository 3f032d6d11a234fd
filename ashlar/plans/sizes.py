"""Materialise a side of a join and learn its size before choosing how to join."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ashlar.plans.loops import Workspace

BROADCAST_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD = 64


def stored_with_size(df: DataFrame, text: str) -> tuple[DataFrame, int]:
    """``df`` written once, and an upper estimate of its bytes in memory (``text`` is its only wide column)."""
    seen = Observation(f"size-{uuid.uuid4().hex}")
    size = F.coalesce(F.sum(F.octet_length(text) + ROW_OVERHEAD), F.lit(0))
    table = Workspace(df.sparkSession).keep(df.observe(seen, size.alias("bytes")))
    return table, int(seen.get["bytes"])


def dealt_by_rows(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` stored, counted and dealt by ``key`` into tasks of about ``rows`` rows, whatever the session's partitions are."""
    table, n = Workspace(df.sparkSession).state(df, "dealt")
    return table.repartition(-(-n // rows) + 1, key)
