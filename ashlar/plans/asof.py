"""As-of join: for each left row the latest right row of the same key, by a chunked scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.plans.scans import last, scan


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    take: Sequence[str],
    tie: Sequence[str] = (),
    unit: str = "month",
    strict: bool = False,
) -> DataFrame:
    """All left columns plus ``take`` of the last right row at or before ``left_time``
    (before it when ``strict``). Right rows of one time are ordered by ``tie``."""
    first, second = (0, 1) if not strict else (1, 0)
    r = right.select(
        *keys,
        F.col(right_time).alias("_t"),
        F.lit(first).alias("_side"),
        F.struct(F.lit(0), *tie).alias("_tie"),
        F.struct(*take).alias("_right"),
        F.lit(0).cast("long").alias("_salt"),
    )
    l = left.select(
        *keys,
        F.col(left_time).alias("_t"),
        F.lit(second).alias("_side"),
        F.struct(*left.columns).alias("_left"),
        # Left rows of one time may stand in any order; told apart, they can be split.
        F.xxhash64(*[c for c, kind in left.dtypes if "map<" not in kind]).alias("_salt"),
    )
    both = l.unionByName(r, allowMissingColumns=True)
    chunk = F.date_trunc(unit, F.col("_t").cast("timestamp"))
    found = scan(both, keys, ["_t", "_side", "_tie", "_salt"], chunk, {"_found": last(F.col("_right"))}, measured=True)
    return found.filter(F.col("_left").isNotNull()).select("_left.*", "_found.*")
