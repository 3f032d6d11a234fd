"""Rule lists evaluated in one projection: no join, no shuffle, no UDF."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank(col: Column) -> Column:
    """Null, empty or white-space text counts as missing."""
    return col.isNull() | (F.trim(col) == "")


def names_where(rules: Mapping[str, Column]) -> Column:
    """Array of the names whose condition is true (null counts as not true)."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))


def broken_rules(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row (keys…, rule) per broken rule."""
    return df.select(*keys, F.explode(names_where(rules)).alias("rule"))
