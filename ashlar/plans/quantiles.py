"""Exact interpolated percentiles without holding a group's values in one task.

Values are first collapsed to (group, value, count) with map-side combine. A mergeable sketch
of fixed size then cuts each group into bins of about equal size; exact bin counts tell which
bins hold the wanted ranks, and only those bins are ranked. The sketch decides balance only:
the result is exact whatever its error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    weight: Column | None = None,
    bins: int = 64,
) -> DataFrame:
    """One row per group: ``n`` (non-null values) and one column per entry of ``probs``.

    ``weight`` counts a row several times (a whole number); ``bins`` is a power of two.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.sum(F.lit(1) if weight is None else weight).cast("bigint").alias("_c"))
        .filter(F.col("_c") > 0)
    )
    cuts = [i / bins for i in range(1, bins)]
    sketch = counts.groupBy(*keys).agg(F.percentile_approx("_v", cuts, 1000).alias("_cuts"))
    binned = _binned(_join(counts, sketch, keys), bins).select(*keys, "_v", "_c", "_bin")
    by_key = Window.partitionBy(*keys)
    upto = by_key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    edges = (
        binned.groupBy(*keys, "_bin")
        .agg(F.sum("_c").alias("_size"))
        .withColumns({"n": F.sum("_size").over(by_key), "_below": F.sum("_size").over(upto) - F.col("_size")})
    )

    def rank(p: float) -> Column:
        return F.lit(p) * (F.col("n") - 1)

    wanted = [f(rank(p)) for p in probs.values() for f in (F.floor, F.ceil)]
    holds = F.lit(False)
    for r in wanted:
        holds = holds | ((r >= F.col("_below")) & (r < F.col("_below") + F.col("_size")))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = _join(binned, edges.filter(holds), [*keys, "_bin"]).withColumn(
        "_first", F.col("_below") + F.sum("_c").over(inside) - F.col("_c")
    )

    def value_at(r: Column) -> Column:
        return F.max(F.when((r >= F.col("_first")) & (r < F.col("_first") + F.col("_c")), F.col("_v")))

    picked = ranked.groupBy(*keys, "n").agg(
        *[value_at(F.floor(rank(p))).alias(f"_lo_{name}") for name, p in probs.items()],
        *[value_at(F.ceil(rank(p))).alias(f"_hi_{name}") for name, p in probs.items()],
    )
    return picked.select(
        *keys,
        "n",
        *[
            (
                F.col(f"_lo_{name}")
                + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (rank(p) - F.floor(rank(p)))
            ).alias(name)
            for name, p in probs.items()
        ],
    )


def _binned(df: DataFrame, bins: int) -> DataFrame:
    """``_bin`` = number of ``_cuts`` below ``_v``, by binary search in plain expressions."""
    df, step = df.withColumn("_bin", F.lit(0)), bins // 2
    while step:
        above = F.try_element_at("_cuts", F.col("_bin") + step) < F.col("_v")
        df = df.withColumn("_bin", F.when(above, F.col("_bin") + step).otherwise(F.col("_bin")))
        step //= 2
    return df


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join that keeps null group keys, as ``groupBy`` does."""
    named = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(named, on).drop(*[f"_k_{k}" for k in keys])
