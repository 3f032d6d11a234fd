"""Running values along (key, order) that do not put a whole key into one task.

A plain window over ``partitionBy(key)`` sends every row of a key to one task. Here each key
is cut into chunks of its order column (a day, a month, a number range). A small aggregate
per (key, chunk), combined on the map side, yields the value each chunk starts with; it is
inserted as a seed row, and the running window then works per (key, chunk). The big side is
shuffled once and nothing is joined back. Only one row per (key, chunk) meets in a window
over the bare key.

A calendar says nothing of where the rows are: a bulk load puts a year of rows on one date. ``split`` measures the
chunks first and cuts those with more than CHUNK_ROWS rows at quantiles of a sample of (key, order).

Where most keys have few rows a chunk holds hardly more than one, and its aggregate is as large as the rows. ``in_two``
deals keys of at most WHOLE_ROWS rows whole, into tasks of about TASK_ROWS rows, and leaves chunks to the others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ashlar.plans.loops import Workspace

#: Rows of one key that a chunk may hold before it is cut by quantiles.
CHUNK_ROWS = 1_000_000
#: A key of more rows is not taken whole by one task.
WHOLE_ROWS = 100_000
#: Rows of a task that takes keys whole.
TASK_ROWS = 200_000
#: Rows are counted in so many buckets of keys before they are counted by key.
KEY_BUCKETS = 1 << 16


@dataclass(frozen=True)
class Carry:
    """``kind``: last (latest non-null value), sum or max; ``inclusive``: counts its own row."""

    kind: str
    value: Column
    inclusive: bool = True


def last(value: Column, inclusive: bool = True) -> Carry:
    return Carry("last", value, inclusive)


def running_sum(value: Column, inclusive: bool = True) -> Carry:
    return Carry("sum", value, inclusive)


def running_max(value: Column, inclusive: bool = True) -> Carry:
    return Carry("max", value, inclusive)


def _running(kind: str, value: Column) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True)
    return F.sum(value) if kind == "sum" else F.max(value)


def split(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column) -> DataFrame:
    """``df`` with ``_split``: 0, or a number that rises along ``order`` within a chunk of more than CHUNK_ROWS rows.

    The counts per (key, chunk) combine on the map side. Only rows of large chunks are dealt by range: splitters come from
    a sample of (key, order), so that each range holds about CHUNK_ROWS rows, whatever their dates; the number of the range
    is stored, so that both passes of the scan see the same one. Rows equal in the whole order stay together. If no chunk
    is large, nothing is moved.
    """
    space = Workspace(df.sparkSession)
    cut = df.withColumn("_cut", chunk)
    counts = cut.groupBy(*keys, "_cut").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CHUNK_ROWS)
    seen = Observation(f"chunks-{uuid.uuid4().hex}")
    counts = counts.observe(seen, F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"))
    large = space.keep(counts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_cut").alias("_of__cut")))
    if not (rows := seen.get["rows"]):
        return df.withColumn("_split", F.lit(0))
    in_large = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*keys, "_cut"]])
    dealt = cut.join(large, in_large, "left_semi").repartitionByRange(-(-rows // CHUNK_ROWS) + 1, *keys, *order)
    dealt = space.keep(dealt.withColumn("_split", F.spark_partition_id()))
    rest = cut.join(large, in_large, "left_anti").withColumn("_split", F.lit(0))
    return dealt.unionByName(rest).drop("_cut")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    carries: Mapping[str, Carry],
    reverse: bool = False,
    measured: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """``df`` plus one running column per carry.

    ``order`` must be total within a key unless ties cannot change a carry; ``chunk`` must not
    decrease along it.
    ``reverse`` runs from the last row to the first, so ``last`` becomes "next".
    ``measured`` counts the chunks first and splits large ones (see ``split``).
    ``tasks`` deals the chunks into so many tasks; without it the session's partitions count.
    """
    inputs = {f"_in_{n}": c.value for n, c in carries.items()}
    if measured:
        df, chunk = split(df, keys, order, chunk), F.struct(chunk.alias("cut"), F.col("_split").alias("split"))
    rows = df.withColumns({"_chunk": chunk, "_seed": F.lit(False), **inputs}).drop("_split")

    position = F.struct(*order)
    final = F.min_by if reverse else F.max_by

    def whole_chunk(name: str, kind: str) -> Column:
        value = F.col(f"_in_{name}")
        if kind == "last":
            return final(value, F.when(value.isNotNull(), position))
        return F.sum(value) if kind == "sum" else F.max(value)

    chunks = rows.groupBy(*keys, "_chunk").agg(
        *[whole_chunk(n, c.kind).alias(f"_in_{n}") for n, c in carries.items()]
    )
    chunk_order = F.col("_chunk").desc() if reverse else F.col("_chunk").asc()
    earlier = Window.partitionBy(*keys).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    seeds = chunks.select(
        *keys,
        "_chunk",
        F.lit(True).alias("_seed"),
        *[_running(c.kind, F.col(f"_in_{n}")).over(earlier).alias(f"_in_{n}") for n, c in carries.items()],
    )

    ordering = [F.col(o).desc() if reverse else F.col(o).asc() for o in order]
    inside = Window.partitionBy(*keys, "_chunk").orderBy(F.col("_seed").desc(), *ordering)
    running = {
        n: _running(c.kind, F.col(f"_in_{n}")).over(
            inside.rowsBetween(Window.unboundedPreceding, 0 if c.inclusive else -1)
        )
        for n, c in carries.items()
    }
    seeded = rows.unionByName(seeds, allowMissingColumns=True)
    if tasks:
        seeded = seeded.repartition(tasks, *keys, "_chunk")
    return (
        seeded.withColumns(running)
        .filter(~F.col("_seed"))
        .drop("_chunk", "_seed", *inputs)
    )


class Whole:
    """Running values of rows that were dealt by key: plain windows, which move nothing."""

    def cut(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column) -> DataFrame:
        return df

    def keep(self, df: DataFrame) -> DataFrame:
        return df

    def scan(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], carries: Mapping[str, Carry], reverse: bool = False) -> DataFrame:
        along = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() if reverse else F.col(o).asc() for o in order])
        return df.withColumns({
            n: _running(c.kind, c.value).over(along.rowsBetween(Window.unboundedPreceding, 0 if c.inclusive else -1))
            for n, c in carries.items()})


class Chunked:
    """Running values of keys that are cut into chunks, which lie in the column ``_at``."""

    def __init__(self, space: Workspace, tasks: int) -> None:
        self.space, self.tasks = space, tasks

    def cut(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column) -> DataFrame:
        parts = split(df, keys, order, chunk)
        return parts.withColumn("_at", F.struct(chunk.alias("cut"), F.col("_split").alias("split"))).drop("_split")

    def keep(self, df: DataFrame) -> DataFrame:
        """A scan reads its input twice, so that chained scans would double the work each time."""
        return self.space.keep(df)

    def scan(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], carries: Mapping[str, Carry], reverse: bool = False) -> DataFrame:
        return scan(df, keys, order, F.col("_at"), carries, reverse, tasks=self.tasks)


def in_two(df: DataFrame, keys: Sequence[str], run: Callable[[DataFrame, Whole | Chunked], DataFrame]) -> DataFrame:
    """``run`` over the keys of at most WHOLE_ROWS rows, dealt by key into tasks of about TASK_ROWS rows, and over the others.

    Whatever ``run`` groups or orders by the keys and more needs no further shuffle in the first part. Rows are counted in
    KEY_BUCKETS buckets, combined on the map side; only keys of buckets that hold more than WHOLE_ROWS are counted singly.
    """
    space = Workspace(df.sparkSession)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int")
    seen = Observation(f"keys-{uuid.uuid4().hex}")
    over = F.col("_n") > WHOLE_ROWS
    counts = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.observe(seen, F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count_if(over).alias("over"))
    buckets = space.keep(counts.filter(over).select("_bucket"))
    rows, large = seen.get["rows"], 0
    if seen.get["over"]:
        met = df.withColumn("_bucket", bucket).join(buckets, "_bucket", "left_semi")
        found = met.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n")).filter(over)
        sizes = Observation(f"keys-{uuid.uuid4().hex}")
        found = space.keep(found.observe(sizes, F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")).drop("_n"))
        large = sizes.get["rows"]
    if not large:
        return run(df.repartition(-(-rows // TASK_ROWS) + 1, *keys), Whole())
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    whole = df.join(found, same, "left_anti").repartition(-(-(rows - large) // TASK_ROWS) + 1, *keys)
    return run(whole, Whole()).unionByName(run(df.join(found, same, "left_semi"), Chunked(space, -(-large // TASK_ROWS) + 1)))
