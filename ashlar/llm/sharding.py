"""Shards by a two-pass external shuffle: scatter by seeded hash, then Fisher-Yates within each bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashlar.llm.common import Stored

SHARDS = 16
#: Bytes that a bucket should hold, and a task of the second pass, which takes its buckets one after another.
BUCKET_BYTES = 4 << 20
TASK_BYTES = 32 << 20
#: Copies of one row that are written out together.
COPIES = 4096
LAW = "key"


def text_size() -> Column:
    """UTF-8 bytes of the text and one more; a null text has none."""
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


def shard_of(shards: int) -> Column:
    """The shard whose seeded hash with the id is highest. A further shard only takes rows into itself."""
    draws = [F.struct(F.xxhash64(F.lit(n), F.col("doc_id")).alias("draw"), F.lit(n).alias("n")) for n in range(shards)]
    return (F.greatest(*draws) if shards > 1 else draws[0])["n"]


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A permutation of n places by swaps from the last place down."""
    order = np.arange(n)
    rng = np.random.default_rng(seed)
    picks = rng.integers(0, np.arange(n, 0, -1)) if n else order
    for i, j in zip(range(n - 1, 0, -1), picks.tolist(), strict=False):
        order[i], order[j] = order[j], order[i]
    return order


def salted(sized: DataFrame, stored: Stored, bucket_bytes: int) -> DataFrame:
    """``sized`` with a salt that parts rows equal in id and text where together they would overfill a bucket.

    Such rows are counted by all their columns, which copies leave as one row and a number, and written out again from that
    number, each copy with a salt of its own. So the salt doesn't depend on where a row was read, and stays when a task runs
    again.
    """
    marked = sized.withColumn("_shard_group", F.xxhash64("doc_id", "text"))
    full = marked.groupBy("_shard_group").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
    full = full.where((F.col("n") > bucket_bytes) & (F.col("rows") > 1))
    full = stored.keep(full.select("_shard_group"), "full")
    few = marked.join(full, "_shard_group", "left_anti").withColumn("_shard_salt", F.lit(0).cast("bigint"))
    counted = marked.join(full, "_shard_group", "left_semi").groupBy(*marked.columns).agg(F.count("*").alias("_shard_n"))
    parts = counted.withColumns({"_shard_row": F.xxhash64(F.to_json(F.struct(*sized.columns))),
                                 "_shard_part": F.explode(F.expr(f"sequence(0L, (_shard_n - 1) div {COPIES})"))})
    copies = parts.repartition("_shard_row", "_shard_part").withColumn("_shard_copy", F.explode(F.expr(
        f"sequence(_shard_part * {COPIES}, least(_shard_n, (_shard_part + 1) * {COPIES}) - 1)")))
    salt = F.xxhash64("_shard_row", "_shard_copy")
    return few.unionByName(copies.withColumn("_shard_salt", salt).select(few.columns))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 7, bucket_bytes: int = BUCKET_BYTES,
          task_bytes: int = TASK_BYTES) -> DataFrame:
    """``docs`` with size, law, shard, slot and grown_shard, in the order they are to be written.

    The law is ``key``: doc_id and the number of shards decide; ``grown_shard`` is the shard if there were one
    more. Pass one scatters whole records by (shard, hash of id and text) into buckets of about ``bucket_bytes``;
    pass two shuffles each bucket in memory. ``slot`` runs from 0 in each shard without gaps. Rows with one id, null
    too, share a shard but not a bucket; rows equal in id and text share a bucket until it is full and are dealt
    over all buckets of their shard beyond that. Null texts have size 1. Columns of the added names are replaced,
    columns whose names begin with ``_shard_`` are dropped. An empty table gives no rows. Buckets and tasks grow in number with
    the table, not in size; what is counted for each bucket stays a table.
    """
    named = ["size", "law", "shard", "grown_shard", "slot"]
    plain = docs.drop(*named, "bucket", *[c for c in docs.columns if c.startswith("_shard_")])
    sized = plain.withColumns({"size": text_size(), "law": F.lit(LAW), "shard": shard_of(shards),
                               "grown_shard": shard_of(shards + 1)})
    stored = Stored(docs.sparkSession)
    total = sized.agg(F.sum("size").alias("n")).first()["n"] or 0
    each = max(1, -(-total // (shards * bucket_bytes)))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text", "_shard_salt"), F.lit(each))
    placed = salted(sized, stored, bucket_bytes).withColumn("bucket", bucket).drop("_shard_group", "_shard_salt")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    first = F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shard_first")
    firsts = stored.keep(counts.select("shard", "bucket", first), "firsts")
    schema = T.StructType([*(placed.schema[c] for c in (*plain.columns, *named[:-1])), T.StructField("slot", T.LongType())])
    keep = [*plain.columns, *named[:-1]]

    def mixed(held: list[pa.RecordBatch], key: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        order = pa.array(fisher_yates(len(table), [seed, *key]))
        slots = pa.array(table.column("_shard_first")[0].as_py() + np.arange(len(table)))
        yield from table.take(order).select(keep).append_column("slot", slots).to_batches(2000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now: tuple[int, int] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column("shard").to_numpy(), batch.column("bucket").to_numpy()], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                key = (int(keys[lo, 0]), int(keys[lo, 1]))
                if now not in (None, key):
                    yield from mixed(held, now)
                    held = []
                now = key
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from mixed(held, now)

    tasks = min(shards * each, max(shards, -(-total // task_bytes)))
    scattered = placed.repartition(tasks, "shard", "bucket").join(firsts, ["shard", "bucket"])
    return scattered.sortWithinPartitions("shard", "bucket", "doc_id", F.crc32(F.col("text").cast("binary"))).mapInArrow(run, schema)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; files hold runs of slots in order."""
    sharded.write.partitionBy("shard").parquet(path)
