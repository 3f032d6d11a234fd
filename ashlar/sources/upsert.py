"""Keyed current table fed by a stream; a replayed batch changes nothing.

Each micro-batch is reduced to its latest row per key and replaces the partition of its own batch number. Every few batches
a compaction folds these into the base, which is cut into buckets by a hash of the key, and a new generation begins:

    rows/g-G/upsert_batch=n       what came since generation G began
    base/g-G/upsert_bucket=b      current rows of a bucket, written when generation G began
    manifest/slot-(G mod 2)       one row: the last batch in the base, and for each bucket the generation that wrote it

A generation is there once its manifest is, one file that appears by a rename; the manifest before it stays. A writer that
dies earlier leaves folders that its next attempt replaces; one that dies later finds its batch counted. Only buckets that
got rows are written again. A reader takes the base and the batches of one generation, whatever came before it, and may
go on while the next generation lasts; older files are emptied.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ashlar.plans.loops import new_folder
from ashlar.sources.streams import run_batches

MANIFEST = "number INT, last BIGINT, schema STRING, buckets MAP<INT, INT>"
BATCH, BUCKET = "upsert_batch", "upsert_bucket"


def latest_by(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*key, "_row.*")


@dataclass
class Generation:
    number: int = 0
    last: int = -1
    schema: str = ""
    buckets: dict[int, int] = field(default_factory=dict)


class CurrentTable:
    """The table under ``root``: one writer, as a stream with one checkpoint is, and any number of readers.

    ``buckets`` bounds a compaction task to its share of the keys and stays the same for a table; ``every`` is the number of
    batches between compactions. Equal order goes to the later batch. A null key is a key like others.
    """

    def __init__(self, spark: SparkSession, root: str, key: Sequence[str], order: Sequence[str], buckets: int = 64, every: int = 16):
        self.spark, self.root, self.key, self.order = spark, root, list(key), list(order)
        self.buckets, self.every = buckets, every

    def start(self, schema: StructType) -> None:
        """An empty table, unless there is one; its columns must then be the same."""
        if {BATCH, BUCKET} & set(schema.names):
            raise ValueError(f"{BATCH} and {BUCKET} are columns of the table's own")
        self._open(0, schema)
        self._manifest(Generation(schema=schema.json())).write.mode("ignore").parquet(f"{self.root}/manifest/slot-0")
        if self._schema(self.generation()) != schema:
            raise ValueError(f"the table at {self.root} has other columns")

    def generation(self, back: int = 0) -> Generation | None:
        """The newest complete generation, or the one before it."""
        reader = self.spark.read.schema(MANIFEST).option("ignoreMissingFiles", True).option("recursiveFileLookup", True)
        rows = sorted(reader.parquet(f"{self.root}/manifest").collect(), key=lambda r: -r["number"])  # two rows at most
        return Generation(**rows[back].asDict()) if back < len(rows) else None

    def write(self, batch: DataFrame, number: int) -> None:
        """One micro-batch; written again, it replaces itself, or is passed over once the base holds it."""
        now = self.generation()
        if number <= now.last:
            return
        latest_by(batch, self.key, self.order).write.mode("overwrite").parquet(f"{self.root}/rows/g-{now.number}/{BATCH}={number}")
        if number - now.last >= self.every:
            self.compact(number)

    def read(self) -> DataFrame:
        """The latest row per key."""
        now = self.generation()
        return self._latest(self._batches(now), now, sorted(now.buckets)).select(self._schema(now).names)

    def compact(self, last: int) -> None:
        """Fold the batches up to ``last``, which are all there are, into the base and begin the next generation."""
        now, before = self.generation(), self.generation(1)
        batches, number = self._batches(now), now.number + 1
        touched = [r[0] for r in batches.select(self._bucket()).distinct().collect()]  # at most ``buckets`` numbers
        merged = self._latest(batches, now, touched).withColumn(BUCKET, self._bucket()).drop(BATCH)
        merged.repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite").parquet(f"{self.root}/base/g-{number}")
        self._open(number, self._schema(now))
        after = Generation(number, last, now.schema, now.buckets | dict.fromkeys(touched, number))
        self._manifest(after).write.mode("overwrite").parquet(f"{self.root}/manifest/slot-{number % 2}")
        if before:
            self._release(before, now)

    def _release(self, old: Generation, kept: Generation) -> None:
        """Empty what only ``old`` reads; the generations after it take their files from what ``kept`` names, or newer ones."""
        unused = {f"base/g-{g}" for g in set(old.buckets.values()) - set(kept.buckets.values())}
        empty = self.spark.createDataFrame([], self._schema(old))
        for folder in sorted(unused | {f"rows/g-{old.number}"}):
            empty.write.mode("overwrite").parquet(f"{self.root}/{folder}")

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _schema(self, g: Generation) -> StructType:
        return StructType.fromJson(json.loads(g.schema))

    def _manifest(self, g: Generation) -> DataFrame:
        return self.spark.createDataFrame([(g.number, g.last, g.schema, g.buckets)], MANIFEST).coalesce(1)

    def _open(self, number: int, schema: StructType) -> None:
        """A batch without rows, so that the folder of a new generation is there."""
        self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.root}/rows/g-{number}/{BATCH}=-1")

    def _batches(self, g: Generation) -> DataFrame:
        schema = self._schema(g).add(BATCH, LongType())
        return self.spark.read.schema(schema).parquet(f"{self.root}/rows/g-{g.number}")

    def _latest(self, batches: DataFrame, g: Generation, buckets: list[int]) -> DataFrame:
        paths = [f"{self.root}/base/g-{g.buckets[b]}/{BUCKET}={b}" for b in buckets if b in g.buckets]
        if paths:
            base = self.spark.read.schema(self._schema(g)).parquet(*paths)
            batches = batches.unionByName(base.withColumn(BATCH, F.lit(-1).cast("bigint")))
        return latest_by(batches, self.key, [*self.order, BATCH])


def upsert_stream(
    stream: DataFrame, key: Sequence[str], order: Sequence[str], root: str | None = None, mode: str = "append", every: int = 16
) -> DataFrame:
    """Run all available input into the table at ``root``; its latest rows. A later run with that root goes on."""
    table = CurrentTable(stream.sparkSession, root or new_folder(stream.sparkSession), key, order, every=every)
    table.start(stored(stream.schema))
    run_batches(stream, table.write, table.root, mode)
    return table.read()


def stored(schema: StructType) -> StructType:
    """Columns as a file gives them back: any may be null, nothing else is noted."""
    plain = StructType()
    for f in schema.fields:
        plain = plain.add(f.name, f.dataType, True)
    return plain
