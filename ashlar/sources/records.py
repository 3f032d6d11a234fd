"""Record files ``NNNN-short-title.md`` in and out.

Both are a Python data source. A reading task takes many small files at once; a writing task puts its rows down as plain
files, first under a hidden name and then renamed, so a task that runs twice leaves the same files and a reader never sees
half of one.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# The data source travels with its code: the workers that plan a scan or a write see no files sent to executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the file name format.
RECORD_PATH = r"([^/]+)/([0-9]{4,})-([A-Za-z0-9-]+)\.md$"
SLUG = "^[A-Za-z0-9-]+$"


#: A reading task's share; a larger file is a task of its own.
SLICE_FILES, SLICE_BYTES = 4096, 32 << 20


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record file: series (its folder), num, slug and the whole text.

    ``path`` holds plain files, at any depth; hidden files and other names are passed over. The driver lists names and sizes
    only. Bytes that aren't UTF-8 become replacement signs. Stores without a Python file system go through
    :func:`scan_records`.
    """
    spark.dataSource.register(RecordFiles)
    return spark.read.format("record_files").load(path)


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """The rows of :func:`read_records` by Spark's whole-text scan: any store Spark reads, about thirty files to a task."""
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    at = F.col("_metadata.file_path")
    rows = texts.select(
        F.regexp_extract(at, RECORD_PATH, 1).alias("series"),
        F.regexp_extract(at, RECORD_PATH, 2).alias("_num"),
        F.regexp_extract(at, RECORD_PATH, 3).alias("slug"),
        F.col("value").alias("text"),
    )
    numbered = rows.filter(F.col("_num") != "").withColumn("num", F.col("_num").cast("bigint"))
    return numbered.select("series", "num", "slug", "text")


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system behind a path and the path in it; one without a scheme is a folder that all machines mount."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Slice(InputPartition):
    files: list[str]


class RecordReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Slice]:
        store, folder = store_of(self.path)
        slices, taken = [Slice([])], 0
        for info in store.get_file_info(fs.FileSelector(folder, recursive=True)):
            if not info.is_file or info.base_name.startswith((".", "_")) or not re.search(RECORD_PATH, info.path):
                continue
            here = slices[-1].files
            if here and (len(here) == SLICE_FILES or taken + info.size > SLICE_BYTES):
                here, taken = [], 0
                slices.append(Slice(here))
            here.append(info.path)
            taken += info.size
        return slices

    def read(self, partition: Slice) -> Iterator[tuple]:
        store, _ = store_of(self.path)
        for path in partition.files:
            series, num, slug = re.search(RECORD_PATH, path).groups()
            with store.open_input_stream(path) as file:
                yield series, int(num), slug, file.read().decode("utf-8", "replace")


@dataclass
class Written(WriterCommitMessage):
    files: int


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = store_of(self.path)
        mine = uuid.uuid4().hex
        files = 0
        for batch in iterator:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hidden = f"{folder}/.{name}.{mine}"
                with store.open_output_stream(hidden) as out:
                    out.write(f"{text or ''}\n".encode())
                store.move(hidden, f"{folder}/{name}")
                files += 1
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = store_of(self.path)
        with store.open_output_stream(f"{folder}/_SUCCESS") as out:
            out.write(f"{sum(m.files for m in messages if m)}\n".encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = store_of(self.path)
        store.delete_dir_contents(folder, missing_dir_ok=True)


class RecordFiles(DataSource):
    """Reads (series, num, slug, text); writes rows (file, text) as one plain file each, into the folder ``path``."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> str:
        return "series STRING, num BIGINT, slug STRING, text STRING"

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"])


def write_records(records: DataFrame, path: str) -> int:
    """records(num, slug, text): one file per record, closed by a line end; the files of ``path`` are replaced.

    Returns the number of files, which ``_SUCCESS`` holds too; a folder without it isn't whole. Null text is an empty record.
    A number below 0, a slug of other signs than letters, digits and hyphens, or two records of one name are a ValueError
    before anything is written. Rows stay in their partitions: only the names are shuffled, for that check.
    """
    spark = records.sparkSession
    num = F.col("num").cast("bigint")
    fits = F.coalesce((num >= 0) & F.col("slug").rlike(SLUG), F.lit(False))
    names = records.groupBy(num.alias("num"), "slug").agg(F.count(F.lit(1)).alias("_n"))
    found = names.agg(F.count_if(~fits).alias("bad"), F.count_if(F.col("_n") > 1).alias("twice"), F.sum("_n").alias("files")).first()
    if found["bad"] or found["twice"]:
        raise ValueError(f"{found['bad']} names no record can have, {found['twice']} names of several records")
    spark.dataSource.register(RecordFiles)
    store, folder = store_of(path)
    store.create_dir(folder, recursive=True)
    store.delete_dir_contents(folder)
    named = records.select(F.format_string("%04d-%s.md", num, F.col("slug")).alias("file"), F.col("text").cast("string").alias("text"))
    named.write.format("record_files").mode("append").save(path)
    return found["files"] or 0
