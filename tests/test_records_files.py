"""Record files: round trips, repeated tasks, names that don't fit."""

import os

import pytest
from pyspark.sql import functions as F

from ashlar.plans.loops import new_folder
from ashlar.sources import records
from ashlar.sources.records import RecordWriter, read_records, scan_records, write_records


def series(spark, n, parts=4):
    rows = spark.range(n, numPartitions=parts)
    return rows.select(F.col("id").alias("num"), F.concat(F.lit("use-"), "id").alias("slug"), F.concat(F.lit("# Ä "), "id").alias("text"))


def test_files_come_back_whole(spark, monkeypatch):
    monkeypatch.setattr(records, "SLICE_FILES", 100)
    folder = f"{new_folder(spark)}/adr"
    assert write_records(series(spark, 1000), folder) == 1000
    names = os.listdir(folder)
    assert len(names) == 1001 and "0007-use-7.md" in names and "_SUCCESS" in names
    got = read_records(spark, folder)
    assert {(r["series"], r["num"], r["slug"], r["text"]) for r in got.collect()} == {("adr", i, f"use-{i}", f"# Ä {i}\n") for i in range(1000)}
    assert got.exceptAll(scan_records(spark, folder)).isEmpty() and got.count() == 1000


def test_a_later_write_replaces_the_files(spark):
    folder = f"{new_folder(spark)}/adr"
    write_records(series(spark, 30), folder)
    write_records(series(spark, 3).withColumn("extra", F.lit(1)), folder)
    assert sorted(r["num"] for r in read_records(spark, folder).collect()) == [0, 1, 2]
    write_records(series(spark, 0), folder)
    assert read_records(spark, folder).collect() == []


def test_null_text_long_text_and_nested_folders(spark):
    root = new_folder(spark)
    rows = spark.createDataFrame([(12345, "a", None), (1, "b", "x" * 3_000_000)], "num INT, slug STRING, text STRING")
    write_records(rows, f"{root}/one/adr")
    write_records(rows.limit(1), f"{root}/two/rfc")
    with open(f"{root}/two/notes.md", "w") as f:
        f.write("no record")
    got = {(r["series"], r["num"]): r["text"] for r in read_records(spark, root).collect()}
    assert {k: len(v) for k, v in got.items()} == {("adr", 12345): 1, ("adr", 1): 3_000_001, ("rfc", 12345): 1}


@pytest.mark.parametrize("rows", [[(1, "a"), (1, "a")], [(1, "../a")], [(None, "a")], [(1, None)], [(-1, "a")]])
def test_names_that_do_not_fit_stop_the_write(spark, rows):
    folder = f"{new_folder(spark)}/adr"
    write_records(series(spark, 3), folder)
    with pytest.raises(ValueError):
        write_records(spark.createDataFrame(rows, "num INT, slug STRING").withColumn("text", F.lit("x")), folder)
    assert read_records(spark, folder).count() == 3


def test_a_task_that_runs_twice_or_stops_half_way(spark, tmp_path):
    import pyarrow as pa

    batch = pa.record_batch({"file": ["0001-a.md", "0002-b.md"], "text": ["one", "two"]})

    def breaks():
        yield batch.slice(0, 1)
        raise OSError("executor lost")

    writer = RecordWriter(str(tmp_path))
    with pytest.raises(OSError):
        writer.write(breaks())
    done = [writer.write(iter([batch])) for _ in range(2)][1]
    writer.commit([done, None])
    assert sorted(os.listdir(tmp_path)) == ["0001-a.md", "0002-b.md", "_SUCCESS"]
    assert (tmp_path / "_SUCCESS").read_text() == "2\n"
    writer.abort([None])
    assert os.listdir(tmp_path) == []
