"""Pipeline stages on nulls, empty texts, repeated rows, columns named like the operators' own, and an empty table."""

from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
CLASHES = ["score", "predicted", "held_out", "document", "_document", "class_id", "is_kept", "spans", "kept_text", "n_words",
           "hit_words", "items", "todo", "full", "row", "a.b"]


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None), (None, None), (900001, ""), (900002, "word " * 60000), (900003, None), (None, "two words")]
    more = spark.createDataFrame(odd, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    docs = docs.unionByName(more, allowMissingColumns=True)
    docs = docs.withColumns({c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(-1)).cast("string")) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        had = {r["doc_id"] for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        found = out.collect()
        assert {r["doc_id"] for r in found} <= had
        for r in found:
            assert all(r[c] == f"{c}{-1 if r['doc_id'] is None else r['doc_id']}" for c in CLASHES), name
        docs = spark.createDataFrame(found, docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_an_empty_table_gives_no_rows(spark):
    docs = spark.createDataFrame([], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == [], name
