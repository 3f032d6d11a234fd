"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the shared folder and read
again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.llm import decontaminate, packing, suffix_dedup, toxicity, weighted_minhash
from ashlar.llm.common import Stored
from ashlar.llm.queries import tokenizer_path


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all else in one column, so that no name of an operator's meets one of the table's."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))


def _restored(found: DataFrame, docs: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    changed = {"text": F.col("text"), **(changed or {})}
    return found.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, learned from ``labels``, doesn't reject.

    Null and empty texts match no clause and stay; repeated rows are judged alike. All columns keep their values, whatever
    their names; an empty table gives no rows.
    """
    judged = toxicity.toxicity(_carried(docs), toxicity.read(spark, sf_dir, "labels"))
    return _restored(judged.where("predicted = 0"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the first by doc_id, nulls last.

    Rows equal in id and text are one document, of which one row stays; null and empty texts are one class. All columns keep
    their values, whatever their names; an empty table gives no rows.
    """
    return _restored(weighted_minhash.keep_one(_carried(docs)), docs)


def cut_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the bytes of repeated 200-byte strings; a character cut in two goes as a whole.

    Null texts become empty, rows equal in id and text lose what they share; n_chars follows the text. All other columns keep
    their values, whatever their names; an empty table gives no rows.
    """
    cut = suffix_dedup.remove_substrings(_carried(docs))
    return _restored(cut, docs, {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")})


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than one in twenty lies in a window of a benchmark item.

    Null and wordless texts stay; repeated rows are judged alike. All columns keep their values, whatever their names; an empty
    table gives no rows.
    """
    found = decontaminate.find_contamination(_carried(docs), toxicity.read(spark, sf_dir, "benchmark"))
    return _restored(found.where(~decontaminate.is_contaminated(F.col("n_words"), F.size("hit_words"))), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 ids.

    A null or empty text is its closing id alone; each row is a document. Other columns are left out; an empty table gives
    no rows.
    """
    return packing.pack(docs, tokenizer_path(), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_substrings", cut_repeated_substrings),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Learned weights, sampled draws and token ids have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = Stored(spark)
    docs = toxicity.read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stored.keep(stage(spark, docs, sf_dir), f"{number}-{name}")
    return docs


QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
