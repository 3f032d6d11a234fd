"""Definitions ledger: append-only rows (term, definition, source, recorded, seq)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.functions.lint import blank, names_where
from ashlar.functions.text import MEASURE, MEASURE_LEAD, tokens, words
from ashlar.plans.asof import asof_join
from ashlar.plans.sizes import BROADCAST_BYTES, stored_with_size

# What an intake must state.
INTAKE_FACTS = ["purpose", "quality", "scale", "constraints", "evolution"]
UNCONFIRMED = "assumption"


def ledger_current(ledger: DataFrame, key: Sequence[str] = ("term",)) -> DataFrame:
    """The latest row per key by (recorded, seq); combined on the map side, no sort of the history."""
    rest = [c for c in ledger.columns if c not in key]
    latest = F.max_by(F.struct(*rest), F.struct("recorded", "seq"))
    return ledger.groupBy(*key).agg(latest.alias("_row")).select(*key, "_row.*")


def ledger_open(ledger: DataFrame) -> DataFrame:
    """Current terms that may not pass to design, with the reason."""
    reason = F.when(blank(F.col("definition").cast("string")), "undefined").when(
        F.lower(F.trim("source")).startswith(UNCONFIRMED), "unconfirmed"
    )
    return ledger_current(ledger).withColumn("reason", reason).filter(F.col("reason").isNotNull())


def undefined_terms(
    docs: DataFrame, vocab: DataFrame, ledger: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Watched terms without a ledger row that occur in each document, with hit counts.

    docs(doc_id, text), vocab(term), ledger(term). A term is one word or several; case and what stands between the words
    don't matter, in the vocabulary, the ledger and the text. ``term`` is spelled as in the vocabulary. Overlapping
    occurrences count each. Terms and texts without a word, nulls among them, match nothing.

    The index holds the words of each term under its first word. Each word of a text carries the words after it, as many
    as the longest term has, and meets the terms that begin with it. The index is stored and measured. If it fits, it is
    broadcast, and words that begin no term are dropped where they are read. Otherwise equal stretches of a document are
    counted first, which combines on the map side, so that a frequent word is not one hot key of raw words.
    """
    known = ledger.select(F.concat_ws(" ", words(F.col("term"))).alias("_name")).distinct()
    named = vocab.select("term", words(F.col("term")).alias("_words")).distinct().filter(F.size("_words") > 0)
    watched = named.withColumn("_name", F.concat_ws(" ", "_words")).join(known, "_name", "left_anti")
    index, size = stored_with_size(watched.withColumn("_first", F.element_at("_words", 1)), "_name")
    longest = index.agg(F.coalesce(F.max(F.size("_words")), F.lit(1))).first()[0]
    # The array of one array keeps the words of a text from being split again for each shift.
    text = docs.select("doc_id", F.explode(F.array(tokens(F.col("text")))).alias("_all")).filter("_all IS NOT NULL")
    shifted = [F.slice("_all", k + 1, F.size("_all")).alias(f"_w{k}") if k else F.col("_all") for k in range(longest)]
    stretch = [f"_w{k}" for k in range(longest)]
    at = text.select("doc_id", F.inline(F.arrays_zip(*shifted))).toDF("doc_id", *stretch)
    begins = F.col("_w0") == F.col("_first")
    fits = (F.size("_words") == 1) | (F.slice(F.array(*stretch), 1, F.size("_words")) == F.col("_words"))
    if 4 * size <= broadcast_bytes:  # name, words, first word and the term as spelled
        hits = at.join(F.broadcast(index), begins).filter(fits).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("hits"))
    else:
        counted = at.groupBy("doc_id", *stretch).agg(F.count(F.lit(1)).alias("_n"))
        hits = counted.join(index, begins).filter(fits).groupBy("doc_id", "term").agg(F.sum("_n").alias("hits"))
    return hits.select("doc_id", "term", "hits")


def extract_measures(rows: DataFrame, text: str) -> DataFrame:
    """One row per number of a definition: metric, comparator, value, k, unit; without a number it is one row, a wish.

    ``measure`` counts from 1 along the text. ``metric`` is the text between the number before and the comparator, null
    without comparator. ``unit`` is the sign or word behind the number, whatever it is; $ goes in front of it.
    ``scaled`` is in base units: k is 1000, ms are seconds, % is a share; other units stay as they are.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(MEASURE), F.lit(0))

    def part(group: int):
        return F.nullif(F.regexp_extract("_piece", MEASURE, group), F.lit(""))

    lead = F.nullif(F.trim(F.regexp_replace(F.regexp_extract("_piece", MEASURE, 1), MEASURE_LEAD, "")), F.lit(""))
    factor = F.when(F.col("suffix") == "k", 1000.0).otherwise(1.0) * F.when(F.col("unit") == "ms", 0.001).when(
        F.col("unit") == "%", 0.01
    ).otherwise(1.0)
    unit = F.concat(F.coalesce(part(3), F.lit("")), F.coalesce(part(6), F.lit("")))
    return (
        rows.select("*", F.posexplode_outer(pieces).alias("_at", "_piece"))
        .withColumns(
            {
                "measure": F.col("_at") + 1,
                "metric": F.when(part(2).isNotNull(), lead),
                "op": part(2),
                "value": part(4).cast("double"),
                "suffix": part(5),
                "unit": F.nullif(unit, F.lit("")),
            }
        )
        .withColumns({"scaled": F.col("value") * factor, "wish": F.col("value").isNull()})
        .drop("_at", "_piece")
    )


def definition_as_of(decisions: DataFrame, ledger: DataFrame, unit: str = "month") -> DataFrame:
    """Each decision (term, decided, …) with the ledger row in force on its date, or nulls."""
    return asof_join(
        decisions, ledger, ["term"], "decided", "recorded", ["definition", "source", "recorded"], tie=["seq"], unit=unit
    )


def ledger_conflicts(ledger: DataFrame) -> DataFrame:
    """Terms with several live definitions or several sources; live = the latest of each source."""
    live = ledger_current(ledger, ["term", "source"])
    counts = live.groupBy("term").agg(
        F.count_distinct("definition").alias("definitions"), F.count(F.lit(1)).alias("sources")
    )
    return counts.filter((F.col("definitions") > 1) | (F.col("sources") > 1))


def intake_gaps(requests: DataFrame) -> DataFrame:
    """One row per incomplete request with its batch of questions (the missing facts)."""
    missing = names_where({fact: blank(F.col(fact).cast("string")) for fact in INTAKE_FACTS})
    return requests.select("request", missing.alias("questions")).filter(F.size("questions") > 0)
