"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the frequent form that a word leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.plans.loops import Workspace

#: The letters of a word and the letters that are lower-cased.
RUN = "[A-Za-zÀ-ÿ]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word has so many code points and occurrences at least.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: One in so many pairs of document and word loses a code point.
SLIP_EVERY = 199
#: A form is at least so many times as frequent as the word.
FORM_TIMES = 5
#: Words that share one chunk and are compared with each other; larger groups share a longer chunk first.
GROUP_WORDS = 64


def corpus_words(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) → words(word, n) of at least LEAST_LENGTH code points that occur at least LEAST_COUNT times.

    Runs of letters are lower-cased (A-Z only). If SLIP_EVERY divides the crc32 of ``<doc_id>:<run>``, the run loses the
    code point at that crc32 modulo its length. Shorter runs can't become words and are never listed. Counts combine on
    the map side, so that a very frequent word is no hot key. Null texts have no words; a null id is an empty one.
    """
    text, doc = F.col("text").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(f"{RUN}{{{LEAST_LENGTH},}}"), F.lit(0))
    listed = docs.select(doc.alias("_doc"), F.explode(runs).alias("_run"))
    lowered = listed.select("_doc", F.translate("_run", UPPER, UPPER.lower()).alias("_run"))
    hashed = lowered.withColumn("_h", F.crc32(F.concat("_doc", F.lit(":"), "_run").cast("binary")))
    at = (F.col("_h") % F.char_length("_run")).cast("int")
    slipped = F.concat(F.substring("_run", F.lit(1), at), F.substring(F.col("_run"), at + 2, F.char_length("_run")))
    words = hashed.select(F.when(F.col("_h") % SLIP_EVERY == 0, slipped).otherwise(F.col("_run")).alias("word"))
    counted = words.filter(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def _signed(rows: DataFrame) -> DataFrame:
    """Rows with the text at the two ends of the word, the grams that fix their place: head from the start, tail from the end."""
    length = F.char_length("word")
    head, tail = F.substring("word", F.lit(1), F.col("_head")), F.substring(F.col("word"), length - F.col("_tail") + 1, F.col("_tail"))
    return rows.withColumn("_key", F.concat_ws(":", "_length", "_head", head, tail))


def _halved(rows: DataFrame) -> DataFrame:
    """The part of the word between head and tail is cut into two chunks; an edit spares one, which joins head or tail."""
    half = F.floor((F.col("_length") - F.col("_head") - F.col("_tail")) / 2).cast("int")
    ends = F.array(F.struct((F.col("_head") + half).alias("_head"), F.col("_tail").alias("_tail")),
                   F.struct(F.col("_head").alias("_head"), (F.col("_tail") + half).alias("_tail")))
    return _signed(rows.select("word", "n", "_length", "_chunk", F.inline(ends)))


def near_words(words: DataFrame) -> DataFrame:
    """words(word, n) → links(a, n_a, b, n_b), each pair of words exactly one edit apart once.

    The shorter word of a pair (with equal lengths: the one first in order) contributes two disjoint chunks of half its
    length, its first and its last. The other contributes the grams of that size at the places where a chunk can lie: at the
    same place, or one place on if it is longer by one. One edit preserves a chunk, and moves the last one by the difference
    of the lengths; grams elsewhere could meet no chunk and aren't written. Words that share a chunk are verified.

    Work follows the words and not their pairs: where more than GROUP_WORDS words share a chunk, the part that may hold the
    edit is halved again and the words share the next chunk too, and so on until at most three code points are open. No
    pair is given up: the edit lies in one of two parts each time.
    """
    space = Workspace(words.sparkSession)
    length = F.char_length("word")
    sides = F.array(F.struct(F.lit(True).alias("_chunk"), length.alias("_length")),
                    F.struct(F.lit(False).alias("_chunk"), length.alias("_length")),
                    F.struct(F.lit(False).alias("_chunk"), (length - 1).alias("_length")))
    rows = words.select("word", "n", F.inline(sides)).withColumns({"_head": F.lit(0), "_tail": F.lit(0)})
    links, left = [], 1
    while left:
        halved = space.keep(_halved(rows))
        counts = halved.groupBy("_key").agg(
            F.count_if("_chunk").alias("_chunks"), F.count_if(~F.col("_chunk")).alias("_grams"),
            F.max(F.col("_length") - F.col("_head") - F.col("_tail")).alias("_open"))
        met = counts.filter((F.col("_chunks") > 0) & (F.col("_grams") > 0))
        large, left = space.state(met.filter((F.col("_chunks") + F.col("_grams") > GROUP_WORDS) & (F.col("_open") > 3)).select("_key"), "large")
        if left:
            rows = halved.join(large, "_key", "left_semi")
            halved = halved.join(large, "_key", "left_anti")
        chunks = halved.filter("_chunk").select("_key", F.col("word").alias("a"), F.col("n").alias("n_a"))
        grams = halved.filter(~F.col("_chunk")).select("_key", F.col("word").alias("b"), F.col("n").alias("n_b"))
        ordered = (F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b"))
        verified = chunks.join(grams, "_key").filter(ordered & (F.levenshtein("a", "b", 1) == 1))
        links.append(space.keep(verified.drop("_key")))
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    return found.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form) → (word, root): forms followed to the last by pointer jumping.

    A form is FORM_TIMES as frequent as its word, so that chains are short and have no cycle.
    """
    space = Workspace(forms.sparkSession)
    pointers, moved = space.state(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("_moved")), "pointers")
    while moved:
        above = pointers.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        jumped = pointers.join(above, F.col("root") == F.col("_word"), "left")
        on = jumped.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved"))
        pointers, moved = space.state(on, "pointers", F.col("_moved"))
    return pointers.select("word", "root")


def _best(n: Column, word: Column) -> Column:
    return F.min(F.struct((-n).alias("less"), word.alias("word")))


def group_variants(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) → one row per word: word, form, root, n, n_near, form_n.

    n_near counts the words exactly one edit (insertion, deletion, replacement of a code point) away. form is the most
    frequent of them (ties: smallest in code-point order) if it occurs at least FORM_TIMES as often as the word, else null;
    root is the end of the chain of forms, the word itself if it has none. Null and empty texts add no words, repeated rows
    count as often as they stand there, an empty table gives no rows, and other columns of docs are not read.
    """
    space = Workspace(docs.sparkSession)
    words = space.keep(corpus_words(docs))
    links = space.keep(near_words(words))
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")),
                   F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n_other")))
    near = links.select(F.inline(ends)).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), _best(F.col("n_other"), F.col("other")).alias("_best"))
    largest = -F.col("_best.less")
    is_form = largest >= F.lit(FORM_TIMES) * F.col("n")
    formed = space.keep(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("_best.word")).alias("form"), F.when(is_form, largest).alias("form_n")))
    ended = roots(formed.filter(F.col("form").isNotNull()))
    return formed.join(ended, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
