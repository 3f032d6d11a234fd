"""Document quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashlar.llm.common import PrefixHash, Stored, blocks, mix, text_of, word_bounds

#: Words of the windows whose repetition counts.
REPEAT_WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words",
            "n_stops", "n_short_words", "n_upper", "n_cased", "n_marks", "n_symbol_words")


def repeats(key: np.ndarray) -> np.ndarray:
    """True where a value occurs twice or more."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def again(key: np.ndarray) -> np.ndarray:
    """True where a value has occurred before."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out


def measure_block(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MEASURES of each document of a block, one row each."""
    n = len(offsets) - 1
    word = ~_SPACE[data]
    start, end, doc = word_bounds(word, offsets)
    count = lambda at: np.bincount(np.searchsorted(offsets, at, "right") - 1, minlength=n)
    out = np.zeros((n, len(MEASURES)), np.int64)
    out[:, 0] = np.bincount(doc, minlength=n)
    out[:, 1] = count(np.flatnonzero(word & ((data & 0xC0) != 0x80)))
    out[:, 2] = count(np.flatnonzero(_SYMBOL[data]))
    upper = (data >= 0x41) & (data <= 0x5A)
    out[:, 9] = count(np.flatnonzero(upper))
    out[:, 10] = count(np.flatnonzero(upper | (data >= 0x61) & (data <= 0x7A)))
    out[:, 11] = count(np.flatnonzero((data == 0x21) | (data == 0x3F)))
    salt = mix(np.arange(n, dtype=np.uint64))
    hashes = PrefixHash(data)
    # lines: cut at \n and between documents
    cut = np.unique(np.concatenate([np.flatnonzero(data == 0x0A) + 1, offsets]))
    first, last = cut[:-1], cut[1:].copy()
    last -= data[last - 1] == 0x0A if len(last) else 0
    words_before = np.concatenate([[0], np.cumsum(word)])
    full = words_before[last] > words_before[first]
    first, last = first[full], last[full]
    line_doc = np.searchsorted(offsets, first, "right") - 1
    line = hashes.of(first, last) ^ salt[line_doc] if len(first) else np.zeros(0, np.uint64)
    out[:, 3] = np.bincount(line_doc[again(line)], minlength=n)
    out[:, 5] = np.bincount(line_doc, minlength=n)
    if len(start):
        each = hashes.of(start, end)
        if len(start) >= REPEAT_WORDS:
            m = len(start) - REPEAT_WORDS + 1
            window = salt[doc[:m]].copy()
            for k in range(REPEAT_WORDS):
                window = mix(window + each[k : k + m])
            inside = doc[:m] == doc[REPEAT_WORDS - 1 :]
            begin = np.flatnonzero(inside)[repeats(window[inside])]
            mark = np.zeros(len(start) + 1, np.int64)
            mark[begin] += 1
            mark[begin + REPEAT_WORDS] -= 1
            out[:, 4] = np.bincount(doc[np.cumsum(mark[:-1]) > 0], minlength=n)
        letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
        out[:, 6] = np.bincount(doc[letters[end] > letters[start]], minlength=n)
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
        out[:, 12] = np.bincount(doc[symbols[end] > symbols[start]], minlength=n)
        out[:, 7] = np.bincount(doc[_STOP[data[end - 1]]], minlength=n)
        out[:, 8] = np.bincount(doc[end - start <= 3], minlength=n)
    return out


def measure(docs: DataFrame) -> DataFrame:
    """Every column of ``docs`` but its text, then MEASURES, replacing columns of these names.

    Words are runs of other characters than blank and the controls 9 to 13. A null text has none, and no lines.
    Equality of lines and windows is equality of 64-bit hashes within one text. Nothing is shuffled.
    """
    plain = docs.drop(*MEASURES)
    carry = [c for c in plain.columns if c != "text"]
    schema = T.StructType([*(plain.schema[c] for c in carry), *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure_block(data, offsets) for _, _, data, offsets in blocks(text_of(batch))]
            table = np.concatenate(parts) if parts else np.zeros((0, len(MEASURES)), np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carry), *(pa.array(table[:, i]) for i in range(len(MEASURES)))],
                names=[*carry, *MEASURES])

    return plain.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)


def vote(good: Column, bad: Column) -> Column:
    """1 for good, 0 for bad, -1 to abstain."""
    return F.when(bad, 0).when(good, 1).otherwise(-1)


def rules() -> dict[str, Column]:
    """Votes by the measures; a rule that cannot tell abstains."""
    n = F.col("n_words")
    chars = F.col("word_chars")
    return {
        "length": vote(n >= 50, n < 10),
        "word_length": vote((2 * chars >= 5 * n) & (chars <= 9 * n), (n == 0) | (chars > 14 * n)),
        "symbols": vote((n > 0) & (10 * F.col("n_symbols") < n), 2 * F.col("n_symbols") > n),
        "lines": vote((F.col("n_lines") > 1) & (F.col("n_dup_lines") == 0), 2 * F.col("n_dup_lines") > F.col("n_lines")),
        "repetition": vote((n >= 10) & (20 * F.col("n_repeat_words") <= n), 5 * F.col("n_repeat_words") > n),
        "letters": vote(10 * F.col("n_letter_words") >= 9 * n, (n >= 20) & (10 * F.col("n_letter_words") < 7 * n)),
        "sentences": vote((n >= 20) & (80 * F.col("n_stops") >= n), (n >= 100) & (F.col("n_stops") == 0)),
        "short_words": vote((n >= 20) & (10 * F.col("n_short_words") >= n), (n >= 50) & (20 * F.col("n_short_words") < n)),
        "symbol_words": vote((n >= 10) & (20 * F.col("n_symbol_words") <= n), 10 * F.col("n_symbol_words") > 3 * n),
        "capitals": vote((n >= 10) & (10 * F.col("n_upper") <= F.col("n_cased")), 2 * F.col("n_upper") > F.col("n_cased")),
        "marks": vote((n >= 10) & (20 * F.col("n_marks") <= n), 10 * F.col("n_marks") > 3 * n),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each vote pattern, each rule's accuracy on good and bad documents, share of good.

    Expectation-maximisation of a model in which rules vote independently given the quality. Abstaining tells nothing. A
    bad document is bad in one way and passes most rules, so that a rule may miss most of the bad ones: its accuracy there
    is as low as the counts say. What is asked of a rule is that its good votes are no likelier on bad documents than on
    good ones, which fixes which class is the good one. It starts from the votes: mostly good without a bad vote, and half
    as likely with each bad one. Counts are smoothed.
    """
    voted, good = patterns >= 0, patterns == 1
    bad = voted & ~good
    p = np.where(bad.any(1), 0.8 * 0.5 ** bad.sum(1), 0.95)
    for _ in range(rounds):
        on_good, on_bad = counts * p, counts * (1 - p)
        share = float((on_good.sum() + 1) / (counts.sum() + 2))
        right = ((on_good[:, None] * good).sum(0) + 2) / ((on_good[:, None] * voted).sum(0) + 2.02)
        missed = ((on_bad[:, None] * good).sum(0) + 1) / ((on_bad[:, None] * voted).sum(0) + 2)
        missed = np.minimum(missed, right)
        told = np.where(good, np.log(right / missed), 0) + np.where(bad, np.log((1 - right) / (1 - missed)), 0)
        odds = np.log(share) - np.log(1 - share) + told.sum(1)
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        done = np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    return p, np.stack([right, 1 - missed]), share


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Measures, votes, ``p_good`` and ``kept`` of every document.

    ``kept`` is false for a document that fails the base rule, else whether the posterior reaches ``threshold``.
    The driver sees one count for each vote pattern, at most 3 to the power of the number of rules. Null and empty
    texts fail the base rule; repeated rows are judged alike; an empty table gives no rows. Columns of the added names
    (MEASURES, pattern, p_good, base_failed, kept) are replaced.
    """
    docs = docs.drop("pattern", "p_good", "base_failed", "kept")
    named = rules()
    stored = Stored(docs.sparkSession)
    measured = measure(docs)
    code = F.lit(0)
    for i, column in enumerate(named.values()):
        code = code + (column + 1) * 3**i
    table = stored.keep(measured.withColumn("pattern", code.cast("int")), "measures")
    counted = {r["pattern"]: r["n"] for r in table.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    codes = np.array(sorted(counted), np.int64)
    if not len(codes):
        return table.withColumns({"p_good": F.lit(None).cast("double"), "base_failed": base_failed(), "kept": F.lit(False)})
    patterns = np.stack([codes // 3**i % 3 - 1 for i in range(len(named))], axis=1)
    p, _, _ = fit_votes(patterns, np.array([counted[c] for c in codes.tolist()], float))
    posterior = docs.sparkSession.createDataFrame(
        [(int(c), float(x)) for c, x in zip(codes, p, strict=True)], "pattern int, p_good double")
    joined = table.join(F.broadcast(posterior), "pattern")
    return joined.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
