"""Removal of repeated passages by sliding runs of sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashlar.llm.common import BASE, INVERSE, PrefixHash, Stored, blocks, mix, powers_to, signed, text_of, word_bounds

#: A run holds at least so many sentences and so many words.
SENTENCES, WORDS = 3, 20
#: A longer sentence counts as several, cut where its words decide: in every CUT_WINDOW gaps between its words, after the
#: word whose hash with the next word's is least. So the cuts of a passage depend on the passage but for its edges.
SENTENCE_WORDS, CUT_WINDOW = 16, 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True
#: Beyond ASCII: ends of sentences and lines, and letters of scripts written without blanks, each a word by itself.
_STOPS = [(0x0085, 0x0085), (0x0589, 0x0589), (0x061D, 0x061F), (0x06D4, 0x06D4), (0x0700, 0x0702), (0x07F9, 0x07F9),
          (0x0837, 0x0837), (0x0839, 0x0839), (0x083D, 0x083E), (0x0964, 0x0965), (0x0F0D, 0x0F0E), (0x104A, 0x104B),
          (0x1362, 0x1362), (0x1367, 0x1368), (0x166E, 0x166E), (0x1735, 0x1736), (0x17D4, 0x17D5), (0x1803, 0x1803),
          (0x1809, 0x1809), (0x1944, 0x1945), (0x1AA8, 0x1AAB), (0x1B5A, 0x1B5B), (0x1B5E, 0x1B5F), (0x1B7D, 0x1B7F),
          (0x1C3B, 0x1C3C), (0x1C7E, 0x1C7F), (0x2026, 0x2026), (0x2028, 0x2029), (0x203C, 0x203D), (0x2047, 0x2049),
          (0x2CF9, 0x2CFB), (0x2E2E, 0x2E2E), (0x2E3C, 0x2E3C), (0x2E53, 0x2E54), (0x3002, 0x3002), (0xA4FF, 0xA4FF),
          (0xA60E, 0xA60F), (0xA6F3, 0xA6F3), (0xA6F7, 0xA6F7), (0xA876, 0xA877), (0xA8CE, 0xA8CF), (0xA92F, 0xA92F),
          (0xA9C8, 0xA9C9), (0xAA5D, 0xAA5F), (0xAAF0, 0xAAF1), (0xABEB, 0xABEB), (0xFE12, 0xFE12), (0xFE15, 0xFE16),
          (0xFE52, 0xFE52), (0xFE56, 0xFE57), (0xFF01, 0xFF01), (0xFF0E, 0xFF0E), (0xFF1F, 0xFF1F), (0xFF61, 0xFF61),
          (0x10A56, 0x10A57), (0x10F55, 0x10F59), (0x11047, 0x11048), (0x110BE, 0x110C1), (0x11141, 0x11143), (0x111C5, 0x111C6),
          (0x111CD, 0x111CD), (0x111DE, 0x111DF), (0x11238, 0x11239), (0x1123B, 0x1123C), (0x112A9, 0x112A9), (0x1144B, 0x1144C),
          (0x115C2, 0x115C3), (0x115C9, 0x115D7), (0x11641, 0x11642), (0x1173C, 0x1173E), (0x11944, 0x11944), (0x11946, 0x11946),
          (0x11A42, 0x11A43), (0x11A9B, 0x11A9C), (0x11C41, 0x11C42), (0x11EF7, 0x11EF8), (0x11F43, 0x11F44), (0x16A6E, 0x16A6F),
          (0x16AF5, 0x16AF5), (0x16B37, 0x16B38), (0x16B44, 0x16B44), (0x16E98, 0x16E98), (0x1BC9F, 0x1BC9F), (0x1DA88, 0x1DA88)]
_UNSPACED = [(0x0E01, 0x0E5B), (0x0E81, 0x0EDF), (0x0F40, 0x0FBC), (0x1000, 0x1049), (0x1780, 0x17D3), (0x3040, 0x30FF),
             (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)]
_CODES = np.zeros(0x200000, np.uint8)
for _kind, _ranges in ((1, _STOPS), (2, _UNSPACED)):
    for _lo, _hi in _ranges:
        _CODES[_lo : _hi + 1] = _kind


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end and document of each word, and the bytes that end a sentence."""
    word, stop = _WORD[data], _STOP[data]
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return *word_bounds(word, offsets), stop
    b = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    b0, b1, b2, b3 = (b[lead + k] & (0xFF if k == 0 else 0x3F) for k in range(4))
    width = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
    code = np.where(width == 2, (b0 & 0x1F) << 6 | b1, np.where(width == 3, (b0 & 0xF) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
    kind = _CODES[code]
    ends = kind == 1
    stop[lead[ends]] = True
    for k in range(4):
        word[lead[ends & (width > k)] + k] = False
    start, end, doc = word_bounds(word, offsets)
    alone = kind == 2
    after = (lead + width)[alone]
    split = np.concatenate([lead[alone], after[after < len(data)]])
    split = split[word[split]]
    if not len(split):
        return start, end, doc, stop
    parts = np.union1d(start, split)
    run = np.searchsorted(start, parts, "right") - 1
    return parts, np.minimum(np.concatenate([parts[1:], [len(data)]]), end[run]), doc[run], stop


def _cuts(closes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Words after which a sentence of over SENTENCE_WORDS words is cut."""
    cut, n = np.zeros(len(words), bool), len(words)
    if n <= SENTENCE_WORDS:
        return cut
    ends = np.flatnonzero(closes)
    long = np.repeat(np.diff(ends, prepend=-1) > SENTENCE_WORDS, np.diff(ends, prepend=-1))
    gaps = mix(words[:-1] * np.uint64(BASE) + words[1:])
    closed = np.concatenate([[0], np.cumsum(closes[:-1])])
    at = np.flatnonzero((closed[CUT_WINDOW:] == closed[:-CUT_WINDOW]) & long[: n - CUT_WINDOW])
    if len(at):
        cut[at + np.lib.stride_tricks.sliding_window_view(gaps, CUT_WINDOW)[at].argmin(axis=1)] = True
    return cut


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """First word, word after the last, and document of each sentence; starts and hashes of the words.

    A sentence ends after a word followed by a full stop, question or exclamation mark of any script or a line end. In
    scripts written without blanks each letter is a word.
    """
    start, end, doc, stop = _words(data, offsets)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, start, np.zeros(0, np.uint64)
    stops = np.concatenate([[0], np.cumsum(stop)])
    closes = np.ones(len(start), bool)
    closes[:-1] = (stops[start[1:]] > stops[end[:-1]]) | (doc[1:] != doc[:-1])
    words = PrefixHash(_LOWER[data]).of(start, end)
    after = np.flatnonzero(closes | _cuts(closes, words)) + 1
    first = np.concatenate([[0], after[:-1]])
    return first, after, doc[first], start, words


def runs(first: np.ndarray, after: np.ndarray, doc: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least runs, each once: the first sentence, the sentence after the last, the hash of the words.

    For each sentence the shortest run that opens there and the shortest that closes there; in any run each sentence is
    in such a run that lies inside.
    """
    n = len(first)
    if n < SENTENCES:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    opens = np.arange(n)
    last = np.maximum(opens + SENTENCES - 1, np.searchsorted(after, first + WORDS))
    opens = opens[last < n]
    last = last[last < n]
    inside = doc[last] == doc[opens]
    opens, last = opens[inside], last[inside]
    closes = np.arange(SENTENCES - 1, n)
    start = np.minimum(closes - SENTENCES + 1, np.searchsorted(first, after[closes] - WORDS, "right") - 1)
    closes, start = closes[start >= 0], start[start >= 0]
    last_of = np.full(n, -1)
    last_of[opens] = last
    new = (doc[start] == doc[closes]) & (last_of[start] != closes)
    opens, last = np.concatenate([opens, start[new]]), np.concatenate([last, closes[new]])
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words) * powers_to(BASE, len(words)), out=sums[1:])
    a, b = first[opens], after[last]
    return opens, last + 1, mix((sums[b] - sums[a]) * powers_to(INVERSE, len(words) + 1)[a] + (b - a).astype(np.uint64))


def document_key():
    """Rows equal in id and text are one document."""
    return F.xxhash64("doc_id", "text")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with n_sentences, n_removed (long) and kept_text after its columns, replacing columns of these names.

    Every run of at least SENTENCES consecutive sentences and WORDS words counts; the least runs are hashed, which cover
    all others. Of the places of one run the first by (doc_id, document, position) stays, nulls first; the sentences of every other place are removed, from
    the first word of a sentence to the first word of the next kept one. Documents equal in id and text are
    one document and keep the same. Null texts stay null, texts without a run stay whole. An empty table gives
    no rows. Places of a frequent run are counted before they are shuffled, and the join that returns to them splits
    skewed runs; only the sentences removed from one document meet in one row.
    """
    added = ["n_sentences", "n_removed", "kept_text"]
    plain = docs.drop(*added, "document", "gone").withColumn("text", F.col("text").cast("string"))
    keyed = plain.withColumn("document", document_key())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("document")
            for lo, _, data, offsets in blocks(text_of(batch)):
                first, after, doc, _, words = sentences(data, offsets)
                opens, stop, run = runs(first, after, doc, words)
                base = np.searchsorted(doc, doc[opens]) if len(opens) else opens
                rows = pa.array(lo + doc[opens])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(run)), ids.take(rows), keys.take(rows), pa.array((opens - base).astype(np.int32)),
                     pa.array((stop - base).astype(np.int32))], names=["run", "doc_id", "document", "first", "after"])

    places = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "document", "text").mapInArrow(
        emit, "run long, doc_id long, document long, first int, after int")
    place = F.struct("doc_id", "document", "first")
    repeated = (places.groupBy("run").agg(F.min(place).alias("kept"), F.max(place).alias("other"))
                .where(~F.col("kept").eqNullSafe(F.col("other"))).select("run", "kept"))
    stored = Stored(docs.sparkSession)
    repeated = stored.keep(repeated, "repeated")  # a table, so that a skewed run can be split
    gone = (places.join(repeated, "run").where(~place.eqNullSafe(F.col("kept")))
            .groupBy("document").agg(F.collect_set(F.struct("first", "after")).alias("gone")))
    gone = stored.keep(gone, "gone")  # and rows equal in id and text
    columns = plain.columns
    schema = T.StructType([*plain.schema, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept_text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone_of, null = batch.column("gone"), batch.column("text").is_null().to_pylist()
            counts, removed, kept = [], [], []
            for lo, hi, data, offsets in blocks(text_of(batch)):
                first, _, doc, start, _ = sentences(data, offsets)
                for i in range(hi - lo):
                    a, b = int(np.searchsorted(doc, i)), int(np.searchsorted(doc, i, "right"))
                    ranges = gone_of[lo + i].as_py() or []
                    mark = np.zeros(b - a + 1, np.int64)
                    for r in ranges:
                        mark[r["first"]] += 1
                        mark[r["after"]] -= 1
                    out = np.cumsum(mark)[:-1] > 0
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    if out.any():
                        edges = np.concatenate([start[first[a:b]] - offsets[i], [len(raw)]])
                        pieces = [raw[: edges[0]], *(raw[edges[k] : edges[k + 1]] for k in np.flatnonzero(~out))]
                        raw = b"".join(pieces)
                    counts.append(b - a)
                    removed.append(int(out.sum()))
                    kept.append(None if null[lo + i] else raw.decode())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.string())], names=schema.names)

    return keyed.join(gone, "document", "left").select(*columns, "gone").mapInArrow(cut, schema)
