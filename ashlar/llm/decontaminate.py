"""Benchmark decontamination with one Aho-Corasick automaton over normalised item windows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import Stored, text_of

#: Consecutive words of an item that make a window.
WINDOW_WORDS = 13
#: Bytes of windows and ids in one automaton; a larger benchmark is scanned with several, one after another.
AUTOMATON_BYTES = 32 << 20

#: A-Z become a-z; digits, letters and every byte of a character beyond ASCII stay; the rest separates words.
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_WORD = np.frombuffer(_NORMAL, np.uint8) != 0x20


def item_windows(text: str | None, width: int = WINDOW_WORDS) -> list[bytes]:
    """The windows of one item: every ``width`` consecutive words, or all words of a shorter item."""
    words = (text or "").encode().translate(_NORMAL).split()
    if not words:
        return []
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def windows_of(items: DataFrame, width: int = WINDOW_WORDS) -> DataFrame:
    """The different (item_id, window) of ``items`` (item_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id"), batch.column("text"), strict=True):
                found = list(set(item_windows(text.as_py(), width)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item.as_py()] * len(found), pa.string()), pa.array(found, pa.binary())], names=["item_id", "window"])

    return items.mapInArrow(cut, "item_id string, window binary").distinct()


def build(windows: list[tuple[str | None, bytes]]) -> ahocorasick.Automaton | None:
    """Automaton over windows with their items; the value of a window is (its words, the ids of its items)."""
    of: dict[bytes, set[str]] = {}
    for item, window in windows:
        of.setdefault(window, set()).update(() if item is None else (item,))
    if not of:
        return None
    automaton = ahocorasick.Automaton()
    for window, ids in of.items():
        automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, tuple(sorted(ids))))
    automaton.make_automaton()
    return automaton


#: The automaton that a worker keeps between tasks, under the name of its scan.
_built: dict[str, ahocorasick.Automaton | None] = {}


def hits_of(raw: bytes, automaton: ahocorasick.Automaton | None) -> tuple[int, set[int], set[str]]:
    """Number of words, positions of the hit words and the items found in one text."""
    words = raw.translate(_NORMAL).split()
    hit: set[int] = set()
    items: set[str] = set()
    if automaton is not None and words:
        plain = f" {b' '.join(words).decode('latin-1')} "
        ends = None
        for end, (length, ids) in automaton.iter(plain):
            if ends is None:  # the index of the blank after each word
                ends = np.cumsum([len(w) + 1 for w in words])
            last = int(np.searchsorted(ends, end))
            hit.update(range(last - length + 1, last + 1))
            items.update(ids)
    return len(words), hit, items


def spans_of(raw: bytes, hit: list[int]) -> list[dict[str, int]]:
    """Byte ranges of the original text that maximal runs of hit words cover."""
    if not hit:
        return []
    word = np.concatenate([[False], _WORD[np.frombuffer(raw, np.uint8)], [False]])
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    at = np.array(hit)
    cut = np.flatnonzero(np.diff(at) > 1)
    first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    return [{"start": int(starts[a]), "end": int(ends[b])} for a, b in zip(first, last, strict=True)]


def find_contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW_WORDS,
                       automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """Documents with what they share with benchmark ``items`` (item_id, text).

    Adds ``n_words`` long, ``hit_words`` array (positions of words inside an occurring window),
    ``items`` array of string (sorted ids), ``spans`` array of (start, end) bytes of the original text, all
    after the columns of ``docs``, whose own columns of these names are replaced. A null or wordless text has
    no words and no hits. An item without words has no window; an item with a null id marks words but is
    not listed. Repeated items count once. Any number of documents with one text are scanned alike.
    Text is scanned in place: nothing of it is shuffled. The windows of one automaton are bounded by
    ``automaton_bytes``; of a larger benchmark the windows are dealt by hash into as many parts. Each part is
    collected, scanned and released, and its result stored, before the next one reaches the driver; an item of any
    length and a window of any number of items are dealt over all parts.
    """
    spark = docs.sparkSession
    stored = Stored(spark)
    added = ["n_words", "hit_words", "items", "spans"]
    out = docs.drop(*added).withColumns({
        "n_words": F.lit(0).cast("long"), "hit_words": F.array().cast("array<int>"),
        "items": F.array().cast("array<string>"),
        "spans": F.array().cast("array<struct<start:long,end:long>>"),
    })
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    windows = stored.keep(windows_of(items, width), "windows")
    size = windows.agg(F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item_id"), F.lit(0))).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // automaton_bytes))
    schema = out.schema
    at = {name: i for i, name in enumerate(out.columns)}
    for part in range(parts):
        mine = windows.where(F.pmod(F.xxhash64("item_id", "window"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast([(r["item_id"], bytes(r["window"])) for r in mine.collect()])

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, key=uuid.uuid4().hex, later=part > 0) -> Iterator[pa.RecordBatch]:
            if key not in _built:
                _built.clear()
                _built[key] = build(shared.value)
            automaton = _built[key]
            for batch in batches:
                n_words, hit_words, found, spans = [], [], [], []
                earlier = zip(batch.column(at["hit_words"]), batch.column(at["items"]), strict=True)
                for text, (hit_before, items_before) in zip(text_of(batch), earlier, strict=True):
                    raw = text.as_py()
                    n, hit, ids = hits_of(raw, automaton)
                    if later:
                        hit.update(hit_before.as_py())
                        ids.update(items_before.as_py())
                    n_words.append(n)
                    hit_words.append(sorted(hit))
                    found.append(sorted(ids))
                    spans.append(spans_of(raw, hit_words[-1]))
                columns = list(batch.columns)
                for name, values in zip(added, (n_words, hit_words, found, spans), strict=True):
                    columns[at[name]] = pa.array(values, batch.schema.field(at[name]).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        out = out.mapInArrow(scan, schema)
        if part + 1 < parts:
            out = stored.keep(out, f"part-{part}")
            shared.unpersist()
    return out


def is_contaminated(n_words, n_hit):
    """At least one word in twenty lies inside an occurring window."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find_contamination``, one row for each document."""
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_words"), n_hit).alias("contaminated"), "spans",
    )
