"""Exact removal of repeated substrings by prefix-free parsing.

Rolling-hash triggers parse every text into phrases: the trigger of a window of WIDTH bytes is its TRIGGER_BYTES-byte
string with the least hash, and a phrase is a longest stretch of windows with one trigger. The window alone decides its
trigger and its place in it, so equal windows lie at the same offset of phrases with one trigger, wherever they
are. The dictionary holds each different phrase once with its frequency in the parse. A window is repeated if its
phrase is frequent, or if the suffix of its dictionary phrase agrees with the suffix of another one over WIDTH bytes.
The order of corpus suffixes matters only through such agreement, so suffixes are compared by names (hashes of their
first WIDTH bytes) in two rounds: offsets in cells of CELL, then single offsets of the cells that are left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashlar.llm.common import BLOCK_BYTES, PrefixHash, Stored, blocks, mix, signed, text_of

WIDTH = 200
TRIGGER_BYTES = 64
CELL = 16
#: Dictionary bytes under one suffix array.
BIN_BYTES = 4 << 20
#: Dictionary bytes of one trigger beyond which its suffixes are split by their next bytes.
TRIGGER_MOST = 1 << 20


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    out, reach = values, 1
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - reach :]) if reach < width else out


def parse(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, trigger: int = TRIGGER_BYTES) -> tuple[np.ndarray, ...]:
    """Phrases of a block of texts: document, first window, number of windows, trigger's place, its hash, phrase's hash."""
    n = len(data) - width + 1
    hashes = PrefixHash(data)
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    rolling = hashes.every(trigger)
    low = np.uint64(0xFFFFFFFF)
    placed = (rolling & ~low) | np.arange(len(rolling), dtype=np.uint64)
    at = (least(placed, width - trigger + 1) & low).astype(np.int64)
    valid = np.zeros(n + 1, np.int64)
    long_enough = np.diff(offsets) >= width
    valid[offsets[:-1][long_enough]] += 1
    valid[offsets[1:][long_enough] - width + 1] -= 1
    inside = np.cumsum(valid)[:n] > 0
    starts = np.flatnonzero(inside)
    if not len(starts):
        return parse(data[:0], offsets[:1], width, trigger)
    doc = np.searchsorted(offsets, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (at[starts[1:]] != at[starts[:-1]]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    place = at[begin]
    phrase = mix(hashes.of(begin, begin + count + width - 1) + (place - begin).astype(np.uint64))
    return doc[first], begin, count, place, rolling[place], phrase


def cells(data: np.ndarray, begin: np.ndarray, count: np.ndarray, place: np.ndarray, cell: int,
          width: int = WIDTH, trigger: int = TRIGGER_BYTES) -> tuple[np.ndarray, ...]:
    """Suffixes of phrases by cells of offsets before the trigger: phrase, first window, number of windows, name of what
    all windows of the cell share, name of all their bytes."""
    hashes = PrefixHash(data)
    near, far = place - (begin + count - 1), place - begin
    cell_of, most = near // cell, far // cell
    each = most - cell_of + 1
    phrase = np.repeat(np.arange(len(begin)), each)
    number = np.arange(len(phrase)) - np.repeat(np.cumsum(each) - each, each) + cell_of[phrase]
    lo, hi = number * cell, number * cell + cell - 1
    hi = np.minimum(hi, width - trigger)
    p = place[phrase]
    core = mix(hashes.of(p - lo, p - hi + width) + number.astype(np.uint64))
    low, high = np.maximum(lo, near[phrase]), np.minimum(hi, far[phrase])
    start = p - high
    whole = mix(hashes.of(start, p - low + width) + (low * width + high).astype(np.uint64))
    return phrase, start, high - low + 1, core, whole


def suffix_array(data: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at ``starts`` in the order of their first ``width`` (8 or more) bytes, each at least so long, and for each
    whether it agrees with the one before it over all of them.

    Suffixes are sorted by eight bytes at a time. Groups of one suffix are done; a group whose next eight bytes are
    all the same is passed on as it is, so passages held many times cost a comparison and no sort.
    """
    starts = starts.astype(np.int64)
    if not len(starts):
        return starts, np.zeros(0, bool)
    eight = np.ndarray((len(data) - 7,), ">u8", np.ascontiguousarray(data), strides=(1,))
    key = eight[starts].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    starts, key = starts[order], key[order]
    agrees = np.append(False, key[1:] == key[:-1])
    at = np.arange(len(starts))
    for depth in [*range(8, width - 8, 8), width - 8]:
        at = at[agrees[at] | np.append(agrees, False)[at + 1]]
        if not len(at):
            break
        key, begins = eight[starts[at] + depth].astype(np.uint64), ~agrees[at]
        group = np.cumsum(begins) - 1
        differs = np.append(False, key[1:] != key[:-1]) & ~begins
        if differs.any():
            mixed = np.zeros(group[-1] + 1, bool)
            mixed[group[differs]] = True
            some = np.flatnonzero(mixed[group])
            order = some[np.lexsort((key[some], group[some]))]
            starts[at[some]], key[some] = starts[at[order]], key[order]
            agrees[at] = np.append(False, key[1:] == key[:-1]) & ~begins
    return starts, agrees


def repeated_windows(data: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """By position in ``data``: whether a suffix at ``starts`` begins there that agrees with another one over ``width`` bytes."""
    order, agrees = suffix_array(data, starts, width)
    out = np.zeros(len(data), bool)
    out[order[agrees | np.append(agrees[1:], False)]] = True
    return out


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("document")
        for lo, _, data, offsets in blocks(text_of(batch)):
            doc, begin, count, _, trigger, phrase = parse(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(trigger)), pa.array(signed(phrase)), keys.take(pa.array(lo + doc)),
                 pa.array((begin - offsets[doc]).astype(np.int32)), pa.array(count.astype(np.int16))],
                names=["trigger", "phrase", "document", "start", "windows"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the dictionary phrases that the documents of a batch hold."""
    for batch in batches:
        todo = batch.column("todo")
        if not len(todo.flatten()):
            continue
        row = np.repeat(np.arange(len(todo)), todo.value_lengths().fill_null(0).to_numpy())
        begin, windows, trigger, single = (todo.flatten().field(k) for k in range(4))
        texts, keys = text_of(batch), batch.column("document").take(pa.array(row))
        _, offsets, data = texts.buffers()
        base = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts)]
        lo = base[row] + begin.to_numpy()
        hi = lo + windows.to_numpy() + WIDTH - 1
        view, cut = memoryview(data), 0
        while cut < len(lo):
            end = max(cut + 1, int(np.searchsorted(np.cumsum(hi[cut:] - lo[cut:]), BLOCK_BYTES, "right")) + cut)
            yield pa.RecordBatch.from_arrays(
                [c.slice(cut, end - cut) for c in (trigger, single, keys, begin, windows)]
                + [pa.array([bytes(view[a:b]) for a, b in zip(lo[cut:end], hi[cut:end], strict=True)], pa.binary())],
                names=["trigger", "single", "document", "start", "windows", "bytes"])
            cut = end


def _sorted_bin(table: pa.Table) -> pa.Table:
    """Runs of repeated windows in the phrases of one bin that the parse holds once."""
    table = table.combine_chunks()
    raw = pa.concat_arrays(table.column("bytes").cast(pa.large_binary()).chunks)
    _, ends, data = raw.buffers()
    ends = np.frombuffer(ends, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data, offsets = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    count = table.column("windows").to_numpy().astype(np.int64)
    phrase = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count)
    starts = offsets[phrase] + within
    gone = repeated_windows(data, starts)[starts] & table.column("single").to_numpy()[phrase]
    opens = gone & (np.append(True, phrase[1:] != phrase[:-1]) | ~np.append(False, gone[:-1]))
    first = np.flatnonzero(opens)
    length = np.add.reduceat(gone, first, dtype=np.int64) if len(first) else first
    start = table.column("start").to_numpy().astype(np.int64)[phrase[first]] + within[first]
    return pa.table([table.column("document").take(pa.array(phrase[first])), pa.array(start.astype(np.int32)),
                     pa.array(length.astype(np.int16))], names=["document", "start", "windows"])


def _suffixes(cell: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            todo, keys = batch.column("todo"), batch.column("document")
            for lo, hi, data, offsets in blocks(text_of(batch)):
                mine = todo.slice(lo, hi - lo)
                doc = np.repeat(np.arange(hi - lo), mine.value_lengths().fill_null(0).to_numpy())
                flat = mine.flatten()
                begin, count = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                begin = begin + offsets[doc]
                place = _places(data, begin)
                phrase, start, windows, core, whole = cells(data, begin, count, place, cell)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(core)), pa.array(signed(whole)), keys.take(pa.array(lo + doc[phrase])),
                     pa.array((start - offsets[doc[phrase]]).astype(np.int32)), pa.array(windows.astype(np.int16))],
                    names=["core", "whole", "document", "start", "windows"])

    return run


def _places(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The trigger's place of the windows that begin at ``begin``."""
    low = np.uint64(0xFFFFFFFF)
    rolling = PrefixHash(data).every(TRIGGER_BYTES)
    placed = (rolling & ~low) | np.arange(len(rolling), dtype=np.uint64)
    return (least(placed, WIDTH - TRIGGER_BYTES + 1)[begin] & low).astype(np.int64) if len(begin) else begin


def _cut(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, *parts in zip(text_of(batch), batch.column("full"), batch.column("more"), strict=True):
                raw = text.as_py()
                mark = np.zeros(len(raw) + 1, np.int32)
                for part in parts:
                    if part.is_valid and len(part.values):
                        start, windows = (part.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                        np.add.at(mark, start, 1)
                        np.add.at(mark, start + windows + WIDTH - 1, -1)
                gone = np.cumsum(mark[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                spans = [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
                rows.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept, kept.decode(errors="ignore")))
            made = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), *(pa.array(v, t) for v, t in zip(made, _RESULT.types, strict=True))],
                names=[*columns, *_RESULT.names])

    return run


_SPANS = "array<struct<start:long,end:long>>"
_RESULT = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                     ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                     ("kept_sha256", pa.string()), ("kept", pa.binary()), ("kept_text", pa.string())])
_ADDED = f"n_bytes long, n_removed long, spans {_SPANS}, kept_sha256 string, kept binary, kept_text string"


def remove_substrings(docs: DataFrame, bin_bytes: int = BIN_BYTES, trigger_most: int = TRIGGER_MOST) -> DataFrame:
    """``docs`` with n_bytes, n_removed, spans (removed byte ranges), kept_sha256, kept (the
    remaining bytes) and kept_text (the same without characters that lost a part).

    Every byte inside a WIDTH-byte string that also starts elsewhere, in the same or another document, goes; all is
    judged on the texts as they came, and no match crosses documents. Null texts count as empty; texts shorter
    than WIDTH stay whole. Each row is a document of its own, so rows equal in id and text lose all windows; rows
    are told apart by a 64-bit hash of id and text, frequent phrases by 64-bit hashes, suffixes under a suffix array
    by their bytes. Columns of the added names are replaced. An empty table gives no rows.
    A trigger or phrase that a third of all phrases share is counted before it is shuffled and split in joins; a suffix
    array covers about ``bin_bytes``, and no trigger of more than ``trigger_most``. Phrases of one document are all that
    meets in one row; rows equal in id and text meet only in joins with stored sides, where they can be split.
    """
    stored = Stored(docs.sparkSession)
    plain = docs.drop("n_bytes", "n_removed", "spans", "kept_sha256", "kept", "kept_text", "document", "full", "more", "todo")
    keyed = plain.withColumn("text", F.col("text").cast("string")).withColumn("document", F.xxhash64("doc_id", "text"))
    phrases = keyed.select("document", "text").mapInArrow(
        _phrases, "trigger long, phrase long, document long, start int, windows short")
    # what a skewed side is joined with is a table: only then can the skewed side be split
    frequent = stored.keep(phrases.groupBy("trigger").agg(F.count("*").alias("n")).where("n > 1").select("trigger"), "frequent")
    parse_ = stored.keep(phrases.join(frequent, "trigger"), "parse")
    dictionary = stored.keep(parse_.groupBy("trigger", "phrase").agg(
        F.count("*").alias("n"), F.min(F.struct("document", "start", "windows")).alias("at")), "dictionary")
    full = parse_.join(dictionary.where("n > 1").select("trigger", "phrase"), ["trigger", "phrase"])
    single = dictionary.where("n = 1")
    bytes_ = F.col("at.windows").cast("long") + (WIDTH - 1)
    open_ = stored.keep(dictionary.groupBy("trigger").agg(
        F.sum(bytes_).alias("bytes"), F.min("n").alias("least")).where("least = 1").select("trigger", "bytes"), "open")
    judged = (single.withColumn("single", F.lit(True)).unionByName(dictionary.where("n > 1").withColumn("single", F.lit(False)))
              .join(open_, "trigger"))
    entries = judged.select("at.*", "trigger", "single", (F.col("bytes") > trigger_most).alias("hot"))
    size = open_.agg(F.sum("bytes").alias("all"), F.max("bytes").alias("most")).first()
    bins = -(-(size["all"] or 0) // bin_bytes) or 1

    pair = F.struct("start", "windows")
    entry = F.struct("start", "windows", "trigger", "single", "hot")
    no_pair, no_entry = "struct<start:int,windows:smallint>", "struct<start:int,windows:smallint,trigger:bigint,single:boolean,hot:boolean>"
    marked = stored.keep(full.select("document", pair.alias("full"), F.lit(None).cast(no_entry).alias("todo"))
                         .unionByName(entries.select("document", F.lit(None).cast(no_pair).alias("full"), entry.alias("todo")))
                         .groupBy("document").agg(F.collect_set("full").alias("full"), F.collect_set("todo").alias("todo")), "marked")
    touched = stored.keep(keyed.join(marked, "document"), "touched")

    # rows equal in id and text hold the same phrases: one of them brings the bytes
    again = stored.keep(keyed.groupBy("document").agg(F.count("*").alias("n")).where("n > 1").select("document"), "again")
    holders = touched.where(F.size("todo") > 0).select("document", "text", "todo")
    one = (holders.join(again, "document", "left_semi")
           .groupBy("document").agg(F.min("text").alias("text")).join(marked.select("document", "todo"), "document"))
    source = holders.join(again, "document", "left_anti").unionByName(one)
    cold = source.withColumn("todo", F.filter("todo", lambda t: ~t["hot"])).where(F.size("todo") > 0)
    more = (cold.mapInArrow(_entries, "trigger long, single boolean, document long, start int, windows short, bytes binary")
            .withColumn("bin", F.pmod(F.xxhash64("trigger"), F.lit(bins))).drop("trigger")
            .groupBy("bin").applyInArrow(_sorted_bin, "document long, start int, windows short"))
    if (size["most"] or 0) > trigger_most:
        hot = source.withColumn("todo", F.filter("todo", lambda t: t["hot"])).where(F.size("todo") > 0)
        more = more.unionByName(_named(stored, hot))
    more = stored.keep(more.groupBy("document").agg(F.collect_set(pair).alias("more")), "more")
    columns = plain.columns
    schema = T.StructType([*(keyed.schema[c] for c in columns), *T._parse_datatype_string(_ADDED)])
    changed = touched.join(more, "document", "left").select(*columns, "full", "more").mapInArrow(_cut(columns), schema)
    raw = F.coalesce("text", F.lit("")).cast("binary")
    same = (keyed.withColumns({"n_bytes": F.octet_length(raw).cast("long"), "n_removed": F.lit(0).cast("long"),
                               "spans": F.array().cast(_SPANS), "kept_sha256": F.sha2(raw, 256), "kept": raw,
                               "kept_text": F.coalesce("text", F.lit(""))})
            .join(marked.select("document"), "document", "left_anti").drop("document"))
    return changed.unionByName(same)


def _named(stored: Stored, source: DataFrame) -> DataFrame:
    """Runs of repeated windows in phrases whose trigger is too frequent for one suffix array, by names of suffixes."""
    pair = F.struct("start", "windows")
    out = None
    for cell in (CELL, 1):
        found = source.mapInArrow(_suffixes(cell), "core long, whole long, document long, start int, windows short")
        shared = stored.keep(found.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), f"shared-{cell}")
        left = stored.keep(found.join(shared, "core"), f"cells-{cell}")
        if cell == 1:
            done = left
        else:
            same = stored.keep(left.groupBy("core", "whole").agg(F.count("*").alias("n")), "same")
            judged = left.join(same, ["core", "whole"])
            open_ = stored.keep(same.where("n = 1").select("core").distinct(), "open-cells")
            done = judged.where("n > 1")
            todo = stored.keep(judged.where("n = 1").unionByName(
                                   judged.where("n > 1").join(open_, "core", "left_semi")
                                   .dropDuplicates(["core", "whole"]))
                               .groupBy("document").agg(F.collect_set(pair).alias("todo")), "todo")
            source = source.select("document", "text").join(todo, "document")
        spans = done.select("document", "start", "windows")
        out = spans if out is None else out.unionByName(spans)
    return out


def digest(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
