"""Packing of tokenised documents into sequences by linear grouping, best fit for the small ones."""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashlar.llm.common import Stored, blocks, text_of

CAPACITY = 2048
#: Groups of equal cardinality that large lengths are rounded up within.
GROUPS = 1024
#: Lengths up to this share of a sequence are small.
SMALL_SHARE = 1 / 8
#: Words whose ids a worker remembers.
CACHED_WORDS = 1_000_000
_BLANK = re.compile("[ \t\n\r]+")
#: Characters beyond those that every Unicode version treats alike.
_ODD = re.compile("[^\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
#: The vocabulary's words in a lower-cased text of the other characters.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\t\n\r a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")
# How a vocabulary file says that its words are those of _WORDS, each encoded by itself.
_CUT_BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: Letters that byte-level vocabularies write for the bytes beyond ASCII.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPELT = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class WordIds:
    """Token ids of texts, word by word, for a vocabulary that drops white space and encodes each word by itself.

    A file that cuts texts in another way than _CUT_BY_WORDS goes through its own tokenizer, text by text.
    Stretches of ASCII and Latin-1 letters are cut into words here, by the vocabulary file's own pattern, and each
    different word is encoded once; a stretch between blanks with other characters goes through the whole tokenizer.
    """

    def __init__(self, tokenizer_json: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        said = json.loads(tokenizer_json)
        marked = all("<|" in t["content"] for t in said.get("added_tokens") or [])
        self.by_words = marked and all(said.get(part) == value for part, value in _CUT_BY_WORDS.items())
        self.words = Memory(self._word)
        self.odd = Memory(self._odd)

    def _word(self, word: str) -> bytes:
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(_SPELT)
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _odd(self, stretch: str) -> bytes:
        return array("I", self.tokenizer.encode(stretch, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of one text."""
        if not self.by_words:
            return self._odd(text)
        if _ODD.search(text) or "<|" in text:
            stretches = _BLANK.split(text)
            return b"".join([self.odd[x] if _ODD.search(x) or "<|" in x else self.encode(x) for x in stretches])
        return b"".join(map(self.words.__getitem__, _WORDS.findall(text.lower())))


class Memory(dict):
    """Results of a function for strings seen so far. A full one takes no more, and starts anew when that
    has cost as many calls again."""

    def __init__(self, fn: Callable[[str], bytes], most: int = CACHED_WORDS) -> None:
        super().__init__()
        self.fn, self.most, self.missed = fn, most, 0

    def __missing__(self, key: str) -> bytes:
        value = self.fn(key)
        if len(self) < self.most:
            self[key] = value
        else:
            self.missed += 1
            if self.missed > 4 * self.most:
                self.clear()
                self.missed = 0
        return value


#: The encoder that a worker keeps between tasks, under the name of its run.
_encoders: dict[str, WordIds] = {}

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("task", T.IntegerType()),
    T.StructField("nth", T.LongType()), T.StructField("ids", T.BinaryType()),
])


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Each document's ids, a closing id 0, cut into pieces of ``capacity`` ids.

    ``task`` and ``nth`` number the pieces of each length within the task that made them; they hold once the
    table is written. The vocabulary file is read on the driver and sent to the tasks.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = WordIds(shared.value)
        encoder, task, seen = _encoders[key], TaskContext.get().partitionId(), {}
        for batch in batches:
            texts, doc_ids = text_of(batch), batch.column("doc_id").to_pylist()
            for lo, hi, _, _ in blocks(texts, 4 << 20):
                rows = []
                for doc_id, text in zip(doc_ids[lo:hi], texts[lo:hi].to_pylist(), strict=True):
                    raw = encoder.encode(text.decode()) + b"\0\0\0\0"
                    for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        length = len(part) // 4
                        nth = seen.get(length, 0)
                        seen[length] = nth + 1
                        rows.append((doc_id, piece, at // 4, length, zlib.crc32(part), task, nth,
                                     part if with_ids else None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW_PIECES.types, strict=True)],
                    schema=ARROW_PIECES)

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, PIECES)


ARROW_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary()),
])


def fullest(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size fill a sequence best, with at most ``left`` of each; larger sizes are preferred."""
    best = np.full(capacity + 1, -1, np.int64)  # size index that last reached this fill, -2 at 0
    best[0] = -2
    used = np.zeros(capacity + 1, np.int64)
    for i, (size, most) in enumerate(zip(sizes, left, strict=True)):
        used[:] = 0
        for _ in range(min(most, capacity // size)):
            reach = np.flatnonzero((best[:-size] != -1) & (best[size:] == -1))
            reach = reach[(best[reach] != i) | (used[reach] < most)]
            if not len(reach):
                break
            best[reach + size] = i
            used[reach + size] = np.where(best[reach] == i, used[reach], 0) + 1
    counts = [0] * len(sizes)
    fill = int(np.flatnonzero(best != -1)[-1])
    while fill:
        counts[best[fill]] += 1
        fill -= sizes[best[fill]]
    return counts


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, list[tuple[int, int]]]]:
    """Kinds of sequence for pieces given as {length: number}: (number of sequences, [(length, pieces), ...]).

    Linear grouping: large pieces, sorted, are cut into ``groups`` groups of equal cardinality and counted with
    the largest length of their group. The fullest configurations of these few sizes are taken, each as often as
    the groups allow; then the real pieces take the places, which leaves at least the room planned. Small pieces
    go, largest first, where they fit best. The work depends on the number of lengths, not of pieces.
    """
    small = int(capacity * SMALL_SHARE)
    large = sorted(((n, c) for n, c in histogram.items() if n > small and c), reverse=True)
    share = max(1, -(-sum(c for _, c in large) // groups))
    members: list[list[list[int]]] = []  # of each group: [length, pieces] from the largest
    room = 0
    for length, count in large:
        while count:
            if not room:
                members.append([])
                room = share
            part = min(count, room)
            members[-1].append([length, part])
            count, room = count - part, room - part
    merged: list[list[list[int]]] = []  # groups whose largest length is the same are one size
    for group in members:
        if merged and merged[-1][0][0] == group[0][0]:
            merged[-1] += group
        else:
            merged.append(group)
    sizes, left = [g[0][0] for g in merged], [sum(c for _, c in g) for g in merged]
    kinds: list[tuple[int, list[tuple[int, int]]]] = []
    while any(left):
        first = next(i for i, n in enumerate(left) if n)  # each round places the largest size that is left
        rest = fullest(sizes, [n - (i == first) for i, n in enumerate(left)], capacity - sizes[first]) \
            if sizes[first] < capacity else [0] * len(sizes)
        counts = [n + (i == first) for i, n in enumerate(rest)]
        times = min(n // c for n, c in zip(left, counts, strict=True) if c)
        places = []  # for each place of the configuration, runs of real lengths over the ``times`` sequences
        for i, c in enumerate(counts):
            left[i] -= c * times
            for _ in range(c):
                places.append(take(merged[i], times))
        kinds += side_by_side(places)
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for number, content in kinds:
        open_.setdefault(capacity - sum(n * c for n, c in content), []).append((number, content))
    for length in sorted((n for n in histogram if n <= small), reverse=True):
        count = histogram[length]
        while count:
            space = min((s for s in open_ if s >= length), default=None)
            number, content = (count, []) if space is None else open_[space].pop()
            if space is None:
                space = capacity
            elif not open_[space]:
                del open_[space]
            fit = space // length
            filled = min(number, count // fit)
            if filled:
                open_.setdefault(space - fit * length, []).append((filled, [*content, (length, fit)]))
                number, count = number - filled, count - filled * fit
            if number and 0 < count < fit:
                open_.setdefault(space - count * length, []).append((1, [*content, (length, count)]))
                number, count = number - 1, 0
            if number and content:
                open_.setdefault(space, []).append((number, content))
    return [kind for rest in open_.values() for kind in rest]


def take(runs: list[list[int]], n: int) -> list[tuple[int, int]]:
    """The next ``n`` pieces of a group, as runs of one length."""
    out = []
    while n:
        part = min(n, runs[0][1])
        out.append((runs[0][0], part))
        runs[0][1] -= part
        n -= part
        if not runs[0][1]:
            runs.pop(0)
    return out


def side_by_side(places: list[list[tuple[int, int]]]) -> list[tuple[int, list[tuple[int, int]]]]:
    """Kinds of sequence when each place runs through its lengths over the same sequences."""
    ends = [np.cumsum([c for _, c in runs]) for runs in places]
    out, at = [], 0
    for end in np.unique(np.concatenate(ends)).tolist():
        held: dict[int, int] = {}
        for runs, upto in zip(places, ends, strict=True):
            length = runs[int(np.searchsorted(upto, at, "right"))][0]
            held[length] = held.get(length, 0) + 1
        out.append((end - at, sorted(held.items(), reverse=True)))
        at = end
    return out


def places(kinds: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, pieces of this length in a sequence, offset of the first)."""
    rank: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for number, content in kinds:
        offset = 0
        for length, fit in content:
            rows.setdefault(length, []).append((rank.get(length, 0), sequence, fit, offset))
            rank[length] = rank.get(length, 0) + number * fit
            offset += length * fit
        sequence += number
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, groups: int = GROUPS,
         with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with the sequence that holds them and their place in it.

    Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids (binary, little-endian 32-bit)
    if ``with_ids``. A null or empty text is the closing id alone. Null and repeated doc_ids are packed like
    others: each row of ``docs`` is a document. Other columns are left out. An empty table gives no rows.
    The driver sees one number for each length, at most ``capacity``; the plan is as small.
    """
    stored = Stored(docs.sparkSession)
    pieces = stored.keep(token_pieces(docs, tokenizer_path, capacity, with_ids), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity, groups)))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length).tolist():
                rows = table[one]
                at = np.flatnonzero(length == one)
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                nth = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + nth // row[:, 2]
                offset[at] = row[:, 3] + nth % row[:, 2] * one
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)],
                names=[*columns, "sequence_id", "offset"])

    ready = pieces.join(ranked, ["task", "length"]).select(*columns, (F.col("base") + F.col("nth")).alias("rank"))
    schema = T.StructType([*(pieces.schema[c] for c in columns), T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    return ready.mapInArrow(put, schema)
