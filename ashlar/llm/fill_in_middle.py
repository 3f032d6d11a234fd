"""Fill-in-the-middle: each text is cut at two ranks of its units and its parts are put in another order."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashlar.llm.common import blocks, mix, text_of

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred texts, so many are rearranged, and so many of those put the suffix in front.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
#: A lane keeps about one in 2**LANE_BITS nodes of the lane below.
LANE_BITS = 4
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]


class SkipList:
    """Indexable skip list over the units of a block of texts.

    A node stands before each unit. Its link leads to the next node of its lane, or to the end of the text, and carries
    how many units and how many code points it passes. The lane above keeps the first node of each text and those that
    a hash of their rank chooses, so that a lane has about a sixteenth of the nodes of the lane below.
    """

    def __init__(self, points: np.ndarray, firsts: np.ndarray) -> None:
        """``points``: code points of each unit; ``firsts``: the first unit of each text, and the number of units."""
        filled = firsts[:-1] < firsts[1:]
        self.filled, heads = filled, firsts[:-1][filled]
        counts = np.diff(firsts)[filled]
        rank = np.arange(len(points)) - np.repeat(heads, counts)
        choice = mix((rank + 1).astype(np.uint64))
        self.lanes = [(np.ones(len(points), np.int64), points.astype(np.int64))]
        self.down: list[np.ndarray] = []
        at = heads
        while len(self.lanes[-1][0]) > len(heads) and LANE_BITS * len(self.down) < 60:
            kept = (choice >> np.uint64(LANE_BITS * len(self.down))) & np.uint64((1 << LANE_BITS) - 1) == 0
            kept[at] = True
            down = np.flatnonzero(kept)
            units, width = self.lanes[-1]
            self.lanes.append((np.add.reduceat(units, down), np.add.reduceat(width, down)))
            self.down.append(down)
            choice = choice[down]
            at = np.searchsorted(down, at)
        self.heads = at

    def points_before(self, ranks: np.ndarray) -> np.ndarray:
        """Code points in front of the unit of this rank, one rank for each text; all texts descend together."""
        out = np.zeros(len(ranks), np.int64)
        node, left = self.heads.copy(), ranks[self.filled].astype(np.int64)
        passed = np.zeros(len(left), np.int64)
        for lane in range(len(self.lanes) - 1, -1, -1):
            units, width = self.lanes[lane]
            going = np.flatnonzero(left > 0)
            while len(going):
                going = going[units[node[going]] <= left[going]]
                left[going] -= units[node[going]]
                passed[going] += width[node[going]]
                node[going] += 1
                going = going[left[going] > 0]
            if lane:
                open_ = np.flatnonzero(left > 0)
                node[open_] = self.down[lane - 1][node[open_]]
        out[self.filled] = passed
        return out


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte of each code point, code points of each unit, and the first unit of each text (with the end).

    A unit is a run of A-Z and a-z, or any other single code point.
    """
    lead = (data & 0xC0) != 0x80
    letter = ((data | 0x20) - np.uint8(97)) < 26
    goes_on = np.zeros(len(data), bool)
    goes_on[1:] = letter[1:] & letter[:-1]
    goes_on[offsets[:-1][offsets[:-1] < len(data)]] = False
    points = np.flatnonzero(lead)
    opens = np.flatnonzero(~goes_on[points])
    widths = np.diff(np.append(opens, len(points)))
    return points, widths, np.searchsorted(points[opens], offsets)


def arranged(text: bytes, first: int, second: int, by_form: int, by_order: int) -> tuple[str, bytes]:
    """Form and output of a text cut before the bytes ``first`` and ``second``."""
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or by_form % 100 >= CUT_PERCENT:
        return "plain", text
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if by_order % 100 < SUFFIX_FIRST_PERCENT:
        return "spm", b"".join([SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle])
    return "psm", b"".join([PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle])


def draws(doc_id: object, seed: int) -> tuple[int, ...]:
    """Four numbers of 32 bits from the seed and the id; a null id is empty."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """docs(doc_id, text, …) without the text, with n (units), form, prefix_chars, middle_chars and output.

    form is psm (prefix, suffix, middle), spm (suffix first) or plain (the text as it is). Cut ranks, form and order
    follow from ``seed`` and doc_id alone, so that reruns and repeated rows agree; a null id draws as an empty one. Null
    and empty texts have no units and are plain, as are texts that hold a marker. prefix_chars and middle_chars are null
    if plain. Texts of any length are read whole; nothing is shuffled. Columns of the added names are replaced.
    """
    plain = docs.drop(*ADDED)
    carry = [c for c in plain.columns if c != "text"]
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]
    schema = T.StructType([*(plain.schema[c] for c in carry), *(T.StructField(a, k) for a, k in zip(ADDED, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(text_of(batch)):
                points, widths, firsts = units(data, offsets)
                n = np.diff(firsts)
                drawn = np.array([draws(d.as_py(), seed) for d in batch.column("doc_id")[lo:hi]], np.int64)
                ranks = np.sort(drawn[:, :2] % (n[:, None] + 1), axis=1)
                lanes = SkipList(widths, firsts)
                cuts = np.stack([lanes.points_before(ranks[:, k]) for k in range(2)], axis=1)
                before = np.searchsorted(points, offsets)
                places = np.append(points, len(data))[before[:-1, None] + cuts]
                places = np.where(cuts == np.diff(before)[:, None], offsets[1:, None], places)
                places = np.where(cuts == 0, offsets[:-1, None], places)
                made = [arranged(data[offsets[i] : offsets[i + 1]].tobytes(), *(places[i] - offsets[i]).tolist(), *drawn[i, 2:].tolist())
                        for i in range(hi - lo)]
                is_plain = np.array([form == "plain" for form, _ in made])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[lo:hi] for c in carry), pa.array(n.astype(np.int64)), pa.array([form for form, _ in made], pa.string()),
                     pa.array(cuts[:, 0], pa.int64(), mask=is_plain), pa.array(cuts[:, 1] - cuts[:, 0], pa.int64(), mask=is_plain),
                     pa.array([output for _, output in made], pa.binary()).cast(pa.string())],
                    names=[*carry, *ADDED])

    return plain.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No part holds a marker, so the markers split the output into its parts."""
    parts = F.split(output, "<[PSM]>", -1)
    first, second, third = (F.element_at(parts, k) for k in (2, 3, 4))
    return F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first)).otherwise(output)


def digest(made: DataFrame) -> DataFrame:
    """The outputs as their lengths and hashes, with the hash of the text rebuilt from output and form."""
    hashes = [F.sha2(c.cast("binary"), 256).alias(name) for c, name in (
        (F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)
