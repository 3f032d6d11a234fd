"""Texts as byte blocks inside tasks, tables written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.plans.loops import new_folder

#: Bytes of text that a task turns into arrays at a time; one text is never split.
BLOCK_BYTES = 1 << 20
#: Odd multiplier of the polynomial hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: A table of hashes that marks its rows has so many places for each, and at most 2**PLACE_BITS; it is made in 2**SLICE_BITS slices.
PLACES, PLACE_BITS, SLICE_BITS = 16, 26, 6
#: One random 64-bit number for each byte value.
BYTE_VALUES = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64)


class Stored:
    """Tables of one run in the shared folder; a lost executor costs no earlier step."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = new_folder(spark)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def marked(keys: DataFrame, column: str) -> Callable[[str], Column]:
    """A condition on a column of 64-bit hashes that all those of ``keys`` meet, and few others (a Bloom filter of one hash).

    It spares a shuffle rows that the join after it would drop. Beyond 2**PLACE_BITS / PLACES keys more others meet it.
    """
    spark = keys.sparkSession
    bits = min(max((PLACES * keys.count()).bit_length(), 16), PLACE_BITS)
    low = bits - SLICE_BITS

    def mark(part: pa.Table) -> pa.Table:
        place = part.column("key").to_numpy().view(np.uint64) >> np.uint64(64 - bits)
        held = np.zeros(1 << low, bool)
        held[place & np.uint64((1 << low) - 1)] = True
        return pa.table({"slice": [int(place[0]) >> low], "held": [np.packbits(held, bitorder="little").tobytes()]},
                        schema=pa.schema([("slice", pa.int32()), ("held", pa.binary())]))

    parts = keys.select(F.col(column).alias("key")).groupBy(F.shiftrightunsigned("key", 64 - SLICE_BITS))
    size = 1 << low - 3
    places = np.zeros(size << SLICE_BITS, np.uint8)
    for r in parts.applyInArrow(mark, "slice int, held binary").collect():
        places[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["held"], np.uint8)
    shared = spark.sparkContext.broadcast(places)

    @F.arrow_udf("boolean")
    def is_marked(key: pa.Array) -> pa.Array:
        place = key.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
        held = shared.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)
        return pa.array((held & 1).astype(bool))

    return is_marked


def text_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column as bytes with 64-bit offsets; null texts become empty."""
    return batch.column(column).cast(pa.large_binary()).fill_null(b"")


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about ``most`` bytes."""
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + most, "right")) - 1)
        yield lo, hi, values[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]
        lo = hi


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_powers: dict[int, np.ndarray] = {}


def powers_to(base: int, n: int) -> np.ndarray:
    """Powers of ``base`` modulo 2**64, kept for the next block unless one very long text asked for them."""
    if n <= 4 * BLOCK_BYTES:
        if len(_powers.get(base, ())) < n:
            _powers[base] = powers(base, max(n, BLOCK_BYTES + (BLOCK_BYTES >> 1)))
        return _powers[base][:n]
    return powers(base, n)


class PrefixHash:
    """Hash of any stretch of a block from prefix sums of value * BASE**position."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers_to(BASE, len(data)), out=self.sums[1:])
        self.back = powers_to(INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """Hash of each stretch of ``width`` bytes."""
        if len(self.sums) <= width:
            return np.zeros(0, np.uint64)
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.back[:n] + np.uint64(width))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_bounds(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each run of word bytes; runs never cross documents."""
    n = len(is_word)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = is_word[firsts]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[lasts] = is_word[lasts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
