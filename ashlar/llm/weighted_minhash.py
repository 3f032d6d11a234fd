"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles, weight = occurrences times damped inverse document
frequency. Each of SAMPLES draws picks one shingle so that two documents agree with probability equal to their
weighted Jaccard similarity; bands of draws give candidates, which the exact similarity then judges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import BASE, INVERSE, PrefixHash, Stored, blocks, marked, mix, powers_to, signed, text_of, word_bounds
from ashlar.operators.graph import failure_domains

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Bands of so many draws: a pair of similarity 0.8 shares a band with probability 0.9998.
BANDS, ROWS = 16, 4
#: Document frequencies are counted in so many buckets of shingles, cut into slices to be summed.
BUCKET_BITS, SLICES = 18, 64
#: A shingle in less than one of so many documents weighs most, 1 + DAMPING times one that every document has.
RARE, DAMPING = 1000, 0.25
#: A block of bucket members holds about so many members, or so many bytes of text if they are long.
BLOCK_MEMBERS, BLOCK_TEXT = 1024, 4 << 20
#: Columns of a block's element matrix that are multiplied at a time.
COLUMNS = 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_NORMAL = bytes(int(_LOWER[b]) if _WORD[b] else 0x20 for b in range(256))

_rng = np.random.default_rng(811)
_MULTIPLIERS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
#: Quantiles of the Gamma(2, 1) draws, picked by 16 bits of a shingle's hash.
_R = np.maximum(_rng.gamma(2.0, 1.0, 1 << 16), 1e-3).astype(np.float32)
_LOG_C = np.log(np.maximum(_rng.gamma(2.0, 1.0, 1 << 16), 1e-6)).astype(np.float32)
_INVERSE_R = (1 / _R).astype(np.float32)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and occurrences of each different shingle of a block, sorted by document.

    Words are lower-cased runs of ASCII letters, digits and characters beyond ASCII. A document of fewer than
    SHINGLE_WORDS words, but not none, has all of them as its one shingle.
    """
    start, end, doc = word_bounds(_WORD[data], offsets)
    none = np.zeros(0, np.int64)
    if not len(start):
        return none, none.view(np.uint64), none
    words = mix(PrefixHash(_LOWER[data]).of(start, end))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers_to(BASE, len(words)), out=sums[1:])
    number = np.bincount(doc, minlength=len(offsets) - 1)
    last = np.cumsum(number)[doc]  # the word after the document's last
    first = last - number[doc]
    at = np.arange(len(words))
    opens = np.flatnonzero((at + SHINGLE_WORDS <= last) | (at == first))
    after = np.minimum(opens + SHINGLE_WORDS, last[opens])
    shingle = mix((sums[after] - sums[opens]) * powers_to(INVERSE, len(words) + 1)[opens] + (after - opens).astype(np.uint64))
    of = doc[opens]
    order = np.argsort(shingle)
    order = order[np.argsort(of[order].astype(np.uint16) if len(offsets) < 65536 else of[order], kind="stable")]
    shingle, of = shingle[order], of[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    return of[first], shingle[first], np.diff(np.append(first, len(shingle)))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold a shingle of each bucket, and the number of documents.

    Every document counts. A task adds up one array of fixed size, and the driver gets one.
    """
    size = 1 << BUCKET_BITS
    part = size // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size, np.int64), 0
        for batch in batches:
            seen += batch.num_rows
            for _, _, data, offsets in blocks(text_of(batch)):
                _, shingle, _ = shingles(data, offsets)
                total += np.bincount((shingle >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=size)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([task] * SLICES, pa.int32()), pa.array(range(SLICES), pa.int32()),
             pa.array([seen if i == 0 else 0 for i in range(SLICES)], pa.int64()),
             pa.array([total[i * part : (i + 1) * part].astype("<i8").tobytes() for i in range(SLICES)], pa.binary())],
            names=["task", "slice", "seen", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, "<i8") for c in frame["counts"]], axis=0)
        return pd.DataFrame({"task": [int(frame["task"].iloc[0]) // 256], "slice": [int(frame["slice"].iloc[0])],
                             "seen": [int(frame["seen"].sum())], "counts": [total.astype("<i8").tobytes()]})

    schema = "task int, slice int, seen long, counts binary"
    counts = docs.select("text").mapInArrow(count, schema)
    counts = counts.groupBy("slice", F.floor(F.col("task") / 256)).applyInPandas(add, schema)
    rows = counts.groupBy("slice").applyInPandas(add, schema).collect()
    total = np.zeros(size, np.int64)
    for r in rows:
        total[r["slice"] * part : (r["slice"] + 1) * part] = np.frombuffer(r["counts"], "<i8")
    return total, sum(r["seen"] for r in rows)


def inverse_frequency(counts: np.ndarray, documents: int) -> np.ndarray:
    """Damped weight of a shingle by its bucket, from 1 to 1 + DAMPING."""
    share = np.log(max(documents, 1) / np.maximum(counts, 1)) / np.log(RARE)
    return 1 + DAMPING * np.clip(share, 0, 1)


def weights(shingle: np.ndarray, occurrences: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return occurrences * idf[(shingle >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]


def draws(of: np.ndarray, shingle: np.ndarray, weight: np.ndarray, documents: int) -> np.ndarray:
    """Band keys of each document, one row each; documents without shingles have none that count."""
    out = np.zeros((documents, BANDS), np.uint64)
    if not len(of):
        return out
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    log_weight = np.log(weight).astype(np.float32)
    low = np.uint64(0xFFFF)
    for band in range(BANDS):
        key = np.full(len(first), band, np.uint64)
        for row in range(ROWS):
            bits = shingle * _MULTIPLIERS[band * ROWS + row]
            pick = (bits >> np.uint64(48)).astype(np.int32)
            r = _R[pick]
            beta = ((bits >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
            t = np.floor(log_weight * _INVERSE_R[pick] + beta)
            a = _LOG_C[((bits >> np.uint64(32)) & low).astype(np.int32)] - r * (t - beta + np.float32(1))
            key = mix(key ^ np.minimum.reduceat(a, first).view(np.uint32).astype(np.uint64))
        out[of[first], band] = key
    return out


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(doc_id, document, node, has_words, n_bytes, bands): node names the normalised words, so copies share it."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, wordy, bands, size = [], [], [], []
            for lo, hi, data, offsets in blocks(text_of(batch)):
                of, shingle, occurrences = shingles(data, offsets)
                keys = draws(of, shingle, weights(shingle, occurrences, shared.value), hi - lo)
                bands.append(keys)
                wordy.append(np.bincount(of, minlength=hi - lo) > 0)
                size.append(np.diff(offsets).astype(np.int64))
                for i in range(hi - lo):
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    words = raw.translate(_NORMAL).split()
                    nodes.append(hashlib.md5(b" ".join(words) if words else b"\n" + raw).digest())
            flat = np.concatenate(bands).reshape(-1) if bands else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("document"), pa.array(nodes, pa.binary()),
                 pa.array(np.concatenate(wordy) if wordy else np.zeros(0, bool)),
                 pa.array(np.concatenate(size) if size else np.zeros(0, np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS), pa.array(signed(flat)))],
                names=["doc_id", "document", "node", "has_words", "n_bytes", "bands"])

    return docs.select("doc_id", "document", "text").mapInArrow(
        sign, "doc_id long, document long, node binary, has_words boolean, n_bytes long, bands array<long>")


def similar(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of nodes whose weighted Jaccard similarity reaches the bound."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def bag(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(raw, np.uint8)
        _, shingle, occurrences = shingles(data, np.array([0, len(data)]))
        return shingle, weights(shingle, occurrences, shared.value)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            good = []
            for left, right in zip(text_of(batch, "text_a"), text_of(batch, "text_b"), strict=True):
                right = right.as_py()
                if right != last:
                    last, held = right, bag(right)
                (s, v), (t, w) = bag(left.as_py()), held
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                both = t[at] == s
                common = np.minimum(v[both], w[at[both]]).sum()
                good.append(bool(common >= (similarity - 1e-9) * (v.sum() + w.sum() - common)))
            keep = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with_both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(judge, "a binary, b binary")


def elements(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and shingle of every occurrence of a shingle; the n-th one has the same hash in all texts."""
    found = []
    for lo, _, data, offsets in blocks(texts):
        of, shingle, occurrences = shingles(data, offsets)
        nth = np.arange(occurrences.sum()) - np.repeat(np.cumsum(occurrences) - occurrences, occurrences)
        each = np.repeat(shingle, occurrences)
        found.append((np.repeat(of, occurrences) + lo, mix(each + nth.astype(np.uint64) * np.uint64(BASE)), each))
    of, element, shingle = (np.concatenate(part) for part in zip(*found, strict=True))
    return of, element, shingle


def overlaps(texts: pa.Array, left: np.ndarray, right: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common weight of each left with each other right text, and the weight of every text.

    Elements in one text only add nothing; the others are columns of a 0/1 matrix, multiplied a few at a time.
    """
    of, element, shingle = elements(texts)
    weight = weights(shingle, np.ones(len(shingle), np.int64), idf)
    total = np.bincount(of, weight, minlength=len(texts))
    _, column, number = np.unique(element, return_inverse=True, return_counts=True)
    many = number > 1
    place = np.cumsum(many) - 1
    inside = many[column]
    of, column, weight = of[inside], place[column[inside]], weight[inside]
    order = np.argsort(column, kind="stable")
    of, column, weight = of[order], column[order], weight[order]
    common = np.zeros((len(left), len(right)))
    for first in range(0, int(many.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + COLUMNS])
        held, worth = np.zeros((len(texts), COLUMNS)), np.zeros(COLUMNS)
        held[of[lo:hi], column[lo:hi] - first] = 1
        worth[column[lo:hi] - first] = weight[lo:hi]
        common += (held[left] * worth) @ held[right].T
    return common, total


def across_components(tiles: DataFrame, idf: np.ndarray, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) that join the labels of each tile: (bucket, low, high, block, node, label, text).

    A tile compares the members of one block with those of another, or of one block with each other, inside its task.
    Of the links found, those that join labels not yet joined are returned, so less than the tile has members.
    """
    shared = tiles.sparkSession.sparkContext.broadcast(idf)

    def compare(tile: pa.Table) -> pa.Table:
        batch = tile.combine_chunks().to_batches()[0]
        block, node = batch.column("block").to_numpy(), batch.column("node")
        left = np.flatnonzero(block == batch.column("low")[0].as_py())
        right = np.flatnonzero(block == batch.column("high")[0].as_py())
        label = batch.column("label").dictionary_encode().indices.to_numpy()
        a, b = [], []
        if len(left) and len(right) and label.any():
            common, total = overlaps(text_of(batch), left, right, shared.value)
            linked = common >= (similarity - 1e-9) * (total[left][:, None] + total[right] - common)
            i, j = np.nonzero(linked & (label[left][:, None] != label[right]))
            i, j = left[i], right[j]
            ends = np.sort(np.stack([label[i], label[j]]).astype(np.int64), axis=0)
            _, first = np.unique(ends[0] * len(label) + ends[1], return_index=True)
            root = list(range(len(label)))

            def top(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for at in first.tolist():
                s, t = top(int(ends[0, at])), top(int(ends[1, at]))
                if s != t:
                    root[s] = t
                    a.append(node[int(i[at])])
                    b.append(node[int(j[at])])
        return pa.table({"a": pa.array([x.as_py() for x in a], pa.binary()), "b": pa.array([x.as_py() for x in b], pa.binary())})

    return tiles.groupBy("bucket", "low", "high").applyInArrow(compare, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    return failure_domains(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def document_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row (doc_id, document, class_id, is_kept) for each row of ``docs`` (doc_id, text).

    Classes are the components of all links between documents that share a band and whose weighted Jaccard
    similarity reaches ``similarity``. ``class_id`` is the least doc_id of the class, null if all are null; one
    document of a class, the first by (doc_id, nulls last, document), is_kept. ``document`` is a hash of id and text; rows equal
    in both are one document. Null texts count as empty; texts without words are in one class only with equal texts.
    An empty table gives no rows; other columns are not looked at.

    Copies (equal words) are one node throughout. In each bucket one member is compared with all others, so the pairs
    grow with the members. A bucket that then still holds several components is cut into blocks, and every two blocks
    are compared inside one task. No two members of a bucket that could join two components stay uncompared.
    """
    spark = docs.sparkSession
    stored = Stored(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        document_key().alias("document"))
    counts, documents = document_frequencies(plain)
    idf = inverse_frequency(counts, documents)
    signed_ = stored.keep(signatures(plain, idf), "signatures")
    nodes = (signed_.where("has_words").groupBy("node")
             .agg(F.min_by("document", F.struct("document")).alias("document"), F.max("n_bytes").alias("n_bytes"),
                  F.first("bands").alias("bands")))
    nodes = stored.keep(nodes, "nodes")
    members = nodes.select("node", "n_bytes", F.explode("bands").alias("bucket"))
    several = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("other")).where("centre != other")
    several = stored.keep(several.select("bucket", "centre"), "several")  # a table, so that a skewed bucket can be split
    live = members.where(marked(several, "bucket")("bucket")).join(several, "bucket")
    live = stored.keep(live.where("node != centre"), "live")
    pairs = stored.keep(live.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "pairs")
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    keys = stored.keep(needed.join(nodes.select("node", "document"), "node"), "keys")
    wanted = plain.select("document", "text").where(marked(keys, "document")("document")).dropDuplicates(["document"])
    texts = stored.keep(wanted.join(keys, "document").select("node", "text"), "texts")
    links = stored.keep(similar(pairs, texts, idf, similarity), "links-0")
    labels = stored.keep(components(links), "labels-0")
    named = live.select("bucket", "node", "n_bytes").join(labels, "node", "left").withColumn("label", F.coalesce("domain", "node"))
    open_ = named.groupBy("bucket").agg(
        F.min("label").alias("label"), F.max("label").alias("other"),
        F.ceil(F.greatest(F.count("*") / BLOCK_MEMBERS, F.sum("n_bytes") / BLOCK_TEXT)).cast("int").alias("blocks"))
    open_ = stored.keep(open_.where("label != other").select("bucket", "blocks"), "open")
    placed = (named.select("bucket", "node", "label").join(open_, "bucket")
              .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
              .withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("bucket", F.least("block", "met").alias("low"), F.greatest("block", "met").alias("high"), "block", "node", "label"))
    tiles = placed.join(texts, "node")
    links = stored.keep(links.unionByName(across_components(tiles, idf, similarity)), "links-1")
    labels = stored.keep(components(links), "labels-1")
    rows = signed_.select("doc_id", "document", "node").join(labels, "node", "left").select(
        "doc_id", "document", F.coalesce("domain", "node").alias("label"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "document")
    classes = rows.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min_by("document", order).alias("first"))
    classes = stored.keep(classes, "classes")
    return rows.join(classes, "label").select("doc_id", "document", "class_id", (F.col("document") == F.col("first")).alias("is_kept"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class; rows equal in id and text are one document."""
    kept = near_duplicates(docs, similarity).where("is_kept").select(F.col("document").alias("_document")).distinct()
    keyed = docs.withColumn("_document", document_key())
    return keyed.join(kept, "_document").dropDuplicates(["_document"]).drop("_document")
