"""Greedy word-piece lengths by a linear longest-match automaton.

A trie of the vocabulary gets failure links: where no longer match goes on, the link of a node leads to the node that
spells what is left after the tokens which are then certain are popped, and the node knows how many those are. A
word is read once, byte by byte, and only numbers are added; no piece is ever built.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashlar.llm.common import text_of

#: Words up to this many bytes are read side by side; longer ones singly.
SIDE_BY_SIDE = 200
#: Words whose lengths a worker remembers.
CACHED_WORDS = 500_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_vocabulary(path: str) -> list[bytes]:
    """Tokens of a byte-level vocabulary file. Those that open a word begin with a blank."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return sorted(bytes(letters[c] for c in token) for token in vocabulary if all(c in letters for c in token))


class Automaton:
    """Trie with failure links and popped-token counts. Node 0 is the root; a missing link is -1."""

    def __init__(self, tokens: list[bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        whole = [False]
        for token in tokens:
            node = 0
            for byte in token:
                nxt = children[node].get(byte)
                if nxt is None:
                    nxt = len(children)
                    children[node][byte] = nxt
                    children.append({})
                    whole.append(False)
                node = nxt
            whole[node] = node != 0
        fail, popped = [-1] * len(children), [0] * len(children)
        level = [0]
        while level:
            below = []
            for node in level:
                for byte, child in children[node].items():
                    below.append(child)
                    if whole[child]:
                        fail[child], popped[child] = 0, 1
                        continue
                    at, count = fail[node], popped[node]
                    while at != -1 and byte not in children[at]:
                        count += popped[at]
                        at = fail[at]
                    if at != -1:
                        fail[child], popped[child] = children[at][byte], count
            level = below
        self.children = children
        self.fail, self.popped = np.array(fail, np.int64), np.array(popped, np.int64)
        pairs = sorted((node * 256 + byte, child) for node, row in enumerate(children) for byte, child in row.items())
        self.edges = np.array([p[0] for p in pairs], np.int64)
        self.ends = np.array([p[1] for p in pairs], np.int64)

    def count(self, word: bytes) -> int:
        """Tokens of the greedy longest matches of one word; a word that they cannot cover is one token."""
        children, fail, popped = self.children, self.fail, self.popped
        node, tokens = 0, 0
        for byte in word:
            while byte not in children[node]:
                if fail[node] < 0:
                    return 1
                tokens += popped[node]
                node = fail[node]
            node = children[node][byte]
        while node:
            if fail[node] < 0:
                return 1
            tokens += popped[node]
            node = fail[node]
        return int(tokens)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The same for many words at once, all moved on by one byte at a time."""
        lengths = np.array([len(w) for w in words], np.int64)
        out = np.zeros(len(words), np.int64)
        for i in np.flatnonzero(lengths > SIDE_BY_SIDE).tolist():
            out[i] = self.count(words[i])
        short = np.flatnonzero(lengths <= SIDE_BY_SIDE)
        short = short[np.argsort(-lengths[short], kind="stable")]
        size = lengths[short]
        data = np.frombuffer(b"".join([words[i] for i in short.tolist()]), np.uint8)
        first = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
        node, tokens, lost = np.zeros(len(short), np.int64), np.zeros(len(short), np.int64), np.zeros(len(short), bool)
        for place in range(int(size[0]) if len(size) else 0):
            here = np.flatnonzero((size > place) & ~lost)
            byte = data[first[here] + place].astype(np.int64)
            while len(here):
                key = node[here] * 256 + byte
                at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                goes = self.edges[at] == key
                node[here[goes]] = self.ends[at[goes]]
                here, byte = here[~goes], byte[~goes]
                stuck = self.fail[node[here]] < 0
                lost[here[stuck]] = True
                here, byte = here[~stuck], byte[~stuck]
                tokens[here] += self.popped[node[here]]
                node[here] = self.fail[node[here]]
        here = np.flatnonzero((node > 0) & ~lost)
        while len(here):
            stuck = self.fail[node[here]] < 0
            lost[here[stuck]] = True
            here = here[~stuck]
            tokens[here] += self.popped[node[here]]
            node[here] = self.fail[node[here]]
            here = here[node[here] > 0]
        out[short] = np.where(lost, 1, tokens)
        return out


#: Automaton and known words that a worker keeps between tasks, under the name of the run.
_kept: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


def count_tokens(docs: DataFrame, tokens: list[bytes]) -> DataFrame:
    """``docs`` without the text, with n_words, n_tokens and longest_word (tokens of the longest word), all long.

    A word is a run of other bytes than blank and the controls 9 to 13, read with one blank before it. Null and
    empty texts have no words. A word that the vocabulary cannot cover counts as one token. Columns of the added
    names are replaced; repeated rows count alike. The vocabulary is sent to the tasks as it is; nothing is shuffled.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(tokens), uuid.uuid4().hex
    added = ["n_words", "n_tokens", "longest_word"]
    plain = docs.drop(*added)
    carry = [c for c in plain.columns if c != "text"]
    schema = T.StructType([*(plain.schema[c] for c in carry), *(T.StructField(a, T.LongType()) for a in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _kept:
            _kept.clear()
            _kept[key] = (Automaton(shared.value), {})
        automaton, known = _kept[key]
        for batch in batches:
            rows = []
            for text in text_of(batch):
                words = text.as_py().split()
                new = list(set(words).difference(known))
                if new:
                    if len(known) > CACHED_WORDS:
                        known.clear()
                        new = list(set(words))
                    known.update(zip(new, automaton.counts([b" " + w for w in new]).tolist(), strict=True))
                counts = [known[w] for w in words]
                rows.append((len(words), sum(counts), max(counts, default=0)))
            table = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *(pa.array(table[:, i]) for i in range(3))],
                                             names=[*carry, *added])

    return plain.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)
