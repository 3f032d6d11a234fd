"""Suffix arrays of the dictionary against a naive order, whole results against brute force on several splits."""

import collections
import random

import numpy as np
import pytest

from ashlar.llm import suffix_dedup


@pytest.mark.parametrize("letters,n,width", [(2, 900, 8), (2, 900, 21), (3, 3000, 64), (26, 3000, 200), (1, 700, 200)])
def test_order_is_that_of_a_naive_sort(letters, n, width):
    rng = np.random.default_rng(letters * n)
    data = rng.integers(97, 97 + letters, n).astype(np.uint8)
    data[n // 2 : n // 2 + n // 3] = data[: n // 3]
    starts = np.flatnonzero(rng.random(n - width + 1) < 0.8)
    raw = data.tobytes()
    order, agrees = suffix_dedup.suffix_array(data, starts, width)
    assert sorted(order) == starts.tolist()
    cut = [raw[k : k + width] for k in order]
    assert cut == sorted(cut)
    assert agrees.tolist() == [k > 0 and cut[k] == cut[k - 1] for k in range(len(cut))]
    seen = collections.Counter(cut)
    again = suffix_dedup.repeated_windows(data, starts, width)
    assert set(np.flatnonzero(again)) == {int(k) for k in starts if seen[raw[k : k + width]] > 1}


def test_no_suffixes():
    order, agrees = suffix_dedup.suffix_array(np.zeros(0, np.uint8), np.zeros(0, np.int64))
    assert len(order) == len(agrees) == 0


def corpus():
    rng = random.Random(5)
    letters = "abcdefgh é"

    def some(n):
        return "".join(rng.choice(letters) for _ in range(n))

    passage, long = some(260), some(2000)
    texts = [some(300) + passage + some(rng.randrange(400)) for _ in range(12)]
    texts += [passage[rng.randrange(40) : 230 + rng.randrange(30)] + some(100) for _ in range(12)]
    texts += [long[: 900 + 7 * k] + some(30) + long[900 + 11 * k :] for k in range(8)]
    texts += [None, "", some(150), "z" * 700, "ab" * 400, some(1 << 17) + passage, long, long]
    return [(k if k % 9 else None, t) for k, t in enumerate(texts)] + [(None, texts[0])] * 3 + [(777, long)] * 3


@pytest.mark.parametrize("bin_bytes,trigger_most", [(4 << 20, 1 << 20), (3000, 1 << 20), (3000, 900), (1 << 20, 0)])
def test_whole_rows_on_every_split(spark, bin_bytes, trigger_most):
    data = corpus()
    docs = spark.createDataFrame([(*r, "x", 1, True) for r in data], "doc_id long, text string, full string, trigger int, single boolean")
    got = suffix_dedup.remove_substrings(docs, bin_bytes, trigger_most).collect()
    raws = [(t or "").encode() for _, t in data]
    seen = collections.Counter(r[k : k + 200] for r in raws for k in range(len(r) - 199))
    want = []
    for (doc, _), r in zip(data, raws, strict=True):
        gone = np.zeros(len(r) + 1, int)
        for k in range(len(r) - 199):
            if seen[r[k : k + 200]] > 1:
                gone[k : k + 200] = 1
        want.append((doc, bytes(b for b, g in zip(r, gone, strict=False) if not g), int(gone.sum())))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r["doc_id"], bytes(r["kept"]), r["n_removed"]) for r in got), key=key) == sorted(want, key=key)
