"""Decontamination with a benchmark that needs many automata, one item far larger than an automaton."""

import random

from ashlar.llm import decontaminate


def test_parts_give_the_rows_of_one_automaton(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]

    def some(n):
        return " ".join(rng.choice(words) for _ in range(n))

    huge, short = some(3000), some(7)
    items = [("huge", huge), ("short", short), ("same", short), ("same", short), (None, short), ("none", None), ("blank", "?!")]
    items += [(f"i{k}", some(30)) for k in range(20)]
    inside = huge.split()
    docs = [(k, some(40) + ". " + " ".join(inside[90 * k : 90 * k + 12 + k % 3]) + "; " + some(10)) for k in range(30)]
    docs += [(100, short.upper()), (101, None), (102, ""), (103, huge), (103, huge)]
    left = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, items string")
    right = spark.createDataFrame(items, "item_id string, text string")
    whole, parts = (
        sorted((r["doc_id"], r["n_words"], r["hit_words"], r["items"], str(r["spans"]))
               for r in decontaminate.find_contamination(left, right, automaton_bytes=most).collect())
        for most in (32 << 20, 30000))
    assert whole == parts
    windows = {}
    for item, text in items:
        for w in decontaminate.item_windows(text):
            windows.setdefault(w, set()).add(item)
    for (doc, text), row in zip(sorted(docs, key=lambda d: (d[0], d[1] or "")), whole, strict=True):
        plain = (text or "").lower().replace(".", " ").replace(";", " ").split()
        hit, ids = set(), set()
        for w, of in windows.items():
            w = w.decode().split()
            for k in range(len(plain) - len(w) + 1):
                if plain[k : k + len(w)] == w:
                    hit.update(range(k, k + len(w)))
                    ids |= of - {None}
        assert row[:4] == (doc, len(plain), sorted(hit), sorted(ids))
