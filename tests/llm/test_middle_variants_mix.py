"""Fill-in-the-middle, spelling variants and source mix against plain Python, and on odd tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashlar.llm import fill_in_middle, source_mix, spelling_variants

CLASHING = ["n", "form", "output", "word", "size", "taken", "target", "_hash", "root"]
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
                     *(T.StructField(c, T.StringType()) for c in CLASHING)])
PIECES = ["alpha", "Beta", "gamma", "Straße", "été", "x1", "中文", "💥", " ", "\n", "12", "<", "<P", "P>", "...", "İ", "\x00", "a"]


def text_of(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(PIECES) for _ in range(n))


TEXTS = [None, "", " ", "one", "a b", "a<P>b", "<S>", "x<M>", "é" * 400, "word " * 300, *(text_of(i, i * 7) for i in range(60)), "ab 💥" * 300_000]
ROWS = [(i, t, None) for i, t in enumerate(TEXTS)] + [(None, text_of(5, 90), "s"), (None, text_of(5, 90), "s"), (7, "again", "s"), (7, "again", "s")]


def table(spark, rows):
    return spark.createDataFrame([(*r, *("c" for _ in CLASHING)) for r in rows], DOCS)


def rows(df):
    return [r.asDict() for r in df.collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- fill in the middle --------------------------------------------------------------------------


def expected_middle(doc_id, text):
    text = text or ""
    found = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted(x % (len(found) + 1) for x in h[:2])
    a, b, z = "".join(found[:low]), "".join(found[low:high]), "".join(found[high:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(found), "plain", None, None, sha(text), sha(text)
    if h[3] % 100 < 20:
        return len(found), "spm", len(a), len(b), sha(f"<S>{z}<P>{a}<M>{b}"), sha(text)
    return len(found), "psm", len(a), len(b), sha(f"<P>{a}<S>{z}<M>{b}"), sha(text)


def test_middles_equal_plain_python(spark):
    made = fill_in_middle.fill_in_middle(table(spark, ROWS).repartition(3))
    assert set(made.columns) == {*DOCS.names, *fill_in_middle.ADDED} - {"text"}
    got = collections.Counter(tuple(r.values()) for r in rows(fill_in_middle.digest(made)))
    assert got == collections.Counter((i, *expected_middle(i, t)) for i, t, _ in ROWS)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_middles_of_an_empty_table(spark):
    assert rows(fill_in_middle.digest(fill_in_middle.fill_in_middle(table(spark, [])))) == []


def test_skip_list_reaches_every_rank():
    rng = np.random.default_rng(4)
    counts = np.array([0, 1, 5000, 0, 17, 16, 300, 0])
    widths = rng.integers(1, 9, counts.sum())
    firsts = np.concatenate([[0], np.cumsum(counts)])
    lanes = fill_in_middle.SkipList(widths, firsts)
    assert len(lanes.lanes) > 3 and len(lanes.lanes[1][0]) < len(widths) / 8
    for lane_units, lane_points in lanes.lanes:
        assert lane_units.sum() == counts.sum() and lane_points.sum() == widths.sum()
    for _ in range(300):
        ranks = np.array([rng.integers(0, c + 1) for c in counts])
        want = [widths[f : f + r].sum() for f, r in zip(firsts[:-1], ranks, strict=True)]
        assert lanes.points_before(ranks).tolist() == want
    assert lanes.points_before(counts).tolist() == [widths[a:b].sum() for a, b in zip(firsts[:-1], firsts[1:], strict=True)]


# -- spelling variants ---------------------------------------------------------------------------


def expected_words(table_rows):
    counts = collections.Counter()
    for doc_id, text, _ in table_rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def expected_variants(words):
    form, near = {}, {}
    for w, n in words.items():
        found = [x for x in words if one_edit(w, x)]
        near[w] = len(found)
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return {w: (form[w], root(w), n, near[w], words[form[w]] if form[w] else None) for w, n in words.items()}


def spelled(seed):
    """Texts over few letters, so that words have many near words, with frequent forms and chains of them."""
    rng = random.Random(seed)
    heads = ["abcabc", "éabcdef", "ÀÉabca", "bbbbbbb", "stationary"]
    lines = [(i, " ".join(rng.choice(heads)[:6] + "".join(rng.choice("abc") for _ in range(rng.randint(0, 3))) for _ in range(200)), None) for i in range(30)]
    chain = {"settlement": 700, "settlemant": 130, "setlemant": 25, "setlemnt": 5, "Settlement,": 3, "tieform": 50, "tieforn": 5, "tieforo": 50}
    lines += [(100 + i, " ".join([w] * n), None) for i, (w, n) in enumerate(chain.items())]
    return [*lines, *lines[:3], (None, "nameless " * 9, None), (None, None, None), (5000, "", None), (5001, "÷×÷×÷× " * 6, "s"), (5002, "long" * 30 + " x", None)]


@pytest.mark.parametrize("group", [64, 6])
def test_variants_equal_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(spelling_variants, "GROUP_WORDS", group)
    data = spelled(3)
    words = expected_words(data)
    want = expected_variants(words)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows(spelling_variants.group_variants(table(spark, data)))}
    assert got == want
    assert want["setlemnt"][1] == "settlement" and want["tieforn"][0] == "tieform" and max(v[3] for v in want.values()) > 10


def test_slips_take_the_code_point_named_by_the_hash(spark):
    data = [(i, "wanderer Über-ÀÉÎÕÜÝ " * 6, None) for i in range(2000)]
    got = {r["word"]: r["n"] for r in rows(spelling_variants.corpus_words(table(spark, data)))}
    assert got == expected_words(data) and len(got) > 2


def test_one_large_group_is_compared_by_longer_chunks(spark):
    """Words that all share their first half, and then all but two code points: every link is found once."""
    letters = "abcdefghijklmnop"
    words = {f"prefix{a}{b}{c}x": 5 for a in letters for b in letters[:6] for c in "ab"}
    table_ = spark.createDataFrame([(w, n) for w, n in words.items()], "word string, n long")
    got = sorted((r["a"], r["b"]) for r in rows(spelling_variants.near_words(table_)))
    assert got == sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))


def test_variants_of_an_empty_table(spark):
    assert rows(spelling_variants.group_variants(table(spark, []))) == []


# -- source mix ----------------------------------------------------------------------------------


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        share = (sum(sizes.values()) - 3 * sum(sizes[s] for s in capped)) / (sum(weight[s] for s in free) or 1)
        over = {s for s in free if weight[s] * share > 3 * sizes[s]}
        if not over:
            return {s: min(weight[s] * share, 3.0 * sizes[s]) for s in order}
        capped |= over


def expected_mix(table_rows):
    placed = collections.defaultdict(list)
    for doc_id, text, source in table_rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        named = f"1:{'' if doc_id is None else doc_id}:{text or ''}"
        placed[source].append((int(hashlib.md5(named.encode()).hexdigest()[:15], 16), size, doc_id))
    sizes = {s: sum(x[1] for x in group) for s, group in placed.items()}
    goal, out = expected_targets(sizes), collections.Counter()
    for s, group in placed.items():
        whole = min(int(goal[s] / sizes[s]), 3) if sizes[s] else 0
        rest, below = goal[s] - whole * sizes[s], 0
        for _, size, doc_id in sorted(group, key=lambda x: x[0]):
            extra = below + size <= rest or below <= rest and (rest - below) * 2 > size
            out[(doc_id, size, sizes[s], goal[s], size * (whole + extra))] += 1
            below += size
    return out


def mixture(seed, n):
    rng = random.Random(seed)
    names = ["b", "a", "é", None, "Z", "zz", "", "small"]
    got = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(names[:7]) if rng.random() < 0.6 else "b") for i in range(n)]
    return [*got, (n, "one\ttwo\x0bthree x\x1f  y", "small"), (n + 1, None, "small"), (n + 2, "", None), (n + 3, " \n ", "blank")]


@pytest.mark.parametrize("digit", [12, 2])
def test_mix_equals_a_sort_by_hash(spark, monkeypatch, digit):
    monkeypatch.setattr(source_mix, "DIGIT_BITS", digit)
    monkeypatch.setattr(source_mix, "DIGITS", [*(("_hash", s) for s in range(60 - digit, -1, -digit)), *(("_row", s) for s in range(60, -1, -digit))])
    data = mixture(3, 700)
    mixed = source_mix.mix(table(spark, data).repartition(5))
    assert set(mixed.columns) == {*DOCS.names, *source_mix.ADDED}
    got = collections.Counter((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in rows(mixed))
    assert got == expected_mix(data)


def test_mix_splits_a_third_of_equal_rows(spark):
    data = [*mixture(8, 300), *[(None, "same words each time", "b")] * 900]
    runs = []
    for parts in (2, 7):
        mixed = rows(source_mix.mix(table(spark, data).repartition(parts), ["doc_id", "source"]))
        runs.append(collections.Counter((r["doc_id"], r["source"], r["size"], r["target"], r["taken"]) for r in mixed))
        assert len(mixed) == len(data) and all(r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0 for r in mixed)
        for s in {r["source"] for r in mixed}:
            group = [r for r in mixed if r["source"] == s]
            assert abs(sum(r["taken"] for r in group) - group[0]["target"]) <= max(r["size"] for r in group) / 2
    assert runs[0] == runs[1]


def test_mix_of_bounded_sources_and_empty_tables(spark):
    data = [(1, "w " * 9, "a"), (2, "w", "b"), (3, "w " * 1000, "c"), (4, "w " * 50, "d"), (5, "", "e")]
    got = {r["doc_id"]: r for r in rows(source_mix.mix(table(spark, data)))}
    want = expected_targets({"a": 9, "b": 1, "c": 1000, "d": 50, "e": 0})
    assert {r["source"]: r["target"] for r in got.values()} == want and got[2]["taken"] == 3
    assert rows(source_mix.mix(table(spark, []))) == []
    assert [r["taken"] for r in rows(source_mix.mix(table(spark, [(1, None, None)])))] == [0]


def test_copies_repeat_documents_as_often_as_taken(spark):
    data = [(1, "w " * 9, "a"), (2, "w", "b"), (3, "w " * 100, "c"), (5, "", "e")]
    mixed = source_mix.mix(table(spark, data), ["doc_id", "text"]).cache()
    times = collections.Counter(r["doc_id"] for r in rows(source_mix.copies(mixed)))
    assert all(times[r["doc_id"]] * r["size"] == r["taken"] for r in rows(mixed)) and times[5] == 1


def test_larger_budgets_hold_smaller_ones(spark):
    frame = table(spark, mixture(5, 400)).select("doc_id", "text", F.lit("one").alias("source"))
    space = source_mix.Workspace(spark)
    stored = space.keep(frame.select("doc_id", "source", source_mix.words(F.col("text")).alias("size"),
                                     source_mix.place(F.col("doc_id"), F.col("text"), 1).alias("_hash"), F.monotonically_increasing_id().alias("_row")))
    first = space.keep(source_mix.histogram(stored, *source_mix.DIGITS[0]))
    edges = []
    for rest in (0.0, 10.0, 500.0, 3000.0):
        budget = spark.createDataFrame([("one", rest, 0)], "source string, _rest double, _below long")
        edges.append(rows(source_mix.thresholds(source_mix.Workspace(spark), stored, first, budget))[0]["_edge_hash"])
    assert edges == sorted(edges) and len(set(edges)) > 2
