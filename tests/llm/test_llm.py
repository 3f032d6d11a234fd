"""Training-data operators against brute force, and on odd tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashlar.llm import (decontaminate, packing, quality, sentence_spans, sharding, suffix_dedup, token_counts, toxicity, warc,
                        weighted_minhash)
from ashlar.llm.queries import tokenizer_path

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("n_words", T.StringType()), T.StructField("score", T.StringType()),
                     T.StructField("document", T.StringType()), T.StructField("slot", T.StringType())])
RNG = random.Random(5)
WORDS = ["alpha", "beta", "gamma", "delta", "Straße", "été", "x1", "omega", "kappa", "theta", "iota", "rho", "tau", "phi"]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice([".", ",", "\n", "!"]) if rng.random() < 0.2 else "") for _ in range(n))


SHARED = prose(90, 77)
TEXTS = [None, "", " \n\t", "one", "one two three", prose(40, 1), prose(40, 1), prose(300, 2), prose(20, 3) + " " + SHARED,
         SHARED + " " + prose(30, 4), "é" * 500, "é" * 500, "ab" * 400, "word " * 200, prose(6000, 9), "<|endoftext|> \x00 中文 İ", "💥" * 60]
ROWS = [(i, t, "c", "s", "d", "q") for i, t in enumerate(TEXTS)] + [(None, prose(50, 6), "c", None, "d", "q")] * 2 + \
       [(7, prose(300, 2), "c", "s", None, "q")] * 2


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def raw(text):
    return (text or "").encode()


def test_toxicity_learns_and_keeps_labels_out(spark, none):
    table, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        table.append((i, prose(30, i) + (f" you are a {RNG.choice(['grobian', 'grobiane', 'grobians'])} indeed." if bad else "."), None, None, None, None))
        marks.append((i, int(bad)))
    docs, labels = spark.createDataFrame(table, DOCS), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in rows(toxicity.toxicity(docs, labels))}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(r["predicted"] == int(i % 4 == 0) for i, r in got.items())
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in rows(toxicity.toxicity(docs, flipped))}
    assert all(again[i] == r["score"] for i, r in got.items())
    assert rows(toxicity.toxicity(none, labels)) == []


def test_toxicity_odd_rows_and_no_labels(spark, docs):
    labels = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    got = rows(toxicity.toxicity(docs, labels))
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if not r["text"]} == {next(r["score"] for r in got if r["text"] == "one")}


def test_grammar_marks_negated_reported_and_aimed_hits():
    grammar = toxicity.Grammar(toxicity.fixed_words(), {}, [1.0] * 7, 0.0)
    f = lambda text: dict(zip(toxicity.FEATURES, grammar.features(text), strict=True))
    assert f("he is not an idiot")["negated"] > 0 and f("he is not an idiot")["plain"] == 0
    assert f("she said idiot")["reported"] > 0
    assert f("you idiot")["aimed"] > 0 and f("idiot. you")["aimed"] == 0
    assert f("not. idiot")["plain"] > 0
    assert f("they kill")["threat"] > 0
    for text in ("He said: you idiot", 'She wrote, "idiot"', "he said, they are, all of them, idiot", 'they wrote: “a word. Then idiot.” and', "sagte: „Idiot“"):
        assert f(text)["reported"] > 0 and f(text)["plain"] == 0, text
    for text in ("he said no. idiot", 'she wrote "a word" idiot', 'he said "x\nidiot', 'the "idiot"'):
        assert f(text)["plain"] > 0 and f(text)["reported"] == 0, text
    assert f("I don’t idiot")["negated"] > 0 and f("I don't, idiot")["plain"] > 0
    assert f("not an idiot, idiot")["clauses"] == f("idiot. idiot")["clauses"] > f("idiot idiot")["clauses"]
    assert f("you idiot")["best"] > f("idiot")["best"] > f("no idiot")["best"]


def test_composition_equals_the_transducers_one_after_another():
    rng, parts = random.Random(4), [toxicity.negation(), toxicity.report(), toxicity.target()]
    for _ in range(300):
        line = [rng.choice(toxicity.SYMBOLS) for _ in range(rng.randint(0, 60))]
        want = line
        for part in parts:
            state, out = 0, []
            for symbol in want:
                state, written = part.step(state, symbol)
                out.append(written)
            want = out
        state, got = 0, []
        for symbol in line:
            got.append(toxicity.WRITE[state][symbol])
            state = toxicity.NEXT[state][symbol]
        assert got == want


def test_sample_takes_one_text_of_each_id(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(500)] + [(9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    texts, sizes = toxicity.sample(docs, labels)
    assert texts.count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(5)) and sum(sizes.values()) <= 10


def test_near_duplicates_against_all_pairs(spark, docs, none):
    base = prose(200, 21).split()
    texts = list(TEXTS)
    for k in range(25):
        words = list(base)
        for at in random.Random(k).sample(range(200), k % 4):
            words[at] = f"edit{k}{at}"
        texts.append(" ".join(words))
    table = spark.createDataFrame([(i, t, None, None, None, None) for i, t in enumerate(texts)], DOCS)
    counts, n = weighted_minhash.document_frequencies(table)
    idf = weighted_minhash.inverse_frequency(counts, n)
    bags = []
    for t in texts:
        data = np.frombuffer(raw(t), np.uint8)
        _, s, c = weighted_minhash.shingles(data, np.array([0, len(data)]))
        bags.append(dict(zip(s.tolist(), weighted_minhash.weights(s, c, idf).tolist(), strict=True)))
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, a in enumerate(bags):
        for j, b in enumerate(bags[:i]):
            same = raw(texts[i]) == raw(texts[j])
            common = sum(min(w, b[s]) for s, w in a.items() if s in b)
            if same or a and common >= 0.8 * (sum(a.values()) + sum(b.values()) - common):
                up[max(root(i), root(j))] = min(root(i), root(j))
    got = {r["doc_id"]: r for r in rows(weighted_minhash.near_duplicates(table))}
    assert {i: r["class_id"] for i, r in got.items()} == {i: root(i) for i in range(len(texts))}
    assert {i for i, r in got.items() if r["is_kept"]} == {root(i) for i in range(len(texts))}
    assert rows(weighted_minhash.near_duplicates(none)) == []
    kept = rows(weighted_minhash.keep_one(docs))
    assert len({raw(r["text"]) for r in kept}) == len(kept) and set(kept[0]) == set(DOCS.names)


@pytest.mark.parametrize("members", [1024, 16])
def test_near_copies_linked_only_through_their_original(spark, monkeypatch, members):
    monkeypatch.setattr(weighted_minhash, "BLOCK_MEMBERS", members)
    base = prose(300, 5).split()
    texts = [" ".join(base)]
    for k in range(80):
        words = list(base)
        for at in range(3 + k % 60, 300, 60):
            words[at] = f"edit{k}x{at}"
        texts.append(" ".join(words))
    table = spark.createDataFrame([(i, t, None, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = rows(weighted_minhash.near_duplicates(table))
    assert len(got) == len(texts) and {r["class_id"] for r in got} == {0}
    assert [r["doc_id"] for r in got if r["is_kept"]] == [0]


def test_overlaps_are_sums_of_least_weights():
    texts = pa.array([raw(" ".join(random.Random(k).choices(["a", "b", "c"], k=60 * k))) for k in range(6)], pa.large_binary())
    idf = 1 + np.random.default_rng(3).random(1 << weighted_minhash.BUCKET_BITS)
    bags = []
    for t in texts:
        data = np.frombuffer(t.as_py(), np.uint8)
        _, s, c = weighted_minhash.shingles(data, np.array([0, len(data)]))
        bags.append(dict(zip(s.tolist(), weighted_minhash.weights(s, c, idf).tolist(), strict=True)))
    common, total = weighted_minhash.overlaps(texts, np.arange(2), np.arange(2, 6), idf)
    assert np.allclose(total, [sum(b.values()) for b in bags])
    assert np.allclose(common, [[sum(min(w, bags[j].get(s, 0)) for s, w in bags[i].items()) for j in range(2, 6)] for i in range(2)])


def test_token_counts_against_longest_match(docs, none):
    for tokens in (token_counts.byte_vocabulary(tokenizer_path("byte_bpe_50k.json")), [b" a", b" alp", b"ha", b"l", b"pha", b" ", b"be", b"ta"]):
        vocabulary, longest = set(tokens), max(map(len, tokens))

        def brute(word):
            at, n = 0, 0
            while at < len(word):
                size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary), 0)  # noqa: B023
                if not size:
                    return 1
                at, n = at + size, n + 1
            return n
        got = rows(token_counts.count_tokens(docs.withColumn("again", F.col("text")), tokens))
        for r in got:
            each = [brute(b" " + w) for w in raw(r["again"]).split()]
            assert (r["n_words"], r["n_tokens"], r["longest_word"]) == (len(each), sum(each), max(each, default=0))
    assert rows(token_counts.count_tokens(none, [b"a"])) == []


def test_warc_round_trip(spark):
    page = "<html><head><title>A &amp; B</title></head><!-- <a href='no'> --><body><script>x</script><p>One<br>two &lt; 3</p><a href='/l'>link</a></body>"
    pages = spark.createDataFrame([(1, "http://a/", page), (2, None, None), (1, "http://a/", page), (3, "u", "<p>" + "long " * 20000)],
                                  "page_id long, url string, html string")
    made = rows(warc.serialised(warc.derivatives(warc.responses_of(pages))))
    assert len(made) == 8
    for r in made:
        (headers, content), = warc.parse(bytes(r["record"]))
        named = dict(headers)
        assert named["WARC-Refers-To"] == r["refers_to"] and content == bytes(r["content"])
        assert named["WARC-Block-Digest"] == warc.digest(content)
    first = [r for r in made if r["page_id"] == 1]
    assert {bytes(r["content"]).decode() for r in first if r["record_type"] == "conversion"} == {"One\ntwo < 3\nlink"}
    assert "title: A & B" in bytes(next(r["content"] for r in first if r["record_type"] == "metadata")).decode()
    assert len({r["record_id"] for r in first}) == 2 and len({r["refers_to"] for r in first}) == 1
    assert first[0]["source_payload_digest"] == warc.digest(page.encode())


def test_contamination_against_brute_force(spark, docs, none):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: words.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(1, SHARED), (2, "one two"), (10, "one"), (2, "one two"), (None, "three"), (5, None), (6, "..."), (9, prose(14, 1))]
    table = spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontaminate.AUTOMATON_BYTES, 2000):
        found = decontaminate.find_contamination(docs, table, automaton_bytes=limit)
        for r in rows(found.withColumn("n_hit", F.size("hit_words"))):
            w, hit, ids = lower(r["text"]), set(), set()
            for item, text in items:
                q = lower(text)
                for k in range(max(1, len(q) - 12) if q else 0):
                    window = q[k : k + 13]
                    for at in range(len(w) - len(window) + 1):
                        if w[at : at + len(window)] == window:
                            hit.update(range(at, at + len(window)))
                            ids.update(() if item is None else (str(item),))
            assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(ids))
            covered = sum(len(lower(raw(r["text"])[s["start"] : s["end"]].decode())) for s in r["spans"])
            assert covered == len(hit)
    assert rows(decontaminate.find_contamination(none, table)) == []
    assert {r["n_hit"] for r in rows(decontaminate.digest(decontaminate.find_contamination(docs, table.limit(0))))} == {0}


def test_quality_measures_against_brute_force(docs, none):
    got = rows(quality.judge(docs.withColumn("again", F.col("text"))))
    assert len(got) == len(ROWS)
    for r in got:
        text = r["again"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert [r[m] for m in quality.MEASURES[:5]] == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
                                                       len(lines) - len(set(lines)), len(hit)]
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert rows(quality.judge(none)) == []


def test_votes_find_the_better_rules():
    rng = np.random.default_rng(3)
    good = rng.random(4000) < 0.7
    right = np.array([0.95, 0.9, 0.6, 0.8])
    votes = np.where(rng.random((4000, 4)) < 0.2, -1, np.where(rng.random((4000, 4)) < right, good[:, None], ~good[:, None]))
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, accuracy, share = quality.fit_votes(patterns, counts.astype(float))
    assert ((p[at.ravel()] >= 0.5) == good).mean() > 0.93
    assert accuracy[0][0] > accuracy[0][2] and abs(share - 0.7) < 0.05


def test_sentence_spans(spark, docs, none):
    passage = " ".join(f"The {w} ran over the {w} hill at night." for w in ["red", "blue", "old", "new", "wet", "dry", "big"])
    table = spark.createDataFrame([(i, f"Start of {i} is here. {passage} The end of {i}.") for i in range(4)] + [(9, None), (8, "Short.")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(sentence_spans.remove_repeats(table))}
    assert got[0]["kept_text"] == got[0]["text"] and got[9]["kept_text"] is None and got[8]["kept_text"] == "Short."
    assert all(got[i]["kept_text"] == f"Start of {i} is here. The end of {i}." for i in (1, 2, 3))
    odd = rows(sentence_spans.remove_repeats(docs))
    assert len(odd) == len(ROWS)
    copies = [r for r in odd if r["text"] == prose(40, 1)]
    assert sorted(r["n_removed"] > 0 for r in copies) == [False, True]
    assert rows(sentence_spans.remove_repeats(none)) == []


def spans_removed(texts):
    """The words of each text, and whether each is removed, by sentence_spans' own sentences and runs."""
    seen, out = set(), []
    for text in texts:
        data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
        first, after, doc, start, words = sentence_spans.sentences(data, offsets)
        opens, stop, run = sentence_spans.runs(first, after, doc, words)
        mark = np.zeros(len(words), bool)
        for a, b, h in zip(opens, stop, run.tolist()):
            mark[first[a] : after[b - 1]] |= h in seen
        seen.update(run.tolist())
        out.append((start, mark))
    return out


@pytest.mark.parametrize("offset", range(16))
def test_passages_in_long_sentences_are_found_at_every_offset(offset):
    rng = random.Random(offset)
    names = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(names, k=70))
    for stop in ("", "."):  # within one sentence; as its opening words
        one = " ".join(rng.choices(names, k=160)) + " " + passage + " " + " ".join(rng.choices(names, k=50))
        head = " ".join(rng.choices(names, k=160 + offset)) + stop + " "
        two = head + passage + " " + " ".join(rng.choices(names, k=50))
        (_, _), (start, mark) = spans_removed([one, two])
        inside = (start >= len(head)) & (start < len(head + passage))
        # Brute force: the only words of a common stretch of over 20 words are the passage's; at most 2 windows are lost at an edge.
        lost = np.flatnonzero(~mark[inside])
        assert not mark[~inside].any()
        assert all(i < 2 * sentence_spans.CUT_WINDOW or i >= 70 - 2 * sentence_spans.CUT_WINDOW - 20 for i in lost) and mark[inside].any()


def test_sentences_end_at_the_stops_of_other_scripts():
    def cut(text):
        data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
        first, after, _, start, _ = sentence_spans.sentences(data, offsets)
        edges = [*(start[first]).tolist(), len(data)]
        return [data[a:b].tobytes().decode() for a, b in zip(edges, edges[1:])], (after - first).tolist()

    assert cut("वह घर गया। वह आया॥ फिर") == (["वह घर गया। ", "वह आया॥ ", "फिर"], [3, 2, 1])
    assert cut("我们去。你好吗？abc好！x") == (["我们去。", "你好吗？", "abc好！", "x"], [3, 3, 2, 1])
    assert cut("هل؟ نعم۔ one") == (["هل؟ ", "نعم۔ ", "one"], [1, 1, 1])


def test_repeated_passage_without_blanks(spark):
    passage = "今天天气很好我们去公园。孩子们在湖边放风筝。晚上大家一起吃饭！后来他们都回家了。"
    table = [(i, f"第{i}篇文章开头。{passage}第{i}篇文章完。") for i in range(3)]
    got = {r["doc_id"]: r["kept_text"] for r in rows(sentence_spans.remove_repeats(spark.createDataFrame(table, "doc_id long, text string")))}
    assert got[0] == table[0][1] and all(got[i] == f"第{i}篇文章开头。第{i}篇文章完。" for i in (1, 2))


def removed_by_all_runs(texts):
    """Brute force over every run of at least SENTENCES sentences and WORDS words: the removed sentences of each text."""
    cut = [[re.findall(r"\w+", s.lower()) for s in re.findall(r"[^.]+\.", t)] for t in texts]
    seen, gone = set(), [set() for _ in texts]
    for t, sentences in enumerate(cut):
        for a in range(len(sentences)):
            for b in range(a + sentence_spans.SENTENCES, len(sentences) + 1):
                run = tuple(w for s in sentences[a:b] for w in s)
                if len(run) >= sentence_spans.WORDS:
                    if run in seen:
                        gone[t].update(range(a, b))
                    seen.add(run)
    return gone


def test_uneven_repeats_are_removed_to_their_end_as_by_all_runs(spark):
    rng = random.Random(8)

    def uneven(lengths):
        return [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) + ". " for n in lengths]

    tail = uneven([16, 1, 3, 1])
    texts = ["".join(tail), "".join(uneven([2]) + tail), "".join(tail + uneven([9, 9, 9]))]
    for _ in range(40):
        passage = uneven(rng.choices([1, 1, 2, 3, 5, 9, 16], k=rng.randrange(3, 9)))
        texts += ["".join(uneven(rng.choices([1, 2, 12], k=2)) + passage + uneven(rng.choices([1, 3, 12], k=rng.randrange(3)))) for _ in range(3)]
    got = {r["doc_id"]: r for r in rows(sentence_spans.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)))}
    for i, gone in enumerate(removed_by_all_runs(texts)):
        sentences = re.findall(r"[^.]+\. ?", texts[i])
        assert got[i]["kept_text"] == "".join(s for k, s in enumerate(sentences) if k not in gone)
        assert (got[i]["n_sentences"], got[i]["n_removed"]) == (len(sentences), len(gone))


def test_shards_are_gapless_and_grow_into_the_new_one(docs, none):
    got = rows(sharding.shard(docs, bucket_bytes=3000))
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter((r[0], r[1]) for r in ROWS)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len(raw(r["text"])) + 1 and r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1
    assert sorted(sharding.fisher_yates(100, [1])) == list(range(100))
    assert rows(sharding.shard(none)) == []


def test_packing_holds_all_ids_once(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = rows(packing.pack(docs, tokenizer_path()))
    made = collections.defaultdict(list)
    for r in got:
        made[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for places in made.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 2048
    texts = collections.Counter(np.frombuffer(b"".join(bytes(r["ids"]) for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])), "<u4").tobytes()
                                for i in range(len(TEXTS)) if i != 7)
    assert texts == collections.Counter(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
                                        for i, t in enumerate(TEXTS) if i != 7)
    assert rows(packing.pack(none, tokenizer_path())) == []


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_is_near_the_bound(seed):
    rng = random.Random(seed)
    histogram = collections.Counter(min(2048, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(6000))
    kinds = packing.plan(dict(histogram))
    placed = collections.Counter()
    for number, content in kinds:
        assert number > 0 and sum(n * c for n, c in content) <= 2048
        for n, c in content:
            placed[n] += number * c
    assert placed == histogram
    assert sum(n for n, _ in kinds) <= 1.02 * sum(n * c for n, c in histogram.items()) / 2048 + 1


def test_repeated_substrings_against_brute_force(docs, none):
    got = rows(suffix_dedup.remove_substrings(docs))
    texts = [raw(r[1]) for r in ROWS]
    seen = collections.Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))

    def cut(t):
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = 1
        return bytes(b for b, g in zip(t, gone, strict=False) if not g), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum())
    assert len(got) == len(ROWS)
    for r in got:
        kept, removed, spans = cut(raw(r["text"]))
        assert (bytes(r["kept"]), r["n_removed"], len(r["spans"])) == (kept, removed, spans)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest() and r["n_bytes"] == len(raw(r["text"]))
        assert r["kept_text"] == kept.decode(errors="ignore")
    assert rows(suffix_dedup.remove_substrings(none)) == []


def test_pipeline_stages_follow_their_rules(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "repeated_substrings", "decontamination", "packing"]
    before = {r["doc_id"]: r for r in rows(docs)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        after = {r["doc_id"]: r for r in rows(docs)}
        assert set(after) <= set(before) and len(after) == docs.count()
        if name == "near_duplicates":
            assert len({r["text"] for r in after.values()}) == len(after)
        if name == "repeated_substrings":
            assert set(after) == set(before)
        before = after
    packed = rows(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir))
    assert {r["doc_id"] for r in packed} == set(before)


def without_toxic(spark, docs, texts, sf_dir):
    grammar = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return {i: t for i, t in texts.items() if grammar.score(np.array([grammar.features(t or "")]))[0] < 0.5}


def one_of_each_class(spark, docs, texts, sf_dir):
    idf = weighted_minhash.inverse_frequency(*weighted_minhash.document_frequencies(docs))
    bags, up = {}, {i: i for i in texts}
    for i, t in texts.items():
        data = np.frombuffer(raw(t), np.uint8)
        _, s, c = weighted_minhash.shingles(data, np.array([0, len(data)]))
        bags[i] = dict(zip(s.tolist(), weighted_minhash.weights(s, c, idf).tolist(), strict=True))
    total = {i: sum(b.values()) for i, b in bags.items()}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    order = sorted(bags)
    for k, i in enumerate(order):
        for j in order[:k]:
            common = sum(min(bags[i][s], bags[j][s]) for s in bags[i].keys() & bags[j].keys())
            if raw(texts[i]) == raw(texts[j]) or bags[i] and common >= 0.8 * (total[i] + total[j] - common):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: t for i, t in texts.items() if root(i) == i}


def without_repeated_bytes(spark, docs, texts, sf_dir):
    seen = collections.Counter(raw(t)[k : k + 200] for t in texts.values() for k in range(len(raw(t)) - 199))
    out = {}
    for i, t in texts.items():
        data, gone = raw(t), np.zeros(len(raw(t)), bool)
        for k in range(len(data) - 199):
            if seen[data[k : k + 200]] > 1:
                gone[k : k + 200] = True
        out[i] = None if t is None else bytes(b for b, g in zip(data, gone, strict=True) if not g).decode(errors="ignore")
    return out


def without_contaminated(spark, docs, texts, sf_dir):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: words.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(q[k : k + 13]) for r in rows(spark.read.parquet(f"{sf_dir}/benchmark.parquet")) if (q := lower(r["text"]))
               for k in range(max(1, len(q) - 12))}
    out = {}
    for i, t in texts.items():
        w, hit = lower(t), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in windows:
                    hit.update(range(at, at + n))
        if not hit or 20 * len(hit) < len(w):
            out[i] = t
    return out


def test_pipeline_stages_give_the_rows_of_plain_python(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs, left = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    before = rows(docs)
    for (name, stage), rule in zip(corpus_pipeline.STAGES, [without_toxic, one_of_each_class, without_repeated_bytes, without_contaminated]):
        want = rule(spark, docs, {r["doc_id"]: r["text"] for r in rows(docs)}, sf_dir)
        out = stage(spark, docs, sf_dir).collect()
        assert {r["doc_id"]: r["text"] for r in out} == want and len(out) == len(want), name
        left.append(len(out))
        docs = spark.createDataFrame(out, docs.schema)
    assert 0 < left[-1] < left[1] < left[0] < len(before)
