"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon maps words to symbols: insult, threat, target, negation, reported speech; commas and colons, quotation marks,
sentence ends and line ends have symbols of their own. Three small transducers rewrite the symbols one after another:
negation marks an insult or threat shortly after a negator, report marks one in the rest of the sentence after a verb of
speech and, if a quotation opens there, up to its end, target joins it with a person addressed in the clause. Their
composition is one table from (state, symbol) to (state, kind of hit). A clause with hits is matched and gets a score from
their weights and marks; a logistic curve over the clause scores of a document gives a probability.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows of each class that the lexicon and the curve are fitted on, at most.
SAMPLE_ROWS = 6000
#: Entries of the learned lexicon, at most.
LEXICON_ENTRIES = 4096
#: Words after a negator that it reaches.
NEGATION_REACH = 2
#: Lengths of the word beginnings that may be entries, since many languages inflect and compound at the end.
STEMS = (4, 5, 6)

# Words of the grammar in English, German, French and Spanish.
INSULTS = """asshole bastard clown coward cretin degenerate disgusting dumb dumbass filth fool freak garbage idiot
imbecile jerk loser maggot moron parasite pathetic pig retard scum stupid subhuman trash vermin worthless
abschaum arschloch bastard depp dummkopf dreck idiot schwein trottel versager widerlich
abruti bouffon connard crétin débile imbécile minable ordure pourriture salaud
basura cabrón escoria estúpido gilipollas idiota imbécil inútil mierda tonto""".split()
THREATS = """kill hurt destroy murder beat shoot stab burn strangle
töten umbringen erschießen vernichten tuer frapper détruire brûler matar golpear destruir quemar""".split()
TARGETS = """you your yours he she they them u du dich dir dein euch ihr ihn tu te toi ton vous ils elles
tú ti usted ustedes vosotros ellos ellas""".split()
NEGATORS = "not no never nobody isn't aren't don't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún".split()
SPEECH = """said says say called calls wrote writes claimed quoted sagte sagt nannte schrieb behauptete
dit appelé écrit affirmé dijo dice llamó escribió afirmó""".split()

SYMBOLS = OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, PAUSE, QUOTE, END, LINE = range(10)
#: What a transducer may make of an insult or threat.
NEGATED, REPORTED, AIMED = 16, 32, 64
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.,;:!?\n\"«»„“”]")
#: Symbols of the marks between words; the first three kinds close a clause.
MARKS = {**dict.fromkeys(",;:", PAUSE), **dict.fromkeys(".!?", END), "\n": LINE, **dict.fromkeys('"«»„“”', QUOTE)}
CLOSING = (PAUSE, END, LINE)
#: What a hit's marks make of its weight.
WEAKER, AIMED_MORE = 0.5, 1.5
#: Features of a document: scores of its matched clauses summed by kind, the best one, and how many there are.
FEATURES = ("plain", "negated", "reported", "aimed", "threat", "best", "clauses")


@dataclass
class Transducer:
    """Letter-to-letter: arcs[state][symbol] = (next state, symbol written); missing arcs copy and stay."""

    arcs: dict[tuple[int, int], tuple[int, int]]
    states: int

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs.get((state, symbol), (state, symbol))


def is_hit(symbol: int) -> bool:
    return symbol & 15 in (INSULT, THREAT)


def negation(reach: int = NEGATION_REACH) -> Transducer:
    """State n: words the last negator still reaches."""
    arcs = {}
    for state in range(reach + 1):
        for symbol in (OTHER, INSULT, THREAT, TARGET, REPORT):
            arcs[state, symbol] = (max(0, state - 1), symbol | NEGATED if state and is_hit(symbol) else symbol)
        arcs[state, NEGATION] = (reach, NEGATION)
        for symbol in CLOSING:
            arcs[state, symbol] = (0, symbol)
    return Transducer(arcs, reach + 1)


def report() -> Transducer:
    """State 1: a verb of speech stood before in the sentence. State 2: in the quotation that opened after it."""
    arcs = {(0, REPORT): (1, REPORT), (1, QUOTE): (2, QUOTE), (2, QUOTE): (0, QUOTE), (1, END): (0, END), (1, LINE): (0, LINE), (2, LINE): (0, LINE)}
    for symbol in (INSULT, THREAT, INSULT | NEGATED, THREAT | NEGATED):
        arcs[1, symbol] = (1, symbol | REPORTED)
        arcs[2, symbol] = (2, symbol | REPORTED)
    return Transducer(arcs, 3)


def target() -> Transducer:
    """State 1: a person was addressed before in the clause."""
    arcs = {(0, TARGET): (1, TARGET), **{(1, symbol): (0, symbol) for symbol in CLOSING}}
    for hit in (INSULT, THREAT):
        for marks in (0, NEGATED, REPORTED, NEGATED | REPORTED):
            arcs[1, hit | marks] = (1, hit | marks | AIMED)
    return Transducer(arcs, 2)


def compose(*parts: Transducer) -> tuple[list[list[int]], list[list[int]]]:
    """Next state and symbol written of the composition, over the lexicon's symbols; only reached states are made."""
    start = (0,) * len(parts)
    number, todo = {start: 0}, [start]
    nexts: list[list[int]] = []
    writes: list[list[int]] = []
    for states in todo:
        next_row, write_row = [], []
        for symbol in SYMBOLS:
            moved, written = [], symbol
            for part, state in zip(parts, states, strict=True):
                state, written = part.step(state, written)
                moved.append(state)
            key = tuple(moved)
            if key not in number:
                number[key] = len(number)
                todo.append(key)
            next_row.append(number[key])
            write_row.append(written)
        nexts.append(next_row)
        writes.append(write_row)
    return nexts, writes


NEXT, WRITE = compose(negation(), report(), target())


@dataclass
class Grammar:
    """Lexicon weights, and the curve over FEATURES."""

    words: dict[str, tuple[int, float]]
    stems: dict[str, float]
    coefficients: list[float]
    intercept: float
    memory: dict[str, tuple[int, float] | None] = field(default_factory=dict)

    def look_up(self, word: str) -> tuple[int, float] | None:
        if word in self.words:
            return self.words[word]
        best = max((self.stems[word[:n]] for n in STEMS if len(word) > n and word[:n] in self.stems), default=None)
        return None if best is None else (INSULT, best)

    def features(self, text: str) -> list[float]:
        """The scores of one text's matched clauses, as logarithms of FEATURES.

        A clause counts as negated or reported if all its hits are, else as plain; as aimed or threat if any hit is.
        """
        memory, tokens = self.memory, _TOKEN.findall(text.lower().replace("\u2019", "'"))
        for token in set(tokens).difference(memory):
            memory[token] = (MARKS[token], 0.0) if token in MARKS else self.look_up(token)
        found = [memory[t] for t in tokens]
        out = [0.0] * len(FEATURES)
        if len(memory) > 400_000:
            memory.clear()
        if not any(x is not None and is_hit(x[0]) for x in found):
            return out
        state, clause, common, some = 0, 0.0, NEGATED | REPORTED, 0
        for x in (*found, (END, 0.0)):
            symbol, weight = (OTHER, 0.0) if x is None else x
            written, state = WRITE[state][symbol], NEXT[state][symbol]
            if is_hit(written):
                clause += weight * (WEAKER if written & (NEGATED | REPORTED) else 1.0) * (AIMED_MORE if written & AIMED else 1.0)
                common, some = common & written, some | written & AIMED | (1 if written & 15 == THREAT else 2)
            elif symbol in CLOSING and some:
                out[1 if common & NEGATED else 2 if common & REPORTED else 0] += clause
                out[3] += clause if some & AIMED else 0.0
                out[4] += clause if some & 1 else 0.0
                out[5] = max(out[5], clause)
                out[6] += 1
                clause, common, some = 0.0, NEGATED | REPORTED, 0
        return [math.log1p(v) for v in out]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.coefficients) + self.intercept, -30, 30)))


def fixed_words() -> dict[str, tuple[int, float]]:
    out: dict[str, tuple[int, float]] = {}
    for words, symbol, weight in ((SPEECH, REPORT, 0.0), (NEGATORS, NEGATION, 0.0), (TARGETS, TARGET, 0.0),
                                  (THREATS, THREAT, 0.5), (INSULTS, INSULT, 1.0)):
        out.update({w: (symbol, weight) for w in words})
    return out


def entries(text: str) -> set[str]:
    """Words of a text, and word beginnings ending in a star, that may become lexicon entries."""
    words = {t for t in _TOKEN.findall(text.lower().replace("\u2019", "'")) if len(t) > 1}
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


def held_out(doc_id):
    """Documents whose labels are never learned from; a null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """Labelled texts to learn from, at most ``most`` of each class chosen by a hash of the id; class sizes."""
    known = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * most ids
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    # one text for each id, however often it is repeated: what the driver sees is bounded by rows, and sizes count ids
    one = texts.join(ids, "doc_id").groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("toxic").alias("toxic"))
    return one.select("text", "toxic"), sizes


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS, lexicon: int = LEXICON_ENTRIES) -> Grammar:
    """Fit the lexicon's weights and the curve on labelled documents outside the held-out fifth.

    An entry joins the lexicon when toxic texts hold it significantly more often: its likelihood ratio must beat
    twice the logarithm of the number of entries tried. Without labels of both classes the fixed words decide.
    Only counts of entries and one short row for each sampled text reach the driver, both bounded by parameters.
    """
    words = fixed_words()
    grammar = Grammar(words, {}, [0.0, 0.0, 0.0, 0.0, 0.0, 3.0, 0.0], -2.0)
    texts, sizes = sample(docs, labels, most)
    used = {y: min(sizes.get(y, 0), most) for y in (0, 1)}
    if not all(used.values()):
        return grammar

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for entry in entries(text):
                    counts.setdefault(entry, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts, pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()),
                 pa.array([c[1] for c in counts.values()], pa.int64())], names=["entry", "clean", "toxic"])

    counted = (texts.mapInArrow(count, "entry string, clean long, toxic long").groupBy("entry")
               .agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")))
    n, m = F.lit(float(used[0])), F.lit(float(used[1]))
    expected = (F.col("c") + F.col("t")) * m / (n + m)
    other = F.col("c") + F.col("t") - expected
    ratio = 2 * (F.col("t") * F.log(F.col("t") / expected)
                 + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / other)).otherwise(0.0))
    odds = F.log((F.col("t") + 0.5) / m) - F.log((F.col("c") + 0.5) / n)
    tested = counted.agg(F.count("*").alias("n")).first()["n"]
    found = (counted.where((F.col("t") >= 3) & (F.col("t") > expected))
             .select("entry", ratio.alias("ratio"), odds.alias("odds"))
             .where((F.col("ratio") > 2 * math.log(max(tested, 2))) & (F.col("odds") > 2.0))
             .orderBy(F.desc("ratio"), "entry").limit(lexicon).collect())
    for r in found:
        if r["entry"].endswith("*"):
            grammar.stems[r["entry"][:-1]] = r["odds"]
        elif r["entry"] not in words or words[r["entry"]][0] in (INSULT, THREAT):
            words[r["entry"]] = (words.get(r["entry"], (INSULT, 0))[0], r["odds"])
    rows = np.array(texts.mapInArrow(featurise(grammar, ["toxic"]), _feature_schema("toxic int"))
                    .select("toxic", *FEATURES).collect(), float)
    if not len(rows):
        return grammar
    share = np.array([sizes[0] / max(1, (rows[:, 0] == 0).sum()), sizes[1] / max(1, (rows[:, 0] == 1).sum())])
    grammar.coefficients, grammar.intercept = logistic(rows[:, 1:], rows[:, 0], share[rows[:, 0].astype(int)])
    return grammar


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[list[float], float]:
    """Weighted ridge logistic regression by Newton steps."""
    x1 = np.column_stack([x, np.ones(len(x))])
    weight = weight / weight.mean()
    penalty = ridge * np.eye(x1.shape[1])
    penalty[-1, -1] = 1e-6
    beta = np.zeros(x1.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        step = np.linalg.solve((x1 * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x1 + penalty,
                               x1.T @ (weight * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta[:-1].tolist(), float(beta[-1])


def _feature_schema(before: str) -> str:
    return f"{before}, " + ", ".join(f"{f} double" for f in FEATURES) + ", score double"


#: The grammar that a worker keeps between tasks, with its memory of words, under the name of its scan.
_kept: dict[str, Grammar] = {}


def featurise(grammar: Grammar, carry: list[str]):
    """A function over batches: the carried columns, FEATURES and score of each text."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _kept:
            _kept.clear()
            _kept[key] = grammar
        mine = _kept[key]
        for batch in batches:
            x = np.array([mine.features(t.as_py() or "") for t in batch.column("text")], float)
            x = x.reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carry), *(pa.array(x[:, i]) for i in range(x.shape[1])),
                 pa.array(mine.score(x))], names=[*carry, *FEATURES, "score"])

    return run


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``docs`` with FEATURES and ``score`` (0 to 1) after its columns, replacing columns of these names.

    Only the text decides. Null, empty and clause-less texts have no hits and score as the curve does at zero.
    Very long texts are scanned whole; repeated rows score alike. Nothing is shuffled. The grammar sent to the
    tasks is bounded by the size of its lexicon.
    """
    plain = docs.drop(*FEATURES, "score")
    schema = T.StructType([*plain.schema, *(T.StructField(f, T.DoubleType()) for f in (*FEATURES, "score"))])
    return plain.withColumn("text", F.col("text").cast("string")).mapInArrow(featurise(grammar, plain.columns), schema)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """Learn from ``labels`` (doc_id, toxic), score every document, and judge it: ``held_out``, ``predicted``.

    Null and empty texts have no clause and score as the curve does at zero; a null id is never held out; repeated rows are
    judged alike; an empty table gives no rows; columns of the added names are replaced. At most ``most`` labelled rows of
    each class are learned from, one text for each id.
    """
    scored = score(docs, learn(docs, labels, most))
    return scored.withColumns({"held_out": held_out(F.col("doc_id")),
                               "predicted": (F.col("score") >= 0.5).cast("int")})


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
