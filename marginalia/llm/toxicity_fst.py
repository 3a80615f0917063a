"""Toxicity by composed weighted finite-state transducers over clauses.

A lexicon rewrites each word to a class: insult, threat, target, negation, report, or other. The class string of a clause then runs
through a cascade of five transducers, each of which reads what the one before has written:

* negation marks insults and threats that follow within a few words as denied; a second negation in its scope takes it back;
* reported speech marks what it introduces, up to the clause's end, as quoted;
* target marks insults and threats near a target as aimed, and writes a pointing mark where a target follows an insult;
* insult turns marked insults into the output symbols plain, denied, quoted and aimed, and raises the weight of insults that pile up;
* threat turns marked threats into threatening, if aimed, and else into a plain symbol of little weight.

``compose`` builds the one deterministic machine of the whole cascade, over the product of the states that can be reached, so a clause costs
one step a word. Only clauses with an insult or threat are run; all others weigh nothing. What each output symbol is worth is learnt: a
document is the weight of its symbols (insults count by the lexicon's weight, times the machine's), and a logistic
regression, held to prior values by a ridge, gives each symbol its part in the score. So a negation counts for as much as the labelled rows
say.

The lexicon is learnt too, from *all* labelled training documents: insults are whole words and word beginnings whose share among toxic
documents is far above their share among the others; negations and targets are words that stand shortly before insults where
documents are significantly more seldom, or more often, toxic. Short fixed lists in four languages open every class. Its three settings
(support, ratio, share) are picked from a grid by two-fold cross-validation within the training rows.

Defined cases: null and empty texts, and texts without a matched clause, have the score of no evidence, which is below 0.5. A very long text
is read whole. Without labelled rows only the fixed words count, with the prior values; ties between settings go to the first of the
grid. Every input row gives one output row, copies included; only the id and text columns are read to score. An empty table gives
an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, held_out, least_hashed, map_batches, materialize, record_batch

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, POINT = range(7)
CLASSES = 6  # what the lexicon writes
DENIED, QUOTED, AIMED = 8, 16, 32  # marks on insults and threats
#: what the cascade writes in the end
SYMBOLS = ("plain", "denied", "quoted", "aimed", "threatening")
PLAIN_OUT, DENIED_OUT, QUOTED_OUT, AIMED_OUT, THREATENING_OUT = range(5)

# Words that open the classes, in English, German, French and Spanish.
SEED_WORDS = {
    INSULT: "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns "
    "trottel dummkopf abschaum versager imbécile crétin abruti minable idiota imbécil estúpido inútil",
    THREAT: "kill hurt destroy beat shoot stab töten umbringen schlagen erschießen tuer frapper poignarder matar golpear apuñalar",
    TARGET: "you your youre u he she they him her them his their du dich dir dein ihr euch tu toi te ton vous votre tú ti tus usted ustedes",
    NEGATION: "not no never nobody isnt arent wasnt dont doesnt didnt without nicht kein keine nie niemals ohne ne pas jamais sans nunca jamás sin",
    REPORT: "said says say wrote writes called calls quoted quote claimed claims reported reports sagte schrieb nannte dit écrit appelle dijo escribió llamó",
}

CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6, 7, 8)
BROADCAST_ROWS = 2_000_000


@dataclass
class Lexicon:
    """Words, and beginnings of words, with their class and weight."""

    words: dict[str, tuple[int, float]] = field(default_factory=dict)
    stems: dict[str, tuple[int, float]] = field(default_factory=dict)

    @classmethod
    def fixed(cls) -> Lexicon:
        return cls({w: (kind, 2.0 if kind in (INSULT, THREAT) else 0.0) for kind, ws in SEED_WORDS.items() for w in ws.split()})

    def classify(self, word: str) -> tuple[int, float]:
        found = self.words.get(word)
        if found is None:
            for n in STEMS:
                found = self.stems.get(word[:n]) if len(word) >= n else None
                if found is not None:
                    return found
        return found or (OTHER, 0.0)


#: (state, symbol) -> (next state, symbol written, factor on the word's weight). The start state is that of ``compose``.
Transducer = Callable[[tuple, int], tuple[tuple, int, float]]


def _hot(symbol: int) -> bool:
    return symbol & 7 in (INSULT, THREAT)


def negation(reach: int = 3) -> Transducer:
    """State: words that the scope still reaches, and whether it denies."""

    def step(state: tuple, symbol: int) -> tuple[tuple, int, float]:
        left, denies = state or (0, False)
        if symbol == NEGATION:
            return (reach, not (left and denies)), OTHER, 1.0
        after = (left - 1, denies) if left > 1 else ()
        return after, symbol | DENIED if _hot(symbol) and left and denies else symbol, 1.0

    return step


def reported_speech() -> Transducer:
    def step(state: tuple, symbol: int) -> tuple[tuple, int, float]:
        if symbol == REPORT:
            return (True,), OTHER, 1.0
        return state, symbol | QUOTED if _hot(symbol) and state else symbol, 1.0

    return step


def target(reach: int = 4, back: int = 2) -> Transducer:
    """State: words that a target still reaches, and words since an insult that a target may still point at."""

    def step(state: tuple, symbol: int) -> tuple[tuple, int, float]:
        left, open_ = state or (0, 0)
        after = max(0, left - 1), max(0, open_ - 1)
        if symbol == TARGET:
            return (reach, 0), POINT if open_ else OTHER, 1.0
        if _hot(symbol):
            return (after[0], 0 if left else back), symbol | AIMED if left else symbol, 1.0
        return after if any(after) else (), symbol, 1.0

    return step


def insult(most: int = 3) -> Transducer:
    """State: insults of the clause so far, up to most."""

    def step(state: tuple, symbol: int) -> tuple[tuple, int, float]:
        if symbol == POINT:
            return state, 64 + AIMED_OUT, 1.0
        if symbol & 7 != INSULT:
            return state, symbol if symbol & 7 == THREAT else OTHER, 1.0
        n = state[0] if state else 0
        kind = DENIED_OUT if symbol & DENIED else QUOTED_OUT if symbol & QUOTED else AIMED_OUT if symbol & AIMED else PLAIN_OUT
        return (min(most, n + 1),), 64 + kind, 1.0 + 0.25 * n

    return step


def threat() -> Transducer:
    def step(state: tuple, symbol: int) -> tuple[tuple, int, float]:
        if symbol >= 64 or symbol & 7 != THREAT:
            return state, symbol, 1.0
        if symbol & (DENIED | QUOTED):
            return state, 64 + (DENIED_OUT if symbol & DENIED else QUOTED_OUT), 1.0
        return state, 64 + (THREATENING_OUT if symbol & AIMED else PLAIN_OUT), 1.0 if symbol & AIMED else 0.1

    return step


Machine = list[list[tuple[int, int, float]]]  # by state and class: next state, output symbol or -1, factor


def cascade(parts: Iterable[Transducer], states: tuple, symbol: int) -> tuple[tuple, int, float]:
    """One step of all parts, each of which reads what the one before writes."""
    after, factor = [], 1.0
    for part, state in zip(parts, states, strict=True):
        state, symbol, f = part(state, symbol)
        after.append(state)
        factor *= f
    return tuple(after), symbol - 64 if symbol >= 64 else -1, factor


def compose(*parts: Transducer) -> Machine:
    """The one machine of the cascade, over the states that can be reached."""
    start = ((),) * len(parts)
    number, order, moves = {start: 0}, [start], []
    for states in order:
        row = []
        for kind in range(CLASSES):
            after, out, factor = cascade(parts, states, kind)
            if after not in number:
                number[after] = len(order)
                order.append(after)
            row.append((number[after], out, factor))
        moves.append(row)
    return moves


GRAMMAR = compose(negation(), reported_speech(), target(), insult(), threat())
#: Isolated words: every insult and threat is plain.
WORDS_ONLY: Machine = [[(0, PLAIN_OUT if kind in (INSULT, THREAT) else -1, 1.0) for kind in range(CLASSES)]]


class Memory:
    """Classes of the words seen so far in a task, dropped when there are too many."""

    def __init__(self, lexicon: Lexicon, most: int = 300_000):
        self.lexicon, self.most = lexicon, most
        self.classes: dict[str, tuple[int, float]] = {}
        self.hot: set[str] = set()

    def see(self, words: list[str]) -> None:
        if len(self.classes) > self.most:
            self.classes, self.hot = {}, set()
        for w in words:
            if w not in self.classes:
                self.classes[w] = kind = self.lexicon.classify(w)
                if kind[0] in (INSULT, THREAT):
                    self.hot.add(w)


def clause_weights(classes: list[tuple[int, float]], grammar: Machine = GRAMMAR) -> list[float]:
    """Weight of each output symbol. A pointing mark has weight 1."""
    state, sums = 0, [0.0] * len(SYMBOLS)
    for kind, weight in classes:
        state, out, factor = grammar[state][kind]
        if out >= 0:
            sums[out] += factor * (weight or 1.0)
    return sums


def clauses(text: str | None, memory: Memory, grammar: Machine = GRAMMAR) -> list[tuple[list[float], int, str]]:
    """(weights of the symbols, words, clause) of every clause with an insult or threat."""
    found = []
    for clause in CLAUSE.split((text or "").lower()):
        words = WORD.findall(clause)
        memory.see(words)
        if not memory.hot.isdisjoint(words):
            found.append((clause_weights([memory.classes[w] for w in words], grammar), len(words), clause))
    return found


# What the symbols are worth before anything is learnt, in log-odds for each unit of log(1 + weight), and the start.
PRIOR = (1.5, 0.2, 0.5, 2.0, 2.0, -1.5)


def features(text: str | None, memory: Memory, grammar: Machine = GRAMMAR) -> list[float]:
    """log(1 + weight) of each symbol over the text's clauses."""
    sums = [0.0] * len(SYMBOLS)
    for weights, _, _ in clauses(text, memory, grammar):
        sums = [a + b for a, b in zip(sums, weights, strict=True)]
    return [math.log1p(s) for s in sums]


def logistic(x: np.ndarray, y: np.ndarray, prior: tuple[float, ...] = PRIOR, ridge: float = 0.5, steps: int = 40) -> np.ndarray:
    """Newton's method with a ridge towards the prior; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    start = np.array(prior)
    w = start.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * (w - start)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(x: Iterable[float], weights: Iterable[float]) -> float:
    *slopes, start = weights
    z = start + sum(a * b for a, b in zip(x, slopes, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


@dataclass
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...] = PRIOR
    settings: tuple[float, float, float] | None = None
    grammar: Machine = field(default_factory=lambda: GRAMMAR)

    def score(self, text: str | None, memory: Memory) -> float:
        return probability(features(text, memory, self.grammar), self.weights)


@dataclass
class Counts:
    """Documents of either class in each fold, in all and by key. A key is a word or, with a star, a beginning of words."""

    size: dict[tuple[int, int], int]  # (toxic, fold)
    toxic: dict[str, tuple[int, int]]
    clean: dict[str, tuple[int, int]]

    def lexicon(self, support: float, ratio: float, share: float, folds: tuple[int, ...] = (0, 1), at_least: int = 5, most: int = 20_000) -> Lexicon:
        """Fixed words, and the keys in at_least toxic documents, and a share of ``support`` of them, whose rate is ``ratio`` times that
        among the others and of whose documents the ``share`` is toxic. A word within a learnt beginning isn't listed again. most
        bounds the model; the strongest entries stay."""
        lexicon = Lexicon.fixed()
        toxic, clean = (sum(self.size.get((y, f), 0) for f in folds) for y in (1, 0))
        learnt = []
        for key, by_fold in self.toxic.items() if toxic else ():
            n1, n0 = sum(by_fold[f] for f in folds), sum(self.clean.get(key, (0, 0))[f] for f in folds)
            if n1 < max(at_least * len(folds) / 2, support * toxic):
                continue
            rate1, rate0 = n1 / toxic, (n0 + 0.5) / (clean + 1)
            if rate1 >= ratio * rate0 and n1 >= share * (n0 + n1):
                learnt.append((-math.log(rate1 / rate0) * math.log1p(n1), key, math.log(rate1 / rate0) / 2))
        learnt = sorted(learnt)[:most]
        for _, key, weight in learnt:
            if key.endswith("*"):
                lexicon.stems[key[:-1]] = (INSULT, weight)
        for _, key, weight in learnt:
            if not key.endswith("*") and lexicon.classify(key)[0] == OTHER:
                lexicon.words[key] = (INSULT, weight)
        return lexicon


def _keys(text: str | None) -> set[str]:
    words = set(WORD.findall((text or "").lower()))
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) >= n}


def count_keys(labelled: DataFrame, support: float, at_least: int = 5) -> Counts:
    """labelled: (text, toxic, fold). Counts all its rows, for the keys that a share of support of the toxic ones hold: at most 1 /
    support times as many as one document has on average."""
    size = {(r["toxic"], r["fold"]): r["count"] for r in labelled.groupBy("toxic", "fold").count().collect()}
    toxic = sum(n for (y, _), n in size.items() if y == 1)
    if not toxic:
        return Counts(size, {}, {})

    def counter(among: frozenset[str] | None):
        def count(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            for text, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _keys(text)
                out[fold].update(own if among is None else own & among)
            keys = [*out[0], *(k for k in out[1] if k not in out[0])]
            return record_batch({"key": (keys, pa.string())} | {f"n{f}": ([out[f][k] for k in keys], pa.int64()) for f in (0, 1)})

        return count

    def counted(y: int, among: frozenset[str] | None) -> DataFrame:
        rows = labelled.filter(F.col("toxic") == y).select("text", "fold")
        each = map_batches(rows, counter(among), "key string, n0 long, n1 long", rows=100_000)
        return each.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    # first the toxic documents, a small part; the keys that many of them hold are then counted among the others
    often = counted(1, None).filter(F.col("n0") + F.col("n1") >= max(at_least, support * toxic)).collect()
    found = {r["key"]: (r["n0"], r["n1"]) for r in often}
    others = {r["key"]: (r["n0"], r["n1"]) for r in counted(0, frozenset(found)).collect()}
    return Counts(size, found, others)


def learn_context(labelled: DataFrame, lexicon: Lexicon, reach: int = 3, support: float = 0.02, surprise: float = 10.8) -> None:
    """Adds to the lexicon the words that stand up to ``reach`` words before insults or threats in documents that are less often toxic
    (negations) or more often (targets) than all documents with an insult or threat, by a likelihood ratio test.

    Counts all rows of labelled; words in fewer than 20 or a share of support of the matched documents are left out, which bounds
    what is collected."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        memory = Memory(lexicon)
        out: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            before: set[str] = set()
            for clause in CLAUSE.split((text or "").lower()):
                words = WORD.findall(clause)
                memory.see(words)
                if not memory.hot.isdisjoint(words):
                    for k, w in enumerate(words):
                        if w in memory.hot:
                            before.update(x for x in words[max(0, k - reach) : k] if x not in memory.hot)
                            before.add("")  # the document itself
            out[toxic].update(before)
        keys = sorted({*out[0], *out[1]})
        return record_batch({"key": (keys, pa.string())} | {f"n{y}": ([out[y][k] for k in keys], pa.int64()) for y in (0, 1)})

    each = map_batches(labelled.select("text", "toxic"), count, "key string, n0 long, n1 long").groupBy("key")
    sums = materialize(each.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "context")
    whole = sums.filter("key = ''").first()
    if whole:
        all0, all1 = whole["n0"], whole["n1"]
        rows = sums.filter((F.col("key") != "") & (F.col("n0") + F.col("n1") >= max(20, support * (all0 + all1)))).collect()
        rate = all1 / (all0 + all1)
        for r in sorted(rows, key=lambda r: r["key"]):
            n = r["n0"] + r["n1"]
            expected = ((r["n1"], n * rate), (r["n0"], n * (1 - rate)))
            g = 2 * sum(a * math.log(a / e) for a, e in expected if a and e)
            if g >= surprise and lexicon.classify(r["key"])[0] == OTHER:
                lexicon.words[r["key"]] = (TARGET if r["n1"] > n * rate else NEGATION, 0.0)
    discard(sums)


#: (support, ratio, share) that cross-validation chooses from.
GRID = tuple(product((0.004, 0.008), (20.0,), (0.6, 0.75, 0.9)))


def _measured(sample: DataFrame, lexicons: list[Lexicon], grammar: Machine = GRAMMAR) -> dict[str, np.ndarray]:
    """toxic, fold and x (features under every lexicon) of the rows of a bounded sample."""

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        memories = [Memory(x) for x in lexicons]
        x = [[v for m in memories for v in features(t, m, grammar)] for t in batch.column(0).to_pylist()]
        return record_batch({"x": (x, pa.list_(pa.float64())), "toxic": (batch.column(1).cast(pa.int32()), pa.int32()), "fold": (batch.column(2).cast(pa.int32()), pa.int32())})

    got = sorted(map_batches(sample.select("text", "toxic", "fold"), measure, "x array<double>, toxic int, fold int").collect())
    x = np.array([r["x"] for r in got], float).reshape(len(got), len(lexicons), len(SYMBOLS))
    return {"x": x, "toxic": np.array([r["toxic"] for r in got], float), "fold": np.array([r["fold"] for r in got], int)}


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    if not len(y) or not 0 < y.sum() < len(y):
        return PRIOR
    *slopes, start = logistic(x, y).tolist()
    return *slopes, min(start, -0.1)  # no evidence never makes a text toxic


def choose(counts: Counts, sample: DataFrame, grid: tuple = GRID) -> tuple[float, float, float]:
    """The settings with the least log-loss: the lexicon and weights of one fold score the other."""
    got = _measured(sample, [counts.lexicon(*settings, folds=(f,)) for settings in grid for f in (0, 1)])
    losses = []
    for k in range(len(grid)):
        loss = 0.0
        for f in (0, 1):
            learn, test = got["fold"] == f, got["fold"] != f
            weights = _fit(got["x"][learn, 2 * k + f], got["toxic"][learn])
            p = np.array([probability(x, weights) for x in got["x"][test, 2 * k + f]])
            y = got["toxic"][test]
            loss -= float(np.sum(np.log(np.where(y == 1, p, 1 - p))))
        losses.append(round(loss, 6))
    return grid[int(np.argmin(losses))]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, choice_rows: int = 1500, grammar: Machine = GRAMMAR) -> Model:
    """Learn from the labelled documents that aren't held out.

    The lexicon and its context words count all of them. The logistic regression takes sample_rows of them at most, and the choice of
    settings choice_rows, those with the least hash of their id and text, so that the model's cost doesn't grow."""
    own = labels.select(F.col("doc_id").alias("_id"), "toxic").filter("toxic in (0, 1)").groupBy("_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.filter(~held_out("_id"))
    # a label is some 20 bytes: up to BROADCAST_ROWS of them go to the tasks, more are merged with the texts
    own = F.broadcast(own) if own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else own.hint("merge")
    fold = F.pmod(F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 5), F.lit(2)).cast("int")
    rows = docs.select("doc_id", "text").join(own, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic", fold.alias("fold"))
    rows = materialize(rows, "toxic-rows")
    counts = count_keys(rows, min(s for s, _, _ in GRID))
    settings = choose(counts, least_hashed(rows, choice_rows)) if counts.toxic else GRID[0]
    lexicon = counts.lexicon(*settings)
    learn_context(rows, lexicon)
    got = _measured(least_hashed(rows, sample_rows), [lexicon], grammar)
    discard(rows)
    return Model(lexicon, _fit(got["x"][:, 0], got["toxic"]), settings, grammar)


def score_toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): the model, of bounded size, travels with the tasks."""
    memory = Memory(model.lexicon)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [model.score(t, memory) for t in batch.column(1).to_pylist()]
        return record_batch({"doc_id": (batch.column(0).cast(pa.int64()), pa.int64()), "score": (scores, pa.float64())})

    return map_batches(docs.select(doc_id, text), run, "doc_id long, score double")


def score_column(model: Model, text: str = "text") -> Column:
    """The score as a column, for filters."""
    memory = Memory(model.lexicon)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t, memory) for t in texts], dtype="float64")

    return score(F.col(text))


def matched_clauses(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, clause, and the weight of each symbol): one row for every matched clause."""
    memory = Memory(model.lexicon)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(d, c, *w) for d, t in zip(*(x.to_pylist() for x in batch.columns), strict=True) for w, _, c in clauses(t, memory, model.grammar)]
        ids, found, *weights = zip(*rows, strict=True) if rows else ((),) * (2 + len(SYMBOLS))
        return record_batch(
            {"doc_id": (ids, pa.int64()), "clause": (found, pa.string())} | {s: (w, pa.float64()) for s, w in zip(SYMBOLS, weights, strict=True)}
        )

    return map_batches(docs.select(F.col(doc_id).cast("long"), text), run, "doc_id long, clause string, " + ", ".join(f"{s} double" for s in SYMBOLS))
