"""Secret scans with probabilistic automata inferred from labelled credentials.

Inference is state merging over a prefix tree: for each kind of credential a tree of its labelled examples is built
with counts, and states are merged, most frequent first, where a Hoeffding bound finds the frequencies of their
next symbols and of ending statistically compatible, and those of all states they lead to; of several compatible states the likeliest
is taken. What remains is a small deterministic automaton with probabilities: fixed prefixes stay as they are, random bodies become
loops. Every candidate of a text is scored by the log-likelihood of its best automaton against a uniform source; scores per kind are
the *format likelihood*. The base patterns stay in the result whatever their score; other candidates are added where the score
reaches ``least`` nats.

Labelled credentials: members of publicly documented token formats, and what the base patterns find in the documents themselves,
a bounded sample for each base pattern (the values with the least hash, each once), so that the formats that a corpus assigns to
keys and tokens are found without them too.

Candidates: every base match, and stretches of 16 or more characters with letters and digits in runs of ``[A-Za-z0-9+/_.=-]``. A
stretch ends where its run ends or before a character that is no letter or digit. It begins at its run's start or after such a
character; automata that begin with a fixed prefix also begin anywhere else, so that a credential behind ``key=``, ``//`` or ``%3D`` is
scored too. For a kind and start the last end that reaches ``least`` counts, so that no end of a credential is left. A stretch inside
another or inside a base match is part of it; of equal stretches the first kind in order stays.

Defined cases: a null or empty text has no spans. A very long text is scanned whole, as one row. Spans are in code points, the end
exclusive. Every input row gives one output row, repeated rows too; only the id and text columns are read. An empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import defaultdict
from collections.abc import Iterable
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches, record_batch

# The base patterns, their order and least lengths.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_RUN = 16
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")

ALNUM = string.ascii_letters + string.digits
# Publicly documented token formats (prefix, alphabet of the body, length of the body).
FORMATS = {
    "aws": ("AKIA", string.ascii_uppercase + string.digits, 16),
    "github": ("ghp_", ALNUM, 36),
    "gitlab": ("glpat-", ALNUM, 20),
    "google": ("AIza", ALNUM + "-_", 35),
    "npm": ("npm_", ALNUM, 36),
    "stripe": ("sk_live_", ALNUM, 24),
    "slack": ("xoxb-", string.digits + "-" + ALNUM, 40),
    "hex": ("", "0123456789abcdef", 32),
}


def labelled_examples(each: int = 150, seed: int = 5) -> list[tuple[str, str]]:
    """(kind, credential): ``each`` random members of every format, the same on every call."""
    rng = random.Random(seed)
    return [(kind, prefix + "".join(rng.choices(letters, k=n))) for kind, (prefix, letters, n) in FORMATS.items() for _ in range(each)]


def assigned(text: str) -> list[tuple[str, str]]:
    """(kind, value) of the base matches of a text that are long enough to be candidates; of assignments what is assigned."""
    found = []
    for start, kind, end in base_spans(text):
        value = text[start:end]
        value = ASSIGN.match(value)[2] if kind == "assign" else value
        if len(value) >= LEAST_RUN and any(map(str.isdigit, value)) and any(map(str.isalpha, value)):
            found.append((f"{kind}-value", value))
    return found


def corpus_examples(docs: DataFrame, each: int = 150, text: str = "text") -> list[tuple[str, str]]:
    """(kind, value) of at most ``each`` different values for each base pattern: those with the least hash in all documents."""

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[str, set[tuple[int, str]]] = defaultdict(set)
        for t in batch.column(0).to_pylist():
            for kind, value in assigned(t or ""):
                found[kind].add((xxhash.xxh3_64_intdigest(value) >> 1, value))
        rows = [(k, h, v) for k, values in found.items() for h, v in sorted(values)[:each]]
        kinds, hashes, values = zip(*rows, strict=True) if rows else [()] * 3
        return record_batch({"kind": (kinds, pa.string()), "h": (hashes, pa.int64()), "value": (values, pa.string())})

    values = map_batches(docs.select(text), scan, "kind string, h long, value string").distinct()
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("h", "value"))
    rows = values.withColumn("rank", rank).filter(F.col("rank") <= each).orderBy("kind", "rank").collect()
    return [(r["kind"], r["value"]) for r in rows]


class Automaton:
    """Counts of a prefix tree, merged by ``infer``; ``score`` then reads them as probabilities."""

    def __init__(self, examples: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends = [0]
        for example in examples:
            state = 0
            for c in example:
                self.count[state][c] = self.count[state].get(c, 0) + 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                state = self.next[state][c]
            self.ends[state] += 1

    def total(self, state: int) -> int:
        return self.ends[state] + sum(self.count[state].values())

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        """Hoeffding's test on ending and on every next symbol, for both states and for all pairs of states that one string leads to."""
        spread = math.sqrt(0.5 * math.log(2 / alpha))
        todo, seen = [(a, b)], {(a, b)}
        while todo:
            a, b = todo.pop()
            na, nb = self.total(a), self.total(b)
            if not na or not nb:
                continue
            bound = spread * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if abs(self.ends[a] / na - self.ends[b] / nb) > bound:
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(c, 0) / na - self.count[b].get(c, 0) / nb) > bound:
                    return False
            for c in self.next[a].keys() & self.next[b].keys():
                pair = self.next[a][c], self.next[b][c]
                if pair[0] != pair[1] and pair not in seen:
                    seen.add(pair)
                    todo.append(pair)
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree below b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def likeness(self, a: int, b: int, alphabet: int = 64) -> float:
        """Log-likelihood of what leaves state b under the smoothed frequencies of state a."""
        total = self.total(a) + 0.1 * (alphabet + 1)
        ending = self.ends[b] * math.log((self.ends[a] + 0.1) / total)
        return ending + sum(n * math.log((self.count[a].get(c, 0) + 0.1) / total) for c, n in self.count[b].items())

    def infer(self, alpha: float = 0.05) -> Automaton:
        """Take the states next to the kept ones, most frequent first; merge each into the likeliest of the compatible kept
        states, or keep it if there is none, until all that can be reached are kept."""
        kept = [0]
        while True:
            fringe = [(s, c) for s in kept for c in sorted(self.next[s]) if self.next[s][c] not in kept]
            if not fringe:
                return self
            source, c = max(fringe, key=lambda x: self.total(self.next[x[0]][x[1]]))
            blue = self.next[source][c]
            same = [s for s in kept if self.compatible(s, blue, alpha)]
            if not same:
                kept.append(blue)
            else:
                target = max(same, key=lambda s: self.likeness(s, blue))
                self.next[source][c] = target
                self.fold(target, blue)

    def compiled(self, open_from: int = 4) -> tuple[list[dict[str, tuple[int, float]]], list[float]]:
        """Transitions with log-probabilities, and the log-probability of ending, for the states in use.

        A state with open_from or more symbols is part of a random body: the other symbols of the examples' alphabet, which it
        hasn't met by chance, follow its likeliest transition as half an example would. Fixed prefixes stay closed."""
        alphabet = {c for counts in self.count for c in counts}
        number, order = {0: 0}, [0]
        for state in order:
            for c in sorted(self.next[state]):
                if self.next[state][c] not in number:
                    number[self.next[state][c]] = len(order)
                    order.append(self.next[state][c])
        moves = [{c: (number[self.next[s][c]], math.log(n / self.total(s))) for c, n in self.count[s].items()} for s in order]
        for s, row in zip(order, moves, strict=True):
            if len(row) >= open_from:
                target = row[max(sorted(row), key=lambda c: row[c][1])][0]
                row |= {c: (target, math.log(0.5 / (self.total(s) + 1))) for c in sorted(alphabet - row.keys())}
        return moves, [math.log(max(self.ends[s], 0.5) / (self.total(s) + 1)) for s in order]


class Grammar:
    """One automaton per kind of credential."""

    SOURCE = math.log(1 / 68)  # a uniform source over the candidate alphabet and the end

    def __init__(self, labelled: Iterable[tuple[str, str]], alpha: float = 0.05):
        by_kind: dict[str, list[str]] = defaultdict(list)
        for kind, text in labelled:
            by_kind[kind].append(text)
        self.automata = {k: Automaton(v).infer(alpha).compiled() for k, v in sorted(by_kind.items())}
        #: first characters of the automata that begin with a fixed prefix
        self.prefixed = {k: set(moves[0]) for k, (moves, _) in self.automata.items() if len(moves[0]) == 1}

    def stretches(self, run: str, least: float) -> list[tuple[int, int, float, str]]:
        """(start, end, score, kind) of the stretches of run that score least or more, with the last end for each start and kind."""
        inner = [not c.isalnum() for c in run]
        digits, letters = ([0, *accumulate(f(c) for c in run)] for f in (str.isdigit, str.isalpha))
        final, found = len(run.rstrip(".=")), []
        for k, (moves, ends) in self.automata.items():
            first = self.prefixed.get(k)
            for start in range(final - LEAST_RUN + 1):
                if run[start] not in first if first else start and not inner[start - 1]:
                    continue
                state, total, last = 0, 0.0, None
                for at in range(start, final):
                    step = moves[state].get(run[at])
                    if step is None:
                        break
                    state, p = step
                    total += p
                    end = at + 1
                    if end - start < LEAST_RUN or not (end == final or inner[end]):
                        continue
                    score = total + ends[state] - self.SOURCE * (end - start + 1)
                    if score >= least and digits[end] > digits[start] and letters[end] > letters[start]:
                        last = (start, end, score, k)
                if last:
                    found.append(last)
        return found

    def score(self, text: str) -> tuple[float, str | None]:
        """(nats over the uniform source, kind) of the likeliest format; minus infinity if none can make the text."""
        best, kind = -math.inf, None
        for k, (moves, ends) in self.automata.items():
            state, total = 0, 0.0
            for c in text:
                step = moves[state].get(c)
                if step is None:
                    break
                state, p = step
                total += p
            else:
                total += ends[state] - self.SOURCE * (len(text) + 1)
                if total > best:
                    best, kind = total, k
        return best, kind


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base matches, leftmost and non-overlapping within each kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    # both other kinds match only inside one run of candidate characters
    for run in RUN.finditer(text):
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            found += [
                (run.start() + m.start(), kind, run.start() + m.end())
                for m in pattern.finditer(run[0])
                if m.end() - m.start() >= LEAST[kind]
            ]
    return sorted(found, key=lambda s: (s[0], BASE.index(s[1])))


def scan_text(text: str | None, grammar: Grammar, least: float = 12.0) -> list[tuple[int, str, int, float, bool]]:
    """(start, kind, end, score, base) of all spans, by start and then kind, base kinds first."""
    text = text or ""
    base = base_spans(text)
    spans = [(s, k, e, grammar.score(text[s:e])[0], True) for s, k, e in base]
    for run in RUN.finditer(text):
        if not (any(c.isdigit() for c in run[0]) and any(c.isalpha() for c in run[0])):
            continue
        taken = [(s, e) for s, _, e in base]
        for start, end, score, kind in sorted(grammar.stretches(run[0], least), key=lambda x: (x[0] - x[1], -x[2], x)):
            start, end = run.start() + start, run.start() + end
            if not any(s <= start and end <= e for s, e in taken):
                taken.append((start, end))
                spans.append((start, f"format-{kind}", end, score, False))
    return sorted(spans, key=lambda s: (s[0], BASE.index(s[1]) if s[1] in BASE else len(BASE), s[1]))


def _joined(spans: Iterable[tuple]) -> str:
    return ",".join(f"{s[1]}:{s[0]}:{s[2]}" for s in spans)


SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "found array<struct<start:long,kind:string,end:long,score:double,base:boolean>>"
)
_FOUND = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])


def scan_secrets(docs: DataFrame, labelled: list[tuple[str, str]] | None = None, least: float = 12.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with all its spans. The automata are inferred once, on the driver, from the labelled
    credentials (a fixed number for each kind; by default those of the documented formats and of docs), and travel with the tasks."""
    grammar = Grammar(labelled_examples() + corpus_examples(docs, text=text) if labelled is None else labelled)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        all_spans = [scan_text(t, grammar, least) for t in batch.column(1).to_pylist()]
        base = [[s for s in spans if s[4]] for spans in all_spans]
        names = ("start", "kind", "end", "score", "base")
        return record_batch(
            {"doc_id": (batch.column(0).cast(pa.int64()), pa.int64())}
            | {f"n_{k}": ([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in BASE}
            | {
                "base_sha256": ([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], pa.string()),
                "spans": ([_joined(s) for s in all_spans], pa.string()),
                "found": ([[dict(zip(names, s, strict=True)) for s in spans] for spans in all_spans], pa.list_(_FOUND)),
            }
        )

    return map_batches(docs.select(doc_id, text), scan, SCHEMA)


def redact(docs: DataFrame, mark: str = "[SECRET]", least: float = 12.0, text: str = "text") -> DataFrame:
    """docs with every span of its text replaced by mark; overlapping spans become one. A null text stays null."""
    grammar = Grammar(labelled_examples() + corpus_examples(docs, text=text))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if not t:
                return t
            out, at = [], 0
            for start, _, end, _, _ in scan_text(t, grammar, least):
                if start >= at:
                    out += [t[at:start], mark]
                at = max(at, end)
            return "".join(out) + t[at:]

        return texts.map(one, na_action="ignore")

    return docs.withColumn(text, clean(F.col(text)))
