"""Language identification with a linear-chain conditional random field over words.

Each word is described by its hashed character n-grams of 1 to 4 characters, by its affixes (beginnings and ends of two and three
characters, apart from the n-grams), by itself, and by the lexicon: the languages whose training texts hold it often and hardly any other's
do. Emission weights and the transition matrix are trained together on the log-likelihood; training sequences are spliced from pieces of
texts in different languages, so that the transitions learn both staying and switching. Words of a text are labelled by
forward-backward; a text's language is the label with the greatest mean posterior.

Forward and backward passes run over all texts of a batch at once: the words form one long sequence cut into blocks,
every block's transfer matrix is built in step with all others, the blocks are then linked, and the vectors filled in.
A text's first word forgets what stands before it. So a long text costs no more a word than a short one.

The fit takes a bounded sample: each language has the same share of ``sample_docs`` texts, one at least, or all it
has, and the same share of ``sample_chars`` characters; of a longer text the beginning is used to learn (to predict, texts are whole).

Defined cases: a null text, and one without a letter, is ``und`` with score 0. Without training rows every text is
``und``. Ties go to the label that sorts first. A very long text is labelled whole. Every input row gives one output row, copies included;
only the id and text columns are read to predict. An empty table gives an empty table.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import held_out, map_batches, record_batch

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case words with a letter (the pattern alone would let fractions and superscripts through)."""
    return [w for w in WORD.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]


UNKNOWN = "und"
GRAMS = (1, 2, 3, 4)
AFFIXES = (2, 3)


@dataclass
class Field:
    labels: list[str]
    weights: np.ndarray  # hashed feature x label
    stay: np.ndarray  # label x label transition weights
    lexicon: dict[str, int] = field(default_factory=dict)  # the label of words that hardly another one's texts hold


def learn_lexicon(texts: list[tuple[list[str], int]], at_least: int = 3, share: float = 0.8, most: int = 50_000) -> dict[str, int]:
    """The label of each word that at least at_least texts hold, a share of them with that label; the most frequent ones."""
    held: dict[str, Counter[int]] = defaultdict(Counter)
    for words, label in texts:
        for w in set(words):
            held[w][label] += 1
    sure = []
    for w, by in held.items():
        label, n = max(by.items(), key=lambda x: (x[1], -x[0]))
        if n >= at_least and n >= share * sum(by.values()):
            sure.append((-n, w, label))
    return {w: label for _, w, label in sorted(sure)[:most]}


def gram_slots(words: list[str], size: int, lexicon: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each feature family, the table slots of all words in a row and where each word's slots end."""
    joined = "".join(f"^{w}$" for w in words)
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.array([len(w) + 2 for w in words], np.int64)
    first = np.cumsum(length) - length
    out = []
    mix, mask = np.uint64(0x9E3779B97F4A7C15), np.uint64(size - 1)
    at = np.arange(len(code)) - np.repeat(first, length)  # place within the word
    room = np.repeat(length, length) - at
    rolled = np.zeros(len(code), np.uint64)
    for n in GRAMS:
        shifted = np.zeros_like(rolled)
        shifted[: len(code) - n + 1] = code[n - 1 :]
        rolled = (rolled + shifted + np.uint64(n)) * mix
        whole = room >= n
        out.append((((rolled[whole] >> np.uint64(24)) & mask).astype(np.int64), np.cumsum(np.maximum(0, length - n + 1))))
    one = np.arange(1, len(words) + 1)

    def hashed(names: list[str]) -> np.ndarray:
        found = pd.util.hash_array(np.array(names, dtype=object), categorize=False) if names else np.empty(0, np.uint64)
        return (found & mask).astype(np.int64)

    out.append((hashed(words), one))
    for n in AFFIXES:
        out.append((hashed([f"{w[:n]}-" for w in words]), one))
        out.append((hashed([f"-{w[-n:]}" for w in words]), one))
    known = [lexicon.get(w, -1) for w in words]
    out.append((hashed([f"lexicon {k}" for k in known]), one))
    return out


def emissions(slots: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    total = np.zeros((len(slots[0][1]), weights.shape[1]))
    for slot, end in slots:
        running = np.vstack([np.zeros((1, weights.shape[1])), np.cumsum(weights[slot], axis=0)])
        total += np.diff(running[np.concatenate([[0], end])], axis=0)
    return total


def scan(b: np.ndarray, first: np.ndarray, a: np.ndarray, step: int = 64) -> np.ndarray:
    """Normalised x_t = (x_{t-1} a) * b_t, where a first word takes the uniform vector for x_{t-1} a."""
    n, k = b.shape
    blocks = -(-n // step)
    pad = blocks * step - n
    b = np.concatenate([b, np.ones((pad, k))]).reshape(blocks, step, k)
    first = np.concatenate([first, np.zeros(pad, bool)]).reshape(blocks, step)
    whole = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(step):
        moved = whole @ a
        f = first[:, t]
        if f.any():
            moved[f] = whole[f].sum(2, keepdims=True) / k
        whole = moved * b[:, t, None, :]
        whole /= whole.max(axis=(1, 2), keepdims=True)
    enter = np.empty((blocks, k))
    x = np.full(k, 1 / k)
    for i in range(blocks):
        enter[i] = x
        x = x @ whole[i]
        x /= x.sum()
    out = np.empty_like(b)
    x = enter
    for t in range(step):
        x = x @ a
        x[first[:, t]] = 1 / k
        x *= b[:, t]
        x /= x.sum(1, keepdims=True)
        out[:, t] = x
    return out.reshape(-1, k)[:n]


def forward_backward(e: np.ndarray, first: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posteriors, forward vectors, backward vectors times emission) of the words."""
    b = np.exp(e - e.max(axis=1, keepdims=True)) + 1e-30
    a = np.exp(stay - stay.max())
    last = np.append(first[1:], True)
    forward = scan(b, first, a)
    backward = scan(b[::-1], last[::-1], a.T)[::-1]
    p = forward * backward / b
    return p / p.sum(1, keepdims=True), forward, backward


def expected_moves(forward: np.ndarray, backward: np.ndarray, inner: np.ndarray, stay: np.ndarray, cells: int = 1 << 22) -> np.ndarray:
    """How often each label is expected to follow each other, summed over blocks of words so that at most ``cells`` numbers are held."""
    a, k = np.exp(stay - stay.max()), len(stay)
    total, step = np.zeros((k, k)), max(1, cells // (k * k))
    for i in range(0, len(forward) - 1, step):
        x, y = forward[i : i + step][: len(forward) - 1 - i], backward[i + 1 : i + step + 1]
        pair = x[:, :, None] * a[None] * y[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        total += pair[inner[i + 1 : i + step + 1]].sum(axis=0)
    return total


def fit(texts: list[tuple[str, str]], size: int = 1 << 17, epochs: int = 15, rate: float = 0.2, piece: int = 30, seed: int = 3) -> Field | None:
    """texts: (text, label). Pieces of ``piece`` words of all texts are dealt to sequences of four."""
    labels = sorted({label for _, label in texts})
    if not labels:
        return None
    split = [(words_of(text), labels.index(label)) for text, label in texts]
    lexicon = learn_lexicon(split)
    pieces = [(words[i : i + piece], label) for words, label in split for i in range(0, len(words), piece)]
    random.Random(seed).shuffle(pieces)
    flat = [w for words, _ in pieces for w in words]
    if not flat:
        return None
    y = np.repeat([label for _, label in pieces], [len(words) for words, _ in pieces])
    begins = np.cumsum([0] + [len(words) for words, _ in pieces])[:-1]
    first = np.zeros(len(flat), bool)
    first[begins[::4]] = True
    code, distinct = pd.factorize(np.array(flat, dtype=object))
    k = len(labels)
    while size * k > MOST_WEIGHTS and size > 1 << 12:
        size >>= 1
    slots = gram_slots(list(distinct), size, lexicon)
    weights, stay = np.zeros((size, k)), np.zeros((k, k))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(stay), np.zeros_like(stay)]
    onehot = np.eye(k)[y]
    inner = ~first
    observed = np.zeros((k, k))
    np.add.at(observed, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
    for epoch in range(1, epochs + 1):
        p, forward, backward = forward_backward(emissions(slots, weights)[code], first, stay)
        rest = onehot - p
        by_word = np.stack([np.bincount(code, rest[:, j], len(distinct)) for j in range(k)], axis=1)
        gradient = np.zeros_like(weights)
        for slot, end in slots:
            each = np.repeat(by_word, np.diff(np.concatenate([[0], end])), axis=0)
            for j in range(k):
                gradient[:, j] += np.bincount(slot, each[:, j], size)
        moves = observed - expected_moves(forward, backward, inner, stay)
        for x, g, i in ((weights, gradient / len(flat), 0), (stay, moves / len(flat), 2)):
            moments[i] = 0.9 * moments[i] + 0.1 * g
            moments[i + 1] = 0.99 * moments[i + 1] + 0.01 * g * g
            x += rate * (moments[i] / (1 - 0.9**epoch)) / (np.sqrt(moments[i + 1] / (1 - 0.99**epoch)) + 1e-6)
    return Field(labels, weights.astype(np.float32), stay, lexicon)


#: Weights of a model; with more than 64 labels they have fewer hashed features each.
MOST_WEIGHTS = 1 << 23


def train(docs: DataFrame, sample_docs: int = 500, sample_chars: int = 2_000_000) -> Field | None:
    """Fit on a bounded sample of the texts with a language that aren't held out: of each language those with the least hash of id and
    text. The bounds keep the model's cost the same for any corpus; no language is left out for being rare or having long texts, and with
    more than sample_docs languages there is one text for each."""
    usable = docs.filter(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    known = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    if not known:
        return None
    each, chars = -(-sample_docs // len(known)), max(1, sample_chars // len(known))
    # three times as many as wanted by a hash of their own, so that only these few are ranked; a row for each label of the model goes to the tasks
    share = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, 3 * each / r["n"]) * (1 << 31))) for r in known], "lang string, share long")
    hashed = usable.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(share), "lang").filter(F.pmod("h", F.lit(1 << 31)) < F.col("share"))
    picked = hashed.select("lang", "h", F.substring("text", 1, chars).alias("text")).dropDuplicates(["lang", "h"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    rows = picked.withColumn("rank", rank).filter(F.col("rank") <= each).orderBy("lang", "rank").collect()
    texts, left = [], {r["lang"]: chars for r in known}
    for r in rows:
        if left[r["lang"]] > 0:
            texts.append((r["text"][: left[r["lang"]]], r["lang"]))
            left[r["lang"]] -= len(r["text"])
    return fit(texts)


def label_batch(texts: list[str | None], field: Field, most_words: int = 200_000) -> list[tuple[list[str], np.ndarray]]:
    """Words of each text with their posteriors over field.labels."""
    out: list[tuple[list[str], np.ndarray]] = []
    group: list[list[str]] = []

    def flush() -> None:
        flat = [w for words in group for w in words]
        if flat:
            code, distinct = pd.factorize(np.array(flat, dtype=object))
            e = emissions(gram_slots(list(distinct), len(field.weights), field.lexicon), field.weights)[code]
            first = np.zeros(len(flat), bool)
            sizes = np.array([len(words) for words in group])
            first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
            p = forward_backward(e, first, field.stay)[0]
        at = 0
        for words in group:
            out.append((words, p[at : at + len(words)] if words else np.empty((0, len(field.labels)))))
            at += len(words)
        group.clear()

    held, most = 0, max(1, 4 * most_words // max(4, len(field.labels)))
    for text in texts:
        group.append(words_of(text))
        held += len(group[-1])
        if held > most:
            flush()
            held = 0
    flush()
    return out


def identify(docs: DataFrame, field: Field | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_words, n_switches): n_switches counts neighbouring words with other labels."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        texts = batch.column(1).to_pylist()
        labelled = label_batch(texts, field) if field else [([], None)] * len(texts)
        for words, p in labelled:
            if not words:
                rows.append((UNKNOWN, 0.0, 0, 0))
                continue
            mean, best = p.mean(axis=0), p.argmax(axis=1)
            k = int(mean.argmax())
            rows.append((field.labels[k], min(1.0, float(mean[k])), len(words), int((best[1:] != best[:-1]).sum())))
        lang, score, n, switches = zip(*rows, strict=True) if rows else [()] * 4
        return record_batch(
            {
                "doc_id": (batch.column(0).cast(pa.int64()), pa.int64()),
                "lang_pred": (lang, pa.string()),
                "score": (score, pa.float64()),
                "n_words": (n, pa.int64()),
                "n_switches": (switches, pa.int64()),
            }
        )

    return map_batches(docs.select(doc_id, text), run, "doc_id long, lang_pred string, score double, n_words long, n_switches long")
