"""Phrases of two to four words that stand together more often than their parts explain, by level-wise passes (Apriori).

A text is lower-cased in A-Z, cut into pieces at ``.,;:!?`` and line breaks, and pieces into words at spaces and tabs. Phrases never
leave a piece. Everything is counted within a language; a null language is ``und``.

Passes. The first pass counts words. Pass k scans the texts again and emits a run of k words only where both runs of k - 1 words in it
are frequent (``least`` times or more), since a frequent phrase has only frequent parts. What is frequent goes to the tasks as a
bitmap of phrase hashes, 32 bits for each phrase and at most 2^29 bits (64 MB), whatever the corpus. A false hit emits a phrase in vain, and
beyond some 10^8 frequent phrases more of them do; counts never depend on it, for the pass's own threshold is exact. Every batch
counts its phrases before they leave Python, every task before they are shuffled, so a frequent phrase or a language with most of the
texts is a few rows for each task. Each pass writes its frequent phrases as a table.

Scores. A phrase seen a times that is cut into parts seen l and r times scores floor(scale * a / (l + r)) for that cut; its lowest cut
counts, and of equal ones the earliest. Parts of a frequent phrase are frequent, so l and r are looked up in the tables of the passes. A
phrase goes if a longer candidate that contains it has at least ``share`` percent of its count. Products are decimals of up to 38 digits.

Ranks. A language may hold any number of phrases, so each of 64 parts of it finds its own best first; at most 64 times ``top`` rows
of a language meet.

Defined cases: null and empty texts have no words. A very long text is one row of one task, like others. Ids aren't read; repeated rows
count each time. Equal scores are ordered by count, then by the phrase's bytes, so ranks have no ties. Phrases are told apart by their
words, not by hashes. Only the text and language columns are read, whatever others are called. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, map_batches, materialize, record_batch
from .suffix_dedup import ODD, Bitmap, mix

LEAST, LONGEST, SHARE, SCALE, TOP = 30, 4, 80, 2_000_000, 2000
PARTS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ENDS_PIECE = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
_IN_WORD = ~(_ENDS_PIECE | np.isin(np.arange(256), list(b" \t")))


class Words:
    """The words of a batch of (text, lang), one after the other: ``code`` in ``vocabulary``, ``piece``, ``lang`` in ``langs``, ``hash``."""

    def __init__(self, batch: pa.RecordBatch):
        texts = batch.column(0).cast(pa.binary()).fill_null(b"").to_pylist()
        tags = batch.column(1).fill_null("und").dictionary_encode()
        self.langs = tags.dictionary.to_pylist()
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)  # no piece reaches over two texts
        inside = np.zeros(len(raw) + 1, bool)
        inside[1:] = _IN_WORD[raw]
        start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        self.piece = np.cumsum(_ENDS_PIECE[raw])[start]
        offsets = np.zeros(len(start) + 1, np.int32)
        np.cumsum(end - start, out=offsets[1:])
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside[1:]]])])
        coded = packed.dictionary_encode()
        self.code, self.vocabulary = coded.indices.to_numpy(), coded.dictionary
        words = self.vocabulary.to_numpy(zero_copy_only=False).tolist()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        self.hash = hashes[self.code]
        owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
        self.lang = tags.indices.to_numpy()[owner]
        self.seed = np.fromiter((xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs), np.uint64, len(self.langs))[self.lang]

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(at, hash) of the runs of k words within a piece; equal runs of one language have equal hashes."""
        n = max(len(self.code) - k + 1, 0)
        h = self.seed[:n].copy()
        for j in range(k):
            h = h * np.uint64(ODD) + self.hash[j : j + n]
        at = np.flatnonzero(self.piece[:n] == self.piece[k - 1 :][:n]) if n else np.empty(0, np.int64)
        return at, mix(h[at])

    def counted(self, at: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first place, number) of each different run at ``at``."""
        order = np.argsort(h)
        at, h = at[order], h[order]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        n = np.diff(np.append(begin, len(h)))
        first = np.repeat(at[begin], n)
        if all((self.code[at + j] == self.code[first + j]).all() for j in range(k)) and (self.lang[at] == self.lang[first]).all():
            return at[begin], n
        # two different runs with one hash: count the words themselves
        rows = np.column_stack([self.lang[at], *(self.code[at + j] for j in range(k))])
        _, one, n = np.unique(rows, axis=0, return_index=True, return_counts=True)
        return at[one], n

    def batch(self, at: np.ndarray, n: np.ndarray, k: int) -> pa.RecordBatch:
        words = [self.vocabulary.take(pa.array(self.code[at + j])) for j in range(k)]
        phrases = words[0] if k == 1 else pc.binary_join_element_wise(*words, b" ")
        langs = pa.DictionaryArray.from_arrays(pa.array(self.lang[at], pa.int32()), pa.array(self.langs, pa.string())).cast(pa.string())
        return record_batch({"lang": (langs, pa.string()), "phrase": (phrases.cast(pa.string()), pa.string()), "f": (n, pa.int64())})


def run_hash(lang: str, phrase: str) -> int:
    h = xxhash.xxh3_64_intdigest(lang.encode())
    for word in phrase.encode().split(b" "):
        h = (h * ODD + xxhash.xxh3_64_intdigest(word)) & (1 << 64) - 1
    return h


def _hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
    h = np.array([0 if p is None else run_hash(x, p) for x, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.uint64)
    return record_batch({"lang": (batch.column(0), pa.string()), "phrase": (batch.column(1), pa.string()), "f": (batch.column(2), pa.int64()), "h": (mix(h).view(np.int64), pa.int64())})


def _passes(rows: DataFrame, least: int, longest: int) -> tuple[list[DataFrame], DataFrame]:
    """The table (lang, phrase, h, f) of each pass, and the number n of words of each language."""

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch)
        at, h = w.runs(1)
        place, n = w.counted(at, h, 1)
        own = w.batch(place, n, 1)
        totals = np.bincount(w.lang, minlength=len(w.langs))
        total = record_batch({"lang": (w.langs, pa.string()), "phrase": ([None] * len(w.langs), pa.string()), "f": (totals, pa.int64())})
        return pa.Table.from_batches([own, total]).combine_chunks().to_batches()[0]

    def runs(k: int, frequent: Bitmap):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            w = Words(batch)
            at, h = w.runs(k - 1)
            ok = np.zeros(len(w.code) + 1, bool)
            ok[at[frequent.has(h)]] = True
            at, h = w.runs(k)
            both = ok[at] & ok[at + 1]
            return w.batch(*w.counted(at[both], h[both], k), k)

        return run

    schema, levels = "lang string, phrase string, f long", []
    for k in range(1, longest + 1):
        emitted = map_batches(rows, words if k == 1 else runs(k, Bitmap(levels[-1].filter("phrase IS NOT NULL"), "h")), schema)
        summed = emitted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | F.col("phrase").isNull())
        # hashes don't compress, so they come after the shuffle
        levels.append(materialize(map_batches(summed, _hashed, schema + ", h long"), f"phrases-{k}"))
    totals = levels[0].filter("phrase IS NULL").select("lang", F.col("f").alias("n"))
    return levels, totals


def _wide(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def _part(words: str, start: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(levels: list[DataFrame], totals: DataFrame, share: int, scale: int) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that no longer one stands for. levels: a table of each pass."""
    known = [x.filter("phrase IS NOT NULL").select("lang", "phrase", "f") for x in levels]
    split = F.split("phrase", " ", -1)
    longer = [x.select("lang", split.alias("w"), "f") for x in known]
    cuts, inside = [], []
    for size, x in enumerate(known[1:], start=2):
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), _part("w", 1, k).alias("first"), _part("w", k + 1, size - k).alias("rest")) for k in range(1, size))))
        cuts.append(x.withColumn("w", split).select("lang", "phrase", F.col("f").alias("a"), each.alias("c")).select("lang", "phrase", "a", "c.*"))
        if size > 2:
            subs = F.array(*(_part("w", i + 1, m) for m in range(2, size) for i in range(size - m + 1)))
            inside.append(longer[size - 1].select("lang", F.explode(subs).alias("phrase"), "f"))
    cut = cuts[0]
    for x in cuts[1:]:
        cut = cut.union(x)
    parts = known[0]
    for x in known[1:-1]:
        parts = parts.union(x)
    left, right = parts.toDF("lang", "first", "l"), parts.toDF("lang", "rest", "r")
    score = F.expr(f"CAST({scale} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    met = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score.cast("long"))
    best = met.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    if inside:
        above = inside[0]
        for x in inside[1:]:
            above = above.union(x)
        above = above.groupBy("lang", "phrase").agg(F.max("f").alias("above"))
        best = best.join(above, ["lang", "phrase"], "left").filter(F.coalesce(100 * _wide("above") < share * _wide("a"), F.lit(True))).drop("above")
    return best.join(totals, "lang")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, share: int = SHARE, scale: int = SCALE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    levels, totals = _passes(docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")), least, longest)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = scored(levels, totals, share, scale).withColumn("part", part)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    found = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    found = materialize(found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(*levels)
    return found
