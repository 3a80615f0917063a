"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

``base_stats`` adds the counts that the base rule and every report need. All other rules own their expression over the text, which is
evaluated only where a row reaches the rule. ``plan_cascade`` runs each rule by itself over a small sample, several times, notes its least time
and the share of rows it rejects, and orders the rules by rejection per cost; ``verdict`` then nests them in one CASE expression, so
that a row stops at the first rule that rejects it. The order decides only what work is done, never which rows pass, so the
sample cannot change a result. It is taken from a few of the input's files, spread over all, and has ``sample_rows`` rows at most; only an
input that is no plain file scan is sampled as a whole.

Defined cases: a null text has no words, so its counts are 0 and it is rejected. Every input row gives one output row, copies
included; a very long text is one row like any other. Ties in rejection per cost keep the given order. Other columns pass through
untouched, except that the names added here replace columns of the same name. An empty table gives an empty table. Repeated
windows are compared by a 64-bit hash of their three words within one text.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, clean_name, discard, materialize

SYMBOLS = "[#*$%&|<>]"
SPACES = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
WINDOW = 3
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """Evaluate value once and hand it to body, however often body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(ASCII_SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACES))


def _covered(hashes: Column) -> Column:
    """Words covered by the windows whose hash occurs twice or more."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(p: Column) -> Column:
        again = F.filter(
            p,
            lambda x, k: (x["h"] == F.get(p, k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(p, k - 1)["h"])),
        )
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def total(s: Column) -> Column:
        return F.aggregate(
            F.transform(s, lambda x, k: F.coalesce(F.least(F.get(s, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
            F.lit(0),
            lambda a, x: a + x,
        )

    return let(let(pairs, starts), total)


def _repeat_words(words: Column) -> Column:
    def of(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))),
        )
        count = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(count)

    return let(words, of).cast("long")


def base_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD_CHAR))
    counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    words, both = clean_name(docs, "_words"), clean_name(docs, "_lines")
    split = docs.withColumns({words: _words(whole), both: counts})
    return split.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"),
            "n_lines": F.col(both)["n"].cast("long"),
            "n_dup_lines": (F.col(both)["n"] - F.col(both)["d"]).cast("long"),
            "n_repeat_words": _repeat_words(F.col(words)),
        }
    ).drop(words, both)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """fails: true where the rule rejects a row that has the columns of base_stats and its text."""

    name: str
    fails: Column


def default_rules(text: str = "text") -> list[Rule]:
    whole = F.coalesce(F.col(text), F.lit(""))
    n = F.col("n_words")

    def count(pattern: str) -> Column:
        return F.regexp_count(whole, F.lit(pattern))

    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("duplicate_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        Rule("shouting", 5 * count("!") > n),
        Rule("few_letters", 2 * count(r"[^\p{L}\x20\x09-\x0D]") > F.col("word_chars")),
        Rule("digits", 5 * count("[0-9]") > F.col("word_chars")),
    ]


def sampled(docs: DataFrame, text: str, rows: int, files: int = 2, fraction: float = 0.05) -> DataFrame:
    """At most ``rows`` texts from ``files`` of the files of docs. Where docs isn't a plain scan, its rows are picked by a hash of
    their text."""
    names = sorted(docs.inputFiles())
    if names:
        chosen = {names[len(names) * k // files].rpartition("/")[2] for k in range(files)}
        try:
            return docs.filter(F.col("_metadata.file_name").isin(*chosen)).select(text).limit(rows)
        except AnalysisException:  # a join or an aggregate has no file of its own
            pass
    return docs.select(text).filter(F.pmod(F.xxhash64(text), F.lit(1000)) < int(1000 * fraction)).limit(rows)


def plan_cascade(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = 1000, times: int = 3) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, seconds) in the order to run: most rejections per second first. An empty sample keeps the given order."""
    stored = materialize(sampled(docs, text, sample_rows), "cascade-texts")
    sample = materialize(base_stats(stored, text), "cascade-sample")
    total = sample.count()

    def run(condition: Column) -> tuple[int, float]:
        query, least = sample.agg(F.count_if(condition).alias("n")), float("inf")
        for _ in range(times):
            began = time.perf_counter()
            rejected = query.first()["n"]
            least = min(least, time.perf_counter() - began)
        return rejected, least

    measured = []
    if total:
        idle = run(F.col("n_words") < 0)[1]
        for rule in rules:
            rejected, took = run(rule.fails)
            measured.append((rule, rejected / total, max(took - idle, 1e-4)))
    discard(stored, sample)
    if not total:
        return [(r, 0.0, 0.0) for r in rules]
    return sorted(measured, key=lambda x: -(x[1] + 0.5 / total) / x[2])


def verdict(ordered: list[Rule]) -> tuple[Column, Column]:
    """(kept, name of the rejecting rule): later rules are evaluated only on rows that passed the earlier ones."""
    kept, by = F.when(base_failed(), F.lit(False)), F.when(base_failed(), F.lit("base"))
    for rule in ordered:
        kept, by = kept.when(rule.fails, F.lit(False)), by.when(rule.fails, F.lit(rule.name))
    return kept.otherwise(F.lit(True)), by.otherwise(F.lit(None).cast("string"))


def apply_cascade(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = 1000) -> DataFrame:
    """docs with the base counts, base_failed and kept."""
    order = [r for r, _, _ in plan_cascade(docs, rules or default_rules(text), text, sample_rows)]
    return base_stats(docs, text).withColumn("base_failed", base_failed()).withColumn("kept", verdict(order)[0])
