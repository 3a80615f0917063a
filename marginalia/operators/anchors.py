"""Where passages stand in a corpus: exact once, not at all, or ambiguous.

A passage that occurs in a text has all its words but the first and last there as whole words in a row. So texts and passages
meet by the hash of up to three such inner words, and only pairs that met are compared. Where the passages have few different hashes
(``MOST_LITERAL``) these go into the scan of the texts as a literal, so that only the texts that hold one leave it; else the runs of
the texts are joined. Passages without an inner word (one or two words) are compared with every text while there are few of them, as a
broadcast behind a check of their number and size; else they meet the texts by their first three characters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, normalised

RUN, MOST_SHORT, MOST_LITERAL, GRAM = 3, 1000, 5000, 3


def occurrences(text: Column, needle: Column) -> Column:
    """All places of needle in text, overlapping ones too."""
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    return F.regexp_count(text, quoted).cast("long")


def _runs(words: Column, size: int) -> Column:
    """Hashes of all runs of size words."""

    def of(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))
        return F.when(F.size(w) >= size, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))

    return let(words, of)


def _met_by_words(hay: DataFrame, needles: DataFrame) -> DataFrame:
    """(item_id, doc_id) of the texts that hold the first inner words of a passage."""
    split, met = F.split("text", " "), []
    for size in range(1, RUN + 1):
        own = needles.filter(F.col("size") == size).select("item_id", F.get(_runs(F.slice("inner", 1, size), size), F.lit(0)).alias("h"))
        few = [r["h"] for r in own.select("h").distinct().limit(MOST_LITERAL + 1).collect()]
        if not few:
            continue
        found = _runs(split, size)
        if len(few) <= MOST_LITERAL:
            found = F.array_intersect(found, F.array(*(F.lit(h).cast("long") for h in sorted(few))))
        met.append(hay.select("doc_id", F.explode(found).alias("h")).join(own, "h").select("item_id", "doc_id"))
    return reduce(DataFrame.union, met).distinct() if met else None


def _met_by_characters(hay: DataFrame, short: DataFrame) -> DataFrame:
    """(item_id, doc_id) of the texts that hold the first characters of a passage."""
    sizes = [r["n"] for r in short.select(F.least(F.length("needle"), F.lit(GRAM)).alias("n")).distinct().collect()]

    def grams(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.substring("text", i, F.lit(n)))

    there = hay.select("doc_id", F.explode(F.array_distinct(F.flatten(F.array(*map(grams, sizes))))).alias("g"))
    return there.join(short.select("item_id", F.substring("needle", 1, GRAM).alias("g")), "g").select("item_id", "doc_id")


def find_passages(passages: DataFrame, texts: DataFrame, most_short: int = MOST_SHORT) -> DataFrame:
    """(item_id, doc_id, n) of all pairs with an occurrence. passages: (item_id, text); texts: (doc_id, text)."""
    needles = passages.select("item_id", normalised(F.col("text")).alias("needle")).filter("needle != ''")
    words = F.split("needle", " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    needles = needles.withColumn("inner", inner).withColumn("size", F.least(F.size("inner"), F.lit(RUN)))
    hay = texts.select("doc_id", normalised(F.col("text")).alias("text")).filter("text != ''")
    met, compared = _met_by_words(hay, needles), []
    if met is not None:
        compared.append(met.join(needles.select("item_id", "needle"), "item_id").join(hay, "doc_id"))
    short = needles.filter("size = 0").select("item_id", "needle")
    size = short.limit(most_short + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length("needle")).alias("bytes")).first()
    if 0 < size["n"] <= most_short and size["bytes"] <= 8 << 20:
        compared.append(hay.join(F.broadcast(short), F.col("text").contains(F.col("needle"))).select("doc_id", "item_id", "needle", "text"))
    elif size["n"]:
        near = _met_by_characters(hay, short)
        compared.append(near.join(short, "item_id").join(hay, "doc_id").select("doc_id", "item_id", "needle", "text"))
    if not compared:
        return needles.select("item_id", F.lit(None).cast(texts.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("n")).limit(0)
    found = reduce(DataFrame.unionByName, compared).filter(F.col("text").contains(F.col("needle")))
    return found.select("item_id", "doc_id", occurrences(F.col("text"), F.col("needle")).alias("n"))


def anchor_status(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, n, status, reason): exact if the passage stands in one place only and no other passage has its words."""
    total = find_passages(passages, texts).groupBy("item_id").agg(F.sum("n").alias("n"))
    named = passages.select("item_id", F.xxhash64(normalised(F.col("text"))).alias("h"))
    twins = named.groupBy("h").agg(F.count("*").alias("twins"))
    n = F.coalesce("n", F.lit(0))
    joined = named.join(twins, "h").join(total, "item_id", "left")
    return joined.select(
        "item_id",
        n.cast("long").alias("n"),
        F.when((n > 1) | ((n == 1) & (F.col("twins") > 1)), "conflict").when(n == 1, "exact").otherwise("unmapped").alias("status"),
        F.when(n > 1, "ambiguous").when((n == 1) & (F.col("twins") > 1), "duplicate_source").when(n == 0, "not_found").alias("reason"),
    )


def coverage(status: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return status.agg(F.count("*").alias("total"), count("exact"), count("degraded"), count("unmapped"), count("conflict"))
