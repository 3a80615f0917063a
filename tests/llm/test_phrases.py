"""op12: phrases and their scores against plain counting in Python integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import collocations as co

from .cases import CLASHING, SCHEMA, odd_rows

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, least, top, longest=4, share=80, scale=2_000_000):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        found = []
        for p, a in count.items():
            if len(p) < 2 or a < least:
                continue
            cuts = [(scale * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            longer = [b for q, b in count.items() if b >= least and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= share * a for b in longer):
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found(spark, rows, least, top, **how):
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    got = co.collocations(df, least=least, top=top, **how)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()))


def prose(seed, texts=60):
    rng = random.Random(seed)
    words = "new york city is of the and a THE é 中文 big-apple | x1".split()
    rows = []
    for _ in range(texts):
        parts = []
        for _ in range(rng.randrange(30)):
            parts.append("New  York\tCity" if rng.random() < 0.2 else rng.choice(words))
            parts.append(rng.choice([" ", " ", " ", " \t", ", ", ".", "\n", "\r\n", "\x0b", "; "]))
        rows.append(("".join(parts), rng.choice(["en", "en", "fr", None, "und"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_phrases_against_plain_counts(spark, seed):
    rows = prose(seed)
    assert found(spark, rows, 3, 5) == plain(rows, 3, 5)
    assert found(spark, rows, 3, 2000) == plain(rows, 3, 2000)


def test_odd_texts(spark):
    rows = [(r["text"], r["lang"]) for r in odd_rows()] + [("a a a a a a. a a", "en"), (" . , ", "en"), (None, "fr"), ("", None)] * 3
    assert found(spark, rows, 2, 50) == plain(rows, 2, 50)
    assert found(spark, [], 2, 50) == []


def test_clashing_names_and_long_text(spark):
    rows = prose(5) + [(" ".join(random.Random(1).choices("abcdef", k=30_000)), "en")]
    df = spark.createDataFrame([(i, t, x, None, 0) for i, (t, x) in enumerate(rows)], SCHEMA)
    df = df.withColumns({c: F.lit("x") for c in {*CLASHING, *COLUMNS[1:], "f", "w", "cut", "part"}})
    assert sorted(map(tuple, co.collocations(df, least=3, top=40).collect())) == plain(rows, 3, 40)


def test_scores_beyond_64_bits(spark):
    big = 10**15
    level = [spark.createDataFrame(rows, "lang string, phrase string, h long, f long") for rows in ([("en", "a", 0, 3 * big + 1), ("en", "b", 0, 2 * big)], [("en", "a b", 0, 2 * big - 1)])]
    totals = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    row = co.scored(level, totals, 80, 2_000_000).first()
    assert row["score"] == 2_000_000 * (2 * big - 1) // (5 * big + 1)


def test_runs_with_one_hash_are_told_apart(monkeypatch):
    """Counting inside a batch doesn't rely on hashes."""
    import pyarrow as pa

    monkeypatch.setattr(co, "mix", lambda h: np.zeros(len(h), np.uint64))
    w = co.Words(pa.record_batch({"text": ["a b a b c"], "lang": ["en"]}))
    at, h = w.runs(2)
    place, n = w.counted(at, h, 2)
    assert sorted(zip(place.tolist(), n.tolist())) == [(0, 2), (1, 1), (3, 1)]
